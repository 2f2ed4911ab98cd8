"""Queries of the sources and of heading structure, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltstone.operators import chunking as C
from siltstone.operators import headings as H
from siltstone.operators import hybrid as Y
from siltstone.plans.analysis_queries import MD, markdown
from siltstone.plans.common import spread, strip_sql, table, windows_sql
from siltstone.sources import files, html, office


def pages(s, d):
    return spread(table(s, d, "pages").select("page_id", "html"))


def md(s, d):
    return html.html_to_markdown(pages(s, d)).withColumnRenamed("markdown", "text")


def xml_text(s, d):
    x = table(s, d, "documents").select("doc_id", F.concat(F.lit("<r><a>"), F.translate("text", "<>&", ""), F.lit("</a><b> t </b>u</r>")).alias("xml"))
    return files.scan_xml(x, "xml", ["doc_id"])


def csv_rows(s, d):
    """Orders as CSV lines, parsed again and rendered."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    lines = table(s, d, "orders").select(F.col("o_orderkey").alias("line_key"), F.to_csv(F.struct(*cols)).alias("line"))
    rows = lines.select("line_key", F.from_csv("line", ", ".join(f"{c} string" for c in cols)).alias("r")).select("line_key", "r.*")
    return rows.select("line_key", files.rendered(rows, cols).alias("text"))


def order_pages(s, d):
    """A page for each customer: a picture, and a table of the orders (one customer's orders are few)."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td></tr>"))
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("l"))
    head = F.concat(F.lit('<p>Orders.</p><figure><img src="c'), F.col("page_id").cast("string"), F.lit('.png" alt="Customer" srcset="s.png 1x, l.png 2x" width=9 style="width: 8px; HEIGHT : 7px">by <i>us</i><figcaption>Portrait</figcaption></figure><table><caption>Orders</caption><tr><th>key</th><th>status</th></tr>'))
    return rows.select("page_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["r"]), ""), F.lit("</table><p>End.</p>")).alias("html"))


def headed_pages(s, d):
    """A page for each customer with headings of several levels, one of them empty."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("page_id")).distinct()
    return o.select("page_id", F.concat(F.lit("<h2> First </h2><p>x</p><h1>Customer "), F.col("page_id").cast("string"), F.lit("</h1><h6>deep</h6><h3> </h3><h2>Second <b>part</b></h2>")).alias("html"))


def order_tables(s, d):
    x = html.html_tables(order_pages(s, d))
    return x.select("page_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), "caption")


def order_markdown(s, d):
    """The same tables as Markdown text between two lines."""
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("r")))).alias("l"))
    return rows.select("page_id", F.concat(F.lit("# Orders\n\nAll of them.\n\n| key | status |\n| --- | --- |\n"), F.array_join(F.transform("l", lambda x: x["r"]), "\n"), F.lit("\n\nEnd.")).alias("text"))


def markdown_tables(s, d):
    x = Y.extract_elements(order_markdown(s, d), "table", keep=("page_id",))
    return x.select("page_id", "chunk_index", "content", "start", "end", "section_title", "context_before", "context_after", "row_count", "column_count", F.array_join("headers", "|").alias("headers"))


RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{}"/></Relationships>'
OFFICE = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook_parts(rows: str) -> dict[str, str]:
    return {"xl/workbook.xml": f'<workbook {OFFICE}><sheets><sheet name="orders" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELATIONS.format("worksheets/one.xml"), "xl/worksheets/one.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"}


def document_parts(rows: str) -> dict[str, str]:
    return {"word/document.xml": f"<document><body><p><r><t>Orders.</t></r></p><tbl>{rows}</tbl><p/></body></document>"}


def presentation_parts(rows: str) -> dict[str, str]:
    return {"ppt/presentation.xml": f'<presentation {OFFICE}><sldIdLst><sldId r:id="r1"/></sldIdLst></presentation>', "ppt/_rels/presentation.xml.rels": RELATIONS.format("slides/one.xml"), "ppt/slides/one.xml": f"<sld><cSld><spTree><sp><txBody>{rows}</txBody></sp></spTree></cSld></sld>"}


def order_files(s, d, head, row, parts):
    """An Office file of the orders of each customer (one customer's orders are few)."""
    rows = table(s, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("l"))

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda body: office.zipped(parts(body)))

    return rows.select("page_id", packed(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["r"]), ""))).alias("content"))


def xml_row(before, between, after):
    return F.concat(F.lit(before), F.col("o_orderkey").cast("string"), F.lit(between), F.col("o_orderstatus"), F.lit(after))


def read_orders(s, d, fmt):
    head, row, parts = {
        "xlsx": ('<row><c t="inlineStr"><is><t>key</t></is></c><c t="inlineStr"><is><t>status</t></is></c></row>', xml_row("<row><c><v>", '</v></c><c t="str"><v>', "</v></c></row>"), workbook_parts),
        "docx": ("<tr><tc><p><r><t>key</t></r></p></tc><tc><p><r><t>status</t></r></p></tc></tr>", xml_row("<tr><tc><p><r><t>", "</t></r></p></tc><tc><p><r><t>", "</t></r></p></tc></tr>"), document_parts),
        "pptx": ("<p><r><t>Orders.</t></r></p>", xml_row("<p><r><t>", " </t></r><r><t>", "</t></r></p>"), presentation_parts),
    }[fmt]
    out = office.read_office(order_files(s, d, head, row, parts), fmt, path="page_id")
    return out.select(F.col("path").cast("long").alias("page_id"), "kind", F.col("page_number").cast("long").alias("page_number"), "title", "text", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"))


def tree(s, d):
    return H.heading_parents(H.heading_rows(markdown(s, d)))


QUERIES = {
    "html_to_markdown": lambda s, d: html.html_to_markdown(pages(s, d)),
    "html_text_of_orders": lambda s, d: html.html_plain_text(order_pages(s, d)),
    "html_headings_of_orders": lambda s, d: html.html_headings(headed_pages(s, d)),
    "html_structured_text": lambda s, d: html.html_structured_text(order_pages(s, d)),
    "html_table_to_markdown": lambda s, d: html.html_to_markdown(order_pages(s, d)),
    "html_plain_text": lambda s, d: html.html_plain_text(pages(s, d)),
    "html_headings": lambda s, d: html.html_headings(pages(s, d)),
    "html_h1": lambda s, d: pages(s, d).select("page_id", F.regexp_count("html", F.lit("(?i)<h1[ >]")).cast("long").alias("n")),
    "chunk_heading_pages": lambda s, d: H.sections_or_paragraphs(md(s, d), "page_id"),
    "csv_lines": csv_rows,
    "scan_json_props": lambda s, d: files.scan_json_flatten(table(s, d, "events"), "props", ["event_id"]),
    "scan_xml": xml_text,
    "images_to_placeholders": lambda s, d: files.images_to_placeholders(table(s, d, "documents").select("doc_id", F.concat(F.lit("![no "), F.col("doc_id").cast("string"), F.lit("](a(b)/c.png) "), "text", F.lit("![](d.png)")).alias("text"))),
    "scan_docx": lambda s, d: read_orders(s, d, "docx"),
    "scan_xlsx": lambda s, d: read_orders(s, d, "xlsx"),
    "scan_pptx": lambda s, d: read_orders(s, d, "pptx"),
    "scan_properties": lambda s, d: files.scan_properties(table(s, d, "documents").filter("text LIKE '%=%' OR text LIKE '%:%'").select("doc_id", "text"), "text", ["doc_id"]),
    "extraction_quality": lambda s, d: table(s, d, "documents").select("doc_id", files.extraction_quality(F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("fast"), F.col("text").contains("|"), F.col("doc_id") % 2 == 0, F.length("text") < 50).alias("quality")),
    "detect_headings": lambda s, d: H.heading_rows(markdown(s, d)),
    "heading_sections": lambda s, d: H.sections(markdown(s, d)),
    "merge_short_sections": lambda s, d: H.merge_short_sections(H.sections(markdown(s, d))),
    "chunk_hybrid": lambda s, d: Y.chunk_hybrid(md(s, d), keep=("page_id",)),
    "extract_tables_md": markdown_tables,
    "html_tables": order_tables,
    "html_images": lambda s, d: html.html_images(order_pages(s, d)).withColumn("srcset", F.array_join(F.transform("srcset", lambda x: F.concat_ws(" ", x["url"], x["descriptor"])), ",")),
    "chunk_heading": lambda s, d: H.sections_or_paragraphs(markdown(s, d)),
    "chunk_heading_or_paragraph": lambda s, d: H.sections_or_paragraphs(markdown(s, d), least=0),
    "heading_path": lambda s, d: H.heading_paths(H.heading_rows(markdown(s, d))).select("doc_id", "seq", "path"),
    "heading_tree": tree,
    "inject_heading_path": lambda s, d: H.inject_paths(C.chunk_character(markdown(s, d)), H.heading_rows(markdown(s, d))),
    "group_by_level": lambda s, d: H.heading_rows(markdown(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
}

HR = rf"""{MD}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM md),
lp AS (SELECT doc_id, line, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ln),
h AS (SELECT doc_id, start, length(regexp_extract(line, '^(#{{1,6}})', 1))::BIGINT AS level, {strip_sql("regexp_extract(line, '^#{1,6}[ " + chr(92) + "t]+(.+)$', 1)")} AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM lp WHERE regexp_matches(line, '^#{{1,6}}[ \t]+.+$')),
up AS (SELECT a.doc_id, a.seq, b.seq AS anc, b.level AS alv, b.title AS atitle FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.seq <= a.seq AND (b.seq = a.seq OR b.level < a.level)
  WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.seq > b.seq AND c.seq <= a.seq AND c.level <= b.level AND b.seq <> a.seq)),
hp AS (SELECT doc_id, seq, string_agg(atitle, ' > ' ORDER BY alv) AS path FROM up GROUP BY ALL)"""

SQL_SECTION = "STRUCT(level BIGINT, title VARCHAR, path VARCHAR, start BIGINT, content VARCHAR, merged VARCHAR[])"


def pure_sql(x: str) -> str:
    return rf"coalesce(list_sum(list_transform(list_filter(list_transform(string_split({x}, chr(10)), lambda y: {strip_sql('y')}), lambda y: y <> '' AND NOT regexp_matches(y, '^#{{1,6}}[ \t\n\r\f\x0B]+')), lambda y: length(y))), 0)"


def joined_sql(a: str, b: str) -> str:
    return f"{{level: least({a}.level, {b}.level), title: {a}.title, path: {a}.path, start: {a}.start, content: {a}.content || chr(10) || chr(10) || {b}.content, merged: list_append({a}.merged, {b}.title)}}"


def closed_sql(done: str, cur: str) -> str:
    return f"CASE WHEN {pure_sql(cur + '.content')} < 100 AND len({done}) > 0 AND {cur}.level > {done}[-1].level THEN list_append({done}[1:len({done}) - 1], {joined_sql(done + '[-1]', cur)}) ELSE list_append({done}, {cur}) END"


def office_sql(text: str, page: str, title: str, table: bool) -> str:
    """SQL of `read_orders`: page, document and table rows from an aggregate `text` of one customer's orders."""
    return f"""WITH t AS (SELECT o_custkey AS page_id, count(*) AS n, {text} AS text FROM orders GROUP BY 1)
SELECT page_id, 'page' AS kind, 1::BIGINT AS page_number, {title} AS title, {page} AS text, NULL AS headers, NULL::BIGINT AS n_rows FROM t
UNION ALL SELECT page_id, 'document', NULL, NULL, text, NULL, NULL FROM t""" + (f" UNION ALL SELECT page_id, 'table', 1, {title}, NULL, 'key|status', n FROM t" if table else "")


ORACLE = {
    "images_to_placeholders": "SELECT doc_id, '[IMAGE_1: no ' || doc_id || '] ' || text || '[IMAGE_2: 图片]' AS text FROM documents",
    "scan_docx": office_sql("'Orders.' || chr(10) || chr(10) || '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey)", "text", "NULL", True),
    "scan_xlsx": office_sql("'Sheet: orders' || chr(10) || 'key' || chr(9) || 'status' || chr(10) || string_agg(o_orderkey || chr(9) || o_orderstatus || chr(10), '' ORDER BY o_orderkey)", "text", "'orders'", True),
    "scan_pptx": office_sql("'Slide 1:' || chr(10) || 'Orders.' || chr(10) || string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey)", "substring(text, 10)", "NULL", False),
    "scan_xml": f"SELECT doc_id, concat_ws(chr(10), nullif({strip_sql("translate(text, '<>&', '')")}, ''), 't', 'u') AS text, 3::BIGINT AS elements FROM documents",
    "html_text_of_orders": """SELECT o_custkey AS page_id, concat_ws(chr(10), 'Orders.', 'by', 'us', 'Portrait', 'Orders', 'key', 'status', string_agg(o_orderkey || chr(10) || o_orderstatus, chr(10) ORDER BY o_orderkey), 'End.') AS text FROM orders GROUP BY 1""",
    "html_headings_of_orders": """WITH t AS (SELECT DISTINCT o_custkey AS page_id FROM orders) SELECT page_id, 0::BIGINT AS i, 1::BIGINT AS level, 'Customer ' || page_id AS text FROM t UNION ALL SELECT page_id, 1, 2, 'First' FROM t UNION ALL SELECT page_id, 2, 2, 'Secondpart' FROM t UNION ALL SELECT page_id, 3, 6, 'deep' FROM t""",
    "html_structured_text": """SELECT o_custkey AS page_id, concat_ws(chr(10), 'Orders.', '', '', '[IMAGE_1: Portrait]', '', 'by', 'us', 'Portrait', 'Orders', 'key', 'status', string_agg(o_orderkey || chr(10) || o_orderstatus, chr(10) ORDER BY o_orderkey), 'End.', '') AS text FROM orders GROUP BY 1""",
    "html_table_to_markdown": """SELECT o_custkey AS page_id, concat_ws(chr(10), 'Orders.', '', '[IMAGE_1: Portrait]', '', 'by', '*us*', 'Portrait', '', '| key | status |', '| --- | --- |', string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey), '', 'End.') AS markdown FROM orders GROUP BY 1""",
    "html_tables": "SELECT o_custkey AS page_id, 'key|status' AS headers, string_agg(o_orderkey || '|' || o_orderstatus, ';' ORDER BY o_orderkey) AS rows, 'Orders' AS caption FROM orders GROUP BY 1",
    "html_images": "SELECT DISTINCT o_custkey AS page_id, 'c' || o_custkey || '.png' AS src, 'Customer' AS alt, 'Portrait' AS caption, '9' AS width, '7px' AS height, 's.png 1x,l.png 2x' AS srcset, 'image/png' AS mime, false AS is_base64, '' AS before, 'by us Portrait' AS after FROM orders",
    "extract_tables_md": """WITH t AS (SELECT o_custkey AS page_id, count(*) AS n, '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY 1)
SELECT page_id, 0::BIGINT AS chunk_index, content, 24::BIGINT AS start, (24 + length(content))::BIGINT AS "end", '# Orders' AS section_title, '' AS context_before, 'End.' AS context_after, n AS row_count, 2::BIGINT AS column_count, 'key|status' AS headers FROM t""",
    "html_h1": "SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]'))::BIGINT AS n FROM pages",
    "csv_lines": "SELECT o_orderkey AS line_key, 'o_orderkey: ' || o_orderkey || ' | o_custkey: ' || o_custkey || ' | o_orderstatus: ' || o_orderstatus || ' | o_orderpriority: ' || o_orderpriority AS text FROM orders",
    "extraction_quality": "SELECT doc_id, CASE WHEN length(text) < 50 THEN 0 ELSE round(least(1, CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.6 END + CASE WHEN contains(text, '|') THEN 0.05 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.02 ELSE 0 END), 6) END::DOUBLE AS quality FROM documents",
    "scan_properties": rf"""WITH l AS (SELECT doc_id, i, {strip_sql('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE contains(text, '=') OR contains(text, ':')))
SELECT doc_id, i AS line_no, {strip_sql("substring(line, 1, p - 1)")} AS key, {strip_sql("substring(line, p + 1)")} AS value, sep FROM (SELECT *, CASE WHEN contains(line, '=') THEN '=' ELSE ':' END AS sep, strpos(line, CASE WHEN contains(line, '=') THEN '=' ELSE ':' END) AS p FROM l WHERE line <> '' AND NOT regexp_matches(line, '^[#!]') AND regexp_matches(line, '[=:]'))""",
    "detect_headings": f"WITH {HR} SELECT doc_id, start, level, title, seq FROM h",
    "heading_path": f"WITH {HR} SELECT doc_id, seq, path FROM hp",
    "heading_sections": f"""WITH {HR}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(start) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM h)
SELECT n.doc_id, n.seq - 1 AS chunk_index, level, title, path, start, {strip_sql('substring(text, (start + 1)::BIGINT, (coalesce(nx, length(text)) - start)::BIGINT)')} AS content FROM n JOIN md ON md.doc_id = n.doc_id JOIN hp ON hp.doc_id = n.doc_id AND hp.seq = n.seq WHERE n.n >= 2""",
    "merge_short_sections": f"""WITH {HR}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(start) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM h),
s AS (SELECT n.doc_id, n.seq, level, title, path, start, {strip_sql('substring(text, (start + 1)::BIGINT, (coalesce(nx, length(text)) - start)::BIGINT)')} AS content FROM n JOIN md ON md.doc_id = n.doc_id JOIN hp ON hp.doc_id = n.doc_id AND hp.seq = n.seq WHERE n.n >= 2),
e AS (SELECT doc_id, list({{done: []::{SQL_SECTION}[], cur: {{level: level, title: title, path: path, start: start, content: content, merged: []::VARCHAR[]}}::{SQL_SECTION}}} ORDER BY seq) AS e FROM s GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(e, lambda a, b: CASE WHEN {pure_sql('a.cur.content')} < 100 AND b.cur.level > a.cur.level
  THEN {{done: a.done, cur: {joined_sql('a.cur', 'b.cur')}}} ELSE {{done: {closed_sql('a.done', 'a.cur')}, cur: b.cur}} END) AS r FROM e),
c AS (SELECT doc_id, {closed_sql('r.done', 'r.cur')} AS l FROM r),
u AS (SELECT doc_id, unnest(l) AS c, unnest(range(0, len(l))) AS chunk_index FROM c)
SELECT doc_id, chunk_index, c.level, c.title, c.path, c.start, c.content, array_to_string(c.merged, ' > ') AS merged_headings FROM u""",
    "inject_heading_path": f"""WITH {HR}, tr AS (SELECT doc_id, seq, list(atitle ORDER BY alv) AS l FROM up GROUP BY ALL), c AS ({windows_sql(500, 450, source="md")}),
m AS (SELECT c.doc_id, c.chunk_index, max(h.seq) AS seq FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.start <= c.start GROUP BY ALL)
SELECT m.doc_id, m.chunk_index, coalesce(array_to_string(l, ' > '), '') AS path, l[-1] AS section_title, l[-2] AS parent_heading FROM m LEFT JOIN tr ON tr.doc_id = m.doc_id AND tr.seq = m.seq""",
    "heading_tree": f"WITH {HR} SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY ALL",
    "group_by_level": f"WITH {HR} SELECT level, count(*) AS n FROM h GROUP BY level",
}
