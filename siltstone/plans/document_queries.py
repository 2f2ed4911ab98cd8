"""Queries of page-wise and element-wise chunking, of converted workbooks, of versions and of enhanced queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import hybrid as Y
from siltstone.operators import metadata as M
from siltstone.operators import retrieval as R
from siltstone.plans.common import RUNS, documents, runs, spread, strip_sql, table
from siltstone.sources import sheets as H


def sheet_pages(s, d):
    """A workbook of each customer: a sheet of orders for each status, and one that is blank."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("sheet_name"), "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), F.col("price").cast("string"), F.lit("\n"))
    g = o.groupBy("doc_id", "sheet_name").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    pages = g.select("doc_id", F.ascii("sheet_name").alias("page_number"), "sheet_name", F.concat(F.lit("Sheet: "), F.col("sheet_name"), F.lit("\nkey\tprice\n"), F.array_join(F.col("l.line"), "")).alias("text"))
    return pages.unionByName(g.select("doc_id", F.lit(75).alias("page_number"), F.lit("blank").alias("sheet_name"), F.lit(" \n ").alias("text")).distinct())


def sheets(s, d):
    x = Y.chunk_sheet_pages(sheet_pages(s, d))
    return x.select("doc_id", "chunk_index", "page_number", "sheet_name", "chunk_type", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "start", "end", "row_count", "column_count", F.array_join("headers", "|").alias("headers"))


def pictured(s, d):
    """Documents with a picture of each form around their text; the last lies inside another."""
    n = F.col("doc_id").cast("string")
    said = F.translate(F.coalesce("text", F.lit("")), "[]<>!`|", "       ")
    return documents(s, d).select("doc_id", F.concat(F.lit("[IMAGE_2:  cat "), n, F.lit("] ![a](u"), n, F.lit(".png)\n"), said, F.lit("\n<IMG class=x src='v"), n, F.lit(".gif'> ![](w.jpg) [IMAGE_1: see ![b](c)]")).alias("text"))


def images(s, d):
    x = Y.extract_elements(pictured(s, d), "image")
    known = documents(s, d).select("doc_id", F.lit(1).alias("image_index"), F.when(F.col("doc_id") % 2 == 0, "a cat").alias("alt_text"), F.lit("caption").alias("caption"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".webp")).alias("file_path"), F.lit(None).cast("string").alias("mime_type"))
    return Y.with_pictures(x, known.filter("doc_id % 3 = 0")).select("doc_id", "chunk_index", "content", "start", "alt", "source", "number", "format")


def coded(s, d):
    """Documents as code blocks of two, three and four lines."""
    body = F.translate(F.coalesce("text", F.lit("")), "`\n\r", "   ")
    return spread(documents(s, d)).select("doc_id", F.concat(F.lit("# Head\n```py\na = 1\nb = 2\n```\nbetween\n```\nx\n"), body, F.lit("\n.z\n```\n```sql\nselect\n1\n2\n3\n```")).alias("text"))


def code(s, d):
    return Y.extract_elements(coded(s, d), "code").select("doc_id", "chunk_index", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "language", "row_count", "section_title")


def books(s, d):
    """Converted workbooks: names in one of four places, and as many tables, gaps or paragraphs as it happens to be."""
    b = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 5).alias("k"))
    named = F.to_json(F.struct(F.array(F.struct(F.lit("sheet: One").alias("name")), F.struct(F.lit("Sheet:Two").alias("name")), F.struct(F.lit("other").alias("name"))).alias("groups")))
    answer = F.when(F.col("k") == 0, F.concat(F.lit('{"json_content": '), named, F.lit("}"))).when(F.col("k") == 1, named).when(F.col("k") == 2, F.lit('{"sections": [{"type": "Sheet", "title": "One"}, {"title": "sheet: Two"}]}')).otherwise(F.lit("{}"))
    n = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit("|a|\n|"), n, F.lit("|\n\n|b|\n|2|\n"))).when(F.col("k") == 1, F.concat(F.lit("one "), n, F.lit("\n\n\ntwo\n\nmore")))
        .when(F.col("k") == 2, F.concat(F.lit("p\n\nq\n\nr "), n)).when(F.col("k") == 3, F.concat(F.lit("## Sheet: Only\ntext "), n)).otherwise(F.lit("no sheets"))
    )
    return b.select("doc_id", answer.alias("answer"), text.alias("text"))


def versioned(s, d):
    """Versions of every document's and model's runs with an even id, numbered by time, with the whole milliseconds as chunk size."""
    x = runs(s, d).filter("result_id % 2 = 0").withColumnRenamed("model", "strategy")
    v = M.versions(x, ["document_id", "strategy"])
    return v.select("document_id", "strategy", "result_id", size(v).alias("params"), "version", "previous_id", "is_active")


def size(df):
    return F.create_map(F.lit("chunk_size"), F.floor(df["processing_time_ms"]).cast("string"))


def activated(s, d):
    before = versioned(s, d)
    asked = before.filter("result_id % 14 = 0").select("result_id", F.lit(1).alias("turn"))
    after = M.activate(before, asked)
    return after.select("result_id", "version", F.col("is_active")).join(before.select("result_id", F.col("is_active").alias("was_active")), "result_id")


def saved(s, d):
    """Of each document and model the latest run with an odd id is saved over the versions of the others."""
    x = M.latest_per(runs(s, d).filter("result_id % 2 = 1"), ["document_id", "model"]).withColumnRenamed("model", "strategy")
    return M.save_versions(versioned(s, d), x.select("document_id", "strategy", "result_id", size(x).alias("params"))).drop("params")


def answers(s, d):
    """What a model might have answered on every benchmark item: complex, fenced, broken, no object, empty, nothing."""
    q, k = F.col("query"), F.col("query_id") % 6
    item = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    full = F.to_json(F.struct(F.concat(F.lit(" "), q, F.lit(" x")).alias("rewritten_query"), F.lit(True).alias("is_complex")))
    full = F.concat(F.substring(full, F.lit(1), F.length(full) - 1), F.lit(', "sub_queries": ["a", " ", 5, "b ", null]}'))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("new "), q).alias("rewritten_query"), F.lit(False).alias("is_complex"), F.array(F.lit("s")).alias("sub_queries"))), F.lit("\n```"))
    out = F.when(k == 0, full).when(k == 1, fenced).when(k == 2, F.concat(F.lit("{broken "), q)).when(k == 3, F.lit("[1]")).when(k == 4, F.lit('{"rewritten_query": "", "is_complex": 1, "sub_queries": "no"}'))
    return item.select("query_id", "query", out.alias("answer"))


def enhanced(s, d):
    e = answers(s, d).select("query_id", R.parse_enhancement(F.col("answer"), F.col("query")).alias("e"))
    return e.select("query_id", "e.rewritten", "e.is_complex", F.array_join("e.sub_queries", "|").alias("sub_queries"), F.array_join("e.all_queries", "|").alias("all_queries"), "e.parsed")


QUERIES = {
    "chunk_sheet_pages": sheets,
    "extract_images": images,
    "extract_code_md": code,
    "split_excel_by_sheets": lambda s, d: H.split_excel_by_sheets(books(s, d)),
    "activate_version": activated,
    "save_version": saved,
    "enhance_query_parse": enhanced,
}

PAGES = """g AS (SELECT o_custkey AS doc_id, o_orderstatus AS sheet_name, ascii(o_orderstatus) AS page_number, count(*) AS n,
  'Sheet: ' || o_orderstatus || chr(10) || 'key' || chr(9) || 'price' || chr(10) || string_agg(o_orderkey || chr(9) || o_totalprice::DECIMAL(15, 2) || chr(10), '' ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey, o_orderstatus),
p AS (SELECT doc_id, page_number, sheet_name, text, n FROM g UNION ALL SELECT DISTINCT doc_id, 75, 'blank', ' ' || chr(10) || ' ', NULL FROM g),
o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM p)"""
TEXT = "translate(coalesce(text, ''), '[]<>!`|', '       ')"
VERSIONS = f"""{RUNS}, v AS (SELECT document_id, model AS strategy, result_id, floor(processing_time_ms)::BIGINT AS size, row_number() OVER w AS version, lag(result_id) OVER w AS previous_id, lead(result_id) OVER w IS NULL AS is_active
  FROM runs WHERE result_id % 2 = 0 WINDOW w AS (PARTITION BY document_id, model ORDER BY created_at, result_id))"""

ORACLE = {
    "chunk_sheet_pages": f"""WITH {PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS chunk_index, page_number, sheet_name, 'table' AS chunk_type, md5(text) AS content_md5, "start", "start" + length(text) AS "end",
  n + 1 AS row_count, 2::BIGINT AS column_count, 'key|price' AS headers FROM o WHERE sheet_name <> 'blank'""",
    "extract_images": f"""WITH x AS (SELECT doc_id, length({TEXT})::BIGINT AS n, length(doc_id::VARCHAR)::BIGINT AS k, doc_id % 3 = 0 AS known FROM documents),
i AS (SELECT doc_id, known, 0 AS o, 0::BIGINT AS s, 'cat ' || doc_id AS alt, NULL AS source, 1 AS number, NULL AS form FROM x
UNION ALL SELECT doc_id, known, 1, 17 + k, 'a', 'u' || doc_id || '.png', NULL, 'png' FROM x
UNION ALL SELECT doc_id, known, 2, 17 + k + 12 + k + n + 1, '', 'v' || doc_id || '.gif', NULL, 'gif' FROM x
UNION ALL SELECT doc_id, known, 3, 17 + k + 12 + k + n + 1 + 26 + k, '', 'w.jpg', NULL, 'jpg' FROM x
UNION ALL SELECT doc_id, known, 4, 17 + k + 12 + k + n + 1 + 26 + k + 11, 'see ![b', NULL, 0, NULL FROM x)
SELECT doc_id, o::BIGINT AS chunk_index, CASE WHEN number = 1 AND known THEN '[Image: ' || CASE WHEN doc_id % 2 = 0 THEN 'a cat' ELSE 'caption' END || ']' ELSE '[Image: ' || CASE WHEN alt <> '' THEN alt ELSE source END || ']' END AS content, s AS "start",
  CASE WHEN number = 1 AND known THEN CASE WHEN doc_id % 2 = 0 THEN 'a cat' ELSE 'caption' END ELSE alt END AS alt, CASE WHEN number = 1 AND known THEN '/img/' || doc_id || '.webp' ELSE source END AS source, number::BIGINT AS number, CASE WHEN number = 1 AND known THEN 'webp' ELSE form END AS format FROM i""",
    "extract_code_md": r"""WITH x AS (SELECT doc_id, 'x' || chr(10) || translate(coalesce(text, ''), '`' || chr(10) || chr(13), '   ') || chr(10) || '.z' AS c FROM documents)
SELECT doc_id, 0::BIGINT AS chunk_index, md5(c) AS content_md5, 'text' AS language, 3::BIGINT AS row_count, '# Head' AS section_title FROM x
UNION ALL SELECT doc_id, 1, md5('select' || chr(10) || '1' || chr(10) || '2' || chr(10) || '3'), 'sql', 4, '# Head' FROM x""",
    "split_excel_by_sheets": """WITH x AS (SELECT doc_id, doc_id % 5 AS k FROM documents),
t AS (SELECT doc_id, 1 AS page_number, 'One' AS sheet_name, CASE k WHEN 0 THEN '|a|' || chr(10) || '|' || doc_id || '|' WHEN 1 THEN 'one ' || doc_id ELSE 'p' || chr(10) || chr(10) || 'q' END AS text, CASE k WHEN 0 THEN 1 ELSE 0 END AS more FROM x WHERE k < 3
UNION ALL SELECT doc_id, 2, 'Two', CASE k WHEN 0 THEN '|b|' || chr(10) || '|2|' WHEN 1 THEN 'two' || chr(10) || chr(10) || 'more' ELSE 'r ' || doc_id END, CASE k WHEN 0 THEN 1 ELSE 0 END FROM x WHERE k < 3
UNION ALL SELECT doc_id, 1, 'Only', '## Sheet: Only' || chr(10) || 'text ' || doc_id, 0 FROM x WHERE k = 3)
SELECT doc_id, page_number, sheet_name, text, (length(text) + more)::BIGINT AS char_count FROM t""",
    "activate_version": f"""WITH {VERSIONS}, a AS (SELECT document_id, strategy, max(result_id) AS chosen FROM v WHERE result_id % 14 = 0 GROUP BY ALL)
SELECT result_id, version, is_active AS was_active, CASE WHEN chosen IS NULL THEN is_active ELSE result_id = chosen END AS is_active FROM v LEFT JOIN a USING (document_id, strategy)""",
    "save_version": f"""WITH {VERSIONS}, n AS (SELECT document_id, strategy, result_id AS new_id, size AS new_size FROM (SELECT document_id, model AS strategy, result_id, floor(processing_time_ms)::BIGINT AS size,
  row_number() OVER (PARTITION BY document_id, model ORDER BY created_at DESC, result_id DESC) AS r FROM runs WHERE result_id % 2 = 1) WHERE r = 1),
c AS (SELECT n.*, v.result_id AS old_id, v.version AS old_version, v.previous_id AS old_previous, v.size = n.new_size OR v.size <> 0 AND abs(n.new_size - v.size) / v.size::DOUBLE <= 0.2 AS small FROM n LEFT JOIN v ON v.document_id = n.document_id AND v.strategy = n.strategy AND v.is_active)
SELECT v.document_id, v.strategy, v.result_id, v.version, v.previous_id, v.is_active AND c.new_id IS NULL AS is_active FROM v LEFT JOIN c USING (document_id, strategy) WHERE NOT (coalesce(c.small, false) AND v.result_id = c.old_id)
UNION ALL SELECT document_id, strategy, new_id, CASE WHEN small THEN old_version ELSE coalesce(old_version, 0) + 1 END, CASE WHEN small THEN old_previous ELSE old_id END, true FROM c""",
    "enhance_query_parse": f"""WITH x AS (SELECT item_id AS query_id, text AS q, item_id % 6 AS k, {strip_sql("text || ' x'")} AS t FROM benchmark)
SELECT query_id, CASE k WHEN 0 THEN t WHEN 1 THEN {strip_sql("'new ' || q")} ELSE q END AS rewritten, k IN (0, 4) AS is_complex, CASE k WHEN 0 THEN 'a|b' ELSE '' END AS sub_queries,
  CASE k WHEN 0 THEN t || '|a|b' WHEN 1 THEN {strip_sql("'new ' || q")} ELSE q END AS all_queries, k IN (0, 1, 4) AS parsed FROM x""",
}
