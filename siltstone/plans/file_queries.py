"""Queries that write files or tables from the given tables and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.storage import shared_folder
from siltstone.plans.common import RUNS, documents, runs, spread, table
from siltstone.sources import files
from siltstone.sources import loading as L
from siltstone.sources import sinks as K


def stored_results(s, d):
    """The folder with the result files of all runs."""
    path = shared_folder(s, "results")
    name = F.concat(F.lit("embedding_"), F.col("result_id").cast("string"), F.lit("_"), F.date_format("created_at", "yyyyMMdd_HHmmss"), F.lit(".json"))
    body = F.to_json(F.struct(F.col("result_id").alias("request_id"), "status", "model", "successful_count"))
    K.sink_json(spread(runs(s, d)).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), name.alias("file_name"), body.alias("body")), path)
    return path


def written(s, d):
    b = F.from_json("body", "request_id long, status string, model string, successful_count long")
    return K.read_results(s, stored_results(s, d)).select("day", "file_name", b.alias("b")).select("day", "file_name", "b.*")


def newest(s, d):
    return K.list_result_files(s, stored_results(s, d), limit=20).select("day", "place", "file_name", F.get_json_object("body", "$.status").alias("status"))


def dual(s, d):
    """Two writes: the runs with an even id, then the others, which take the place of a document's and model's earlier record."""
    store = K.Publication(s, shared_folder(s, "dual"))
    for odd in (0, 1):
        part = runs(s, d).filter(F.col("result_id") % 2 == odd)
        K.sink_dual_write(store, part.select("result_id", "document_id", "model", "status", "created_at"), part.select("result_id", F.col("processing_time_ms").alias("payload")))
    return store.read("records").select("result_id", "document_id", "model", "status").join(store.read("payloads"), "result_id")


def text_files(s, d):
    """Documents as files in several encodings; one in gbk where its bytes are no UTF-8."""
    x = documents(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.when(F.col("doc_id") % 3 == 0, F.encode(F.translate("text", "\r", ""), "UTF-8")).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("中文 text\n第二行".encode("gbk").hex()))).otherwise(F.concat(F.encode(F.lit("caf"), "UTF-8"), F.unhex(F.lit("E9"))))
    return x.select(F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise("")).alias("path"), body.alias("content"), "doc_id")


def scanned(s, d):
    rows = L.scan_text(text_files(s, d).select("path", "content"))
    return rows.select("path", "format", "encoding", "line_count", "file_size", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def attempts(s, d):
    """Documents as files of several formats, some of them broken."""
    body, n = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    end = F.element_at(F.array(*[F.lit(x) for x in ("txt", "json", "json", "pdf", "docx", "qqq")]), (n + 1).cast("int"))
    content = F.when(n == 1, F.to_json(F.struct(F.lit(1).alias("a"), F.array(F.lit("some text here")).alias("b")))).when(n == 2, "{broken").otherwise(body)
    x = spread(documents(s, d)).select(F.concat(F.lit("/files/f"), F.col("doc_id").cast("string"), F.lit("."), end).alias("path"), F.encode(content, "UTF-8").alias("content"))
    out = L.load_with_fallback(x)
    return out.select("path", "format", "success", "loader", F.length("text").cast("long").alias("chars"), "fallback_used", "error", F.size("attempts").cast("long").alias("attempts"))


def pictures(s, d):
    """Page bodies behind the leading bytes of several picture types."""
    p = table(s, d, "pages")
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "3C68746D6C3E")]), (F.col("page_id") % 5 + 1).cast("int"))
    body = F.concat(F.unhex(head), F.encode(F.repeat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 2 == 0, 1).otherwise(40)), "UTF-8"))
    out = L.image_store_policy(p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), body.alias("content")))
    return out.select("path", "mime", "bytes", "store", F.length("data").cast("long").alias("data_chars"), "file_name")


def uploads(s, d):
    """Documents as files named by their source, the text repeated so that some are too large."""
    end = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".md", ".exe", "", ".tar.gz", ".odt")]), (F.col("doc_id") % 6 + 1).cast("int"))
    x = table(s, d, "documents").select("doc_id", F.concat(F.lit("in/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), end).alias("name"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.when(F.col("doc_id") % 7 == 0, 100_000).when(F.col("doc_id") % 11 == 0, 0).otherwise(1)).alias("size"))
    return x.select("doc_id", files.validate_upload(F.col("name"), F.col("size")).alias("problem"))


def csv_files(s, d):
    """Orders written as CSV files with a header, and read as text."""
    path = shared_folder(s, "csv")
    table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    return files.scan_csv(s, path)


def json_lines(s, d):
    """Orders as nested JSON texts, flattened to a line for each value."""
    body = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 2 == 0).alias("even")).alias("state"), F.array(F.struct(F.col("o_orderpriority").alias("p")), F.struct(F.lit("x y").alias("p"))).alias("list")))
    return files.scan_json_flatten(table(s, d, "orders").select("o_orderkey", body.alias("body")), "body", ["o_orderkey"])


QUERIES = {
    "scan_csv": csv_files,
    "scan_json_flatten": json_lines,
    "validate_upload": uploads,
    "sink_json": written,
    "list_result_files": newest,
    "sink_dual_write": dual,
    "scan_text": scanned,
    "load_with_fallback": attempts,
    "image_store_policy": pictures,
}

NAMED = "'embedding_' || result_id || '_' || strftime(created_at, '%Y%m%d_%H%M%S') || '.json'"
UTF8 = "octet_length(encode(t))"

ORACLE = {
    "scan_csv": "SELECT 'o_orderkey: ' || o_orderkey || ' | o_custkey: ' || o_custkey || ' | o_orderstatus: ' || o_orderstatus || ' | o_orderpriority: ' || o_orderpriority AS text FROM orders",
    "scan_json_flatten": """SELECT o_orderkey, i::BIGINT AS i, CASE i WHEN 0 THEN 'key: ' || o_orderkey WHEN 1 THEN 'state.status: ' || o_orderstatus WHEN 2 THEN 'state.even: ' || CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END WHEN 3 THEN 'list[0].p: ' || o_orderpriority ELSE 'list[1].p: x y' END AS line
FROM orders, (SELECT unnest(range(0, 5)) AS i)""",
    "validate_upload": """WITH x AS (SELECT doc_id, doc_id % 6 AS k, (octet_length(encode(coalesce(text, ''))) * CASE WHEN doc_id % 7 = 0 THEN 100000 WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END)::BIGINT AS size FROM documents)
SELECT doc_id, CASE WHEN k IN (2, 3, 4) THEN 'Unsupported file format: ' || CASE k WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.gz' END WHEN size > 52428800 THEN 'File size exceeds limit: ' || size || ' bytes' WHEN size = 0 THEN 'Empty file not allowed' END AS problem FROM x""",
    "sink_json": f"WITH {RUNS} SELECT strftime(created_at, '%Y-%m-%d') AS day, {NAMED} AS file_name, result_id AS request_id, status, model, successful_count FROM runs",
    "list_result_files": f"WITH {RUNS}, f AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, {NAMED} AS file_name, status FROM runs) SELECT day, place, file_name, status FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY file_name DESC) AS place FROM f) WHERE place <= 20",
    "sink_dual_write": f"""WITH {RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY document_id, model ORDER BY result_id % 2 DESC, created_at DESC, result_id DESC) AS r FROM runs)
SELECT result_id, document_id, model, status, processing_time_ms AS payload FROM l WHERE r = 1""",
    "scan_text": f"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(coalesce(text, ''), chr(13), '') WHEN 1 THEN '中文 text' || chr(10) || '第二行' ELSE 'café' END AS t FROM documents)
SELECT '/files/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS format, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' ELSE 'latin-1' END AS encoding,
  (length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS line_count, CASE doc_id % 3 WHEN 0 THEN {UTF8} WHEN 1 THEN 16 ELSE 4 END::BIGINT AS file_size, md5(t) AS text_md5 FROM x""",
    "load_with_fallback": """WITH x AS (SELECT doc_id, doc_id % 6 AS n, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
y AS (SELECT *, CASE n WHEN 0 THEN 'txt' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'pdf' WHEN 4 THEN 'docx' ELSE 'qqq' END AS format, n = 1 OR n = 0 AND length(t) > 10 AS success FROM x)
SELECT '/files/f' || doc_id || '.' || format AS path, format, success, CASE n WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'none' WHEN 4 THEN 'docx' ELSE 'unknown' END AS loader,
  CASE WHEN success THEN CASE n WHEN 0 THEN length(t) ELSE length('a: 1' || chr(10) || 'b[0]: some text here') END END::BIGINT AS chars, false AS fallback_used,
  CASE WHEN success THEN NULL WHEN n = 3 THEN 'No available loaders for this format' WHEN n = 5 THEN 'Unsupported format: qqq' ELSE 'All parsers failed' END AS error, CASE WHEN n IN (3, 5) THEN 0 ELSE 1 END::BIGINT AS attempts FROM y""",
    "image_store_policy": """WITH x AS (SELECT page_id, page_id % 5 AS n, encode(coalesce(repeat(html, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 40 END), '')) AS t FROM pages),
y AS (SELECT page_id, CASE n WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS mime, CASE n WHEN 0 THEN '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB WHEN 1 THEN '\\xFF\\xD8\\xFF\\xE0'::BLOB WHEN 2 THEN 'GIF89a'::BLOB WHEN 3 THEN 'RIFF\\x00\\x00\\x00\\x00WEBP'::BLOB ELSE '<html>'::BLOB END || t AS b FROM x),
z AS (SELECT *, octet_length(b) AS n, CASE WHEN mime IS NULL THEN 'skip' WHEN octet_length(b) <= 51200 THEN 'inline' ELSE 'file' END AS store FROM y)
SELECT 'p' || page_id AS path, mime, n::BIGINT AS bytes, store, CASE WHEN store = 'inline' THEN 4 * ((n + 2) // 3) END::BIGINT AS data_chars, CASE WHEN store = 'file' THEN sha256(b) || '.' || split_part(mime, '/', 2) END AS file_name FROM z""",
}
