"""Queries of index maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import index_maintenance as I
from siltstone.plans.common import CHUNKS, chunks, table


def index(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 37).alias("doc_id"))


def incoming(s, d):
    return index(s, d).filter("vec_id % 5 = 0").select((F.col("vec_id") + 250).alias("vec_id"), (F.col("label") + 100).alias("label"), "doc_id")


def contexts(s, d):
    return chunks(s, d).filter("chunk_index % 2 = 0").select("chunk_id", F.concat(F.lit("part "), F.col("chunk_index").cast("string")).alias("context"))


def kinds(s, d):
    kind = F.when(F.col("chunk_index") % 4 == 0, "image").when(F.col("chunk_index") % 4 == 1, "table").when(F.col("chunk_index") % 4 == 2, "code").otherwise("text")
    return chunks(s, d).select("chunk_id", I.multimodal_text(kind, F.col("content"), F.lit(None).cast("string")).alias("text"))


def prepared(s, d):
    """Chunks as pictures and texts, with the chunks before and after them as context."""
    w = W.partitionBy("doc_id").orderBy("chunk_index")
    x = chunks(s, d).select("doc_id", "chunk_id", "chunk_index", "content", F.lag("content").over(w).alias("before"), F.lead("content").over(w).alias("after"))
    kind, n = F.when(F.col("chunk_index") % 4 == 3, "text").otherwise("image"), F.col("chunk_id")
    alt, caption = F.when(n % 3 == 0, "Image").when(n % 3 == 1, F.concat(F.lit("alt "), n.cast("string"))), F.when(n % 5 == 0, F.concat(F.lit("caption "), n.cast("string")))
    return x.select("chunk_id", I.prepare_chunk_text(kind, F.col("content"), alt, caption, F.col("before"), F.col("after"), n % 7 != 0, n % 2 == 0).alias("text"))


QUERIES = {
    "prepare_chunk_text": prepared,
    "update_vectors": lambda s, d: I.upsert(index(s, d), incoming(s, d)),
    "delete_vectors": lambda s, d: I.delete(index(s, d), index(s, d).filter("label = 3")).select("vec_id"),
    "delete_by_doc": lambda s, d: I.delete(index(s, d), index(s, d).filter("doc_id < 5").select("doc_id").distinct(), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("vectors")),
    "contextual_prefix": lambda s, d: I.contextual_prefix(chunks(s, d).select("chunk_id", "content"), contexts(s, d)),
    "multimodal_text": kinds,
    "sanitize_stats": lambda s, d: table(s, d, "events").select("event_id", F.round(I.finite(F.col("value") / F.nullif(F.col("value") - F.floor("value"), F.lit(0.0))), 3).alias("ratio")),
}

IX = "ix AS (SELECT vec_id, label::BIGINT AS label, vec_id % 37 AS doc_id FROM embeddings), nw AS (SELECT vec_id + 250 AS vec_id, label + 100 AS label, doc_id FROM ix WHERE vec_id % 5 = 0)"

ORACLE = {
    "prepare_chunk_text": f"""WITH {CHUNKS}, x AS (SELECT chunk_id AS n, chunk_index, content, lag(content) OVER w AS b, lead(content) OVER w AS a,
  CASE WHEN chunk_id % 3 = 1 THEN 'alt ' || chunk_id END AS alt, CASE WHEN chunk_id % 5 = 0 THEN 'caption ' || chunk_id END AS cap FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
y AS (SELECT *, CASE WHEN n % 2 = 0 THEN concat_ws(chr(10), '图片标题: ' || cap, '图片描述: ' || alt, '前文: ' || right(b, 200), '后文: ' || left(a, 200)) ELSE concat_ws(' ', cap, alt, right(b, 150), left(a, 150)) END AS t FROM x)
SELECT n AS chunk_id, CASE WHEN chunk_index % 4 <> 3 AND n % 7 <> 0 AND t <> '' THEN t ELSE content END AS text FROM y""",
    "update_vectors": f"WITH {IX} SELECT * FROM ix WHERE vec_id NOT IN (SELECT vec_id FROM nw) UNION ALL SELECT * FROM nw",
    "delete_vectors": f"WITH {IX} SELECT vec_id FROM ix WHERE label <> 3",
    "delete_by_doc": f"WITH {IX} SELECT label, count(*) AS vectors FROM ix WHERE doc_id >= 5 GROUP BY label",
    "contextual_prefix": f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN 'part ' || chunk_index || chr(10) || content ELSE content END AS content FROM chunks",
    "multimodal_text": f"WITH {CHUNKS} SELECT chunk_id, CASE chunk_index % 4 WHEN 0 THEN '[图片] ' || substring(content, 1, 150) WHEN 1 THEN '[表格] ' || content WHEN 2 THEN '[代码] ' || content ELSE content END AS text FROM chunks",
    "sanitize_stats": "SELECT event_id, round(coalesce(value / nullif(value - floor(value), 0), 0), 3) AS ratio FROM events",
}
