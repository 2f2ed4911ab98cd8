"""Queries over the engine's own tables, with their SQL. Events, documents, labels and conversations stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import metadata as M
from siltstone.plans.common import CHUNKS, RUNS, chunks, documents, runs, table

NOW = "2024-01-20 00:00:00"


def docs(s, d):
    return table(s, d, "documents")


def labels(s, d):
    return table(s, d, "labels")


def hashes(s, d, edited: bool = False):
    """Chunk hashes; in the edited state every 7th chunk has another text, every 11th is gone and documents divisible by 13 are new."""
    c = chunks(s, d)
    if edited:
        c = c.filter("chunk_id % 11 <> 0").withColumn("content", F.when(F.col("chunk_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    else:
        c = c.filter("doc_id % 13 <> 0")
    return c.select("chunk_id", T.content_hash(F.col("content")).alias("hash"))


def changes(s, d):
    return M.detect_changes(hashes(s, d), hashes(s, d, True))


def cached(s, d):
    """A cache of all documents' hashes, each last used on one of the twenty days before NOW."""
    used = F.expr("timestamp'2024-01-01' + make_dt_interval(cast(doc_id * 7919 % 20 as int))")
    c = documents(s, d).select("doc_id", T.content_hash(F.col("text")).alias("full_hash"), used.alias("last_accessed"))
    return c.groupBy("full_hash").agg(F.max("last_accessed").alias("last_accessed"), F.min("doc_id").alias("vector")).select(F.concat(F.substring("full_hash", 8, 16), F.lit(":m")).alias("cache_key"), "full_hash", "last_accessed", "vector")


def looked_up(s, d):
    w = documents(s, d).select(F.col("doc_id").alias("input_index"), T.content_hash(F.col("text")).alias("full_hash")).withColumn("cache_key", F.concat(F.substring("full_hash", 8, 16), F.lit(":m")))
    return M.cache_lookup(w, cached(s, d), F.lit(NOW).cast("timestamp"))


def statuses(s, d):
    r = runs(s, d)
    return r.groupBy("document_id").agg(F.sum("successful_count").alias("ok"), F.sum("failed_count").alias("bad")).select("document_id", M.status_of(F.col("ok"), F.col("bad")).alias("status"))


def progress(s, d):
    x = looked_up(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("cached"))
    done = F.col("total") - F.col("cached")
    return x.select("total", "cached", F.round(done * 100.0 / F.col("total"), 2).alias("percent"), F.round(F.col("cached") / F.col("total"), 6).alias("hit_rate"))


def uploads(s, d):
    e = table(s, d, "events").groupBy((F.col("user_id")).alias("session_id")).agg(F.array_sort(F.collect_set((F.col("event_id") % 12 + 1).cast("long"))).alias("parts"))
    return e.withColumn("total", F.lit(12).cast("long"))


def compare_runs(s, d):
    ids = [1, 5, 9, 77_777_777]
    want = s.createDataFrame([(i,) for i in ids], "result_id long")
    return want.join(runs(s, d), "result_id", "left").select("result_id", F.col("status").isNull().alias("missing"), "status", "processing_time_ms")


def min_by_spread(s, d):
    st = chunks(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("char_count") - F.min("char_count")).alias("spread"))
    return st.agg(F.min_by("doc_id", F.struct("spread", "doc_id")).alias("most_even"), F.min_by("doc_id", F.struct("n", "doc_id")).alias("fewest"))


def props(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.json_object_keys("props").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.array_join("k", ",").alias("keys"), "n")


def latency(s, d):
    v = F.col("processing_time_ms")
    b = F.when(v < 10, "0-10").when(v < 50, "10-50").when(v < 100, "50-100").when(v < 500, "100-500").otherwise("500-")
    return runs(s, d).filter("processing_time_ms > 0").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))




def parameter_changes(s, d):
    """Every chunk count of a document against the next document's, as parameters."""
    n = chunks(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    b = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    return n.join(b, "doc_id").select("doc_id", M.parameter_change(F.create_map(F.lit("chunk_size"), "n"), F.create_map(F.lit("chunk_size"), "m")).alias("change"))


count = lambda: F.count(F.lit(1)).alias("n")

QUERIES = {
    "filter_conjunctive": lambda s, d: M.filter_runs(runs(s, d), model="click", status="SUCCESS", since="2024-01-05", until="2024-01-15").select("result_id", "document_id"),
    "filter_like": lambda s, d: docs(s, d).filter(F.col("source").like("src1%")).select("doc_id", "source"),
    "filter_ilike": lambda s, d: docs(s, d).filter(F.col("text").ilike("%THIS WORK IS%")).select("doc_id"),
    "filter_in": lambda s, d: docs(s, d).filter(F.col("lang").isin("fr", "es")).select("doc_id", "lang"),
    "filter_or_of_ands": lambda s, d: runs(s, d).filter(((F.col("model") == "click") & (F.col("status") == "FAILED")) | ((F.col("model") == "view") & (F.col("status") == "SUCCESS"))).select("result_id"),
    "inner_join": lambda s, d: docs(s, d).select("doc_id", "lang").join(runs(s, d), F.col("doc_id") == F.col("document_id")).groupBy("lang", "status").agg(count()),
    "three_way_join": lambda s, d: docs(s, d).select("doc_id", "source").join(labels(s, d), "doc_id").join(runs(s, d).withColumnRenamed("document_id", "doc_id"), "doc_id").groupBy("source", "quality").agg(count()),
    "left_anti_orphans": lambda s, d: runs(s, d).join(docs(s, d).select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").select("result_id"),
    "not_exists": lambda s, d: docs(s, d).select("doc_id").join(labels(s, d).select("doc_id"), "doc_id", "left_anti"),
    "semi_join": lambda s, d: docs(s, d).select("doc_id").join(labels(s, d).filter("toxic = 1").select("doc_id"), "doc_id", "left_semi"),
    "latest_per_group": lambda s, d: M.latest_per(runs(s, d), ["document_id", "model"]).select("document_id", "model", "result_id", "status"),
    "latest_one": lambda s, d: runs(s, d).orderBy(F.desc("created_at"), F.desc("result_id")).limit(1).select("result_id", "status"),
    "parent_lookup": lambda s, d: chunks(s, d).select("chunk_id", "doc_id").join(docs(s, d).select("doc_id", "source"), "doc_id", "left"),
    "group_count": lambda s, d: runs(s, d).groupBy("status", "model").agg(count()),
    "group_multi_agg": lambda s, d: M.run_statistics(runs(s, d), "model").withColumn("max_ms", F.round("max_ms", 6)).withColumn("min_ms", F.round("min_ms", 6)),
    "having_duplicates": lambda s, d: M.duplicates_to_drop(runs(s, d), ["document_id", "model", "status"]).select("result_id"),
    "max_version_plus_1": lambda s, d: M.next_version(M.versions(runs(s, d), ["document_id", "model"]), ["document_id", "model"]),
    "versions": lambda s, d: M.versions(runs(s, d), ["document_id", "model"]).select("result_id", "version", "previous_id", "is_active"),
    "parameter_change": parameter_changes,
    "distinct": lambda s, d: docs(s, d).join(runs(s, d).withColumnRenamed("document_id", "doc_id"), "doc_id").select("source", "model").distinct(),
    "sort_page": lambda s, d: M.sorted_page(runs(s, d), "processing_time_ms", True, 3, 20).select("result_id", "total"),
    "compare_results": min_by_spread,
    "compare_runs": compare_runs,
    "delete_by_predicate": lambda s, d: runs(s, d).agg(F.count_if(F.col("created_at") < F.lit("2024-01-10").cast("timestamp")).alias("would_delete"), count()),
    "queue_statistics": lambda s, d: runs(s, d).groupBy("status").agg(count(), F.count_distinct("document_id").alias("documents")),
    "age_cleanup": lambda s, d: runs(s, d).filter(F.col("status").isin("SUCCESS", "FAILED") & (F.col("created_at") < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))).select("result_id"),
    "missing_parts": lambda s, d: M.missing_parts(uploads(s, d)),
    "list_by_document": lambda s, d: M.versions(runs(s, d), ["document_id"]).select("document_id", "result_id", (~F.col("is_active")).alias("deletable")),
    "text_length_stats": lambda s, d: docs(s, d).groupBy("source").agg(F.round(F.avg(F.length("text")), 6).alias("avg_len"), F.min(F.length("text")).cast("long").alias("min_len"), F.max(F.length("text")).cast("long").alias("max_len")),
    "content_hash": lambda s, d: documents(s, d).select("doc_id", T.content_hash(F.col("text")).alias("hash")),
    "cache_key": lambda s, d: documents(s, d).select("doc_id", F.concat(F.substring(T.content_hash(F.col("text")), 8, 16), F.lit(":bge-m3")).alias("cache_key")),
    "detect_changes": changes,
    "incremental_plan": lambda s, d: M.incremental_plan(changes(s, d)),
    "cache_lookup": lambda s, d: looked_up(s, d).select("input_index", "hit"),
    "cache_evict_lru": lambda s, d: M.cache_evict(cached(s, d), 100).select("cache_key"),
    "cached_batch_or_compute": lambda s, d: looked_up(s, d).select("input_index", F.coalesce("vector", F.col("input_index") + 1_000_000).alias("vector"), "hit"),
    "embedding_status": statuses,
    "batch_embed": lambda s, d: chunks(s, d).withColumn("batch", F.floor(F.col("chunk_index") / 10)).groupBy("doc_id", "batch").agg(count(), F.count_if(F.col("char_count") < 200).alias("failed")).select("doc_id", "batch", M.status_of(F.col("n") - F.col("failed"), F.col("failed")).alias("status")),
    "progress": progress,
    "embedding_run_stats": lambda s, d: runs(s, d).groupBy("model").agg(F.round(F.avg("processing_time_ms"), 2).alias("avg_ms"), F.round(F.avg("successful_count"), 0).alias("avg_ok")),
    "latency_histogram": latency,
    "overall_progress": lambda s, d: runs(s, d).groupBy("document_id").agg(F.coalesce(F.round(F.avg(F.when(F.col("status") != "FAILED", F.col("processing_time_ms"))), 2), F.lit(100.0)).alias("progress")),
    "index_statistics_ema": lambda s, d: M.ema(runs(s, d), ["model"], "processing_time_ms", ["created_at", "result_id"]),
    "op_log_stats": lambda s, d: runs(s, d).filter(F.col("created_at") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 48 HOURS")).groupBy("model").agg(count(), F.round(F.count_if(F.col("status") == "SUCCESS") / F.count(F.lit(1)), 6).alias("success_rate")),
    "recommend_stats": lambda s, d: runs(s, d).groupBy("model").agg(F.round(F.count_if(F.col("status") == "SUCCESS") / F.count(F.lit(1)), 6).alias("adopted"), F.round(F.count_if(F.col("status") == "PARTIAL_SUCCESS") / F.count(F.lit(1)), 6).alias("modified"), F.round(F.count_if(F.col("status") == "FAILED") / F.count(F.lit(1)), 6).alias("fallback")),
    "history_trim": lambda s, d: M.newest(table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 3, "turn", "role"),
    "search_history_cap": lambda s, d: M.newest(runs(s, d), ["document_id"], 5, "created_at", "result_id").select("document_id", "result_id"),
    "merge_results": lambda s, d: M.merge_results(runs(s, d).select("document_id", "model", F.col("result_id").alias("source_order"), "status"), ["document_id", "model"]),
    "json_key_lists": props,
    "group_by_type": lambda s, d: docs(s, d).groupBy(F.coalesce("lang", F.lit("text")).alias("chunk_type")).agg(count()),
    "group_by_model": lambda s, d: runs(s, d).groupBy("model").agg(count(), F.min("result_id").alias("first_id"), F.max("result_id").alias("last_id"), F.sum("result_id").alias("sum_ids")),
}

HASHES = f"""{CHUNKS}, a AS (SELECT chunk_id, 'sha256:' || sha256(content) AS h FROM chunks WHERE doc_id % 13 <> 0),
b AS (SELECT chunk_id, 'sha256:' || sha256(CASE WHEN chunk_id % 7 = 0 THEN content || '!' ELSE content END) AS h FROM chunks WHERE chunk_id % 11 <> 0),
ch AS (SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, CASE WHEN a.chunk_id IS NULL THEN 'new' WHEN b.chunk_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.chunk_id = b.chunk_id)"""
CACHE = f"""h AS (SELECT doc_id, 'sha256:' || sha256(text) AS full_hash FROM documents),
cache AS (SELECT full_hash, substr(full_hash, 8, 16) || ':m' AS cache_key, max(TIMESTAMP '2024-01-01' + to_days((doc_id * 7919 % 20)::INTEGER)) AS last_accessed, min(doc_id) AS vector FROM h GROUP BY full_hash),
lk AS (SELECT h.doc_id AS input_index, c.vector, c.vector IS NOT NULL AS hit FROM h LEFT JOIN cache c ON c.full_hash = h.full_hash AND c.last_accessed >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"""
VERSIONED = "v AS (SELECT *, row_number() OVER w AS version, lag(result_id) OVER w AS previous_id, lead(result_id) OVER w IS NULL AS is_active FROM runs WINDOW w AS (PARTITION BY document_id, model ORDER BY created_at, result_id))"
LATEST = "SELECT *, row_number() OVER (PARTITION BY document_id, model ORDER BY created_at DESC, result_id DESC) AS r FROM runs"


def w(body: str) -> str:
    return f"WITH {RUNS} {body}"


def share(model: str) -> str:
    return f"round(count(*) FILTER (WHERE status = '{model}') / count(*), 6)"


ORACLE = {
    "filter_conjunctive": w("SELECT result_id, document_id FROM runs WHERE model = 'click' AND status = 'SUCCESS' AND created_at >= '2024-01-05' AND created_at <= '2024-01-15'"),
    "filter_like": "SELECT doc_id, source FROM documents WHERE source LIKE 'src1%'",
    "filter_ilike": "SELECT doc_id FROM documents WHERE text ILIKE '%THIS WORK IS%'",
    "filter_in": "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')",
    "filter_or_of_ands": w("SELECT result_id FROM runs WHERE (model = 'click' AND status = 'FAILED') OR (model = 'view' AND status = 'SUCCESS')"),
    "inner_join": w("SELECT lang, status, count(*) AS n FROM documents JOIN runs ON doc_id = document_id GROUP BY ALL"),
    "three_way_join": w("SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) JOIN runs ON doc_id = document_id GROUP BY ALL"),
    "left_anti_orphans": w("SELECT result_id FROM runs LEFT JOIN documents ON doc_id = document_id WHERE doc_id IS NULL"),
    "not_exists": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "semi_join": "SELECT DISTINCT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1",
    "latest_per_group": w(f"SELECT document_id, model, result_id, status FROM ({LATEST}) WHERE r = 1"),
    "latest_one": w("SELECT result_id, status FROM runs ORDER BY created_at DESC, result_id DESC LIMIT 1"),
    "parent_lookup": f"WITH {CHUNKS} SELECT c.doc_id, chunk_id, source FROM chunks c LEFT JOIN documents d ON d.doc_id = c.doc_id",
    "group_count": w("SELECT status, model, count(*) AS n FROM runs GROUP BY ALL"),
    "group_multi_agg": w("SELECT model, count(*) AS runs, sum(successful_count)::BIGINT AS successful, sum(failed_count)::BIGINT AS failed, round(avg(processing_time_ms), 2) AS avg_ms, round(max(processing_time_ms), 6) AS max_ms, round(min(processing_time_ms), 6) AS min_ms FROM runs GROUP BY model"),
    "having_duplicates": w("SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY document_id, model, status ORDER BY created_at DESC, result_id DESC) AS r FROM runs) WHERE r > 1"),
    "max_version_plus_1": w("SELECT document_id, model, count(*) + 1 AS next_version FROM runs GROUP BY ALL"),
    "versions": w("").rstrip() + f", {VERSIONED} SELECT result_id, version, previous_id, is_active FROM v",
    "parameter_change": f"WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) SELECT a.doc_id, CASE WHEN a.n = b.n THEN 'none' WHEN abs(b.n - a.n) / a.n > 0.2 THEN 'major' ELSE 'minor' END AS change FROM n a JOIN n b ON b.doc_id = a.doc_id + 1",
    "distinct": w("SELECT DISTINCT source, model FROM documents JOIN runs ON doc_id = document_id"),
    "sort_page": w("SELECT result_id, (SELECT count(*) FROM runs) AS total FROM runs ORDER BY processing_time_ms DESC, result_id LIMIT 20 OFFSET 40"),
    "compare_results": f'WITH {CHUNKS}, st AS (SELECT doc_id, count(*) AS n, max(char_count) - min(char_count) AS spread FROM chunks GROUP BY 1) SELECT (SELECT doc_id FROM st ORDER BY spread, doc_id LIMIT 1) AS most_even, (SELECT doc_id FROM st ORDER BY n, doc_id LIMIT 1) AS fewest',
    "compare_runs": w("SELECT i AS result_id, status IS NULL AS missing, status, processing_time_ms FROM (VALUES (1), (5), (9), (77777777)) t(i) LEFT JOIN runs ON result_id = i"),
    "delete_by_predicate": w("SELECT count(*) FILTER (WHERE created_at < '2024-01-10') AS would_delete, count(*) AS n FROM runs"),
    "queue_statistics": w("SELECT status, count(*) AS n, count(DISTINCT document_id) AS documents FROM runs GROUP BY status"),
    "age_cleanup": w(f"SELECT result_id FROM runs WHERE status IN ('SUCCESS', 'FAILED') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"),
    "missing_parts": "SELECT session_id, part FROM (SELECT DISTINCT user_id AS session_id FROM events), (SELECT unnest(range(1, 13)) AS part) EXCEPT SELECT user_id, event_id % 12 + 1 FROM events",
    "list_by_document": w("SELECT document_id, result_id, lead(result_id) OVER (PARTITION BY document_id ORDER BY created_at, result_id) IS NOT NULL AS deletable FROM runs"),
    "text_length_stats": "SELECT source, round(avg(length(text)), 6) AS avg_len, min(length(text))::BIGINT AS min_len, max(length(text))::BIGINT AS max_len FROM documents GROUP BY source",
    "content_hash": "SELECT doc_id, CASE WHEN text = '' THEN 'sha256:' || repeat('0', 64) ELSE 'sha256:' || sha256(text) END AS hash FROM documents",
    "cache_key": "SELECT doc_id, substr(sha256(text), 1, 16) || ':bge-m3' AS cache_key FROM documents",
    "detect_changes": f"WITH {HASHES} SELECT * FROM ch",
    "incremental_plan": f"WITH {HASHES}, x AS (SELECT count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM ch) SELECT new, modified, unchanged, new + modified AS to_embed, round(unchanged * 100.0 / (new + modified + unchanged), 1) AS savings_percent FROM x",
    "cache_lookup": f"WITH {CACHE} SELECT input_index, hit FROM lk",
    "cache_evict_lru": f"WITH {CACHE} SELECT cache_key FROM cache ORDER BY last_accessed, cache_key LIMIT (SELECT CASE WHEN count(*) >= 100 THEN 10 ELSE 0 END FROM cache)",
    "cached_batch_or_compute": f"WITH {CACHE} SELECT input_index, coalesce(vector, input_index + 1000000) AS vector, hit FROM lk",
    "embedding_status": w("SELECT document_id, CASE WHEN sum(failed_count) = 0 AND sum(successful_count) > 0 THEN 'SUCCESS' WHEN sum(successful_count) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status FROM runs GROUP BY document_id"),
    "batch_embed": f"WITH {CHUNKS} SELECT doc_id, (chunk_index // 10)::BIGINT AS batch, CASE WHEN count(*) FILTER (WHERE char_count < 200) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (WHERE char_count >= 200) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status FROM chunks GROUP BY 1, 2",
    "progress": f"WITH {CACHE} SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS cached, round((count(*) - count(*) FILTER (WHERE hit)) * 100.0 / count(*), 2) AS percent, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM lk",
    "embedding_run_stats": w("SELECT model, round(avg(processing_time_ms), 2) AS avg_ms, round(avg(successful_count), 0) AS avg_ok FROM runs GROUP BY model"),
    "latency_histogram": w("SELECT CASE WHEN processing_time_ms < 10 THEN '0-10' WHEN processing_time_ms < 50 THEN '10-50' WHEN processing_time_ms < 100 THEN '50-100' WHEN processing_time_ms < 500 THEN '100-500' ELSE '500-' END AS bucket, count(*) AS n FROM runs WHERE processing_time_ms > 0 GROUP BY 1"),
    "overall_progress": w("SELECT document_id, coalesce(round(avg(processing_time_ms) FILTER (WHERE status <> 'FAILED'), 2), 100.0) AS progress FROM runs GROUP BY 1"),
    "index_statistics_ema": w("SELECT model, round(list_reduce(list(processing_time_ms ORDER BY created_at, result_id), lambda a, b: a * 0.9::DOUBLE + b * (1 - 0.9::DOUBLE)), 6) AS ema FROM runs GROUP BY model"),
    "op_log_stats": w(f"SELECT model, count(*) AS n, {share('SUCCESS')} AS success_rate FROM runs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR GROUP BY model"),
    "recommend_stats": w(f"SELECT model, {share('SUCCESS')} AS adopted, {share('PARTIAL_SUCCESS')} AS modified, {share('FAILED')} AS fallback FROM runs GROUP BY model"),
    "history_trim": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM conversations) WHERE r <= 3",
    "search_history_cap": w("SELECT document_id, result_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, result_id DESC) AS r FROM runs) WHERE r <= 5"),
    "merge_results": w("SELECT document_id, model, result_id AS source_order, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id, model ORDER BY result_id) AS r FROM runs) WHERE r = 1"),
    "json_key_lists": "SELECT array_to_string(json_keys(props), ',') AS keys, count(*) AS n FROM events GROUP BY 1",
    "group_by_type": "SELECT coalesce(lang, 'text') AS chunk_type, count(*) AS n FROM documents GROUP BY 1",
    "group_by_model": w("SELECT model, count(*) AS n, min(result_id) AS first_id, max(result_id) AS last_id, sum(result_id)::BIGINT AS sum_ids FROM runs GROUP BY model"),
}
