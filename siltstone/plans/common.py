"""Projections of the given tables that stand in for the engine's own, shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer input splits than cores over all cores; a large table has more splits and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character chunks of all documents with chunk_id = doc_id * 1,000,000 + index."""
    c = chunking.chunk_character(documents(spark, sf_dir))
    return c.withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as embedding runs: document user_id, model event_type, status by value, time value."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 10, "FAILED").when(F.col("value") < 30, "PARTIAL_SUCCESS").otherwise("SUCCESS")
    good = F.when(status == "SUCCESS", 50).when(status == "PARTIAL_SUCCESS", 40).otherwise(0).cast("long")
    return e.select(F.col("event_id").alias("result_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("model"), status.alias("status"), good.alias("successful_count"), (F.lit(50) - good).cast("long").alias("failed_count"), F.col("value").alias("processing_time_ms"), F.col("ts").alias("created_at"))


#: SQL of the same projections, for the oracles.
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))"
TOKENS = r"regexp_extract_all(lower({0}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9]+')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


def tokens_sql(x: str) -> str:
    return TOKENS.format(x)


def windows_sql(size: int, step: int, source: str = "documents", text: str = "text", keep: str = "doc_id") -> str:
    """CTE body: (keep, content, start, end, chunk_index, char_count, word_count) of sliding windows."""
    return f"""
  SELECT {keep}, row_number() OVER (PARTITION BY {keep} ORDER BY s) - 1 AS chunk_index, content, s AS start, e AS "end", length(content)::BIGINT AS char_count, {WORDS.format('content')}::BIGINT AS word_count
  FROM (SELECT {keep}, s, least(s + {size}, n) AS e, {strip_sql(f'substring({text}, (s + 1)::BIGINT, {size})')} AS content
    FROM (SELECT {keep}, {text}, length({text})::BIGINT AS n, unnest(range(0, CASE WHEN length({text}) = 0 THEN 0 WHEN length({text}) <= {size} THEN 1 ELSE ((length({text}) - {size} + {step - 1}) // {step}) + 1 END)) * {step} AS s FROM {source}))
  WHERE content <> ''"""


CHUNKS = f"chunks AS (SELECT *, doc_id * 1000000 + chunk_index AS chunk_id FROM ({windows_sql(500, 450)}))"
RUNS = """runs AS (SELECT event_id AS result_id, user_id AS document_id, event_type AS model,
  CASE WHEN value < 10 THEN 'FAILED' WHEN value < 30 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status,
  (CASE WHEN value < 10 THEN 0 WHEN value < 30 THEN 40 ELSE 50 END)::BIGINT AS successful_count,
  (CASE WHEN value < 10 THEN 50 WHEN value < 30 THEN 10 ELSE 0 END)::BIGINT AS failed_count, value AS processing_time_ms, ts AS created_at FROM events)"""
