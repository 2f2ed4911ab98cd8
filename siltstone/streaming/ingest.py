"""Incremental ingestion as a stream (an extension): arriving documents are chunked and upserted by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions import text as T
from siltstone.operators import chunking


def chunk_stream(spark: SparkSession, source: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Chunks of the Parquet files that arrive under `source`."""
    c = chunking.chunk_character(spark.readStream.schema(schema).parquet(source))
    return c.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index")).withColumn("hash", T.content_hash(F.col("content")))


def upsert(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks that are new or changed since the last batch to `target`, each with its batch; a replayed batch overwrites its own partition."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["chunk_id", "hash"])
        if batch_id:
            old = spark.read.parquet(target).filter(F.col("batch") < batch_id)
            last = old.groupBy("chunk_id").agg(F.max_by("hash", "batch").alias("hash"))
            rows = rows.join(last, ["chunk_id", "hash"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts by event type and window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
