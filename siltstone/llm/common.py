"""Helpers shared by the operators: shared work folders, deterministic splits, bounded sampling."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Where the setting is absent, a temporary folder is set for a session on one machine (tests); on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # a core setting: cannot be changed once the context runs
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_aside(df: DataFrame, results: list[str]) -> DataFrame:
    """`df` ready to get the columns `results`: own columns of those names (case aside) keep their values under the name with "_own" after it,
    appended until the name is free."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in results}
    names = []
    for c in df.columns:
        if c.lower() in {r.lower() for r in results}:
            c += "_own"
            while c.lower() in taken:
                c += "_own"
            taken.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def share_of(h: Column, rate: float) -> Column:
    """Whether a 64-bit hash falls in the given share of its range (exact down to 2^-53)."""
    return F.shiftrightunsigned(h, 11) < F.lit(int(min(1.0, rate) * 2**53))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes (the settings are the session's; a smaller number of rows of the user's stays, and any size)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


#: What this Python worker keeps from one task to the next, and when it last gave memory back.
_kept: dict[str, object] = {}
_gave_back = [0.0]


def give_back(every: float = 0.5) -> None:
    """Returns freed memory of a reused Python worker to the system, at most once in `every` seconds: else what one batch or stage needed stays with the worker."""
    if time.monotonic() - _gave_back[0] < every:
        return
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    _gave_back[0] = time.monotonic()


def kept(operator: str, make: Callable[[], object] = dict):
    """What an operator keeps in a reused Python worker from one task to the next, made by `make` where absent. A worker keeps the state of one operator
    at a time, so that those of a pipeline's stages do not add up."""
    give_back()
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = make()
    return _kept[operator]


def broadcast_if(df: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows (counted, if `rows` isn't given); else as it is, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = workdir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the folders of `staged` tables that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_staged_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2 on division by 4 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def bounded_ids(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows of `df` (a narrow table with column `key`), chosen by a hash of the key.

    A cheap rate filter comes first, so that the final top-k merges few rows whatever the table's size.
    """
    n = df.count()
    h = F.xxhash64(F.lit("sample"), F.col(key))
    if n > 4 * bound:
        df = df.filter(share_of(h, 2 * bound / n))
    return df.orderBy(h, key).limit(bound)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, per_bucket: int = 100_000) -> DataFrame:
    """Number the rows of each group 0..n-1 without gathering a group in one task.

    Rows are dealt to buckets by a hash of `order` (one group may hold most rows); each bucket is numbered by
    a window, and a small table of bucket counts gives every bucket's first number.
    """
    n = df.count()
    buckets = max(1, min(1 << 16, -(-n // per_bucket) * 8))
    b = f"_{out}_bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    key = [*group, b]
    from pyspark.sql import Window as W

    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(W.partitionBy(*group).orderBy(b)) - F.col("_n")).drop("_n")
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_first")
    local = dealt.withColumn("_row", F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1)
    cond = None
    for i, k in enumerate(key):
        c = local[k].eqNullSafe(first[f"_k{i}"])
        cond = c if cond is None else cond & c
    return local.join(first, cond).withColumn(out, (F.col("_first") + F.col("_row")).cast("long")).drop(b, "_row", "_first", *[f"_k{i}" for i in range(len(key))])
