"""Operators over the engine's own tables: runs, versions, caches, logs. Plain relational plans; every latest-row choice has a tie-break."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that a caller may sort by.
SORTABLE = ("result_id", "document_id", "model", "status", "processing_time_ms", "created_at")


def filter_runs(runs: DataFrame, model: str | None = None, status: str | None = None, document_id: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Conjunction of the given conditions; dates are inclusive at both ends."""
    conds = [F.col("model") == model if model else None, F.col("status") == status if status else None, F.col("document_id") == document_id if document_id is not None else None, F.col("created_at") >= F.lit(since).cast("timestamp") if since else None, F.col("created_at") <= F.lit(until).cast("timestamp") if until else None]
    for c in conds:
        runs = runs if c is None else runs.filter(c)
    return runs


def latest_per(rows: DataFrame, by: list[str], when: str = "created_at", tie: str = "result_id") -> DataFrame:
    """The newest row of each group; ties to the larger `tie`. One aggregation with map-side combine: a hot group shuffles one row a task."""
    other = [c for c in rows.columns if c not in by]
    best = F.max_by(F.struct(*other), F.struct(when, tie)).alias("_b")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col(f"_b.{c}").alias(c) for c in other]).select(*rows.columns)


def sorted_page(rows: DataFrame, column: str, descending: bool, page: int, size: int, tie: str = "result_id") -> DataFrame:
    """One page of the sorted rows, with the total beside it."""
    if column not in SORTABLE:
        raise ValueError(f"sort column {column}: one of {SORTABLE}")
    c = F.col(column)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(c.desc() if descending else c.asc(), tie).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def run_statistics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, sums and times to 2 places; nulls count as 0."""
    t = F.col("processing_time_ms")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("successful_count"), F.lit(0)).cast("long").alias("successful"), F.coalesce(F.sum("failed_count"), F.lit(0)).cast("long").alias("failed"), F.coalesce(F.round(F.avg(t), 2), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.max(t), F.lit(0.0)).alias("max_ms"), F.coalesce(F.min(t), F.lit(0.0)).alias("min_ms"))


def versions(rows: DataFrame, by: list[str], when: str = "created_at", tie: str = "result_id") -> DataFrame:
    """Numbers the rows of each group by time from 1; the last is active, and each knows the one before."""
    w = W.partitionBy(*by).orderBy(when, tie)
    out = rows.withColumn("version", F.row_number().over(w).cast("long")).withColumn("previous_id", F.lag(tie).over(w))
    return out.withColumn("is_active", F.lead(tie).over(w).isNull())


def next_version(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


# Fixed value: the parameters whose numbers may move a little.
CRITICAL = ("chunk_size", "overlap", "separator", "min_chunk_size", "max_chunk_size")


def parameter_change(old: Column, new: Column, critical: tuple[str, ...] = CRITICAL, minor: float = 0.2) -> Column:
    """"none", "minor" or "major" for two maps of numbers or texts. Added or removed keys are major; so is a critical number that moved by over `minor` of itself (from 0: at all), a critical
    value that is no number and another now, and any change of another key. No old map, or an empty one, is major."""
    def change(k: Column, a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        far = F.coalesce((x == 0) | (F.abs(y - x) / F.abs(x) > minor), F.lit(True))
        return F.when(a.isNull() | b.isNull(), 2).when((a == b) | F.coalesce(x == y, F.lit(False)), 0).when(k.isin(*critical) & ~far, 1).otherwise(2)

    worst = F.array_max(F.map_values(F.map_zip_with(old, new, change)))
    return F.when(F.coalesce(F.size(old), F.lit(0)) <= 0, "major").when(worst == 2, "major").when(worst == 1, "minor").otherwise("none")


def activate(rows: DataFrame, asked: DataFrame, by: tuple[str, ...] = ("document_id", "strategy"), key: str = "result_id") -> DataFrame:
    """Makes versions active, each instead of the others of its group. rows: (by, key, is_active, ...); asked: (key, turn): of several for one group the last turn wins, then the greater key.

    Ids that are not there change nothing; groups that nobody asked for keep their flags. One merge on the group's key."""
    now = rows.withColumn("_g", F.to_json(F.struct(*by)))
    chosen = now.select("_g", key).join(asked.select(key, "turn"), key).groupBy("_g").agg(F.max(F.struct("turn", key)).alias("_on"))
    out = now.join(chosen, "_g", "left").withColumn("is_active", F.when(F.col("_on").isNotNull(), F.col(key) == F.col(f"_on.{key}")).otherwise(F.col("is_active")))
    return out.select(*rows.columns)


def save_versions(rows: DataFrame, new: DataFrame, by: tuple[str, ...] = ("document_id", "strategy"), key: str = "result_id") -> DataFrame:
    """Versions after new results were saved. rows: (by, key, params, version, previous_id, is_active); new: (by, key, params), one row a group.

    A result whose parameters changed none or a little against the group's active version takes its place, with its number and what came before it. Any other becomes the next version and
    the active one, and the version before it is the one that was active. One full merge on the group's key; null group keys are groups too."""
    group = F.to_json(F.struct(*by))
    now, come = rows.withColumn("_g", group), new.select(group.alias("_g"), *[F.col(c).alias(f"_{c}") for c in (*by, key, "params")])
    state = now.groupBy("_g").agg(F.max("version").alias("_last"), F.max_by(F.struct("version", key, "params", "previous_id"), F.when(F.col("is_active"), F.col("version"))).alias("_was"))
    merged = come.join(state, "_g", "left").withColumn("_small", F.coalesce(parameter_change(F.col("_was.params"), F.col("_params")) != "major", F.lit(False)))
    kept = now.join(merged.select("_g", "_small", F.col(f"_was.{key}").alias("_old"), F.lit(True).alias("_met")), "_g", "left")
    kept = kept.filter(~(F.coalesce("_small", F.lit(False)) & F.col(key).eqNullSafe(F.col("_old"))))
    kept = kept.withColumn("is_active", F.col("is_active") & F.col("_met").isNull()).select(*rows.columns)
    version = F.when(F.col("_small"), F.col("_was.version")).otherwise(F.coalesce("_last", F.lit(0)) + 1)
    before = F.when(F.col("_small"), F.col("_was.previous_id")).otherwise(F.col(f"_was.{key}"))
    added = merged.select(*[F.col(f"_{c}").alias(c) for c in by], F.col(f"_{key}").alias(key), F.col("_params").alias("params"), version.cast("long").alias("version"), before.alias("previous_id"), F.lit(True).alias("is_active"))
    return kept.unionByName(added.select(*rows.columns))


def duplicates_to_drop(rows: DataFrame, by: list[str], when: str = "created_at", tie: str = "result_id") -> DataFrame:
    """All but the newest row of groups with several."""
    w = W.partitionBy(*by).orderBy(F.desc(when), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r > 1").drop("_r")


def newest(rows: DataFrame, by: list[str], keep: int, when: str, tie: str) -> DataFrame:
    """The newest `keep` rows of each group (history caps)."""
    w = W.partitionBy(*by).orderBy(F.desc(when), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def missing_parts(uploads: DataFrame) -> DataFrame:
    """uploads: (session_id, total, parts: array<long>). Part numbers from 1 to total that are not there, one row each."""
    want = uploads.filter("total > 0").select("session_id", F.explode(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("total")), F.col("parts"))).alias("part"))
    return want


def ema(rows: DataFrame, by: list[str], value: str, order: list[str], keep: float = 0.9) -> DataFrame:
    """Exponential moving average of each group's values in order: keep * old + (1 - keep) * new, from the first value.

    Tasks hold ranges of the order, so a large group spreads over many. Each folds its rows of a group to one row: old becomes old * _decay + _carry.
    """
    parts = rows.select(*by, *order, F.col(value).cast("double").alias("_v"), F.to_json(F.struct(*by)).alias("_g"))
    parts = parts.repartitionByRange("_g", *order, "_v").sortWithinPartitions("_g", *order, "_v")
    kept = [*by, *order, "_v"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(first, decay, carry):
            return pa.RecordBatch.from_arrays([*first.columns, pa.array([decay], pa.float64()), pa.array([carry], pa.float64())], names=[*kept, "_decay", "_carry"])

        group, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            g, v = np.array(b.column("_g").to_pylist()), b.column("_v")
            x, null = v.to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                decay = keep ** (e - s)
                # a null makes all after it null
                carry = None if null[s:e].any() else float(((1 - keep) * keep ** np.arange(e - s - 1, -1, -1.0) * x[s:e]).sum())
                if held is not None and g[s] == group:
                    held = (held[0], held[1] * decay, None if carry is None or held[2] is None else held[2] * decay + carry)
                else:
                    if held is not None:
                        yield row(*held)
                    group, held = g[s], (b.select(kept).slice(s, 1), decay, carry)
        if held is not None:
            yield row(*held)

    kind = {f.name: f.dataType.simpleString() for f in parts.schema}
    some = parts.mapInArrow(fold, ", ".join([*[f"`{c}` {kind[c]}" for c in kept], "_decay double", "_carry double"]))
    ranges = F.array_sort(F.collect_list(F.struct(*order, "_v", "_decay", "_carry")))
    got = some.groupBy(*by).agg(ranges.alias("_rs"))
    return got.select(*by, F.round(F.aggregate("_rs", F.element_at("_rs", 1)["_v"], lambda s, r: s * r["_decay"] + r["_carry"]), 6).alias("ema"))


def detect_changes(before: DataFrame, now: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, change): new, modified, unchanged or deleted by content hash."""
    a = before.select(F.col(key).alias("_k"), F.col("hash").alias("_old"))
    b = now.select(key, "hash")
    j = b.join(a, F.col(key) == F.col("_k"), "full")
    change = F.when(F.col("_k").isNull(), "new").when(F.col(key).isNull(), "deleted").when(F.col("hash") == F.col("_old"), "unchanged").otherwise("modified")
    return j.select(F.coalesce(F.col(key), F.col("_k")).alias(key), change.alias("change"))


def incremental_plan(changes: DataFrame) -> DataFrame:
    """Counts of each change, of what to embed and to reuse, and the share saved."""
    n = lambda c: F.count_if(F.col("change") == c)
    out = changes.agg(n("new").alias("new"), n("modified").alias("modified"), n("unchanged").alias("unchanged"))
    total = F.col("new") + F.col("modified") + F.col("unchanged")
    return out.select("*", (F.col("new") + F.col("modified")).alias("to_embed"), F.when(total > 0, F.round(F.col("unchanged") * 100.0 / total, 1)).otherwise(F.lit(0.0)).alias("savings_percent"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """wanted: (input_index, cache_key, full_hash); cache: (cache_key, full_hash, last_accessed, vector). A hit has the key, the whole hash, and an age within
    `days`. Adds hit and vector."""
    fresh = cache.filter(F.col("last_accessed") >= now - F.expr(f"INTERVAL {days} DAYS")).select("cache_key", "full_hash", "vector")
    return wanted.join(fresh, ["cache_key", "full_hash"], "left").withColumn("hit", F.col("vector").isNotNull())


def cache_evict(cache: DataFrame, most: int = 10_000, share: float = 0.1) -> DataFrame:
    """What to drop when the cache has `most` entries or more: the int(share * most) least recently used. So many rows at most meet in one task, however large the cache is."""
    n = int(most * share) if cache.count() >= most else 0
    return cache.orderBy("last_accessed", "cache_key").limit(n)


def status_of(ok: Column, failed: Column) -> Column:
    return F.when((failed == 0) & (ok > 0), "SUCCESS").when(ok > 0, "PARTIAL_SUCCESS").otherwise("FAILED")


def merge_results(results: DataFrame, key: list[str], order: str = "source_order") -> DataFrame:
    """Union of extracted tables and images of several loaders: the first loader wins on each key."""
    other = [c for c in results.columns if c not in key]
    first = F.min_by(F.struct(*other), order).alias("_b")
    return results.groupBy(*key).agg(first).select(*key, *[F.col(f"_b.{c}").alias(c) for c in other])
