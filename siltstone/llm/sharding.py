"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (rows of equal text) are ordered by the MD5 of their text and never split. The smallest capacity C for
which a greedy left-to-right fill needs at most `shards` shards is found by binary search; the cuts are those of
the greedy fill at that C.

The ordered sizes never reach the driver. A table of block sums does: a block is an interval of the key order,
named by a hexadecimal prefix of the key. From block sums alone every cut is known to lie in an interval, so a
capacity is certainly feasible, certainly not, or open. Only blocks that an open cut may fall in are refined by one
more aggregation (longer prefixes) until the bracket of capacities closes. Each round collects a bounded table.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import numbered, set_aside, staged

#: Prefix characters by which one refinement round lengthens the open blocks, and the most blocks refined at once.
STEP, OPEN_BLOCKS = 3, 64
KEY_CHARS = 32


def _cuts(pos: list[int], atomic: list[bool], cap: int, shards: int) -> tuple[list[int], list[int], bool, bool]:
    """Lower and upper bounds of the greedy cut positions at `cap`, and whether it surely fits or surely does not."""
    lo, hi, lows, highs, total = 0, 0, [], [], pos[-1]
    for _ in range(shards):
        i = bisect_right(pos, lo + cap) - 1
        lo = max(lo, pos[i])
        j = bisect_right(pos, hi + cap) - 1
        hi = pos[j] if j == len(pos) - 1 or atomic[j] else min(hi + cap, pos[j + 1])
        hi = max(hi, lo)
        lows.append(lo)
        highs.append(hi)
    return lows, highs, lo >= total, hi < total


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The least feasible capacity, and the first key of every shard after the first (keys in between stay together).

    groups: columns key (32 lower-case hexadecimal characters, unique) and size (long, positive).
    An empty table gives capacity 0 and no cuts.
    """
    def blocks(df: DataFrame, chars: int) -> list:
        return (df.groupBy(F.substring("key", 1, chars).alias("block")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.min("key").alias("first")).collect())

    table = {r["block"]: (r["bytes"], r["n"], r["most"], r["first"]) for r in blocks(groups, STEP)}
    if not table:
        return 0, []
    total = sum(v[0] for v in table.values())
    biggest = max(v[2] for v in table.values())
    low = max(biggest, -(-total // shards))
    high = low + biggest
    while True:
        names = sorted(table, key=lambda b: b.ljust(KEY_CHARS, "0"))
        pos, atomic = [0], []
        for b in names:
            pos.append(pos[-1] + table[b][0])
            atomic.append(table[b][1] == 1)
        a, z = low, high
        while a < z:  # the least capacity that block bounds already prove feasible
            mid = (a + z) // 2
            a, z = (a, mid) if _cuts(pos, atomic, mid, shards)[2] else (mid + 1, z)
        high = a
        a, z = low, high
        while a < z:  # the least that they do not prove infeasible
            mid = (a + z) // 2
            a, z = (mid + 1, z) if _cuts(pos, atomic, mid, shards)[3] else (a, mid)
        low = a
        lows, _, _, _ = _cuts(pos, atomic, low, shards)
        _, highs, _, _ = _cuts(pos, atomic, high, shards)
        wanted = []
        for x, y in zip(lows, highs, strict=True):
            i, j = bisect_right(pos, x) - 1, bisect_right(pos, y) - 1
            wanted += [k for k in range(max(i, 0), min(j, len(names) - 1) + 1) if not atomic[k]]
        wanted = list(dict.fromkeys(wanted))
        if not wanted:
            firsts = [table[names[i]][3] for x in lows[:-1] if (i := bisect_right(pos, x) - 1) < len(names)]
            return low, firsts
        # the largest open blocks first: they bound the bracket most
        chosen = [names[k] for k in sorted(wanted, key=lambda k: -table[names[k]][0])[:OPEN_BLOCKS]]
        by_len: dict[int, list[str]] = {}
        for b in chosen:
            by_len.setdefault(len(b), []).append(b)
        for n, bs in by_len.items():
            finer = blocks(groups.filter(F.substring("key", 1, n).isin(bs)), min(n + STEP, KEY_CHARS))
            for b in bs:
                del table[b]
            table |= {r["block"]: (r["bytes"], r["n"], r["most"], r["first"]) for r in finer}


def minimax_shards(df: DataFrame, text: str = "text", shards: int = 8) -> DataFrame:
    """Adds size (UTF-8 bytes + 1), text_crc32, group_key, shard and capacity to `df`; equal texts share a shard.

    Null text counts as a text of no bytes and shares a group with the empty text. Repeated rows stay, each counted.
    An empty table returns no rows. No text is shuffled: cuts are key comparisons on the scan. Columns of `df` named like a result go on as name_own.
    """
    df = set_aside(df, ["size", "text_crc32", "group_key", "shard", "capacity"])
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn("size", F.octet_length(body).cast("long") + 1).withColumn("text_crc32", F.crc32(body.cast("binary"))).withColumn("group_key", F.md5(body.cast("binary")))
    groups = keyed.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("size"))
    capacity, cuts = minimax_cuts(staged(groups, "shard-groups"), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("group_key") >= c).cast("int")
    return keyed.withColumn("shard", shard.cast("int")).withColumn("capacity", F.lit(capacity).cast("long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = minimax_shards(docs).select("doc_id", "size", "text_crc32", "group_key", F.lit("bytes").alias("law"), "shard")
    out = numbered(staged(out, "shard-rows"), ["shard"], ["doc_id", "group_key"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
