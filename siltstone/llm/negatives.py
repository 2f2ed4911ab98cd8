"""Hard negatives by Kronecker-packed products.

Components are whole numbers. Several candidates' components, made non-negative by a bias, lie in separate fields of one wide whole number; a product of an
anchor's component and that number multiplies all of them at once, and the sum over the components holds every candidate's score in its own field:
sum_j a_j * sum_f (x_fj + bias) * base^f = sum_f (score_f + bias * sum_j a_j) * base^f. A field is wide enough for any sum, so the unpacked scores are exact.
Fields share a 53-bit whole number of a double where two or more fit, so that the products are a matrix product; else a Python integer of any width.

Candidates lie in blocks by a hash of their label, so that an anchor reads only blocks of its label for its positives and all blocks for its negatives.
A block or a batch of anchors is packed into one row once; every batch meets every block that it must read in a task of its own, which
returns only what can be among the first few. The work is that of a stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import staged
from siltstone.llm.topk import matrix, quantised

#: Components in one block of candidates and in one batch of anchors, at most about; buckets of labels; batches to aim at.
BLOCK, BATCH, BUCKETS, BATCHES = 1 << 21, 1 << 18, 1024, 16
#: Anchors whose scores with a block are held at once; fields of a Python integer.
ROWS, FIELDS = 32, 16
MANTISSA = 53
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95


class Fields:
    """How candidates' components are packed: fields a word, their base and the bias, for components up to `high` and anchors with sums of magnitudes up to `mass`."""

    def __init__(self, high: int, mass: int):
        self.bias = int(high)
        bits = max(1, (2 * int(mass) * 2 * max(self.bias, 1)).bit_length() + 1)
        self.exact = MANTISSA // bits >= 2
        self.fields = MANTISSA // bits if self.exact else FIELDS
        self.base = 1 << bits
        self.half = 1 << (bits - 1)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(components, words) of the candidates' matrix (candidates, components)."""
        n = -(-len(x) // self.fields) * self.fields
        padded = np.zeros((n, x.shape[1]))
        padded[: len(x)] = x
        if not self.exact:
            padded = np.array([[int(e) for e in r] for r in padded], dtype=object).reshape(padded.shape)
        biased = (padded + self.bias).reshape(-1, self.fields, x.shape[1])
        out = biased[:, 0]
        for f in range(1, self.fields):
            out = out + biased[:, f] * (self.base**f if not self.exact else float(self.base**f))
        return np.ascontiguousarray(out.T)

    def scores(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Exact inner products of the anchors with the n packed candidates."""
        if not self.exact:
            anchors = np.array([[int(e) for e in r] for r in anchors], dtype=object).reshape(anchors.shape)
        total = anchors @ words
        # a field may be negative: half a base lifts it, so that fields part cleanly
        total = total + sum(self.half * self.base**f for f in range(self.fields))
        out = np.empty((len(anchors), words.shape[1], self.fields), dtype=np.int64 if self.exact else object)
        for f in range(self.fields):
            high = np.floor(total / self.base) if self.exact else total // self.base
            out[:, :, f] = total - high * self.base
            total = high
        bias = np.array([self.bias * int(s) for s in anchors.sum(1)], dtype=out.dtype)
        got = out.reshape(len(anchors), -1)[:, :n] - self.half - bias[:, None]
        if not self.exact:
            if any(not -(2**63) < s < 2**63 for s in got.ravel()):
                raise OverflowError("an inner product of these vectors does not fit in a long")
            got = got.astype(np.int64)
        return got


def _packed(rows: DataFrame, key: list[str], width: int, kind: str, extra: list[str] | None = None) -> DataFrame:
    """One row for each key: uids, ids, labels and vectors (numbers of `kind`, one after another), ordered by id; and the lists in `extra`."""
    more = extra or []

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["vec_id", "uid"], kind="stable")
        row = {k: [p[k].iloc[0]] for k in key} | {c: [p[c].to_numpy()] for c in ("uid", "vec_id", "label")}
        row["v"] = [matrix(p["v"].tolist(), width).astype(kind).tobytes()]
        return pd.DataFrame(row | {c: [np.concatenate(p[c].tolist())] for c in more})

    kinds = ", ".join([*(f"{k} int" for k in key), "uid array<long>, vec_id array<long>, label array<long>, v binary", *(f"{c} array<long>" for c in more)])
    return rows.groupBy(*key).applyInPandas(pack, kinds)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row of `anchors`, a part of the rows of `vectors`.

    Both have (uid, vec_id, label, v): uid tells rows apart, v holds whole numbers (see `rows_of`). An anchor's positives are its `positives` other rows of the same
    label with the highest inner products; for each, the `negatives` rows of other labels with the highest scores in least..most hundredths of the
    positive's score, bounds included. Ties go to the smaller vec_id. A repeated id counts as several rows, each candidate or anchor of its own. Fewer rows:
    all of them; a negative positive score has no range. Vectors that are shorter than others count as if zeros followed. Empty input: no rows.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e)))).alias("high")).first()
    asked = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + F.abs(e))).alias("mass")).first()
    if not size["n"] or not asked["n"]:
        return spark.createDataFrame([], result)
    width = max(int(size["d"]), 1)
    fields = Fields(int(size["high"]), int(asked["mass"]))

    cell = max(64, BLOCK // width)
    n_buckets = max(1, min(BUCKETS, size["n"] // cell))
    bucket = F.pmod(F.xxhash64("label"), F.lit(n_buckets)).cast("int")
    kind = "<i2" if size["high"] < 2**15 else "<f8"
    per_batch = max(16, min(BATCH // width, -(-asked["n"] // BATCHES)))
    # a bucket has as many blocks and batches of anchors as its rows need: a label with a third of all rows is dealt to many. At most BUCKETS rows
    parts = vectors.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    turns = anchors.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / per_batch).cast("int").alias("turns"))
    shares = F.broadcast(staged(parts.join(turns, "bucket", "left"), "negatives-shares"))
    dealt = vectors.withColumn("bucket", bucket).join(shares, "bucket").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    blocks = staged(_packed(dealt.select("bucket", "part", "uid", "vec_id", "label", "v"), ["bucket", "part"], width, kind), "negatives-blocks")

    def upto(n) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    def met(left: DataFrame, right: DataFrame, search: Callable, kinds: str) -> DataFrame:
        """Packed batches meet blocks, one pair a group; both have batch, bucket and part."""
        key = ["batch", "bucket", "part"]
        renamed = right.select(*[F.col(c).alias(f"b_{c}") for c in key], "uid", "vec_id", "label", "v")
        return left.groupBy(*key).cogroup(renamed.groupBy(*[f"b_{c}" for c in key])).applyInPandas(search, kinds)

    def opened(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r = p.iloc[0]
        uid, ids, label = (np.asarray(r[c], dtype=np.int64) for c in ("uid", "vec_id", "label"))
        return uid, ids, label, np.frombuffer(r["v"], dtype=kind).reshape(len(uid), width).astype(np.float64)

    def scored(left: pd.DataFrame, right: pd.DataFrame):
        """Blocks of anchors (their rows, as a slice) with their scores against all candidates of the block."""
        a = opened(left)[3]
        x = opened(right)[3]
        words = fields.pack(x)
        for i in range(0, len(a), ROWS):
            yield i, fields.scores(a[i : i + ROWS], words, len(x))

    def highest(s: np.ndarray, take: np.ndarray, k: int) -> np.ndarray:
        """The k places of `take` with the highest scores, ties to the first place."""
        if len(take) > k:
            kth = np.partition(s[take], len(take) - k)[len(take) - k]
            take = take[s[take] >= kth]
        return take[np.argsort(-s[take], kind="stable")[:k]]

    first = "a_uid long, anchor_id long, label long, vec_id long, score long"

    def find_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            a_uid, a_id, a_label, _ = opened(left)
            uid, ids, label, _ = opened(right)
            same = {x: np.flatnonzero(label == x) for x in np.unique(a_label)}
            for i, s in scored(left, right):
                for r in range(len(s)):
                    take = same[a_label[i + r]]
                    take = take[uid[take] != a_uid[i + r]]
                    out += [(a_uid[i + r], a_id[i + r], a_label[i + r], ids[c], s[r, c]) for c in highest(s[r], take, positives)]
        return pd.DataFrame(out, columns=["a_uid", "anchor_id", "label", "vec_id", "score"]).astype("int64")

    # positives: a bucket's batches of anchors meet the bucket's blocks
    homes = anchors.withColumn("bucket", bucket).join(shares, "bucket").withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "uid"), F.col("turns")).cast("int"))
    own = staged(_packed(homes.select("bucket", "batch", "uid", "vec_id", "label", "v"), ["bucket", "batch"], width, kind), "negatives-anchors")
    left = own.join(shares, "bucket").withColumn("part", upto(F.col("parts")))
    right = blocks.join(shares, "bucket").filter("turns > 0").withColumn("batch", upto(F.col("turns")))
    w = W.partitionBy("a_uid").orderBy(F.desc("score"), "vec_id")
    best = met(left, right, find_positives, first).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= positives)
    best = staged(best, "negatives-positives")

    # negatives: batches of anchors with their positives' scores meet all blocks
    lists = best.filter("score >= 0").groupBy(F.col("a_uid").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("p"))
    full = lambda c: F.concat(F.transform("p", lambda e: e[c].cast("long")), F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("p")))
    batches = -(-asked["n"] // per_batch)
    ranged = anchors.join(lists, "uid").select(F.pmod(F.xxhash64(F.lit("batch"), "uid"), F.lit(batches)).cast("int").alias("batch"), "uid", "vec_id", "label", "v", full("vec_id").alias("p_ids"), full("score").alias("p_scores"))
    ranged = staged(_packed(ranged, ["batch"], width, kind, ["p_ids", "p_scores"]), "negatives-ranges")
    left = ranged.withColumn("bucket", upto(F.lit(n_buckets))).join(shares, "bucket").withColumn("part", upto(F.col("parts")))
    right = blocks.withColumn("batch", upto(F.lit(batches)))
    second = "a_uid long, anchor_id long, slot int, positive_id long, positive_score long, negative_id long, negative_score long"

    def find_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            a_uid, a_id, a_label, _ = opened(left)
            _, ids, label, _ = opened(right)
            p_ids, p_scores = (np.asarray(left.iloc[0][c], dtype=np.int64).reshape(len(a_uid), positives) for c in ("p_ids", "p_scores"))
            for i, s in scored(left, right):
                for r in range(len(s)):
                    # least * p <= 100 * n <= most * p, in whole numbers of any size
                    ranges = [(-(-least * int(p) // 100), most * int(p) // 100) for p in p_scores[i + r] if p >= 0]
                    near = np.flatnonzero((s[r] >= min(x for x, _ in ranges)) & (s[r] <= max(y for _, y in ranges)))
                    near = near[label[near] != a_label[i + r]]
                    for slot, (lo, hi) in enumerate(ranges):
                        take = near[(s[r][near] >= lo) & (s[r][near] <= hi)]
                        out += [(a_uid[i + r], a_id[i + r], slot, p_ids[i + r, slot], p_scores[i + r, slot], ids[c], s[r, c]) for c in highest(s[r], take, negatives)]
        return pd.DataFrame(out, columns=["a_uid", "anchor_id", "slot", "positive_id", "positive_score", "negative_id", "negative_score"]).astype({"slot": "int32"} | {c: "int64" for c in ("a_uid", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")})

    found = met(left, right, find_negatives, second)
    w = W.partitionBy("a_uid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def rows_of(df: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part: an id, a whole-number label, and a vector without null or non-finite components, which become floor(scale * x).
    The rows are written, so that uid stays the same."""
    kept = df.filter(F.col(label).isNotNull()).select(F.struct(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label")).alias("_key"), F.col(embedding).alias("embedding"))
    rows = quantised(kept.filter("_key.vec_id IS NOT NULL"), "_key", "embedding", scale)
    return staged(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id.vec_id").alias("vec_id"), F.col("vec_id.label").alias("label"), "v"), "negatives-rows")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    vectors = rows_of(moved)
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.uid <> c.uid
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS turn FROM s WHERE same
), n AS (
  SELECT p.anchor, p.anchor_id, p.turn, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.turn ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND p.turn <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
