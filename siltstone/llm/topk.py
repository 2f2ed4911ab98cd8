"""Exact top-k inner-product search by a pivot-distance index.

Inner products are turned into distances by one more coordinate: v' = (v, sqrt(M^2 - |v|^2)), q' = (q, 0), with M the
largest norm, so |q' - v'|^2 = |q|^2 + M^2 - 2 q.v. Every vector is keyed by its nearest pivot and the distance to it; a pivot's
vectors lie in RINGS rings of distance. A query reads the rings of a pivot outwards from its own distance, and in a ring annulus after annulus, and stops
where the triangle inequality | |q'p| - |v'p| | already excludes its current k-th score. Scores are exact integers.

Tables of pivots and rings have at most PIVOTS * RINGS rows, whatever the corpus; only they reach the driver and every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_ids, staged

#: Vectors in one piece of a ring, queries in one batch, rows of one annulus step, vectors to fit pivots on.
CELL, QUERIES, STEP, FIT = 8192, 2048, 512, 8192
#: Pivots grow with the vectors between these bounds; rings of a pivot.
LEAST_PIVOTS, PIVOTS, RINGS = 16, 512, 16


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v: array<double>) with v = floor(scale * x), whole numbers. Null ids, null vectors, and vectors with a null or non-finite
    component take no part. Shorter vectors count as if zeros followed, so an empty one scores 0 with all. Repeated rows stay."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")) | (F.abs(e * scale) == float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(~bad)
    # rint: floor without a cast to long, for whole and half steps alike
    whole = lambda e: F.when(F.rint(e * scale) > e * scale, F.rint(e * scale) - 1).otherwise(F.rint(e * scale))
    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def identified(vectors: DataFrame) -> DataFrame:
    """Adds uid, a number of each row, to (vec_id, v). The rows are written, so that it stays the same."""
    return staged(vectors.withColumn("uid", F.monotonically_increasing_id()), "topk-vectors")


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of whole numbers as float64, zeros after short ones."""
    if all(len(v) == width for v in vectors):
        return np.array(list(vectors), dtype=np.float64).reshape(-1, width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: through float64 where no partial sum can exceed 2^53, int64 below 2^63, else whole numbers of any size.
    Scores are long: one that does not fit is an error."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    big = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    if any(not -(2**63) < x < 2**63 for x in big.ravel()):
        raise OverflowError("an inner product of these vectors does not fit in a long")
    return big.astype(np.int64)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """A few Lloyd steps from evenly spaced rows."""
    p = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(8):
        near = (np.square(sample).sum(1)[:, None] - 2 * sample @ p.T + np.square(p).sum(1)).argmin(1)
        for i in range(len(p)):
            if (near == i).any():
                p[i] = sample[near == i].mean(0)
    return p


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row with all rows but itself, ties to the smaller id.

    vectors: (uid, vec_id, v) as `identified` gives them; queries: some of their rows. Fewer candidates than k: all of them. A repeated id counts as
    several candidates with the same id and as several queries, each with its own k rows; of a repeated row, the others are candidates of each. Empty input: no rows.
    """
    spark = vectors.sparkSession
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    stats = vectors.agg(F.max(norm2).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top, width = float(stats["m"]), int(stats["d"])
    keys = bounded_ids(vectors.select("vec_id").distinct(), "vec_id", FIT)
    fit = matrix([r["v"] for r in vectors.join(F.broadcast(keys), "vec_id").limit(2 * FIT).collect()], width)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top - np.square(x).sum(1), 0))[:, None]])

    pivots = _pivots(lift(fit), min(PIVOTS, max(LEAST_PIVOTS, round((stats["n"] / CELL) ** 0.5))))

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.square(x).sum(1)[:, None] - 2 * x @ pivots.T + np.square(pivots).sum(1), 0))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            d = far(lift(matrix(p["v"].tolist(), width)))
            near = d.argmin(1)
            yield pd.DataFrame({"pivot": near.astype(np.int32), "dist": d[np.arange(len(p)), near], "uid": p["uid"], "vec_id": p["vec_id"], "v": p["v"]})

    keyed_rows = staged(vectors.mapInPandas(index, "pivot int, dist double, uid long, vec_id long, v array<double>"), "topk-index")
    # rings of about equal counts, CELL vectors or more each while a pivot has fewer than RINGS of them; equal distances share one, however many
    cuts = keyed_rows.groupBy("pivot").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n")).collect()
    edges = {}
    for r in cuts:
        some = min(RINGS, r["n"] // CELL)
        if some > 1:
            edges[r["pivot"]] = np.array([r["cuts"][round(i * RINGS / some) - 1] for i in range(1, some)])

    @F.pandas_udf("int")
    def ring_of(pivot: pd.Series, dist: pd.Series) -> pd.Series:
        out = np.zeros(len(pivot), dtype=np.int32)
        for p, at in pivot.groupby(pivot).groups.items():
            if p in edges:
                rows = pivot.index.get_indexer(at)
                out[rows] = np.searchsorted(edges[p], dist.to_numpy()[rows], "right")
        return pd.Series(out)

    ringed = keyed_rows.withColumn("ring", ring_of("pivot", "dist"))
    spans = ringed.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    rings = pd.DataFrame([(r["pivot"], r["ring"], r["lo"], r["hi"], -(-r["n"] // CELL)) for r in spans], columns=["pivot", "ring", "lo", "hi", "parts"]).sort_values(["pivot", "ring"], ignore_index=True)
    # a crowded ring is dealt to parts by a hash of the row's number: equal rows part too
    parts_of = spark.createDataFrame(rings[["pivot", "ring", "parts"]].values.tolist(), "pivot int, ring int, parts int")
    indexed = ringed.join(F.broadcast(parts_of), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")

    batches = max(1, -(-queries.count() // QUERIES))
    asked = queries.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int"))
    pair = "query long, query_id long, q array<double>, batch int, dq double, bound double, pivot int, ring int, part int"
    r_pivot, r_ring, r_parts = rings["pivot"].to_numpy(), rings["ring"].to_numpy(), rings["parts"].to_numpy()
    r_lo, r_hi = rings["lo"].to_numpy(), rings["hi"].to_numpy()
    settled = -np.inf

    def wanted(nearest: bool):
        """The rings that a query reads: first those of its nearest pivot that has vectors, then all others that its bound doesn't exclude."""
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if not len(p):
                    continue
                q = matrix(p["q"].tolist(), width)
                d = far(np.hstack([q, np.zeros((len(q), 1))]))
                own = np.unique(r_pivot)[d[:, np.unique(r_pivot)].argmin(1)]
                dq = d[:, r_pivot]
                bound = np.where(np.isnan(p["bound"].to_numpy(dtype=float)), settled, p["bound"].to_numpy(dtype=float))
                gap = np.maximum(0, np.maximum(r_lo[None, :] - dq, dq - r_hi[None, :]) - 1e-6 * (1 + dq))
                most = (np.square(q).sum(1)[:, None] + top - gap * gap) / 2 + 1e-6 * (1 + top)
                take = (r_pivot[None, :] == own[:, None]) if nearest else (r_pivot[None, :] != own[:, None]) & (most >= bound[:, None])
                row, ring = np.nonzero(take)
                times = r_parts[ring]
                row, ring, part = np.repeat(row, times), np.repeat(ring, times), np.concatenate([np.arange(t) for t in times]) if len(times) else times
                for i in range(0, len(row), 4096):
                    a, b = row[i : i + 4096], ring[i : i + 4096]
                    yield pd.DataFrame({"query": p["query"].to_numpy()[a], "query_id": p["query_id"].to_numpy()[a], "q": p["q"].to_numpy()[a], "batch": p["batch"].to_numpy()[a], "dq": dq[a, b], "bound": bound[a], "pivot": r_pivot[b], "ring": r_ring[b], "part": part[i : i + 4096]})

        return run

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values(["dist", "vec_id"], kind="stable")
        dist, ids, uids, v = right["dist"].to_numpy(), right["vec_id"].to_numpy(), right["uid"].to_numpy(), matrix(right["v"].tolist(), width)
        q = matrix(left["q"].tolist(), width)
        qn, dq, kth = np.square(q).sum(1), left["dq"].to_numpy(), left["bound"].to_numpy().astype(np.float64)
        query, qid = left["query"].to_numpy(), left["query_id"].to_numpy()
        # annuli of STEP vectors; a block of queries takes each annulus that its bounds don't exclude, nearest first
        edges = list(range(0, len(dist), STEP))
        lo, hi = np.array([dist[e] for e in edges]), np.array([dist[min(e + STEP, len(dist)) - 1] for e in edges])
        gap = np.maximum(0, np.maximum(lo[None, :] - dq[:, None], dq[:, None] - hi[None, :]))
        most = (qn[:, None] + top - np.square(np.maximum(gap - 1e-6 * (1 + dq[:, None]), 0))) / 2 + 1e-6 * (1 + top)
        turn = np.argsort(gap, 1, kind="stable")
        none = np.iinfo(np.int64).min
        best_s, best_i = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
        for step in range(len(edges)):
            block = turn[:, step]
            live = most[np.arange(len(q)), block] >= kth
            if not live.any():
                break  # gaps only grow from here
            for b in np.unique(block[live]):
                rows = np.flatnonzero(live & (block == b))
                s, e = edges[b], min(edges[b] + STEP, len(dist))
                got = _dots(q[rows], v[s:e])
                cand = np.broadcast_to(ids[s:e], got.shape)
                got = np.where(uids[s:e][None, :] == query[rows][:, None], none, got)
                alls = np.hstack([best_s[rows], got])
                alli = np.hstack([best_i[rows], np.where(got == none, np.iinfo(np.int64).max, cand)])
                order = np.lexsort((alli, np.where(alls == none, np.iinfo(np.int64).max, -np.where(alls == none, 0, alls))), axis=1)[:, :k]
                best_s[rows], best_i[rows] = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
                last = best_s[rows][:, k - 1]
                kth[rows] = np.where(last != none, np.maximum(kth[rows], last), kth[rows])
        # what lies below the query's bound can't be among its best
        bound = left["bound"].to_numpy().astype(np.float64)[:, None]
        keep = (best_s != none) & (best_s >= bound - 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0)))
        r, c = np.nonzero(keep)
        return pd.DataFrame({"query": query[r], "query_id": qid[r], "vec_id": best_i[r, c], "score": best_s[r, c]})

    schema = "query long, query_id long, vec_id long, score long"

    def run(pairs: DataFrame) -> DataFrame:
        """Each query meets the vectors of each part that it reads."""
        key = ["pivot", "ring", "part", "batch"]
        need = pairs.select(*key).distinct()
        vecs = indexed.join(need, ["pivot", "ring", "part"]).select(*[F.col(c).alias(f"v_{c}") for c in key], "dist", "uid", "vec_id", "v")
        return pairs.groupBy(*key).cogroup(vecs.groupBy(*[f"v_{c}" for c in key])).applyInPandas(search, schema)

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    # first the nearest pivot: its k-th score bounds all later reading
    near = asked.withColumn("bound", F.lit(None).cast("double")).mapInPandas(wanted(True), pair)
    first = staged(best(run(near)), "topk-first")
    bound = first.filter(F.col("rank") == k).select("query", F.col("score").cast("double").alias("bound"))
    rest = asked.join(bound, "query", "left").mapInPandas(wanted(False), pair)
    return best(first.drop("rank").unionByName(run(rest))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = identified(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
    return exact_topk(vectors, vectors.filter(F.pmod(F.col("vec_id"), F.lit(100)) == 0))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid AS query, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.uid <> q.uid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
