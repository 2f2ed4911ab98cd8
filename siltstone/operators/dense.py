"""Dense vectors: embedders, exact search, collections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.functions.tokens import coded_tokens

DIM = 64


def hash_embedding(df: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, term slot, value): a deterministic embedding without a model. Every token adds 1 or -1 (ninth hexadecimal digit of its MD5 under 8: 1) to
    the slot that its first eight digits name."""
    each = df.select(key, F.explode(T.tokens(F.col(text))).alias("term"))
    h = F.md5(F.col("term").cast("binary"))
    slot = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
    sign = F.when(F.substring(h, 9, 1) < "8", 1.0).otherwise(-1.0)
    return each.groupBy(key, slot.alias("slot")).agg(F.sum(sign).alias("value"))


def hashed(text: Column, dim: int = DIM) -> Column:
    """The same embedding as an array, inside the row; null for a text whose vector is zero or that has no token."""
    @F.arrow_udf("array<double>")
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            words, codes, rows = coded_tokens(p)
            digests = b"".join([hashlib.md5(w).digest() for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)])
            h = np.frombuffer(digests, dtype=[("slot", ">u4"), ("sign", "u1"), ("rest", "V11")])
            at, sign = h["slot"].astype(np.int64)[codes] % dim, np.where(h["sign"] < 0x80, 1.0, -1.0)[codes]
            v = np.bincount(rows * dim + at, weights=sign, minlength=len(p) * dim)
            empty = ~v.reshape(len(p), dim).any(axis=1)
            ends = np.arange(len(p) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(v), mask=pa.array(empty))

    return embed(text)


def hash_vectors(df: DataFrame, key: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, embedding): the same embedding for each row (no shuffle); rows without one are left out."""
    return df.select(key, hashed(F.col(text), dim).alias("embedding")).filter(F.col("embedding").isNotNull())


def sparse_cosine(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str) -> DataFrame:
    """(query, doc, score): cosines of vectors in long form (key, slot, value), to 6 places."""
    def unit(df: DataFrame, key: str) -> DataFrame:
        n = df.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).filter("norm > 0")
        return df.join(n, key)

    d = unit(docs, doc_key).withColumnRenamed("value", "vd").withColumnRenamed("norm", "nd")
    q = unit(queries, query_key).withColumnRenamed("value", "vq").withColumnRenamed("norm", "nq")
    return d.join(q, "slot").groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("vd") * F.col("vq")) / (F.first("nd") * F.first("nq")), 6).alias("score"))


#: Queries ranked at once, and vectors of one piece when the queries take several blocks.
RANKED, PIECE = 256, 8192


def _best(ids: np.ndarray, q: np.ndarray, g: pd.DataFrame, k: int, metric: str, cols: list[str]) -> Iterator[pd.DataFrame]:
    """The best k rows of `g` for each query, within each group of `cols`."""
    for values, x in g.groupby(cols, dropna=False) if cols else [((), g)]:
        v, vid = np.array(x["embedding"].tolist(), dtype=np.float64), x["vec_id"].to_numpy()
        vn2 = (v * v).sum(1)
        for i in range(0, len(ids), RANKED):
            part = q[i : i + RANKED]
            qn, raw = np.sqrt((part * part).sum(1)), part @ v.T
            if metric in ("COSINE", "RAW_COSINE"):
                den = qn[:, None] * np.sqrt(vn2)[None, :]
                s = np.divide(raw, den, out=np.zeros_like(raw), where=den > 0)
                s = (s + 1) / 2 if metric == "COSINE" else s
            elif metric == "IP":
                s = (raw + 1) / 2
            else:
                s = 1 / (1 + np.maximum(qn[:, None] ** 2 + vn2[None, :] - 2 * raw, 0))
            s = np.round(s, 6)
            order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
            r = np.repeat(np.arange(len(part)), order.shape[1])
            out = {"query_id": ids[i + r]} | dict(zip(cols, [[c] * len(r) for c in (values if isinstance(values, tuple) else (values,))], strict=True))
            yield pd.DataFrame(out | {"vec_id": vid[order.ravel()], "score": s[r, order.ravel()]})


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", by: tuple[str, ...] = (), most: int = 4096) -> DataFrame:
    """(query_id, [by,] vec_id, score, rank): exact top k of each query, over all rows or within each group of `by`.

    vectors: (vec_id, embedding[, by]); queries: (query_id, q). Up to `most` queries go to every task as one matrix; more are dealt to blocks of about
    `most`, and each block meets each piece of the vectors. Tasks keep k candidates of each query (and group) for the final ranking.
    Scores to 6 places (RAW_COSINE: the cosine itself); ties to the smaller id.
    """
    cols = list(by)
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join(["query_id long", *[f"`{c}` {kind[c]}" for c in cols], "vec_id long", "score double"])
    names = ["query_id", *cols, "vec_id", "score"]
    vectors, n = vectors.select(*cols, "vec_id", "embedding"), queries.count()
    if n <= most:
        rows = queries.select("query_id", "q").collect()
        ids, q = np.array([r["query_id"] for r in rows]), np.array([r["q"] for r in rows], dtype=np.float64)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p) and len(ids):
                    yield from _best(ids, q, p, k, metric, cols)

        got = vectors.mapInPandas(run, schema)
    else:
        blocks, pieces = -(-n // most), max(1, -(-vectors.count() // PIECE))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"), every(pieces).alias("_piece"))
        held = vectors.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).cast("int").alias("_piece"), every(blocks).alias("_block"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=names)
            q = np.array(left["q"].tolist(), dtype=np.float64)
            return pd.concat(list(_best(left["query_id"].to_numpy(), q, right, k, metric, cols)), ignore_index=True)

        got = asked.groupBy("_block", "_piece").cogroup(held.groupBy("_block", "_piece")).applyInPandas(meet, schema)
    w = W.partitionBy("query_id", *cols).orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _nearest(ids: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The ids of the n nearest rows of `c` by cosine (to 6 places; ties to the smaller id) for each row of `v`."""
    norm = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
    raw = v @ c.T
    s = np.round(np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0), 6)
    return ids[np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]]


#: Lists of an inverted index at most: their centroids go to every task.
LISTS = 4096


def in_lists(vectors: DataFrame, centroids: DataFrame, n: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vectors` (key, vector) with the lists they belong to: a row for each of the n nearest centroids (list, c), at most LISTS of them. Nothing is shuffled."""
    rows = centroids.select(F.col("list").cast("long").alias("list"), "c").limit(LISTS + 1).collect()
    if len(rows) > LISTS:
        raise ValueError(f"more than {LISTS} lists")
    ids, c = np.array([r["list"] for r in rows], dtype=np.int64), np.array([r["c"] for r in rows], dtype=np.float64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            # as many rows at once as RANKED: a task holds no larger matrix of rows by lists
            for i in range(0, len(p) if len(ids) else 0, RANKED):
                x = p.iloc[i : i + RANKED]
                near = _nearest(ids, c, np.array(x[vector].tolist(), dtype=np.float64), n)
                yield pd.DataFrame({key: np.repeat(x[key].to_numpy(), near.shape[1]), "list": near.ravel(), vector: x[vector].repeat(near.shape[1]).to_numpy()})

    return vectors.select(key, vector).mapInPandas(run, f"{key} long, list long, {vector} array<double>")


def inverted_search(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int = 16, metric: str = "COSINE", part: int = PIECE) -> DataFrame:
    """(query_id, vec_id, score, rank): approximate top k by an inverted index: vectors lie in the list of their nearest centroid, and a query reads the `probes` lists nearest to it.

    Scores of what is read are exact. Lists with more than about `part` vectors are dealt to parts, each of which meets the list's queries, so no list is one task."""
    held = in_lists(vectors, centroids)
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    sizes = F.broadcast(sizes)  # a row for each list, at most LISTS
    held = held.join(sizes, "list").withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")).drop("_parts")
    asked = in_lists(queries.select("query_id", F.col("q").alias("embedding")), centroids, probes, "query_id").withColumnRenamed("embedding", "q")
    asked = asked.join(sizes, "list").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        q = np.array(left["q"].tolist(), dtype=np.float64)
        return pd.concat(list(_best(left["query_id"].to_numpy(), q, right, k, metric, [])), ignore_index=True)

    got = asked.groupBy("list", "_part").cogroup(held.groupBy("list", "_part")).applyInPandas(meet, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def validate(vectors: DataFrame, dims: tuple[int, ...] = (DIM,), least: float = 1e-8) -> DataFrame:
    """(vec_id, dim, problem): null where a vector has an allowed length, finite components and is not zero."""
    e = F.col("embedding")
    problem = F.when(e.isNull(), "missing").when(~F.size(e).isin(*dims), "dimension").when(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.forall(e, lambda x: F.abs(x) <= least), "zero")
    return vectors.select("vec_id", F.size(e).cast("long").alias("dim"), problem.alias("problem"))


def merge_by_score(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query over all collections."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("merged_rank", F.row_number().over(w).cast("long")).filter(F.col("merged_rank") <= k)


def merge_round_robin(found: DataFrame, k: int) -> DataFrame:
    """First of each collection in order, then second of each, until k."""
    w = W.partitionBy("query_id").orderBy("rank", "collection")
    return found.withColumn("merged_rank", F.row_number().over(w).cast("long")).filter(F.col("merged_rank") <= k)


def list_collections(indexes: DataFrame) -> DataFrame:
    """indexes: (collection, vectors, doc_id, has_sparse, dim, created). Most vectors first."""
    return indexes.groupBy("collection").agg(F.sum("vectors").cast("long").alias("vectors"), F.count_distinct("doc_id").alias("documents"), F.bool_or("has_sparse").alias("has_sparse"), F.min("dim").alias("dim"), F.max("created").alias("created")).orderBy(F.desc("vectors"), "collection")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Mean, population variance, L2 norm and share of components beyond 1e-6 of each vector, to 6 places."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    mean = F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(e, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    share = F.size(F.filter(e, lambda x: F.abs(x) > 1e-6)) / n
    return vectors.select("vec_id", F.round(mean, 6).alias("mean"), F.round(var, 6).alias("variance"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(share, 6).alias("nonzero_share"))
