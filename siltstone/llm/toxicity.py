"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

Two language models, one of toxic and one of ordinary documents, are compared on every text: the score grows with
(log P_toxic - log P_ordinary) / words. Counts are contexts, as Kneser and Ney count them: the documents of a class that hold a word, and those that hold a pair.
With c its own class, o the other, N sums of counts and [x] = max(x, 0):

    P_c(w)     = [c(w) - d_c(w)] / N_c + g_c S(w)                 S: counts of both classes together, the shared backoff
    P_c(w | h) = [c(hw) - d_c(hw)] / c(h.) + g_c(h) P_c(w)        g: what the discounts leave, so that each sums to 1

The discount d is a constant and RHO times what the other class's rate would let expect. So an expression keeps mass of its own only where its class has
clearly more of it; all others (rare expressions above all) have the shared counts' probability in both models and do not tilt the comparison. Only kept
expressions need a weight: the logarithm of a ratio for each such word, history and pair.

Counts cover every labelled document that is learned from (but the share that sets the scale, at most about CALIBRATE of them). Count tables and weights are
DataFrames that grow with the corpus and are joined by key; the driver gets sums, filters of 2^BITS bits and the calibration rows. Keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import broadcast_if, kept, set_aside, share_of, small_batches, staged
from siltstone.llm.textvec import mix

#: Constant discount of words and of pairs, and the multiple of the other class's expectation that is discounted too.
WORD, PAIR, RHO = 3.0, 6.0, 4.0
#: Labelled documents that set the scale of the score: about an eighth of them, at most about so many.
CALIBRATE = 8192
#: Bits of a filter of keys (a false hit costs a row of a join, never a result); counts held in a task before they go on; words a worker remembers.
BITS, HELD, WORDS = 24, 1_000_000, 400_000
#: Weights, or labels, up to this many rows are broadcast; more are joined by a shuffle.
SMALL = 2_000_000
THRESHOLD = 0.5
RESULTS = ["score", "predicted", "ratio", "words"]

#: ASCII letters and digits and all bytes of other characters make words; what else ASCII has parts them.
_PARTED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_START = np.uint64(0x5EED)
_ODD, _HISTORY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA5A5A5A5A5A5A5A5)


class Hashes(dict):
    """Hash of each word met by this worker; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_keys(text: str | None) -> np.ndarray:
    """Keys of a text's words in order, letters in lower case; none for a null text."""
    known = kept("toxicity", Hashes)
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTED).split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def histories(w: np.ndarray) -> np.ndarray:
    """The word before each word; a fixed key before the first."""
    return np.concatenate([[_START], w[:-1]]).astype(np.uint64) if len(w) else w


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _ODD + w)


def history_keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _HISTORY)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS bits of the low bits of column `key`: 2 MB, whatever the table."""
    at = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    rows = keys.select(F.shiftright(at, 5).alias("at"), F.expr("shiftleft(1L, cast(key & 31 AS int))").alias("bit"))
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 5), dtype=np.uint32)
    out[got["at"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.uint64).astype(np.uint32)
    return out


def _totals(columns: list[list[np.ndarray]], names: list[str]) -> pd.DataFrame:
    """How often each key comes in each of the columns."""
    parts = [np.concatenate(c) if c else np.zeros(0, dtype=np.uint64) for c in columns]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    kind = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    n = np.bincount(kind * len(keys) + at, minlength=len(keys) * len(parts)).reshape(len(parts), -1)
    return pd.DataFrame({"key": keys.view(np.int64)} | {name: n[i].astype(np.int32) for i, name in enumerate(names)})


def _count_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word, of each class: documents that hold it (c0, c1) and pairs of it and a next word, by document (f0, f1)."""
    names, held, size = ["c0", "c1", "f0", "f1"], [[], [], [], []], 0
    for p in parts:
        for text, y in zip(p["text"], p["toxic"], strict=True):
            w = word_keys(text)
            h = histories(w)
            _, first = np.unique(pair_keys(h, w), return_index=True)
            held[y].append(np.unique(w))
            held[2 + y].append(h[first])
            size += len(first) + len(held[y][-1])
            if size >= HELD:
                yield _totals(held, names)
                held, size = [[], [], [], []], 0
    if size:
        yield _totals(held, names)


def _pair_counter(bits):
    """For each pair of words that both pass the filter, documents of each class that hold it."""

    def totals(held: tuple[list, list, list]) -> pd.DataFrame:
        h, w, y = (np.concatenate(x) for x in held)
        _, first, at = np.unique(pair_keys(h, w), return_index=True, return_inverse=True)
        n = [np.bincount(at, weights=y == c, minlength=len(first)).astype(np.int32) for c in (0, 1)]
        return pd.DataFrame({"h": h[first].view(np.int64), "w": w[first].view(np.int64), "c0": n[0], "c1": n[1]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = ([], [], []), 0
        for p in parts:
            for text, y in zip(p["text"], p["toxic"], strict=True):
                w = word_keys(text)
                good = in_filter(bits.value, w)
                h, before = histories(w), np.concatenate([[False], good[:-1]])
                h, w = h[good & before], w[good & before]
                _, first = np.unique(pair_keys(h, w), return_index=True)
                for x, new in zip(held, (h[first], w[first], np.full(len(first), y, dtype=np.int8)), strict=True):
                    x.append(new)
                size += len(first)
                if size >= HELD:
                    yield totals(held)
                    held, size = ([], [], []), 0
        if size:
            yield totals(held)

    return run


@dataclass
class Model:
    """weights: (key, weight) of words, histories and pairs; bits: filter of their keys; base: the ratio of a text without any; slope and middle of the score."""

    weights: DataFrame
    bits: np.ndarray
    base: float
    slope: float
    middle: float


def _excess(own: Column, other: Column, own_all: Column, other_all: Column, constant: float) -> Column:
    """What the discount leaves of a count."""
    return F.greatest(own - constant - RHO * own_all * (other + 1) / (other_all + 1), F.lit(0.0))


def count(learn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Count tables of the rows (text, toxic) of `learn`, over all of them: words (key, c0, c1, f0, f1) and pairs (h, w, c0, c1) that a class has in more documents than are discounted."""
    spark = learn.sparkSession
    words = learn.mapInPandas(_count_words, "key long, c0 int, c1 int, f0 int, f1 int").groupBy("key").agg(*[F.sum(x).alias(x) for x in ("c0", "c1", "f0", "f1")])
    words = staged(words, "toxicity-words")
    bits = spark.sparkContext.broadcast(filter_of(words.filter(F.greatest("c0", "c1") > PAIR)))
    pairs = learn.mapInPandas(_pair_counter(bits), "h long, w long, c0 int, c1 int").groupBy("h", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return words, staged(pairs.filter(F.greatest("c0", "c1") > PAIR), "toxicity-pairs")


def weights_of(words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, float]:
    """(key, weight) of the expressions that keep mass of their own in a class, and the ratio of all others. Joins by key; nothing reaches the driver but sums."""
    spark = words.sparkSession
    n = words.agg(F.coalesce(F.sum("c0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("c1"), F.lit(0)).alias("n1")).first()
    n0, n1 = n["n0"], n["n1"]
    if not n0 or not n1:
        return spark.createDataFrame([], "key long, weight double"), 0.0
    a, b = F.lit(float(n0)), F.lit(float(n1))
    e = words.select("key", "c0", "c1", "f0", "f1", (_excess(F.col("c0"), F.col("c1"), a, b, WORD) / a).alias("e0"), (_excess(F.col("c1"), F.col("c0"), b, a, WORD) / b).alias("e1"))
    left = e.agg((1 - F.sum("e0")).alias("g0"), (1 - F.sum("e1")).alias("g1")).first()
    shared = (F.col("c0") + F.col("c1")) / F.lit(float(n0 + n1))
    e = e.withColumns({"p0": F.col("e0") + left["g0"] * shared, "p1": F.col("e1") + left["g1"] * shared})
    base = float(np.log(left["g1"] / left["g0"]))
    of_words = e.filter("e0 > 0 OR e1 > 0").select("key", (F.log(F.col("p1") / F.col("p0")) - base).alias("weight"))

    before = words.select(F.col("key").alias("h"), F.col("f0").cast("double").alias("all0"), F.col("f1").cast("double").alias("all1"))
    x = pairs.join(before, "h").withColumns({"e0": _excess(F.col("c0"), F.col("c1"), F.col("all0"), F.col("all1"), PAIR), "e1": _excess(F.col("c1"), F.col("c0"), F.col("all1"), F.col("all0"), PAIR)})
    x = x.filter("e0 > 0 OR e1 > 0").withColumns({f"e{c}": F.when(F.col(f"e{c}") > 0, F.col(f"e{c}") / F.col(f"all{c}")).otherwise(0.0) for c in (0, 1)})
    x = staged(x.select("h", "w", "e0", "e1"), "toxicity-excess")
    after = x.groupBy("h").agg((1 - F.sum("e0")).alias("g0"), (1 - F.sum("e1")).alias("g1"))
    y = x.join(after, "h").join(e.select(F.col("key").alias("w"), "p0", "p1"), "w")
    ratio = F.log((F.col("e1") + F.col("g1") * F.col("p1")) / (F.col("e0") + F.col("g0") * F.col("p0")))

    @F.pandas_udf("long")
    def of_history(h: pd.Series) -> pd.Series:
        return pd.Series(history_keys(h.to_numpy().view(np.uint64)).view(np.int64))

    @F.pandas_udf("long")
    def of_pair(h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(pair_keys(h.to_numpy().view(np.uint64), w.to_numpy().view(np.uint64)).view(np.int64))

    own = F.log(F.col("g1") / F.col("g0"))
    of_pairs = y.select(of_pair("h", "w").alias("key"), (ratio - own - F.log(F.col("p1") / F.col("p0"))).alias("weight"))
    rows = of_words.unionByName(after.select(of_history("h").alias("key"), own.alias("weight"))).unionByName(of_pairs)
    return staged(rows, "toxicity-weights"), base


def _ratios(rows: DataFrame, weights: DataFrame, bits: np.ndarray, base: float, text: str) -> DataFrame:
    """`rows` without the text, with columns words and ratio. A text goes through one Arrow function; its few keys that pass the filter are joined with the weights."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("words long, keys array<long>, times array<int>")
    def look(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            w = word_keys(t)
            h = histories(w)
            keys = np.concatenate([w, history_keys(h), pair_keys(h, w)])
            keys, times = np.unique(keys[in_filter(shared.value, keys)], return_counts=True)
            out.append((len(w), keys.view(np.int64), times.astype(np.int32)))
        return pd.DataFrame(out, columns=["words", "keys", "times"])

    seen = rows.withColumn("_seen", look(text)).withColumn("_uid", F.monotonically_increasing_id()).drop(text)
    seen = staged(seen, "toxicity-seen")
    hits = seen.select("_uid", F.explode(F.arrays_zip("_seen.keys", "_seen.times")).alias("_k")).select("_uid", F.col("_k.keys").alias("key"), F.col("_k.times").alias("times"))
    sums = hits.join(broadcast_if(weights, SMALL), "key").groupBy("_uid").agg(F.sum(F.col("times") * F.col("weight")).alias("_sum"))
    ratio = base + F.coalesce("_sum", F.lit(0.0)) / F.greatest(F.col("_seen.words"), F.lit(1))
    return seen.join(sums, "_uid", "left").withColumns({"words": F.col("_seen.words"), "ratio": ratio}).drop("_uid", "_seen", "_sum")


def _scale(ratio: np.ndarray, toxic: np.ndarray, base: float) -> tuple[float, float]:
    """Slope and middle of a logistic curve of the ratio, both classes weighing alike; a fixed curve where a class is missing."""
    if not toxic.any() or toxic.all():
        return 400.0, base + 0.005
    unit = max(float(ratio.std()), 1e-4)
    x, y = (ratio - base) / unit, toxic.astype(float)
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())) / len(x)
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    a = max(a, 1e-3)
    return a / unit, base - b / a * unit


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", toxic: str = "toxic") -> Model:
    """Learn from every row of `docs` with a label 0 or 1 in `labels` (joined by id_col).

    Null ids and labels teach nothing; a document that is repeated, or labelled twice, counts each time; null and empty texts have no words. Without
    documents of both classes no expression has a weight, and every text scores alike."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(toxic).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(toxic).cast("int").alias("toxic"))
    n = known.count()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(broadcast_if(known, SMALL, n), "_id")
    if n > SMALL:
        rows = staged(rows, "toxicity-labelled")
    aside = share_of(F.xxhash64(F.lit("toxicity"), "_id"), min(0.125, CALIBRATE / max(n, 1)))
    weights, base = weights_of(*count(rows.filter(~aside).select("text", "toxic")))
    bits = filter_of(weights)
    got = _ratios(rows.filter(aside).select("text", "toxic"), weights, bits, base, "text").select("ratio", "toxic").toPandas()
    slope, middle = _scale(got["ratio"].to_numpy(dtype=float), got["toxic"].to_numpy(dtype=int) == 1, base)
    return Model(weights, bits, base, slope, middle)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with score (0 to 1, higher: toxic is likelier), predicted (score >= THRESHOLD), ratio (log-likelihoods' difference a word) and words.

    One row for each row, repeated ones included; whole texts. A null text, or one without a word, has the ratio of a text without kept expressions. Columns
    of `docs` that have a result's name go on as name_own."""
    small_batches(docs.sparkSession)
    rows = set_aside(docs, [*RESULTS, "_seen", "_uid", "_sum"])
    got = _ratios(rows, model.weights, model.bits, model.base, rows.columns[docs.columns.index(text)])
    score = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -model.slope * (F.col("ratio") - model.middle)))))
    return got.withColumns({"score": score, "predicted": (score >= THRESHOLD).cast("int")})


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 0 on division by 5 (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "ratio", "words")
