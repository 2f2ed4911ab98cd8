"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages (runs of WIDTH code points; the last may be shorter). Every passage is encoded: shares of
character classes and of their bigrams, and how often words return soon after. A small network maps each encoding to a hidden vector;
gated attention, tanh(Vh) * sigmoid(Uh), weighs the passages; the weighted mean is scored. Only documents have labels; what
passages matter is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_ids, held_out, kept, set_aside, small_batches
from siltstone.llm.textvec import code_points, word_hashes

#: Code points of a passage; labelled documents to learn from, at most; hidden and attention units; training rounds.
WIDTH, DOCUMENTS, HIDDEN, GATES, EPOCHS = 512, 4000, 24, 12, 40
#: Rows of one document to learn from, at most: a longer text's passages are averaged in so many even runs, so that each of them counts. Scores use the passages themselves.
PASSAGES = 64
THRESHOLD = 0.7
LAGS = (1, 2, 3, 5, 8)

#: Character classes: letters by case, digits, white space, each frequent mark, and the rest.
MARKS = ".,;:!?|*#$%&-_=/'\"()<>{}[]@"
_CLASS = np.full(0x300, 5, dtype=np.uint8)
for _i in range(0x300):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 6 + MARKS.index(_c) if _c in MARKS else 5
CLASSES = 6 + len(MARKS)
#: Coarse classes for bigrams.
_COARSE = np.array([0, 1, 2, 3, 4, 5, *[6 + i % 8 for i in range(len(MARKS))]], dtype=np.uint8)
COARSE = 14
FEATURES = CLASSES + COARSE * COARSE + len(LAGS) + 2


def passages(text: str | None) -> np.ndarray:
    """One encoded row for each passage of the whole text; a null or empty text is one passage of zeros."""
    c = code_points(text or "")
    n = len(c)
    if not n:
        return np.zeros((1, FEATURES), dtype=np.float32)
    k = -(-n // WIDTH)
    kind = np.where(c < 0x300, _CLASS[np.minimum(c, 0x2FF)], 5).astype(np.int64)
    at = np.arange(n) // WIDTH
    size = np.bincount(at, minlength=k).astype(np.float32)[:, None]
    ones = np.bincount(at * CLASSES + kind, minlength=k * CLASSES).reshape(k, CLASSES) / size
    rough = _COARSE[kind].astype(np.int64)
    twos = np.bincount(at[1:] * COARSE * COARSE + rough[:-1] * COARSE + rough[1:], minlength=k * COARSE * COARSE).reshape(k, COARSE * COARSE) / size
    w, starts, ends = word_hashes(c)
    home = starts // WIDTH
    words = np.maximum(np.bincount(home, minlength=k), 1).astype(np.float32)
    again = np.zeros((k, len(LAGS) + 2), dtype=np.float32)
    for j, lag in enumerate(LAGS):
        if len(w) > lag:
            again[:, j] = np.bincount(home[lag:], weights=w[lag:] == w[:-lag], minlength=k) / words
    again[:, -2] = np.bincount(home, weights=ends - starts, minlength=k) / words / 10
    again[:, -1] = np.minimum(words / 100, 1)
    return np.hstack([np.sqrt(ones), np.sqrt(twos), again]).astype(np.float32)


def pooled(x: np.ndarray, most: int = PASSAGES) -> np.ndarray:
    """At most `most` rows: the means of even runs of the rows of `x`, none of which is left out."""
    if len(x) <= most:
        return x
    edges = np.linspace(0, len(x), most + 1).astype(int)
    return (np.add.reduceat(x.astype(np.float64), edges[:-1]) / np.diff(edges)[:, None]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple:
        """x: passages, bag: the bag of each, in order. Scores of the bags, and what training needs."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * g) @ p["a"]
        first = np.searchsorted(bag, np.arange(bags))
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        e /= np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(e[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, (x, h, t, g, e, z)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), 256):
            rows = [passages(t) for t in texts[i : i + 256]]
            bag = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            out.append(self.forward(np.concatenate(rows), bag, len(rows))[0])
        return np.concatenate(out) if out else np.zeros(0)


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Adam on the cross-entropy of the bags' labels, with weight decay. One class only, or no bag: its share is every score."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags) if bags else np.zeros((1, FEATURES), dtype=np.float32)
    p = {"w": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATES)), "u": rng.normal(0, 0.3, (HIDDEN, GATES)), "a": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = Model(rows.mean(0), np.maximum(rows.std(0), 0.02), p)
    if len(set(labels.tolist())) < 2:
        p["c"][:] = 0
        p["d"][:] = 0.0 if not len(labels) else 4.0 if labels[0] else -4.0
        return model
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            sizes = [len(bags[j]) for j in pick]
            bag = np.repeat(np.arange(len(pick)), sizes)
            y, (x, h, t, g, e, z) = model.forward(np.concatenate([bags[j] for j in pick]), bag, len(pick))
            dy = (y - labels[pick]) / len(pick)
            dz = dy[:, None] * p["c"]
            dh = e[:, None] * dz[bag]
            de = (dz[bag] * h).sum(1)
            first = np.searchsorted(bag, np.arange(len(pick)))
            da = e * (de - np.add.reduceat(e * de, first)[bag])
            dt, dg = da[:, None] * p["a"] * g * (1 - t * t), da[:, None] * p["a"] * t * g * (1 - g)
            dh += dt @ p["v"].T + dg @ p["u"].T
            dw = dh * (1 - h * h)
            grad = {"w": x.T @ dw + 1e-4 * p["w"], "b": dw.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ da, "c": z.T @ dy + 1e-4 * p["c"], "d": np.array([dy.sum()])}
            step += 1
            for k, v in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS) -> Model:
    """Learn from at most `documents` documents that have a label (labels: doc_id, quality 0 or 1; of several labels of a document the least
    counts; others are ignored). Of several rows of a document that with the least text hash counts. At most PASSAGES encoded rows of each reach the driver (see `pooled`).

    Null texts are empty; null ids and labels teach nothing; without a label every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = bounded_ids(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", documents)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("quality")
        for p in parts:
            out = []
            for t in p["text"]:
                out.append(pooled(passages(t)).astype(np.float16).tobytes())
            yield pd.DataFrame({"doc_id": p["doc_id"], "quality": p["quality"], "rows": out})

    # at most `documents` rows of ids and labels are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(encode, f"doc_id {kind}, quality int, rows binary").collect(), key=lambda r: r["doc_id"])
    bags = [np.frombuffer(bytes(r["rows"]), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got]
    return fit(bags, np.array([r["quality"] for r in got], dtype=float))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0) to `docs`; whole texts, no shuffle.

    One row for each row, repeated ones included; null and empty texts are one passage of zeros and get its score. Columns of `docs` named like a
    result go on as name_own. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        kept("quality")
        return pd.Series(shared.value.score(x.tolist()))

    rows = set_aside(docs, ["score", "predicted"])
    return rows.withColumn("score", score(text)).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out_of = held_out(F.col("doc_id"))
    model = train(docs.filter(~out_of), labels.filter(~out_of))
    return classify(docs, model).select("doc_id", out_of.alias("held_out"), "score", "predicted")
