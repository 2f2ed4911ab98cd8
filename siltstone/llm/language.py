"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For every bit one binary classifier over hashed n-grams of characters tells the languages
with a 1 from those with a 0. Decoding sums, bit by bit, the classifier's loss against a codeword, weighted by how well that
bit did on training texts, and takes the nearest codeword; a small gap to the second nearest is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import held_out, kept, set_aside, share_of, small_batches
from siltstone.llm.textvec import code_points, mix

#: Buckets of n-gram hashes; characters in an n-gram; training texts of a language (expected: drawn by a hash at a fixed rate);
#: gap of mean losses below which a result is ambiguous.
BUCKETS, ORDERS, TEXTS, GAP = 1 << 14, (1, 2, 3, 4), 2000, 0.05
UNKNOWN = "und"
#: Mean loss without any evidence: a nearest codeword beyond it has the weighted bits against it.
CHANCE = float(np.log(2))
#: Languages that a model can hold: one row of counters a half of each, in every task and in the driver.
LANGUAGES = 512
RESULTS = ["lang_pred", "score", "ambiguous", "second_lang", "loss"]


def has_letter(text: str | None) -> bool:
    """Whether any character is of Unicode category L."""
    return any(c.isalpha() for c in text or "")



def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1 (one row a language). All splits of the languages in two for up to 6 languages; else rows of
    pseudo-random balanced columns, 12 for each doubling of n."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=float).T
    rng, cols = np.random.default_rng(7), []
    for _ in range(12 * int(np.ceil(np.log2(n)))):
        c = np.ones(n)
        c[rng.permutation(n)[: n // 2]] = -1
        cols.append(c)
    return np.array(cols).T


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of a text: lower case, runs of what is no letter as one blank, a blank at both ends."""
    body = re.sub(r"[\W\d_]+", " ", text.lower())
    c = code_points(f" {body.strip()} ").astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of an n-gram
    trust: np.ndarray  # bits, sum 1

    def decide(self, text: str | None) -> tuple[str, float, bool, str | None, float | None]:
        """Language, score from 0 to 1, whether it is ambiguous, the runner-up, and the loss against the nearest codeword. Null, no letter, or no
        language learned: und, 0, false, null, null. Equal losses: the language first in order."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False, None, None
        g = grams(text)
        total = self.weights[g].sum(0) if len(g) < BUCKETS // 4 else np.bincount(g, minlength=BUCKETS) @ self.weights
        margin = total / np.sqrt(len(g))
        loss = np.logaddexp(0, -self.codes * margin) @ self.trust
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * 2)
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / p.sum()), bool(gap < GAP), self.languages[order[1]] if len(order) > 1 else None, float(loss[order[0]])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", texts: int = TEXTS) -> Model:
    """Learn from the rows of `docs` with a text and a language: about `texts` of each language, drawn by a hash of the id at a rate fixed
    by the language's count. The driver gets n-gram counts by language and by half (one half weighs the bits), at most BUCKETS a language and half.

    Null texts and languages, and texts without a letter, teach nothing; repeated rows count each; an empty table gives a model without languages.
    More than LANGUAGES languages: ValueError."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), dtype=np.float32), np.ones(1))
    turn = {x: i for i, x in enumerate(languages)}
    share = None
    for x in languages:
        c = (F.col("lang") == x) & share_of(F.xxhash64(F.lit("language"), "_id", "text"), texts / sizes[x])
        share = c if share is None else share | c

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2 * len(languages), BUCKETS), dtype=np.int64)
        for p in parts:
            for i, t, x in zip(p["_id"], p["text"], p["lang"], strict=True):
                if has_letter(t):
                    sums[2 * turn[x] + int(len(t) % 4 == 0)] += np.bincount(grams(t), minlength=BUCKETS)
        r, c = np.nonzero(sums)
        yield pd.DataFrame({"part": r.astype(np.int32), "bucket": c.astype(np.int32), "n": sums[r, c]})

    got = rows.filter(share).mapInPandas(count, "part int, bucket int, n long").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((2 * len(languages), BUCKETS))
    sums[got["part"], got["bucket"]] = got["n"]
    both = sums.reshape(len(languages), 2, BUCKETS)
    codes = codewords(len(languages))

    def fit(counts: np.ndarray) -> np.ndarray:
        rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)  # each language weighs alike in a bit
        return np.stack([np.log(rate[codes[:, b] > 0].mean(0) / rate[codes[:, b] < 0].mean(0)) if (codes[:, b] < 0).any() else np.zeros(BUCKETS) for b in range(codes.shape[1])], 1)

    # a bit is trusted as far as it tells the languages apart on the other half
    half = fit(both[:, 0])
    other = both[:, 1] / np.maximum(both[:, 1].sum(1, keepdims=True), 1)
    trust = np.maximum(np.min(codes * (other @ half), 0), 0.01)
    return Model(languages, codes, fit(both.sum(1)).astype(np.float32), trust / trust.sum())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score, ambiguous, second_lang and loss to `docs` (see `Model.decide`); whole texts, no shuffle.

    One row for each row, repeated ones included. Columns of `docs` that have a result's name go on as name_own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    out = "lang_pred string, score double, ambiguous boolean, second_lang string, loss double"

    @F.pandas_udf(out)
    def decide(x: pd.Series) -> pd.DataFrame:
        kept("language")
        return pd.DataFrame([shared.value.decide(t) for t in x], columns=RESULTS)

    rows = set_aside(docs, [*RESULTS, "_lang"])
    return rows.withColumn("_lang", decide(text)).select(*[rows[f"`{c}`"] for c in rows.columns], *[F.col("_lang")[r].alias(r) for r in RESULTS])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "second_lang")
