"""Hard negatives, toxicity and collocations: edge cases and brute-force comparisons."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import collocations, negatives, toxicity
from siltstone.llm.common import share_of

# hard negatives


def brute_negatives(rows):
    """rows: (vec_id, label, components) that take part, every one a row of its own."""
    out = []
    v = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in e]) for i, y, e in rows]
    for a, (aid, ay, ae) in enumerate(v):
        if aid % 50:
            continue
        s = [(-sum(x * z for x, z in zip(ae, e, strict=False)), i, y) for c, (i, y, e) in enumerate(v) if c != a]
        for p, pid, _ in sorted(x for x in s if x[2] == ay)[:5]:
            good = sorted(x for x in s if x[2] != ay and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(aid, pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(good)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, uid string, score string, bucket int"


def run_negatives(spark, tmp_path, rows, monkeypatch=None):
    spark.createDataFrame([(*r, "u", "s", 3) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in negatives.op11(spark, str(tmp_path)).collect())


def vectors(n, seed, dims=6, grain=16):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, -i, 50 * (i % 4)]), [round(rng.gauss(0, 1) * grain) / grain for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def test_negatives_against_brute_force(spark, tmp_path, monkeypatch):
    """Ties, repeated ids among anchors and candidates, repeated rows, negative ids; rows with a null or a non-finite number take no part."""
    rows = vectors(260, 3)
    rows += rows[:20] + [(100, [1.0] * 6, 1)] * 4
    odd = [(50, None, 1), (50, [1.0] * 6, None), (None, [1.0] * 6, 1), (50, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (50, [float("nan")] * 6, 1), (50, [float("inf")] + [0.0] * 5, 2)]
    want = brute_negatives([(i, y, e) for i, e, y in rows])
    assert len(want) > 100
    assert run_negatives(spark, tmp_path, rows + odd) == want
    monkeypatch.setattr(negatives, "BLOCK", 64 * 6)  # many blocks, buckets and batches
    monkeypatch.setattr(negatives, "BATCHES", 2)
    assert run_negatives(spark, tmp_path, rows + odd) == want


def test_negatives_of_few_rows_and_none(spark, tmp_path):
    assert run_negatives(spark, tmp_path, []) == []
    assert run_negatives(spark, tmp_path, [(1, [1.0], 1)]) == []
    assert run_negatives(spark, tmp_path, [(50, [1.0], 1)]) == []
    few = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2)]
    assert run_negatives(spark, tmp_path, few) == [(50, 51, 1, 52, 65536, 49152)]
    zero = [(50, [0.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (53, [-1.0, 0.0], 2)]
    assert run_negatives(spark, tmp_path, zero) == [(50, 51, 1, 52, 0, 0), (50, 51, 2, 53, 0, 0)]


def test_negatives_of_vectors_of_unequal_length(spark, tmp_path):
    rows = [(50, [1.0, 1.0], 1), (51, [1.0], 1), (52, [0.75, 0.0, 5.0], 2), (53, [], 2)]
    assert run_negatives(spark, tmp_path, rows) == [(50, 51, 1, 52, 65536, 49152)]


@pytest.mark.parametrize("scale", [1, 100, 30_000, 10**7])
def test_fields_unpack_exact_scores(scale):
    rng = np.random.default_rng(scale)
    for d in (1, 5, 70):
        a, x = rng.integers(-scale, scale + 1, (9, d)), rng.integers(-scale, scale + 1, (23, d))
        fields = negatives.Fields(int(np.abs(x).max()), int(np.abs(a).sum(1).max()))
        got = fields.scores(a.astype(float), fields.pack(x.astype(float)), len(x))
        assert (got == a @ x.T).all() and got.dtype == np.int64
    assert negatives.Fields(160, 2000).fields == 2 and not negatives.Fields(10**9, 10**12).exact


def test_fields_that_do_not_fit_in_a_long():
    fields = negatives.Fields(2**40, 2**41)
    x = np.array([[2.0**40, 2.0**40]])
    with pytest.raises(OverflowError):
        fields.scores(x, fields.pack(x), 1)


# toxicity


def test_toxicity_against_brute_force(spark, sf):
    """The same models by plain loops over the labelled rows that are learned from."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    ids = spark.createDataFrame([(i,) for i, _ in labels], "i long")
    aside = {r["i"] for r in ids.filter(share_of(F.xxhash64(F.lit("toxicity"), "i"), min(0.125, toxicity.CALIBRATE / len(labels)))).collect()}

    def words(t):
        return re.sub(r"[\x00-/:-@\[-`{-\x7f]", " ", (t or "").lower()).split(" ")

    def clean(t):
        return [w for w in words(t) if w]

    c1, c2, after = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, y in labels:
        if i in aside or i not in docs:
            continue
        w = clean(docs[i])
        c1[y].update(set(w))
        pairs = set(zip([""] + w[:-1], w, strict=True))
        c2[y].update(pairs)
        after[y].update(h for h, _ in pairs)
    n = [sum(c.values()) for c in c1]

    def excess(own, other, own_all, other_all, constant):
        return max(own - constant - toxicity.RHO * own_all * (other + 1) / (other_all + 1), 0)

    e1 = [{w: e / n[c] for w in c1[c] if (e := excess(c1[c][w], c1[1 - c][w], n[c], n[1 - c], toxicity.WORD)) > 0} for c in (0, 1)]
    left = [1 - sum(e.values()) for e in e1]
    frequent = {w for c in (0, 1) for w in c1[c] if c1[c][w] > toxicity.PAIR}
    e2 = [{}, {}]
    for c in (0, 1):
        for (h, w), v in c2[c].items():
            if h in frequent and w in frequent and v > toxicity.PAIR and (e := excess(v, c2[1 - c][h, w], after[c][h], after[1 - c][h], toxicity.PAIR)) > 0:
                e2[c][h, w] = e / after[c][h]
    rest = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for (h, _), e in e2[c].items():
            rest[c][h] += e

    def p(c, h, w):
        one = e1[c].get(w, 0) + left[c] * max(c1[0][w] + c1[1][w], 1e-9) / sum(n)
        return e2[c].get((h, w), 0) + (1 - rest[c][h]) * one

    got = {r["doc_id"]: r for r in toxicity.op12(spark, sf).collect()}
    assert len(got) == len(docs) and len(e1[1]) > 5
    for i, t in docs.items():
        w = clean(t)
        want = sum(math.log(p(1, h, x) / p(0, h, x)) for h, x in zip([""] + w[:-1], w, strict=True)) / len(w) if w else math.log(left[1] / left[0])
        assert got[i]["words"] == len(w) and got[i]["ratio"] == pytest.approx(want, abs=1e-9)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.5) and 0 <= got[i]["score"] <= 1


def test_toxicity_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    got = toxicity.op12(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    share = {r["toxic"]: r["p"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] > 0.9 and share[0] < 0.01


def test_toxicity_learns_pairs(spark):
    """A pair of two ordinary words is an expression of its own."""
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(pool) for _ in range(30)]
        w = [x for k, x in enumerate(w) if not (k and x == "w2" and w[k - 1] == "w1")]
        if i % 4 == 0:
            w[10:12] = ["w1", "w2"]
            w[20:22] = ["w1", "w2"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    got = toxicity.classify(spark.createDataFrame([(1, "w5 w1 w2 w9 w1 w2 w7"), (2, "w2 w5 w1 w9 w7 w8 w1 w3 w2")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["predicted"] for r in got.collect()} == {1: 1, 2: 0}


def test_toxicity_of_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; no labels, one class only, nothing at all."""
    own = "score double, predicted int, ratio string, words string, _uid int, _seen int, _text string, key int"
    rows = [(1, "idiot fool"), (1, "idiot fool"), (2, None), (3, ""), (None, "fine day"), (4, "idiot " * 200_000), (5, "Ünïcode 漢字 ﬁ"), (6, "idiot###scum")]
    df = spark.createDataFrame([(i, t, 0.25, 7, "own", "own", 1, 2, "own", 3) for i, t in rows], f"doc_id long, text string, {own}")
    learn = spark.createDataFrame([(i, "you idiot go away idiot" if i % 2 else "a fine day to you", i % 2) for i in range(400)], "doc_id long, text string, toxic int")
    model = toxicity.train(learn.select("doc_id", "text"), learn.select("doc_id", "toxic"))
    got = toxicity.classify(df, model).collect()
    assert len(got) == len(rows) and {r["score_own"] for r in got} == {0.25} and {r["words_own"] for r in got} == {"own"} and {r["_uid_own"] for r in got} == {1}
    by = {r["doc_id"]: r for r in got}
    assert by[4]["predicted"] == by[6]["predicted"] == 1 and by[4]["words"] == 200_000 and by[2]["words"] == by[3]["words"] == 0
    assert by[2]["score"] == by[3]["score"] == by[5]["score"] < 0.5 and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.classify(df.limit(0), model).count() == 0
    for some in (learn.limit(0), learn.filter("toxic = 0"), learn.withColumn("toxic", F.lit(None).cast("int"))):
        plain = toxicity.train(some.select("doc_id", "text"), some.select("doc_id", "toxic"))
        out = toxicity.classify(df, plain).collect()
        assert len(out) == len(rows) and len({r["score"] for r in out}) == 1 and out[0]["score"] < 0.5


# collocations


def brute_collocations(docs, shown=2000):
    """docs: (text, lang)."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    out = []
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= 30}
    inside = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in cand.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        s, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -s, -a, " ".join(w).encode(), left, right))
    rank, rows = collections.Counter(), []
    for lang, s, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= shown:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def collocations_of(spark, docs, **how):
    df = spark.createDataFrame([(t, x, 1, "own") for t, x in docs], "text string, lang string, k int, phrase string").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize("budget", [collocations.BUDGET, 40])
def test_collocations_against_brute_force(spark, budget):
    """Few words that repeat much: overlaps, prefixes over the budget at every level, ties, marks, tabs, letters beyond ASCII, null texts and languages, repeated rows."""
    rng = random.Random(7)
    docs = [(None, "en"), ("", None), ("same same same same same " * 40, "en"), (". , ;\n\t", "en")]
    for i in range(1200):
        w = [rng.choice(["the", "The", "of", "É", "é", "ﬁx", "a|b", "zwölf", "of the", "x y z u", "rare%d" % i]) for _ in range(rng.randrange(40))]
        docs.append(("".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n"]) for x in w), rng.choice(["en", "de", None, "und"])))
    docs += [docs[5]] * 9
    want = brute_collocations(docs)
    assert len(want) > 25 and {r[0] for r in want} == {"en", "de", "und"}
    assert collocations_of(spark, docs, budget=budget) == want
    assert collocations_of(spark, docs, budget=budget, shown=5) == [r for r in want if r[1] <= 5]


def test_collocations_of_a_long_text_and_of_many_words(spark):
    """A text of more words than one run, in one piece, and more words than numbers of 16 bits."""
    rng = random.Random(2)
    long = " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(3 * collocations._RUN + 17))
    many = " ".join(f"n{i}" for i in range(70_000))
    docs = [(long, "en"), *[(many, "xx")] * 30]
    assert collocations_of(spark, docs) == brute_collocations(docs)


def test_collocations_of_nothing(spark):
    assert collocations_of(spark, []) == collocations_of(spark, [(None, None), ("a b c", "en")]) == []


def test_subtree_counts_from_leaf_totals():
    rows = np.array([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 0, 0], [2, 1, 0, 0], [1, 2, 3, 4]])
    got = {(k, tuple(node[:k])): int(n) for k, nodes, total, _ in collocations.subtree(rows, np.array([5, 1, 2, 7, 10]), np.ones(5, dtype=int)) for node, n in zip(nodes.tolist(), total, strict=True)}
    assert got == {(1, (1,)): 18, (1, (2,)): 7, (2, (1, 2)): 18, (2, (2, 1)): 7, (3, (1, 2, 3)): 16, (4, (1, 2, 3, 4)): 15, (4, (1, 2, 3, 5)): 1}
