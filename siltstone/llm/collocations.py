"""Phrase collocations from depth-truncated suffix subtrees.

Every word of a text starts a suffix: the word and up to DEPTH - 1 next words of its piece. The suffixes are parted vertically, by their prefixes, into groups that
fit a memory budget: first by their first word; a prefix with more suffixes than the budget is extended by its next word, and again up to DEPTH words, where
all suffixes of a prefix are equal and are one row with a count. Each group then builds the subtree of its prefixes independently: its sorted leaves are the
distinct suffixes with their totals, an inner node of depth d is a run of leaves that share d words, and its frequency is the sum of their totals.

Words that are too rare to be in any candidate end a suffix: a counting filter of 2^FILTER counters, which never counts too little, says which.
Tasks combine equal suffixes before the shuffle and ship them in blocks with the block's own words. The driver gets the plan alone: at most
(levels + 1) * slots counters, slots growing as words / BUDGET. What follows the subtrees (cuts, containment, ranks) are joins and aggregations of
candidates, in whole numbers and decimals.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, staged
from siltstone.llm.textvec import mix

DEPTH, LEAST, SHOWN = 4, 30, 2000
#: Suffixes of a group at most (but for one suffix that is repeated more often), words held in a task before they are combined, words that a task remembers.
BUDGET, HELD, WORDS = 2_000_000, 2_000_000, 500_000
#: Counters of the filter of rare words; least slots of prefixes at a level; shares of a language's candidates.
FILTER, SLOTS, SHARES = 22, 1 << 12, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: `.` for all marks that end a piece (no word holds one), a space for a tab.
_PIECES = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, A-Z in lower case; b"." wherever a piece ends. A null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PIECES).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\0" + word)


class Slots(dict):
    """Filter counter of each word of a language; -1 for the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({b".": -1})
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        self[word] = at = word_hash(self.lang, word) & ((1 << FILTER) - 1)
        return at


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each language (slot -1), and how often each counter of the filter is met, over all languages."""
    sums = np.zeros(1 << FILTER, dtype=np.int64)
    known: dict[str, Slots] = {}
    totals: dict[str, int] = {}
    for p in parts:
        for lang, text in zip(p["lang"], p["text"], strict=True):
            words = tokens(text)
            if sum(map(len, known.values())) > WORDS:
                known.clear()
            slot = known.setdefault(lang, Slots(lang))
            at = np.fromiter(map(slot.__getitem__, words), dtype=np.int64, count=len(words))
            at = at[at >= 0]
            np.add.at(sums, at, 1) if len(at) < 1 << 16 else sums.__iadd__(np.bincount(at, minlength=1 << FILTER))
            totals[lang] = totals.get(lang, 0) + len(at)
    if totals:
        yield pd.DataFrame({"lang": list(totals), "slot": -1, "n": list(totals.values())}).astype({"slot": "int32", "n": "int64"})
    at = np.flatnonzero(sums)
    for i in range(0, len(at), 1 << 18):
        yield pd.DataFrame({"lang": None, "slot": at[i : i + (1 << 18)].astype(np.int32), "n": sums[at[i : i + (1 << 18)]]})


@dataclass
class Plan:
    """Which group takes a suffix. frequent: filter bits; hot[d]: slots of prefixes of d + 1 words that are extended; group[d]: groups of the others."""

    frequent: np.ndarray
    hot: list[np.ndarray]
    group: list[np.ndarray]

    def keys(self, hashes: list[np.ndarray]) -> list[np.ndarray]:
        """Slots of the prefixes of 1, 2 ... words of suffixes, given the hashes of their words (0 where a suffix is over)."""
        k, out = np.zeros(len(hashes[0]), dtype=np.uint64), []
        for h in hashes:
            k = mix(k * _ODD + h)
            out.append((k & np.uint64(len(self.hot[0]) - 1)).astype(np.int64))
        return out

    def place(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Group and level (words of the prefix that decided) of suffixes."""
        level = np.ones(len(hashes[0]), dtype=np.int64)
        slots = self.keys(hashes)
        group = self.group[0][slots[0]].copy()
        more = self.hot[0][slots[0]]
        for d in range(1, DEPTH):
            if not more.any():
                break
            level[more] = d + 1
            group[more] = self.group[d][slots[d][more]]
            more = more & self.hot[d][slots[d]]
        return group, level


class Vocabulary(dict):
    """Numbers of a language's words in this task: 0 for the end of a piece and for words too rare for a candidate."""

    def __init__(self, lang: str, frequent: np.ndarray):
        super().__init__({b".": 0})
        self.lang, self.frequent, self.words, self.hashes = lang, frequent, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        at = h & ((1 << FILTER) - 1)
        if not self.frequent[at >> 3] >> (at & 7) & 1:
            self[word] = 0
            return 0
        self[word] = i = len(self.words)
        self.words.append(word)
        self.hashes.append(h)
        return i


#: Words of one run of a text: a run's new words always have numbers left, of 16 bits.
_RUN = 1 << 15


class _Held:
    """Runs of one language's texts in a task, until they are combined."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.vocabulary, self.runs, self.starts, self.size = Vocabulary(lang, frequent), [], [], 0

    def add(self, words: list[bytes], new: int) -> None:
        """The first `new` words start suffixes; the others only end them."""
        self.runs.append(np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.uint64, count=len(words)))
        self.starts.append(np.arange(len(words)) < new)
        self.runs.append(np.zeros(1, dtype=np.uint64))
        self.starts.append(np.zeros(1, dtype=bool))
        self.size += new

    def combined(self) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
        """Distinct suffixes, DEPTH numbers each (0 after the end), and how often each comes."""
        a = np.concatenate([*self.runs, np.zeros(DEPTH, dtype=np.uint64)])
        n = len(a) - DEPTH
        key, goes_on = np.zeros(n, dtype=np.uint64), np.concatenate(self.starts)
        for d in range(DEPTH):
            goes_on = goes_on & (a[d : n + d] != 0)
            key = key << np.uint64(16) | np.where(goes_on, a[d : n + d], np.uint64(0))
        key, times = np.unique(key[key != 0], return_counts=True)
        return self.vocabulary, np.stack([key >> np.uint64(16 * (DEPTH - 1 - d)) & np.uint64(0xFFFF) for d in range(DEPTH)], 1).astype(np.int64), times


def _suffixes(parts: Iterator[pd.DataFrame], frequent: np.ndarray) -> Iterator[tuple[Vocabulary, np.ndarray, np.ndarray]]:
    """Combined suffixes of a task, language by language, each time the memory for them is used."""
    held: dict[str, _Held] = {}
    for p in parts:
        for lang, text in zip(p["lang"], p["text"], strict=True):
            words = tokens(text)
            for i in range(0, len(words), _RUN):
                if lang not in held:
                    held[lang] = _Held(lang, frequent)
                held[lang].add(words[i : i + _RUN + DEPTH - 1], min(_RUN, len(words) - i))
                if len(held[lang].vocabulary.words) > _RUN - DEPTH:
                    yield held.pop(lang).combined()
                if sum(h.size for h in held.values()) >= HELD or sum(len(h.vocabulary) for h in held.values()) > WORDS:
                    yield held.pop(max(held, key=lambda x: held[x].size)).combined()
    for lang in list(held):
        yield held.pop(lang).combined()


def _hashes(vocabulary: Vocabulary, rows: np.ndarray) -> list[np.ndarray]:
    h = np.array(vocabulary.hashes, dtype=np.uint64)
    return [h[rows[:, d]] for d in range(DEPTH)]


def plan(docs: DataFrame, counters: DataFrame, budget: int) -> Plan:
    """Vertical partitioning of the suffixes of `docs` (lang, text): prefixes are extended while they have more suffixes than `budget`, then groups are filled."""
    spark = docs.sparkSession
    frequent = counters.filter(F.col("slot") >= 0).filter(F.col("n") >= LEAST)
    # of the filter only its bits come to the driver: 2^FILTER of them, as whole bytes
    got = frequent.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot & 7)")).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER - 3), dtype=np.uint8)
    bits[got["at"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.uint8)
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    slots = max(SLOTS, 1 << int(16 * total / budget).bit_length())
    hot = [np.zeros(slots, dtype=bool) for _ in range(DEPTH)]
    none = Plan(bits, hot, [np.zeros(slots, dtype=np.int32) for _ in range(DEPTH)])
    shared = spark.sparkContext.broadcast(none)

    def loads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((DEPTH, slots), dtype=np.int64)
        for vocabulary, rows, n in _suffixes(parts, shared.value.frequent):
            for d, at in enumerate(shared.value.keys(_hashes(vocabulary, rows))):
                # what is combined in a task is one row of a group; the load is what a group has to hold
                sums[d] += np.bincount(at, minlength=slots)
        level, slot = np.nonzero(sums)
        yield pd.DataFrame({"level": level.astype(np.int32), "slot": slot.astype(np.int32), "n": sums[level, slot]})

    rows = docs.mapInPandas(loads, "level int, slot int, n long").groupBy("level", "slot").agg(F.sum("n").alias("n")).toPandas()
    load = np.zeros((DEPTH, slots), dtype=np.int64)
    load[rows["level"], rows["slot"]] = rows["n"]
    # the deepest level is never extended: its suffixes are equal but for those that share a slot
    hot = [(load[d] > budget) & (d < DEPTH - 1) for d in range(DEPTH)]
    items = sorted(((int(load[d][at]), d, int(at)) for d in range(DEPTH) if not d or hot[d - 1].any() for at in np.flatnonzero((load[d] > 0) & ~hot[d])), reverse=True)
    bins = [(0, i) for i in range(max(1, -(-sum(x[0] for x in items) // budget)))]
    group = [np.zeros(slots, dtype=np.int32) for _ in range(DEPTH)]
    for n, d, at in items:  # the largest first, each into the emptiest group
        filled, i = heapq.heappop(bins)
        group[d][at] = i
        heapq.heappush(bins, (filled + n, i))
    return Plan(bits, hot, group)


def _packed(suffixes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted suffixes in 16-bit numbers, and their counts, column by column: steps of the first number, the others' low and high bytes, counts in a byte (255: in full at the end)."""
    columns = [np.diff(suffixes[:, 0], prepend=0), *(suffixes[:, d] for d in range(1, DEPTH))]
    planes = [c.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() for c in columns]
    return zlib.compress(b"".join([*planes, np.minimum(times, 255).astype(np.uint8).tobytes(), times[times >= 255].astype("<i8").tobytes()]), 1)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    columns = [raw[2 * n * d : 2 * n * (d + 1)].reshape(2, n).T.copy().view("<u2").reshape(n).astype(np.int64) for d in range(DEPTH)]
    columns[0] = columns[0].cumsum()
    times = raw[2 * n * DEPTH : (2 * DEPTH + 1) * n].astype(np.int64)
    times[times == 255] = np.frombuffer(raw[(2 * DEPTH + 1) * n :].tobytes(), dtype="<i8")
    return np.stack(columns, 1), times


def _blocks(shared):
    """Combined suffixes as one row for each group and level: the block's words and its suffixes in numbers of those words."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vocabulary, rows, n in _suffixes(parts, shared.value.frequent):
            group, level = shared.value.place(_hashes(vocabulary, rows))
            words = np.array(vocabulary.words, dtype=object)
            order = np.lexsort((level, group))
            key = group[order] * 8 + level[order]
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, dtype=int)
            out: dict[str, list] = {c: [] for c in ("group", "level", "lang", "words", "suffixes", "n")}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:b]
                used, own = np.unique(rows[at], return_inverse=True)
                if used[0]:  # 0 keeps its number
                    used, own = np.concatenate([[0], used]), own + 1
                for c, v in zip(out, (key[a] // 8, key[a] % 8, vocabulary.lang, zlib.compress(b" ".join(words[used[1:]]), 1), _packed(own.reshape(-1, DEPTH), n[at]), len(at)), strict=True):
                    out[c].append(v)
            if out["n"]:
                yield pd.DataFrame(out).astype({"group": "int32", "level": "int32", "n": "int32"})

    return run


def subtree(rows: np.ndarray, times: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of the depth-truncated suffix tree of `rows` (DEPTH numbers each, 0 after the end): for each depth, the first leaf of every node, its frequency
    (the sum of its leaves' totals) and whether the suffixes of its prefix are all here (prefixes that were extended lie in several groups)."""
    order = np.lexsort(tuple(rows[:, d] for d in range(DEPTH - 1, -1, -1)))
    rows, times, level = rows[order], times[order], level[order]
    # depth at which a leaf leaves the path of the one before
    differs = np.ones(len(rows), dtype=bool)
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for d in range(DEPTH):
        differs[1:] = rows[1:, d] != rows[:-1, d]
        new = new | differs
        first = np.flatnonzero(new)
        total = np.add.reduceat(times, first)
        there = rows[first, d] != 0
        yield d + 1, rows[first[there]], total[there], level[first[there]] <= d + 1


def _count_group(p: pd.DataFrame) -> pd.DataFrame:
    """Frequencies of a group's phrases: those of LEAST and more, and all of prefixes that other groups share."""
    out = []
    for lang, blocks in p.groupby("lang", sort=False):
        numbers: dict[bytes, int] = {}
        rows, times = [], []
        for words, suffixes, n in zip(blocks["words"], blocks["suffixes"], blocks["n"], strict=True):
            to = np.array([0, *(numbers.setdefault(w, len(numbers) + 1) for w in zlib.decompress(words).split(b" "))], dtype=np.int32)
            own, total = _unpacked(suffixes, n)
            rows.append(to[own])
            times.append(total)
        level = np.repeat(blocks["level"].to_numpy(), blocks["n"])
        text = [b"", *numbers]
        for k, nodes, n, whole in subtree(np.concatenate(rows), np.concatenate(times), level):
            keep = (n >= LEAST) | ~whole
            phrases = [b" ".join([text[i] for i in node[:k]]).decode("utf-8", "surrogatepass") for node in nodes[keep].tolist()]
            out.append(pd.DataFrame({"lang": lang, "phrase": phrases, "k": k, "a": n[keep], "whole": whole[keep]}))
    return pd.concat(out, ignore_index=True).astype({"k": "int32"}) if out else pd.DataFrame({"lang": [], "phrase": [], "k": [], "a": [], "whole": []})


def frequencies(docs: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (lang, text): (lang, phrase, k, a) of all phrases of 1 to DEPTH words with a >= LEAST, and (lang, n) of all words."""
    spark = docs.sparkSession
    counters = staged(docs.mapInPandas(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "collocations-counters")
    shared = spark.sparkContext.broadcast(plan(docs, counters, budget))
    blocks = docs.mapInPandas(_blocks(shared), "group int, level int, lang string, words binary, suffixes binary, n int")
    nodes = staged(blocks.groupBy("group").applyInPandas(_count_group, "lang string, phrase string, k int, a long, whole boolean"), "collocations-nodes")
    parted = nodes.filter("NOT whole").groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)
    whole = nodes.filter("whole").select("lang", "phrase", "k", "a")
    return whole.unionByName(parted.select("lang", "phrase", "k", "a")), counters.filter("slot < 0").select("lang", "n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", shown: int = SHOWN, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `shown` collocations.

    Candidates are phrases of 2 to DEPTH words in one piece with frequency a >= LEAST. Its cut after k words has l and r, the frequencies of both parts, and
    score floor(2000000 a / (l + r)); the cut with the lowest score counts (ties: the first). A candidate goes if a longer one holds it and has at
    least four fifths of its frequency. Order: score, then a, both descending, then the phrase. Null languages are `und`; null and empty texts have no words;
    repeated rows count each; a language without candidates has no row, an empty table none.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    found, totals = frequencies(rows, budget)
    found = staged(found, "collocations-frequencies")
    phrases = found.filter("k > 1")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(CAST(2000000 AS decimal(7,0)) * CAST(a AS decimal(19,0))) DIV (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_cut"))
    # what longer candidates hold: all their shorter phrases of two words and more
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    held = phrases.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    left = best.join(held, ["lang", "phrase"], "left").filter("_longer IS NULL OR CAST(_longer AS decimal(19,0)) * 100 < CAST(a AS decimal(19,0)) * 80")
    # each share of a language's candidates gives its first ones, so that no task meets more than SHARES * shown of a language
    order = [F.desc("_cut.score"), F.desc("a"), "phrase"]
    dealt = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = dealt.withColumn("_r", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_r") <= shown)
    top = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= shown)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0), (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT f.lang, f.k, f.phrase, f.a, c.cut, string_split(f.phrase, ' ') AS w FROM f JOIN (SELECT unnest([1, 2, 3]) AS cut) c ON c.cut < f.k
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000 * c.a) // (x.a + y.a), c.cut) AS turn
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), held AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s.i:s.i + s.m - 1], ' ') AS phrase, max(a) AS longer
  FROM f JOIN (SELECT * FROM (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m)) s ON s.m < f.k AND s.i + s.m - 1 <= f.k
  WHERE f.k > 2 GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE s.turn = 1 AND (h.longer IS NULL OR 100 * h.longer < 80 * s.a)
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
