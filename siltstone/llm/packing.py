"""Best-fit packing by exact-complement hashing.

Documents become token pieces (only those over the capacity are cut). A packing is a matter of the histogram of piece
lengths alone, which has at most `capacity` counters: on it, sums of one, two and three lengths are looked up that fill a gap exactly, as
often as the counts allow, and best fit places the rest. The result is a list of patterns (lengths in order, how often).
Each length's pieces are numbered by Spark, so that a pattern slot takes a range of numbers, and every piece finds its
sequence and offset by one search in a bounded table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import kept, numbered, small_batches, staged

CAPACITY = 2048
#: Words that a worker remembers before it forgets the older half.
WORDS = 1_000_000


class WordEncoder:
    """Ids of whole texts by the `tokenizers` library, which is asked once for each distinct word.

    The vocabulary drops white space and never joins across it; texts with characters whose splitting or lower case the library may see
    differently from Python go to it whole.
    """

    ODD = re.compile("[\x1c-\x1fΣİ\u0300-\u036f]")
    #: In these texts lower case comes to the same before and after normalisation.
    LATIN = re.compile("[\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027]*")
    #: Words of one piece: their last token, and no other, ends a word.
    PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
    #: Plain words that the library gets as one text.
    JOINED = 512

    def __init__(self, path: str, words: int = WORDS):
        self.words = words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def several(self, words: list[str]) -> None:
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, dtype="<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        """Remembers the ids of new words. A comma or full stop after a letter or digit at a word's end is a piece of its own."""
        young = self.young
        marked = [w for w in new if w[-1] in ",." and len(w) > 1 and w[-2].isalnum()]
        new.difference_update(marked)
        new.update([w[:-1] for w in marked], [w[-1] for w in marked])
        new.difference_update(young)
        if self.old:
            for w in new.intersection(self.old):
                young[w] = self.old[w]
            new.difference_update(young)
        plain = [w for w in new if self.PLAIN.fullmatch(w)]
        self.several(list(new.difference(plain)))
        groups = [plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        for g, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(g):
                self.several(g)
                continue
            body, at = ids.tobytes(), 0
            for w, c in zip(g, cuts, strict=True):
                young[w] = body[at:c]
                at = c
        for w in marked:
            young[w] = young[w[:-1]] + young[w[-1]]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        words = [None if self.ODD.search(t) else t.lower().split() if self.LATIN.fullmatch(t) and "<|" not in t else t.split() for t in texts]
        new = set().union(*[w for w in words if w is not None])
        new.difference_update(self.young)
        if new:
            if len(self.young) + len(new) > self.words and self.young:
                self.old, self.young = self.young, {}
                new = set().union(*[w for w in words if w is not None])
            self.learn(new)
        get = self.young.__getitem__
        return [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


def encoder(path: str, words: int = WORDS) -> WordEncoder:
    """The worker's encoder for a vocabulary."""
    return kept(f"packing {words} {path}", lambda: WordEncoder(path, words))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False, words: int = WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then id 0, cut at `capacity`. Null text is empty: one piece of id 0.

    Repeated rows each give their pieces; an empty table gives none; other columns of `docs` are left out, whatever their names."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, words)
        for p in parts:
            for at in range(0, len(p), 1000):
                q = p.iloc[at : at + 1000]
                rows = []
                for i, ids in zip(q[id_col], enc.encode_many([x or "" for x in q[text]]), strict=True):
                    ids += b"\0\0\0\0"
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[s : s + 4 * capacity]
                        rows.append((i, k, s // 4, len(x) // 4, zlib.crc32(x)) + ((np.frombuffer(x, dtype="<u4").astype(np.int32),) if keep_ids else ()))
                yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that use up `counts` (length -> pieces)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is not between 1 and {capacity}")
        left[n] += c
    out: list[tuple[tuple[int, ...], int]] = []

    def most(combo: tuple[int, ...]) -> int:
        return min(int(left[x]) // combo.count(x) for x in combo)

    def pairs(gap: int) -> np.ndarray:
        """Larger halves a of available pairs a + b = gap, largest first."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        return a[(left[a] > 0) & (left[gap - a] > 0) & ((a * 2 != gap) | (left[a] > 1))] if gap > 1 else a[:0]

    def complement(gap: int) -> tuple[int, ...] | None:
        if left[gap] > 0:
            return (gap,)
        if len(a := pairs(gap)):
            return (int(a[0]), int(gap - a[0]))
        for c in np.flatnonzero(left[: gap // 3 + 1])[::-1]:  # c the least of three
            a = pairs(int(gap - c))
            a = a[gap - c - a >= c]
            for x in a:  # only the x whose partner is c itself can fail, so at most two are tried
                combo = (int(x), int(gap - c - x), int(c))
                if most(combo):
                    return combo
        return None

    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    waiting = []
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            left[n] -= 1
            combo = complement(capacity - n)
            left[n] += 1
            if combo is None:
                # opens bins of its own only after all exact fills: the small lengths decide there
                waiting.append((n, int(left[n])))
                left[n] = 0
                break
            full = (n, *combo)
            m = most(full)
            for x in full:
                left[x] -= m
            out.append((full, m))
    # best fit, longest first; bins by gap: patterns and how many
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for n, c in sorted(waiting, reverse=True):
        while c:
            gap = min((g for g in bins if g >= n), default=None)
            if gap is None:
                # as many as fit in one bin, so that no copy waits for its own
                per = capacity // n
                if c >= per:
                    m, shape = c // per, (n,) * per
                else:
                    m, shape = 1, (n,) * c
                c -= m * len(shape)
                bins.setdefault(capacity - n * len(shape), {})
                bins[capacity - n * len(shape)][shape] = bins[capacity - n * len(shape)].get(shape, 0) + m
                continue
            shape, have = next(iter(bins[gap].items()))
            m = min(c, have)
            c -= m
            if have == m:
                del bins[gap][shape]
                if not bins[gap]:
                    del bins[gap]
            else:
                bins[gap][shape] = have - m
            if gap == n:
                out.append(((*shape, n), m))
            else:
                b = bins.setdefault(gap - n, {})
                b[*shape, n] = b.get((*shape, n), 0) + m
    out += [(shape, m) for b in bins.values() for shape, m in b.items()]
    return out


def packed(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (a column `length` from 1 to capacity; `order` tells pieces apart). Equal rows are interchangeable.
    An empty table gives no rows."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    key, base, offset, seq, taken = [], [], [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for shape, m in plan(counts, capacity):
        at = 0
        for n in shape:
            key.append(n << 44 | int(taken[n]))
            base.append(seq - int(taken[n]))
            offset.append(at)
            taken[n] += m
            at += n
        seq += m
    turn = np.argsort(key, kind="stable")
    keys, bases, offsets = np.array(key, dtype=np.int64)[turn], np.array(base, dtype=np.int64)[turn], np.array(offset, dtype=np.int64)[turn]
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            slot = np.searchsorted(keys, p["length"].to_numpy() << 44 | p["_number"].to_numpy(), "right") - 1
            yield p.drop(columns="_number").assign(sequence_id=bases[slot] + p["_number"].to_numpy(), offset=offsets[slot]) if len(p) else p.drop(columns="_number").assign(sequence_id=pd.Series(dtype="int64"), offset=pd.Series(dtype="int64"))

    rows = numbered(pieces, ["length"], order, "_number")
    return rows.select(*pieces.columns, "_number").mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, words: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document. words: how many a worker remembers (memory, not results)."""
    small_batches(docs.sparkSession)
    pieces = staged(token_pieces(docs, path, capacity, words=words), "packing-pieces")
    return packed(pieces, ["doc_id", "piece", "ids_crc32", "start"], capacity)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocab.path("word_bpe_49k.json"))
