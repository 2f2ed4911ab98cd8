"""Byte-level BPE through a lazily determinised finite-state transducer, and streaming decoding.

The transducer reads a piece (one match of the split pattern) byte by byte. A state stands for the last token already
emitted and the bytes still open; it knows the BPE segmentation of every prefix of the open bytes. For ranks that come from merges the last
token of a prefix is the one that ends there and may follow the last token of the prefix before it, and two tokens may
follow each other exactly if BPE leaves their joint bytes as these two. After each byte, starts at which no vocabulary
entry can still be under way are dropped; tokens on which all remaining paths agree are emitted at once. So the lookahead is bounded by the
longest entry. States and transitions are made when first met, kept in tables, and the tables are dropped when they reach a limit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import small_batches

#: Transitions that a worker keeps before it starts afresh; pieces and words that it remembers.
TRANSITIONS, PIECES, WORDS = 500_000, 100_000, 1_000_000
#: Bytes from which a piece makes no states; its certain tokens are let go that often.
SPAN = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.under_way = {t[:k] for t in ranks for k in range(1, len(t))}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.four = [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]
        self.pairs: dict[int, bool] = {}
        self.made_of: dict[bytes, tuple[bytes, bytes]] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.open: list[tuple[int | None, tuple, tuple, int, bytes]] = []  # last token out, token and start of each open prefix, tail, what is left if the piece ends
        self.step: dict[int, tuple[int, bytes]] = {}
        self.tails: dict[bytes, int] = {b"": 0}
        self.tail_bytes: list[bytes] = [b""]
        self.moves: dict[int, tuple[int, tuple, tuple]] = {}
        self.state(None, (), (), 0)

    def state(self, last: int | None, toks: tuple, starts: tuple, tail: int) -> int:
        key = (last, toks, tail)
        if (n := self.ids.get(key)) is None:
            n = self.ids[key] = len(self.open)
            self.open.append((last, toks, starts, tail, self.emitted(toks, starts, len(toks))))
        return n

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """BPE by ranks, the definition: merge the leftmost adjacent pair of least rank until none (or `until` parts) is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge made the token; None for a single byte."""
        if len(token) == 1:
            return None
        if (got := self.made_of.get(token)) is None:
            got = self.made_of[token] = tuple(self.merged(token, 2))
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the joint bytes of tokens a and b as these two.

        Time runs backwards: the later merge of the two sides is undone, and the parts that then touch are looked up. If they
        could merge before the step just undone (at an equal rank the left pair goes first), BPE would have crossed the boundary.
        """
        if len(self.pairs) > TRANSITIONS:
            self.pairs.clear()
        rank, x, y, before, ok = self.ranks, self.bytes_of[a], self.bytes_of[b], 1 << 60, True
        while True:
            if rank.get(x + y, 1 << 60) < before:
                ok = False
                break
            hx, hy = self.halves(x), self.halves(y)
            if hx and (not hy or rank[x] > rank[y]):
                before, x = rank[x], hx[1]
            elif hy:
                before, y = rank[y] + 1, hy[0]
            else:
                break
        self.pairs[a << 32 | b] = ok
        return ok

    def move(self, tail: int, byte: int) -> tuple[int, tuple, tuple]:
        """A tail is the longest run of last bytes that begins an entry without ending it. After one more byte: the new tail, the entries that end
        here with their lengths, and the lengths of all runs that are still under way; each longest first."""
        data = self.tail_bytes[tail] + bytes((byte,))
        ending, live = [], []
        for i in range(len(data)):
            run = data[i:]
            if (t := self.ranks.get(run)) is not None:
                ending.append((t, len(run)))
            if run in self.under_way:
                live.append(len(run))
        longest = data[len(data) - live[0] :] if live else b""
        if (n := self.tails.get(longest)) is None:
            n = self.tails[longest] = len(self.tail_bytes)
            self.tail_bytes.append(longest)
        got = self.moves[tail << 8 | byte] = n, tuple(ending), tuple(live)
        return got

    def read(self, last: int | None, toks: list[int], starts: list[int], tail: int, data: bytes) -> tuple[int, tuple]:
        """Reads bytes: appends the token that ends each prefix and its start; returns the tail and the runs under way."""
        moves, pairs, n, live = self.moves, self.pairs, len(toks), ()
        for b in data:
            n += 1
            tail, ending, live = moves.get(tail << 8 | b) or self.move(tail, b)
            for t, size in ending:  # the longest entry that may follow the token before it
                p = n - size
                before = toks[p - 1] if p else last
                if before is None or ((ok := pairs.get(before << 32 | t)) is None and self.follows(before, t)) or ok:
                    break
            else:
                raise ValueError(f"byte {b} is not in the vocabulary")
            toks.append(t)
            starts.append(p)
        return tail, live

    def emitted(self, toks, starts, end: int) -> bytes:
        out, four = [], self.four
        while end:
            out.append(four[toks[end - 1]])
            end = starts[end - 1]
        return b"".join(out[::-1])

    @staticmethod
    def agreed(starts, live: tuple) -> int:
        """The deepest boundary that the paths of the whole prefix and of all live starts share: what lies before it is certain."""
        n = cut = len(starts)
        for size in live:
            p = n - size
            while p != cut:
                if p > cut:
                    p = starts[p - 1]
                else:
                    cut = starts[cut - 1]
            if not cut:
                break
        return cut

    def advance(self, s: int, byte: int) -> tuple[int, bytes]:
        last, toks, starts, tail, _ = self.open[s]
        n = len(toks) + 1
        tail, ending, live = self.moves.get(tail << 8 | byte) or self.move(tail, byte)
        pairs = self.pairs
        for t, size in ending:  # the longest entry that may follow the token before it
            p = n - size
            before = toks[p - 1] if p else last
            if before is None or ((ok := pairs.get(before << 32 | t)) is None and self.follows(before, t)) or ok:
                break
        else:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        toks += (t,)
        starts += (p,)
        cut, out = self.agreed(starts, live), b""
        if cut:
            out, last = self.emitted(toks, starts, cut), toks[cut - 1]
        # only what lies on the paths of the prefix and of live starts is ever read again: the rest is blanked, so that more states are the same
        left = n - cut
        if left and not (live and live[0] == left) and last is not None:
            last = -1
        kept, since = [-1] * left, [0] * left
        for size in (0, *live):
            p = n - size
            while p > cut and kept[p - cut - 1] < 0:
                kept[p - cut - 1] = toks[p - 1]
                p = starts[p - 1]
        for i, t in enumerate(kept):
            if t >= 0 and starts[cut + i] > cut:
                since[i] = starts[cut + i] - cut
        got = self.step[s << 8 | byte] = self.state(last, tuple(kept), tuple(since), tail), out
        return got

    def long_piece(self, piece: bytes) -> bytes:
        """A piece read on its paths, without making states. What is certain is let go every SPAN bytes."""
        last, toks, starts, tail, out = None, [], [], 0, []
        for i in range(0, len(piece), SPAN):
            tail, live = self.read(last, toks, starts, tail, piece[i : i + SPAN])
            if cut := self.agreed(starts, live):
                out.append(self.emitted(toks, starts, cut))
                last = toks[cut - 1]
                toks, starts = toks[cut:], [p - cut if p > cut else 0 for p in starts[cut:]]
        out.append(self.emitted(toks, starts, len(toks)))
        return b"".join(out)

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.four[whole]
        if len(piece) > SPAN:
            return self.long_piece(piece)
        if len(self.step) > TRANSITIONS:
            self.reset()
        s, out, step, advance = 0, [], self.step, self.advance
        for b in piece:
            s, said = step.get(s << 8 | b) or advance(s, b)
            if said:
                out.append(said)
        out.append(self.open[s][4])
        return b"".join(out)


class Remembered:
    """A bounded memory of two generations: the younger fills, then becomes the older one and what was used in neither is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        """What is remembered of a key that the younger generation lacks."""
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value


#: Ids of whole tokens, and what the decoder says on them from START (None where that does not bring it back to START).
Run = tuple[bytes, bytes | None]


def both(runs: list[Run]) -> Run:
    said = [x for _, x in runs]
    return b"".join([ids for ids, _ in runs]), None if None in said else b"".join(said)


class Encoder:
    """encode(text): the ids of a whole text as little-endian unsigned 32-bit integers."""

    #: A blank preceded by white space and followed by more, or by the end: only then can a match cross the start of a blank.
    CROSSING = re.compile(r"\s (?:\s|\Z)|^ (?:\s|\Z)")
    #: White space but the blank and the line feed.
    RARE_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
    #: Letters without exception, then marks that make one match.
    PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([^\\w\\s]*)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.decoder = Decoder(ranks)
        self.fst, self.split = Transducer(ranks), regex.compile(pattern).findall
        #: Whether the pattern takes a word with the blank before it, and the marks after it together.
        self.by_word = self.split("ab cd, ef.*\ngh?") == ["ab", " cd", ",", " ef", ".*", "\n", "gh", "?"]
        self.words, self.pieces = Remembered(WORDS), Remembered(PIECES)

    def fresh(self, piece: str) -> Run:
        ids = self.fst.encode_piece(piece.encode("utf-8"))
        return ids, self.decoder.said(ids)

    def piece(self, piece: str) -> Run:
        got = self.pieces.young.get(piece) or self.pieces.get(piece)
        if got is None:
            got = self.fresh(piece)
            if len(piece) <= 64:
                self.pieces.put(piece, got)
        return got

    def word(self, word: str) -> Run:
        """The run of a blank and `word`, which has no blank."""
        got = self.words.get(word)
        if got is None:
            plain = self.PLAIN.fullmatch(word)
            if plain is None:
                return both([self.piece(x) for x in self.split(" " + word)])
            body, marks = plain.groups()
            if marks:
                got = both([self.words.young.get(body) or self.word(body), self.piece(marks)])
            else:
                got = self.fresh(" " + word)
            if len(word) <= 64:
                self.words.put(word, got)
        return got

    def runs(self, text: str) -> list[Run]:
        """Runs of whole tokens, one a word where words can be split alone."""
        parts = text.split(" ")
        if not self.by_word or (("" in parts or "\n " in text or any(c in text for c in self.RARE_SPACE)) and self.CROSSING.search(text)):
            return [self.piece(x) for x in self.split(text)]
        got = list(map(self.words.young.get, parts))
        got[0] = both([self.piece(x) for x in self.split(parts[0])])
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.words.young.get(parts[i]) or self.word(parts[i])
        return got

    def encode(self, text: str) -> bytes:
        return b"".join([ids for ids, _ in self.runs(text)])


#: States of the UTF-8 machine: START awaits a lead byte; LAST, TWO and THREE so many continuation bytes; the others a continuation byte of narrower
#: bounds (after leads E0, ED, F0, F4).
START, LAST, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BAD = range(9)
#: By state: least and largest byte that goes on, and the state after it.
GOES_ON = {LAST: (0x80, 0xBF, START), TWO: (0x80, 0xBF, LAST), THREE: (0x80, 0xBF, TWO), AFTER_E0: (0xA0, 0xBF, LAST), AFTER_ED: (0x80, 0x9F, LAST), AFTER_F0: (0x90, 0xBF, TWO), AFTER_F4: (0x80, 0x8F, TWO)}


def _lead(b: int) -> tuple[int, int]:
    """The state after a lead byte, and the bits of the code point that it carries."""
    if b < 0x80:
        return START, b
    if 0xC2 <= b <= 0xDF:
        return LAST, b & 0x1F
    if 0xE0 <= b <= 0xEF:
        return AFTER_E0 if b == 0xE0 else AFTER_ED if b == 0xED else TWO, b & 0x0F
    if 0xF0 <= b <= 0xF4:
        return AFTER_F0 if b == 0xF0 else AFTER_F4 if b == 0xF4 else THREE, b & 0x07
    return BAD, 0


LEADS = [_lead(b) for b in range(256)]


class Utf8Stream:
    """Incremental UTF-8 state machine: feed bytes, get text; a sequence may be cut anywhere, its state and bits wait for the next bytes.

    A malformed sequence (its longest part that could have gone on) becomes one U+FFFD. `close` ends the stream."""

    def __init__(self) -> None:
        self.state, self.code = START, 0

    def feed(self, data: bytes) -> str:
        if self.state == START and data.isascii():
            return data.decode("ascii")
        state, code, out = self.state, self.code, []
        for b in data:
            if state != START:
                low, high, after = GOES_ON[state]
                if low <= b <= high:
                    state, code = after, code << 6 | b & 0x3F
                    if state == START:
                        out.append(chr(code))
                    continue
                out.append("\ufffd")  # this byte begins anew
            state, code = LEADS[b]
            if state == START:
                out.append(chr(code))
            elif state == BAD:
                out.append("\ufffd")
                state = START
        self.state, self.code = state, code
        return "".join(out)

    def close(self) -> str:
        cut, self.state, self.code = self.state != START, START, 0
        return "\ufffd" if cut else ""


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.table[i] = t
        #: What the machine says on each token in START, where it comes back to START.
        self.alone: list[bytes | None] = []
        for t in self.table:
            x = Utf8Stream()
            said = x.feed(t)
            self.alone.append(said.encode("utf-8") if x.state == START else None)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete."""
        s = Utf8Stream()
        for i in ids:
            if x := s.feed(self.table[i]):
                yield x
        if x := s.close():
            yield x

    def said(self, ids: bytes) -> bytes | None:
        """UTF-8 of what the machine says on a run of ids that begins in START; None if the run doesn't end there."""
        tokens = struct.unpack(f"<{len(ids) // 4}I", ids)
        out = [self.alone[t] for t in tokens]
        if None not in out:
            return b"".join(out)
        s = Utf8Stream()
        text = "".join([s.feed(self.table[t]) for t in tokens])
        return text.encode("utf-8") if s.state == START else None

    def joined(self, runs: list[Run]) -> bytes:
        """UTF-8 of what the machine says on runs in turn. Runs that leave it in START say the same wherever they stand; else all are fed in one go."""
        out = [said for _, said in runs]
        if None in out:
            return "".join(self.stream(struct.unpack(f"<{sum(len(ids) for ids, _ in runs) // 4}I", b"".join([ids for ids, _ in runs])))).encode("utf-8")
        return b"".join(out)


_loaded: dict[tuple, tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a worker process."""
    if (path, pattern) not in _loaded:
        ranks = read_ranks(path)
        _loaded[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) of every whole text; decoded_sha256 is that of the streaming decoder's text. No shuffle.

    One row for each row of `df`, repeated ids and texts included, in no order. Null counts as empty (no ids); an empty table gives no rows; other columns
    of `df` are left out, whatever their names.
    """
    ids_type = ", token_ids array<int>" if keep_ids else ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, dec = codec(path, pattern)
        for p in parts:
            n, a, b, t = [], [], [], []
            for x in p[text]:
                parts = enc.runs(x or "")
                ids = b"".join([i for i, _ in parts])
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(dec.joined(parts)).hexdigest())
                if keep_ids:
                    t.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
            yield pd.DataFrame({id_col: p[id_col], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b} | ({"token_ids": t} if keep_ids else {}))

    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)
    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids_type}")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(id, text) from arrays of ids by the streaming decoder; null arrays give null, malformed bytes U+FFFD."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dec = codec(path, pattern)[1]
        for p in parts:
            yield pd.DataFrame({id_col: p[id_col], "text": [None if x is None else "".join(dec.stream(x)) for x in p[ids]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids).mapInPandas(run, f"`{id_col}` {kind}, text string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, keep_ids=False)
