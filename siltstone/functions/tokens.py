"""Tokens of a batch of texts inside Arrow functions: those of `functions.text.tokens`, found for all texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte of UTF-8 is: 1 a letter or digit of ASCII, 2 the first byte of a Han character, 3 one where the next byte decides.
_ASCII = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_KIND = bytes(1 if b in _ASCII else 3 if b == 0xE4 else 2 if 0xE5 <= b <= 0xE9 else 0 for b in range(256))
#: Bytes that are looked at together, about: what a core holds close.
PIECE = 1 << 17


def _cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(starts, sizes, bytes in lower case) of the tokens of texts that begin at `bounds` of `data`."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND) + bytes(2)), dtype=np.uint8)
    # U+4E00 is E4 B8 80, U+9FFF is E9 BF BF
    at = np.flatnonzero(kind == 3)
    kind[at] = np.where(data[at + 1] >= 0xB8, 2, 0)
    word, begins = kind == 1, np.zeros(len(kind) + 1, dtype=bool)
    begins[bounds] = True
    inner = word[1:] & word[:-1] & ~begins[1:-1]  # the byte continues the token of the byte before
    first, last = word.copy(), word.copy()
    first[1:] &= ~inner
    last[:-1] &= ~inner
    han = np.flatnonzero(kind == 2)
    first[han] = last[han + 2] = True
    for more in range(3):
        word[han + more] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) - starts + 1, data[word[: len(data)]].tobytes().lower()


def coded_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, codes, rows): the distinct tokens of `texts` (null: empty) and, for every token in order, the places of its word and of its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    # the two characters beyond ASCII whose lower case has a letter of ASCII
    if pc.any(pc.match_substring_regex(texts, "[\u0130\u212a]")).as_py():
        texts = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
    _, bounds, held = texts.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(held or b"", dtype=np.uint8)
    edges = np.unique(np.append(np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], PIECE)), len(texts))).tolist()
    cuts = [(bounds[i], *_cut(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])) for i, j in zip(edges, edges[1:], strict=False)] or [(0, *_cut(data[:0], bounds[:1] * 0))]
    starts = np.concatenate([at + x for at, x, _, _ in cuts])
    ends = np.append(0, np.cumsum(np.concatenate([x for _, _, x, _ in cuts])))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(b"".join([x for _, _, _, x in cuts]))).dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    return found.dictionary.cast(pa.string()), found.indices.to_numpy().astype(np.int64), rows
