"""Whole-batch text arithmetic with numpy: code points, words and their hashes, without a Python step for each word."""

from __future__ import annotations

import numpy as np

_ODD, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _ODD, dtype=np.uint64)]).cumprod(dtype=np.uint64)
        _inverse = np.concatenate([[np.uint64(1)], np.full(size - 1, _INV, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_SPACE = np.zeros(0x3001, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def is_space(codes: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(codes, 0x3000 - 1)] | (codes == 0x3000)


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words (runs without white space) of one text's code points."""
    if not len(codes):
        e = np.zeros(0, dtype=np.int64)
        return e.astype(np.uint64), e, e
    gap = np.concatenate([[True], is_space(codes), [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts.astype(np.uint64), starts, ends
    powers, inverse = _tables(len(codes))
    total = np.concatenate([[np.uint64(0)], ((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)]).cumsum(dtype=np.uint64)])
    # a polynomial in the word's characters alone: the power of its start is divided out
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words, lower case; of the whole word sequence where there are fewer than n words; none without words."""
    w, _, _ = word_hashes(code_points(text.lower()))
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ w[i : len(w) - k + 1 + i]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2 * i + 1)
        out ^= out >> np.uint64(31)
    return mix(out)
