"""Hashes of words and of five-word shingles, whole columns at a time.

Words are runs of bytes other than space and 9 to 13, with A-Z lowered.  A word's hash is
a polynomial in 2**64 over random byte values, mixed; a shingle's is one over its
words' hashes, mixed.  Equal shingles have equal hashes; unequal ones collide with
a chance near 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
PIECE = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20_11))
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_BYTE[_SEP] = 0
_P = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) * 2 + 1
_Q = np.uint64(int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) * 2 + 1)


def _powers(p: int) -> np.ndarray:
    out = np.empty(PIECE, np.uint64)
    out[0], n = 1, 1
    while n < PIECE:
        k = min(n, PIECE - n)
        out[n : n + k] = out[:k] * np.uint64(pow(p, n, 1 << 64))
        n += k
    return out


_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _long_word(raw: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, by the same rule."""
    total, at = 0, 0
    while at < len(raw):
        part = _BYTE[raw[at : at + PIECE]]
        total += int((part * _POW[0][: len(part)]).sum()) * pow(_P, at, 1 << 64)
        at += PIECE
    return mix(np.array([total % (1 << 64)], np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of a UTF-8 text, in order, in memory bounded beside the result."""
    if not _POW:
        _POW.extend((_powers(_P), _powers(pow(_P, -1, 1 << 64))))
    b = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        if end < len(b):
            gaps = np.nonzero(_SEP[b[at:end]])[0]
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                stop = at
                while stop < len(b) and not _SEP[b[stop]]:
                    stop += 1 if stop - at > 1 << 30 else max(1, int(np.argmax(_SEP[b[stop : stop + PIECE]])) or min(PIECE, len(b) - stop))
                out.append(_long_word(b[at:stop]))
                at = stop
                continue
        part = b[at:end]
        # Where words begin and end, in turn.
        word = np.ones(len(part) + 2, bool)
        np.take(_SEP, part, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            total = np.zeros(len(part) + 1, np.uint64)
            values = _BYTE[part]
            values *= _POW[0][: len(part)]
            np.cumsum(values, out=total[1:])
            out.append(mix((total[ends] - total[starts]) * _POW[1][starts]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``k`` words; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    acc = words[: n - k + 1].copy()
    for j in range(1, k):
        acc *= _Q
        acc += words[j : n - k + 1 + j]
    return mix(acc + np.uint64(k))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; a plain sort is faster than numpy's own on short arrays of hashes."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    return distinct(shingle_hashes(word_hashes(text.encode()), k)) if text else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """A hash of a set of hashes, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        x = mix(mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(x.astype(np.int64)[0])
