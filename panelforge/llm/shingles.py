"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_M = np.uint64(0x5851F42D4C957F2D)
#: Bytes hashed at once; words are never cut, longer ones are folded piece by piece.
_CHUNK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(int(_M)), _powers(pow(int(_M), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _values(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial values of the words b[start:end], all within one chunk."""
    first, n = start[0], end[-1] - start[0]
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((b[first : first + n].astype(np.uint64) + np.uint64(1)) * _POW[:n][::-1], out=acc[1:])
    s, e = start - first, end - first
    return (acc[e] - acc[s]) * _INV[n - e]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of every word, A-Z lower-cased; words are runs without blank, tab, newline, vertical tab, form feed, return."""
    b = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[b], [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        last = int(np.searchsorted(end, start[at] + _CHUNK, "right"))
        if last > at:
            out[at:last] = _values(b, start[at:last], end[at:last])
            at = last
            continue
        h = np.uint64(0)
        for k in range(int(start[at]), int(end[at]), _CHUNK):
            stop = min(k + _CHUNK, int(end[at]))
            with np.errstate(over="ignore"):
                h = h * _POW[stop - k] + _values(b, np.array([k]), np.array([stop]))[0]
        out[at] = h
        at += 1
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a shorter text is one run; no words, empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * _M + w[i : i + len(h)])
    return np.unique(h)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    h = mix(s + np.uint64(0x632BE59BD9B4E019))
    with np.errstate(over="ignore"):
        x = mix(np.array([np.bitwise_xor.reduce(h), h.sum(dtype=np.uint64)]) + np.uint64(len(s)))
    return int(mix(x[:1] * _M + x[1:])[0].view(np.int64)) if len(s) else 0
