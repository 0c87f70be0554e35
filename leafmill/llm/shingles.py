"""Word shingles of a text as 64-bit hashes. Numpy only."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(0x5EED)
_BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of text hashed at once.
AT_ONCE = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _place(n: int) -> np.ndarray:
    """Odd factors of the places 0 to n-1: a table's entry, times another of its powers for each 64 places."""
    if n <= 64:
        return _PLACE[:n]
    turns = np.full(-(-n // 64), 0xD1342543DE82EF95, np.uint64)
    turns[0] = 1
    turns = np.cumprod(turns, dtype=np.uint64)
    return (turns[:, None] * _PLACE[None, :]).reshape(-1)[:n]


def _piece_words(raw: np.ndarray) -> np.ndarray:
    ink = _INK[raw]
    edges = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    sizes = edges[1::2] - edges[::2]
    if not len(sizes):
        return np.zeros(0, np.uint64)
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    terms = _BYTE[_LOWER[raw[ink]]] * _place(int(sizes.max()))[place]
    return mixed(np.add.reduceat(terms, heads) + sizes.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (run of bytes that are no ASCII white space, A-Z lowered)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= AT_ONCE:
        return _piece_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + AT_ONCE)
        while end < len(raw):  # to the next white space
            gap = np.flatnonzero(~_INK[raw[end : end + AT_ONCE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + AT_ONCE)
        out.append(_piece_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[-1 - k]
    return np.unique(mixed(total))
