"""Canonical length-limited Huffman codes for token ids, with block-parallel table decoding. Numpy only."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: A segment starts with this, and its file ends each segment with END (written as the line separator).
START, END = b"LMH1", "\nLMHE\n"
_HEAD = struct.Struct("<4sIIIQQ")  # START, part, documents, ids of a block, ids, bytes of payload
_CODE = struct.Struct("<4sII")


def limited_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge), for positive weights.

    Each level merges the leaves with the pairs of the level before; how many leaves the chosen prefix of each level
    holds gives every leaf's length.
    """
    n = len(weights)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = np.argsort(weights, kind="stable")
    leaves = np.asarray(weights, np.int64)[order]
    level, is_leaf = leaves, []
    is_leaf.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Symbols in canonical order (by length, then value) with their lengths."""

    symbols: np.ndarray
    lengths: np.ndarray
    limit: int

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray, least_limit: int = 16) -> Code:
        limit = max(least_limit, int(np.ceil(np.log2(max(2, len(symbols))))) + 1)
        lengths = limited_lengths(counts, limit)
        order = np.lexsort((symbols, lengths))
        return cls(np.asarray(symbols, np.int64)[order], lengths[order], limit)

    def codes(self) -> np.ndarray:
        """The canonical code of each symbol: counting up, shifted left where the length grows."""
        if not len(self.symbols):
            return np.zeros(0, np.uint64)
        room = np.left_shift(np.int64(1), self.limit - self.lengths)  # of the last level's leaves
        return ((np.cumsum(room) - room) >> (self.limit - self.lengths)).astype(np.uint64)

    def to_bytes(self) -> bytes:
        return _CODE.pack(b"LMHC", self.limit, len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.lengths.astype("u1").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Code:
        magic, limit, n = _CODE.unpack_from(raw)
        if magic != b"LMHC":
            raise ValueError("not a code file")
        at = _CODE.size
        return cls(np.frombuffer(raw, "<u4", n, at).astype(np.int64), np.frombuffer(raw, "u1", n, at + 4 * n).astype(np.int64), limit)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.symbols.max(initial=0)) + 1
        code, length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.symbols], length[self.symbols] = self.codes(), self.lengths
        return code, length

    def decoder(self) -> np.ndarray:
        """For each `limit` bits that can come next: symbol << 5 | length."""
        entry = (self.symbols.astype(np.uint64) << np.uint64(5)) | self.lengths.astype(np.uint64)
        table = np.repeat(entry, np.left_shift(np.int64(1), self.limit - self.lengths))
        return np.concatenate([table, np.full((1 << self.limit) - len(table), 1, np.uint64)])


def pack(ids: np.ndarray, encoder: tuple[np.ndarray, np.ndarray], block: int) -> tuple[bytes, np.ndarray]:
    """The ids' code bits, first bit highest, and the bit offset where each block of ids begins."""
    code, length = encoder[0][ids], encoder[1][ids]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = ends - length
    words = np.zeros(total // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - length
    inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(room < 0)  # at most one id reaches into the next word
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::block]


def unpack(payload: bytes, offsets: np.ndarray, n: int, block: int, decoder: np.ndarray, limit: int) -> np.ndarray:
    """All blocks at once: each step reads one id of every block from its own bit offset."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, last = offsets.astype(np.int64), len(view) - 1
    out = np.empty((min(block, n), len(at)), np.uint32)
    decoder, down = decoder.astype(np.uint32), np.uint32(32 - limit)
    for step in range(len(out)):
        got = decoder[(view[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down]
        out[step] = got >> np.uint32(5)
        at += got & np.uint32(31)
    return out.T.reshape(-1)[:n]


def write_segment(part: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, encoder, block: int) -> bytes:
    """part, documents (a byte that says if the id is null, the id, the number of ids), block offsets, payload."""
    payload, offsets = pack(ids, encoder, block)
    nulls = np.array([d is None for d in doc_ids], "u1")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(START, part, len(doc_ids), block, len(ids), len(payload))
    return head + nulls.tobytes() + keys.tobytes() + sizes.astype("<u8").tobytes() + offsets.astype("<u8").tobytes() + payload


def read_segments(raw: bytes, code: Code | None):
    """(part, doc ids, sizes, ids) of each segment of a file; without a code, (part, ids in it) only."""
    at, table, end = 0, code.decoder() if code else None, len(END.encode())
    while at < len(raw):
        magic, part, docs, block, n, size = _HEAD.unpack_from(raw, at)
        if magic != START:
            raise ValueError("not a segment")
        nulls_at = at + _HEAD.size
        keys_at = nulls_at + docs
        sizes_at = keys_at + 8 * docs
        offsets_at = sizes_at + 8 * docs
        blocks = -(-n // block)
        payload_at = offsets_at + 8 * blocks
        at = payload_at + size + end
        if raw[payload_at + size : at] != END.encode():
            raise ValueError("a segment is cut short")
        if code is None:
            yield part, n
            continue
        nulls = np.frombuffer(raw, "u1", docs, nulls_at)
        keys = [None if z else k for z, k in zip(nulls.tolist(), np.frombuffer(raw, "<i8", docs, keys_at).tolist(), strict=True)]
        sizes = np.frombuffer(raw, "<u8", docs, sizes_at).astype(np.int64)
        offsets = np.frombuffer(raw, "<u8", blocks, offsets_at)
        yield part, keys, sizes, unpack(raw[payload_at : payload_at + size], offsets, n, block, table, code.limit)
