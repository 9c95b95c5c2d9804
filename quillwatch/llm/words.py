"""Hashes of the words of whole Arrow text columns, computed with numpy over the column's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Freed batches go back to the system; the default pool keeps them for the worker's life.
pa.set_memory_pool(pa.system_memory_pool())

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes worked on at once; a cut falls between words.
CHUNK = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Cutter:
    """inside: for every byte value, whether it belongs to a word. fold: the byte value that counts in its place."""

    def __init__(self, inside: np.ndarray, fold: np.ndarray | None = None):
        self.inside = inside
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.values = values if fold is None else values[fold]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end byte of all words, and for each row the number of words before it (one entry more than rows)."""
        hashes, starts, ends = [], [], []
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at, n = 0, len(data)
        while at < n:
            to = min(n, at + CHUNK)
            while to < n and not edge[to] and self.inside[data[to]] and self.inside[data[to - 1]]:
                to += 1
            part = data[at:to]
            inside = self.inside[part]
            before = np.empty_like(inside)
            before[0] = False
            before[1:] = inside[:-1]
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            start = np.flatnonzero(inside & (~before | edge[at:to]))
            end = np.flatnonzero(inside & (~after | edge[at + 1:to + 1])) + 1
            up, down = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[part] * up[:-1], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
            starts.append(start + at)
            ends.append(end + at)
            at = to
        if not hashes:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
        start = np.concatenate(starts)
        return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def signs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `Cutter.words`, with every code point as a word of its own; ASCII ones only if `inside` has them, A-Z as a-z."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(start[1:], len(data))
    keep = inside[data[start]] if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    code = np.zeros(len(start), np.uint64)
    for k in range(4):
        at = np.minimum(start + k, max(0, len(data) - 1))
        code = code << np.uint64(8) | np.where(start + k < end, _fold()[data[at]], 0).astype(np.uint64)
    return mix(code + np.uint64(1)), start, end, np.searchsorted(start, offsets)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each word on (rows are not looked at); shorter by length - 1."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out = mix(out * _BASE + hashes[k:k + n])
    return out


def _space() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def _fold() -> np.ndarray:
    fold = np.arange(256)
    fold[65:91] += 32
    return fold


def _alnum() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return inside


#: Words between white space, A-Z as a-z; and runs of letters, digits and non-ASCII bytes.
SPACED = Cutter(_space(), _fold())
LETTERS = Cutter(_alnum(), _fold())
