"""Byte-level BPE encoding and decoding with a public file of ranks, by padded matrices.

A text is cut by the vocabulary's word pattern. A piece that is a token is that token; every other distinct piece of a group of rows becomes a row of a
matrix of token ids, its bytes at first, padded to the width of its length bucket. In each round every row merges its leftmost pair of minimum rank: the ranks of
its pairs stand in a second matrix, the two pairs that a merge touches are looked up again in a hash table of numpy arrays, and both matrices are compacted by the
cell that the merge freed, so they lose one column a round. Rows without a pair left are read off and taken out of the matrix.

Pieces of more than `WIDE` bytes are cut first where no token can reach over: where the two bytes are no token and no token holds them with the byte before or
the byte after. What is still longer would need a round for every merge; there a round merges all occurrences of the minimum rank from left to right, up to the
first one whose merged token forms a pair of lower rank with a neighbour. The result is the same.

Each task works on its own rows and nothing is shuffled. Encoded pieces are kept between batches in a table that is emptied at `CACHE` pieces.
The ranks are read once by the driver and sent to the tasks (their size is that of the file, whatever the corpus is).

Defined cases: a null or empty text has no ids and decodes to no bytes; strings that look like special tokens are ordinary text; whole texts are encoded,
whatever their length (cut for work between two letters parted by one space, where a piece always starts); rows are independent, so repeated rows give repeated results.
Both are column functions, so other columns of a table, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from quillwatch.llm.letters import cut

CACHE = 400_000
#: Bytes of the widest matrix.
WIDE = 256
#: Cells of a matrix, and characters of text that are worked on together.
CELLS = 1 << 18
TOGETHER = 1_000_000
NONE = np.int32(2**31 - 1)
#: The general pattern's classes for ASCII texts: white space is \t to \r and the space.
ASCII_CLASSES = ((r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\S", r"[^\t-\r ]"), (r"\s", r"[\t-\r ]"))
_WORK_CUT = re.compile("(?<=[a-z]) (?=[a-z])")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """tokens: id to bytes. rank(a, b): id of the token that the tokens a and b make, NONE where they make none."""

    def __init__(self, text: str, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, text.splitlines()))}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, k in self.ids.items():
            self.tokens[k] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pad = len(self.tokens)
        self.words = regex.compile(pattern)
        ascii_pattern = pattern
        for general, narrow in ASCII_CLASSES:
            ascii_pattern = ascii_pattern.replace(general, narrow)
        self.ascii_words = re.compile(ascii_pattern)
        made = [(a, b, k) for token, k in self.ids.items() for i in range(1, len(token)) if (a := self.ids.get(token[:i])) is not None and (b := self.ids.get(token[i:])) is not None]
        left, right, out = np.array(made, np.int64).reshape(-1, 3).T
        self._table(left, right, out)
        self.pairs, self.triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for token in self.ids:
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = True
            for i in range(len(token) - 2):
                self.triples[token[i] << 16 | token[i + 1] << 8 | token[i + 2]] = True
        self.cache: dict[str, bytes] = {}

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) * np.uint64(self.pad + 1) + right.astype(np.uint64) + np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def _table(self, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        bits = max(4, int(4 * max(1, len(out)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
        keys = self._key(left, right)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            free = self.keys[at] == 0
            placed, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[placed], self.values[placed] = keys[won], out[won]
            rest = np.ones(len(todo), bool)
            rest[np.flatnonzero(free)[first]] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def _segments(self, body: bytes) -> list[bytes]:
        """The parts of a piece between which no token can lie."""
        data = np.frombuffer(body, np.uint8).astype(np.int32)
        near = self.pairs[data[:-1] << 8 | data[1:]]
        triple = self.triples[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        near[1:] |= triple
        near[:-1] |= triple
        edges = [0, *(np.flatnonzero(~near) + 1).tolist(), len(body)]
        return [body[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Encodings of pieces of one length bucket."""
        sizes = np.array([len(r) for r in rows])
        width = int(sizes.max())
        ids = np.full((len(rows), width), self.pad, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        where, done = np.arange(len(rows)), [None] * len(rows)
        while len(where):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(where)), at]
            open_ = best != NONE
            if not open_.all():
                for k in np.flatnonzero(~open_):
                    done[where[k]] = ids[k][ids[k] != self.pad]
                where, ids, ranks, at, best = where[open_], ids[open_], ranks[open_], at[open_], best[open_]
                if not len(where):
                    break
            line = np.arange(len(where))
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids, ranks = ids[keep].reshape(len(where), -1), ranks[keep].reshape(len(where), -1)
            ids[line, at] = best
            last = ids.shape[1] - 1
            ranks[line, at] = np.where(at < last, self.rank(best, ids[line, np.minimum(at + 1, last)]), NONE)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.rank(ids[inner, at[inner] - 1], best[inner])
        return done

    def _merge_wide(self, body: bytes) -> np.ndarray:
        ids = np.append(self.single[np.frombuffer(body, np.uint8)], np.int32(self.pad))
        ranks = np.append(self.rank(ids[:-1], ids[1:]), NONE)
        while (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            start = np.append(True, np.diff(at) > 1)  # of places in a row every second one, as the first takes the cell of the next
            at = at[(np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]) % 2 == 0]
            before = np.where(np.append(False, np.diff(at) == 2), best, np.where(at > 0, ids[at - 1], self.pad))
            new = np.full(len(at), best)
            sooner = (self.rank(before, new) < best) | (self.rank(new, ids[at + 2]) < best)
            if sooner.any():
                at = at[:sooner.argmax() + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            ids, ranks = ids[keep], ranks[keep]
            at = at - np.arange(len(at))
            for touched in (at, at[at > 0] - 1):
                ranks[touched] = self.rank(ids[touched], ids[touched + 1])
        return ids[:-1]

    def encode_bodies(self, bodies: set[bytes]) -> dict[bytes, bytes]:
        """int32 ids of distinct byte strings without a token of their own."""
        out, buckets = {}, {}
        for body in bodies:
            if len(body) > WIDE:
                out[body] = self._merge_wide(body).tobytes()
            else:
                buckets.setdefault((len(body) - 1).bit_length(), []).append(body)
        for bits, held in buckets.items():
            step = max(1, CELLS >> bits)
            for k in range(0, len(held), step):
                part = held[k:k + step]
                out.update((body, ids.tobytes()) for body, ids in zip(part, self._merge_rows(part), strict=True))
        return out

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """int32 ids of distinct pieces."""
        out, cut_up = {}, {}
        for piece in pieces:
            body = piece.encode("utf-8", "replace")
            known = self.ids.get(body)
            if known is not None:
                out[piece] = known.to_bytes(4, "little")
            else:
                cut_up[piece] = self._segments(body) if len(body) > WIDE else [body]
        done = self.encode_bodies({body for bodies in cut_up.values() for body in bodies})
        out.update((piece, b"".join(map(done.__getitem__, bodies))) for piece, bodies in cut_up.items())
        return out

    def encode_group(self, texts: list[str]) -> list[bytes]:
        cuts = [self.ascii_words.findall(t) if t.isascii() else cut(self.words, t) for t in texts]
        new: set[str] = set()
        for pieces in cuts:
            new.update(pieces)
        if len(self.cache) + len(new) > CACHE:
            keep = {p: self.cache[p] for p in new if p in self.cache}
            self.cache = keep if len(keep) + len(new) <= 2 * CACHE else {}
        known = self.cache
        new.difference_update(known)
        known.update(self.encode_pieces(new))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cuts]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """int32 ids of each text, in order; long texts in parts."""
        group, size = [], 0
        for text in texts:
            if len(text) > TOGETHER:
                if group:
                    yield from self.encode_group(group)
                    group, size = [], 0
                yield b"".join(self.encode_group([p])[0] for p in parts(text))
                continue
            group.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self.encode_group(group)
                group, size = [], 0
        if group:
            yield from self.encode_group(group)


def parts(text: str) -> Iterator[str]:
    """A long text in parts that start where a piece starts in any case: at a space between two plain letters."""
    at = 0
    while at < len(text):
        found = _WORK_CUT.search(text, at + TOGETHER) if at + TOGETHER < len(text) else None
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


_loaded: dict[tuple[str, str], Ranks] = {}


def loaded(text: str, pattern: str) -> Ranks:
    """One table of ranks per worker process."""
    if (text, pattern) not in _loaded:
        _loaded.clear()
        _loaded[text, pattern] = Ranks(text, pattern)
    return _loaded[text, pattern]


def read_ranks(path: str) -> str:
    with open(path, encoding="ascii") as f:
        return f.read()


def encoder(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: text to ids."""
    @arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(ranks, pattern)
        for batch in batches:
            rows = list(model.encode(batch.fill_null("").to_pylist()))
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in rows], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
    return encode


def decoder(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: ids to the bytes of their tokens. A null list has no bytes."""
    @arrow_udf(BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(loaded(ranks, pattern).tokens, pa.binary())
        for batch in batches:
            ids = batch.fill_null([]) if batch.null_count else batch
            ends = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))
            yield pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens.take(ids.flatten())), b"")
    return decode
