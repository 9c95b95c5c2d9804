"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as sequences of words: lower-cased runs of letters and digits. An item of n words may differ by k = floor(rate * n) word edits. It is split into k + 1 pieces; a
passage within k edits holds at least one piece unchanged. Pieces are found in whole texts by rolling hashes of as many words; the words around hits, widened by k, are then measured with
Myers' bit-parallel edit distance, a bit for each word of the item. Hits of an item that stand near each other are measured in one go.

Items are a stated query set. They are taken in blocks of about `block_items`, whose pieces are sent to the tasks: one pass over the documents a block, without
shuffle, with what it found written before the next block is read, so one block is held at a time.

Defined cases: null or empty texts match nothing, and neither do items without a word; items of fewer than `min_words` words are found where they stand unchanged (k = 0); such items that hold other
than ASCII letters, as scripts without spaces give few words, are compared by code points instead, with k = 0 below 3 * `min_words` of them; equal items are each reported;
repeated documents are each reported; of equally near places of one item in one stretch the first is reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillwatch.llm.training import unused
from quillwatch.llm.words import LETTERS, mix, raw, signs
from quillwatch.sources.shared import materialize

MATCH = "array<struct<item:long,start:long,end:long,distance:int>>"


def myers(pattern: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of a pattern of n symbols to any stretch of text, and the first end of such a stretch. pattern: places of each symbol as bits."""
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    best, at = n, 0
    for j, symbol in enumerate(text, 1):
        eq = pattern.get(symbol, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(x | up) & mask
        minus = up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & mask
        minus = (minus << 1) & mask
        y = eq | down
        up = minus | ~(y | plus) & mask
        down = plus & y
        if score < best:
            best, at = score, j
    return best, at


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def single_signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits one by one."""
    return signs(data, offsets, LETTERS.inside)


class Items:
    """Pieces of a block of items, by their length in words (what `cut` gives)."""

    def __init__(self, ids: list, texts: list[str], rate: float, min_words: int, cut: Callable = LETTERS.words):
        hashes, _, _, first = cut(*raw(pa.array(texts, pa.string())))
        self.cut = cut
        self.ids, self.words, self.budget = ids, [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(texts)):
            w = hashes[first[i]:first[i + 1]]
            n, k = len(w), int(rate * len(w)) if len(w) >= min_words else 0
            self.words.append(w.tolist())
            self.budget.append(k)
            if not n:
                continue
            for j in range(k + 1):
                a, b = j * n // (k + 1), (j + 1) * n // (k + 1)
                pieces.setdefault(b - a, []).append((int(_fold(w[a:b])), i, a))
        self.pieces = {}
        for size, rows in pieces.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(key >> np.uint64(48)).astype(np.int64)] = True
            self.pieces[size] = (key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen)
        self.bits = [(places(w), places(w[::-1])) for w in self.words]

    def hits(self, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row, item, first word of the item if nothing before the piece was edited; sorted."""
        found = []
        rolled = hashes
        for size in range(1, max(self.pieces, default=0) + 1):
            if size > 1:
                m = len(hashes) - size + 1
                if m <= 0:
                    break
                rolled = mix(rolled[:m] * _ROLL + hashes[size - 1:])
            if size not in self.pieces:
                continue
            key, item, offset, seen = self.pieces[size]
            at = np.flatnonzero(seen[(rolled >> np.uint64(48)).astype(np.int64)])
            at = at[row[at] == row[at + size - 1]]
            low, high = np.searchsorted(key, rolled[at], "left"), np.searchsorted(key, rolled[at], "right")
            count = high - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = np.repeat(at, count)
            found.append(np.column_stack([row[where], item[which], where - offset[which]]))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    def matches(self, column: pa.Array) -> list[list[tuple]]:
        data, offsets = raw(column)
        out: list[list[tuple]] = [[] for _ in range(len(column))]
        if not self.pieces:
            return out
        hashes, start, end, first = self.cut(data, offsets)
        row = np.repeat(np.arange(len(column)), np.diff(first))
        hits = self.hits(hashes, row).tolist()
        k = 0
        while k < len(hits):
            r, item, low = hits[k]
            budget, n = self.budget[item], len(self.words[item])
            high = low
            while k + 1 < len(hits) and hits[k + 1][:2] == [r, item] and hits[k + 1][2] <= high + 2 * budget + 1:
                k += 1
                high = hits[k][2]
            k += 1
            a, b = max(int(first[r]), low - budget), min(int(first[r + 1]), high + n + budget)
            window = hashes[a:b].tolist()
            distance, stop = myers(self.bits[item][0], n, window)
            if distance <= budget:
                _, back = myers(self.bits[item][1], n, window[:stop][::-1])
                x, y = start[a + stop - back], end[a + stop - 1]
                chars = lambda i: int(np.count_nonzero((data[offsets[r]:i] & 0xC0) != 0x80))  # noqa: B023, E731
                out[r].append((self.ids[item], chars(x), chars(y), distance))
        return out


_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _fold(words: np.ndarray) -> np.uint64:
    out = words[:1].copy()
    for w in words[1:]:
        out = mix(out * _ROLL + w)
    return out[0]


def matcher(ids: list, texts: list[str], rate: float, min_words: int) -> Callable[[Column], Column]:
    """Column function: lower-cased text to its matches."""
    few = np.diff(LETTERS.words(*raw(pa.array(texts, pa.string())))[3]) < min_words
    unspaced = [bool(f) and not t.isascii() for f, t in zip(few, texts, strict=True)]
    pick = lambda wanted: ([i for i, u in zip(ids, unspaced, strict=True) if u == wanted], [t for t, u in zip(texts, unspaced, strict=True) if u == wanted])
    held = [Items(*pick(False), rate, min_words)]
    if any(unspaced):
        held.append(Items(*pick(True), rate, 3 * min_words, single_signs))

    @arrow_udf(MATCH)
    def match(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())]))
        rows = [sum(found, []) for found in zip(*[x.matches(column) for x in held], strict=True)]
        return pa.array([[dict(zip(("item", "start", "end", "distance"), m, strict=True)) for m in row] for row in rows], kind)
    return match.asNondeterministic()  # for the optimiser, which would evaluate it twice under an explode


def matchers(items: DataFrame, rate: float = 0.2, min_words: int = 6, block_items: int = 10_000) -> Iterator[tuple[Callable[[Column], Column], bool]]:
    """Column functions of the blocks of items, one after the other, and whether each is the last. The driver holds one block."""
    wanted = items.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    blocks = max(1, -(-wanted.count() // block_items))
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield matcher([r["item_id"] for r in rows], [r["text"] for r in rows], rate, min_words), b == blocks - 1


def find(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start, end, distance: a row per passage of a document within the item's error budget. Places are code points of the lower-cased text."""
    text, out = F.lower(F.coalesce("text", F.lit(""))), None
    for match, last in matchers(items, **options):
        rows = docs.select("doc_id", F.explode(match(text)).alias("m")).select("doc_id", F.col("m.item").alias("item_id"), "m.start", "m.end", "m.distance")
        rows = rows if last and out is None else materialize(rows, "matches")
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold a passage of any item. Each block of items reads what the one before it left."""
    name, = unused(docs, "_matches")
    for match, last in matchers(items, **options):
        docs = docs.withColumn(name, match(F.lower(F.coalesce("text", F.lit(""))))).where(F.size(name) == 0).drop(name)
        docs = docs if last else materialize(docs, "uncontaminated")
    return docs
