"""Fill-in-middle transformation: whole texts cut between lines into prefix, middle and suffix and put together in a drawn order.

The ends of a text's lines, as code point offsets, are a boundary set in containers of 2^16 values: an array of the low halves, a bitmap, or runs, whichever is
smallest for that container. Cumulative cardinalities say in which container the k-th end lies, and a local select gives it: both cut offsets come from two
such selects. The draws are digits of a hash of the row's id, so they are the same on every run; cutting, putting together and restoring are
column expressions, only the boundary set is built in Arrow batches. Nothing is shuffled.

Defined cases: a null text counts as empty; a text that is empty or holds one of the marks stays as it is (form plain); a null id is hashed as an empty one;
a text without line feeds is one line; whole texts are cut, whatever their length; rows are independent, so repeated rows give repeated results.
`transform` returns the table's own columns and one struct; a column that already has the struct's name is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

MARKS = ("<P>", "<S>", "<M>")
#: Values of an array container at most; a bitmap's bytes.
ARRAY_MOST, BITMAP_BYTES = 4096, 8192


class Boundaries:
    """A sorted set of offsets. select(k): the k-th of them, counted from 0."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        edges = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(offsets) else np.zeros(0, np.int64)
        self.keys = high[edges]
        self.before = np.append(edges, len(offsets))
        self.containers = [self._container((offsets[a:b] & 0xFFFF)) for a, b in zip(self.before, self.before[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.before[-1])

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        start = np.flatnonzero(np.append(True, np.diff(low) > 1))
        if 2 + 4 * len(start) < min(2 * len(low), BITMAP_BYTES):
            return "run", low[start].astype(np.uint16), start  # first value of each run, values before it
        if len(low) <= ARRAY_MOST:
            return "array", low.astype(np.uint16)
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return "bitmap", np.packbits(bits), np.append(0, np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64)))  # values before each word of 64 bits

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        kind, values, *counts = self.containers[at]
        k -= int(self.before[at])
        if kind == "array":
            low = int(values[k])
        elif kind == "run":
            run = int(np.searchsorted(counts[0], k, "right")) - 1
            low = int(values[run]) + k - int(counts[0][run])
        else:
            word = int(np.searchsorted(counts[0], k, "right")) - 1
            low = 64 * word + int(np.flatnonzero(np.unpackbits(values[8 * word:8 * word + 8]))[k - int(counts[0][word])])
        return (int(self.keys[at]) << 16) + low


def line_ends(text: str) -> np.ndarray:
    """Offsets in code points just after every line; the last line need not end in a line feed."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    return ends if not len(codes) or codes[-1] == 10 else np.append(ends, len(codes))


@arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, one, two in batches:
        out = np.zeros((3, len(texts)), np.int64)
        for row, (text, a, b) in enumerate(zip(texts, one.to_pylist(), two.to_pylist(), strict=True)):
            held = Boundaries(line_ends(text.as_py() or ""))
            n = len(held)
            lines = sorted((a % (n + 1), b % (n + 1)))
            out[:, row] = n, *(held.select(k - 1) if k else 0 for k in lines)
        yield pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "first", "second"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, out: str = "fim", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs (doc_id, text and any other columns) and a struct: n lines, form (plain, psm, spm), prefix_chars and middle_chars (null if plain), output.

    Of 100 texts, rate are transformed, and of 100 of those spm have the suffix first. marks: of prefix, suffix, middle.
    """
    own = [docs[f"`{c}`"] for c in docs.columns if c.lower() != out.lower()]
    h = draws(docs["doc_id"], seed)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*own).alias("row"), text.alias("text"), _cuts(text, h[0], h[1]).alias("cut"), h[2].alias("h3"), h[3].alias("h4"))
    text, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    plain = (text == "") | (F.col("h3") % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    rows = rows.select("row", "text", "cut", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"))
    parts = [F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))]
    prefix, middle, suffix = parts
    p, s, m = map(F.lit, marks)
    output = (F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut = F.col("form") != "plain"
    made = F.struct(F.col("cut.n").alias("n"), "form", F.when(cut, first).alias("prefix_chars"), F.when(cut, second - first).alias("middle_chars"), output.alias("output"))
    return rows.select("row.*", made.alias(out))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that `transform` was given, from its output and form. A mark cannot begin inside a part, so the first of each kind is the mark."""
    def between(mark: str, upto: str | None) -> Column:
        start = F.instr(output, mark) + len(mark)
        return F.substring(output, start, F.instr(output, upto) - start if upto else F.length(output))
    p, s, m = marks
    return (F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
            .otherwise(F.concat(between(p, m), between(m, None), between(s, p))))
