"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

Features are the presence of n-grams of `SIZES` characters of the lower-cased text, hashed to `2 ** BITS` places. From a labelled sample, the documents of either class that hold a
place are counted by Spark; r is the logarithm of the ratio of the smoothed shares. The `features` places that part the classes most are kept, presence is multiplied by r, and
a logistic regression with a quadratic penalty is fitted to the products. Sample (at most about `fit_docs` documents) and features are bounded by parameters; the driver
holds the sample's kept places only. Scoring reads every n-gram of every whole text inside the tasks, without shuffle.

Defined cases: a null or empty text has no n-gram and gets the score of the intercept; if no label is at hand all scores are 0.5; repeated rows get equal scores; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from quillwatch.llm.training import labelled_sample

SIZES, BITS = (3, 4, 5), 22
#: Characters worked on at once; the n-grams over a cut are taken with the part before it.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def places(texts: list[str], keep: np.ndarray | None) -> Iterator[np.ndarray]:
    """row * 2**BITS + place of the n-grams of texts, each once per row and chunk; keep: which places count (all if None)."""
    texts = [t.lower() for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    body = "".join(texts)
    longest = max(SIZES)
    for at in range(0, len(body), CHUNK):
        to = min(len(body), at + CHUNK)
        chars = np.frombuffer(body[at:min(len(body), to + longest - 1)].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        row = np.searchsorted(end, np.arange(at, to), side="right")
        room = end[row] - np.arange(at, to)  # characters from here to the end of the row
        code = np.zeros(len(chars), np.uint64)
        found = []
        for n in range(1, longest + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            code = (code[:m] ^ chars[n - 1:]) * _ODD
            code ^= code >> np.uint64(29)
            if n in SIZES:
                k = min(m, to - at)
                place = ((code[:k] * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)
                ok = room[:k] >= n if keep is None else keep[place] & (room[:k] >= n)
                hit = np.flatnonzero(ok)
                found.append((row[hit] << BITS) + place[hit])
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def row_places(texts: list[str], keep: np.ndarray | None) -> np.ndarray:
    """As `places`, for the whole list, each once per row."""
    parts = list(places(texts, keep))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def grouped(texts: list[str], chars: int = 4 * CHUNK) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per place and class within a task."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        texts, label = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        at = 0
        for group in grouped(texts):
            found = row_places(group, None)
            row, place = found >> BITS, found & ((1 << BITS) - 1)
            for k in (0, 1):
                seen[k] += np.bincount(place[label[at:at + len(group)][row] == k], minlength=1 << BITS).astype(np.int32)
            at += len(group)
    used = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0][used].astype(np.int64)), pa.array(seen[1][used].astype(np.int64))], ["place", "clean", "toxic"])


class Weights:
    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float):
        self.place, self.weight, self.bias = place, weight, bias
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return {"place": self.place, "weight": self.weight, "bias": self.bias, "_table": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.place] = self.weight
            self._keep = self._table != 0
        out = []
        for group in grouped(texts):
            found = row_places(group, self._keep)
            out.append(np.bincount(found >> BITS, self._table[found & ((1 << BITS) - 1)], minlength=len(group)))
        z = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: np.ndarray, columns: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of presence-times-ratio features, by Adam over the whole sample. rows is sorted."""
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    x = ratio[columns]
    for k in range(1, steps + 1):
        z = np.bincount(rows, w[columns] * x, minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g, gb = np.bincount(columns, error[rows] * x, minlength=len(w)) + penalty * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-9)
        b -= rate * (mb / (1 - 0.9 ** k)) / (np.sqrt(vb / (1 - 0.999 ** k)) + 1e-9)
    return w * ratio, b


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value above which calling a row toxic has the highest F1; between two rows' values."""
    order = np.argsort(-z, kind="stable")
    hits, called = np.cumsum(y[order]), np.arange(1, len(z) + 1)
    ends = np.append(z[order][1:] < z[order][:-1], True)  # equal values are called together
    f1 = np.where(ends, 2 * hits / (called + y.sum()), -1)
    k = int(f1.argmax())
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + below) / 2)


def fit_cut(rows: np.ndarray, columns: np.ndarray, ratio: np.ndarray, y: np.ndarray, smoothing: float = 1.0, folds: int = 3) -> tuple[np.ndarray, float]:
    """Weights fitted to the whole sample, with the intercept moved so that 0.5 is the best cut for documents outside the fit.

    The sample separates its own classes almost wholly, so its own scores say nothing about the cut: each fold is scored by weights and ratios of the others."""
    weight, bias = fit_logistic(rows, columns, ratio, y)
    fold = np.arange(len(y)) % folds
    if any(y[fold == f].sum() in (0, (fold == f).sum()) for f in range(folds)):
        return weight, bias
    z = np.zeros(len(y))
    for f in range(folds):
        keep = fold != f
        inside, toxic = keep[rows], y[rows] == 1
        q = (np.bincount(columns[inside & ~toxic], minlength=len(ratio)) + smoothing) / ((1 - y[keep]).sum() + 2 * smoothing)
        p = (np.bincount(columns[inside & toxic], minlength=len(ratio)) + smoothing) / (y[keep].sum() + 2 * smoothing)
        number = np.cumsum(keep) - 1
        w, b = fit_logistic(number[rows[inside]], columns[inside], np.log(p / q), y[keep])
        z[~keep] = (np.bincount(rows[~inside], w[columns[~inside]], minlength=len(y)) + b)[~keep]
    return weight, bias - best_cut(z, y)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", fit_docs: int = 10_000, features: int = 8192, smoothing: float = 1.0, parts: int = 8) -> Weights | None:
    sample = labelled_sample(docs, labels, label, allowed, fit_docs)
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    if not clean + toxic:
        return None
    counts = (sample.select("text", "label").repartition(parts).mapInArrow(_count, "place long, clean long, toxic long")
              .groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    p, q = (F.col("toxic") + smoothing) / (toxic + 2 * smoothing), (F.col("clean") + smoothing) / (clean + 2 * smoothing)
    best = counts.withColumn("r", F.log(p / q)).withColumn("gain", F.abs(F.col("r") * (p - q))).orderBy(F.desc("gain"), "place").limit(features).select("place", "r").toArrow()
    place, ratio = best["place"].to_numpy(), best["r"].to_numpy()
    order = np.argsort(place)
    place, ratio = place[order], ratio[order]
    keep = np.zeros(1 << BITS, bool)
    keep[place] = True
    keep_bits = np.packbits(keep)

    @arrow_udf(ArrayType(IntegerType()))
    def present(texts: pa.Array) -> pa.Array:
        mask = np.unpackbits(keep_bits).astype(bool)
        size, found = [], []
        for group in grouped(texts.to_pylist()):
            got = row_places(group, mask)
            size.append(np.bincount(got >> BITS, minlength=len(group)))
            found.append(got & ((1 << BITS) - 1))
        flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *[np.cumsum(np.concatenate(size))]] if size else [[0]]).astype(np.int32)), pa.array(flat))

    rows = sample.select("doc_id", "label", present("text").alias("x")).toArrow().sort_by("doc_id")
    lists = rows["x"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    columns = np.searchsorted(place, lists.flatten().to_numpy())
    weight, bias = fit_cut(np.repeat(np.arange(len(size)), size), columns, ratio, rows["label"].to_numpy().astype(np.float64), smoothing)
    return Weights(place, weight, bias)


def scorer(model: Weights | None) -> Callable[[Column], Column]:
    """Column function: text to score, 0 to 1."""
    @arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(texts.fill_null("").to_pylist()) if model is not None else np.full(len(texts), 0.5))
    return score


def classify(docs: DataFrame, model: Weights | None) -> DataFrame:
    """docs with score and predicted (1 if the score is 0.5 or more); columns of these names are replaced."""
    scored = docs.withColumn("score", scorer(model)(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
