"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes that cover the whole text. A passage is described by how often each pair of character classes
follows one another, by the share of its words that repeat the word before and the share that are new in it, and encoded by a learned layer; learned gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is
scored. Encoder, attention and scorer are fitted together from document labels only, by gradient descent on a sample of at most about `fit_docs` labelled
documents, of each at most `fit_passages` passages spread over its text. The sample is fitted in one task, whose input these two bounds limit; the driver gets the weights. Scoring reads every passage of every document inside the tasks, without shuffle.

Defined cases: a null or empty text is one passage without characters; a document without a label is only scored; if no label is at hand all scores are 0.5 and predicted is 1;
repeated rows get equal scores; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from quillwatch.llm.training import labelled_sample
from quillwatch.llm.words import SPACED, raw

PASSAGE = 512
GROUP = 1024
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",;:", "!?", "|/\\", "*#$%&@^~_+=<>", "'\"`()[]{}-"]
KINDS = len(CLASSES) + 2
PAIRS = KINDS * KINDS
WIDTH = PAIRS + 2


def _classes() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    out[128:] = len(CLASSES) + 1
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


OF_BYTE = _classes()


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of passages and the row of each, a group of passages at a time. Every row has one passage at least."""
    data, offsets = raw(column)
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + number * PASSAGE
    end = np.minimum(start + PASSAGE, offsets[1:][row])
    for k in range(0, len(row), GROUP):
        s, e = start[k:k + GROUP], end[k:k + GROUP]
        kinds = OF_BYTE[data[s[0]:e[-1]]]
        pair = kinds[:-1] * KINDS + kinds[1:]
        owner = np.repeat(np.arange(len(s)), e - s)
        inside = owner[:-1] == owner[1:]
        found = np.bincount((owner[:-1] * PAIRS + pair)[inside], minlength=len(s) * PAIRS).reshape(len(s), PAIRS)
        word, first, _, _ = SPACED.words(data[s[0]:e[-1]], np.unique(np.append(s, e[-1])) - s[0])
        holder = np.searchsorted(s - s[0], first, side="right") - 1
        words = np.maximum(1, np.bincount(holder, minlength=len(s)))
        again = np.bincount(holder[1:][(word[1:] == word[:-1]) & (holder[1:] == holder[:-1])], minlength=len(s)) / words
        order = np.lexsort((word, holder))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (holder[order][1:] != holder[order][:-1])
        fresh = np.bincount(holder[order][new], minlength=len(s)) / words
        yield np.column_stack([np.sqrt(found / np.maximum(1, found.sum(1, keepdims=True))), again, fresh]).astype(np.float32), row[k:k + GROUP]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Weights: encoder (E, e), gate (V, U, w), scorer (c, b)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.25, (WIDTH, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
                  "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages and their attention before it is normalised."""
        h = np.maximum(0, x @ self.p["E"] + self.p["e"])
        return h, (np.tanh(h @ self.p["V"]) * _sigmoid(h @ self.p["U"])) @ self.p["w"]

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of texts. The gate's output is bounded by the sum of |w|, so plain exponentials can be added up over groups."""
        n = len(column)
        weight, value = np.zeros(n), np.zeros(n)
        for x, row in passages(column):
            h, a = self.encode(x)
            a = np.exp(a.astype(np.float64))
            weight += np.bincount(row, a, minlength=n)
            value += np.bincount(row, a * (h @ self.p["c"]), minlength=n)
        return _sigmoid(value / np.maximum(weight, 1e-300) + float(self.p["b"][0]))

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                step += 1
                chosen = order[k:k + batch]
                g = self._gradient([bags[i] for i in chosen], labels[chosen])
                lr = rate * (1 - epoch / epochs)
                for name, d in g.items():
                    d = d + decay * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.p[name] = (self.p[name] - lr * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def _gradient(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.concatenate(bags)
        size = np.array([len(b) for b in bags])
        at = np.cumsum(size) - size
        of = np.repeat(np.arange(len(bags)), size)
        pre = x @ p["E"] + p["e"]
        h = np.maximum(0, pre)
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = np.exp((t * s) @ p["w"])
        a = a / np.add.reduceat(a, at)[of]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        error = (_sigmoid(z @ p["c"] + p["b"]) - y) / len(bags)
        dz = error[:, None] * p["c"]
        da = (dz[of] * h).sum(1)
        dlogit = a * (da - np.add.reduceat(a * da, at)[of])
        dts = dlogit[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (pre > 0)
        return {"E": x.T @ dpre, "e": dpre.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s * dlogit[:, None]).sum(0), "c": z.T @ error, "b": np.array([error.sum()])}


def passage_features(most: int) -> Callable[[Column], Column]:
    """Column function: text to the features of its passages, of `most` evenly spread ones where there are more."""
    @arrow_udf(ArrayType(FloatType()))
    def features(texts: pa.Array) -> pa.Array:
        parts = list(passages(texts)) if len(texts) else []
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, WIDTH), np.float32)
        row = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        count = np.bincount(row, minlength=len(texts))
        at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        keep = (count[row] <= most) | (at * most // np.maximum(1, count[row]) != (at - 1) * most // np.maximum(1, count[row]))
        count = np.bincount(row[keep], minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count * WIDTH)]).astype(np.int32)), pa.array(x[keep].ravel()))
    return features


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("label", "ascending")])
    bags = [np.asarray(x.values, np.float32).reshape(-1, WIDTH) for x in rows["x"].combine_chunks()]
    model = Attention().fit(bags, rows["label"].to_numpy().astype(np.float32))
    yield pa.RecordBatch.from_arrays([pa.array(list(model.p)), pa.array([v.ravel().tolist() for v in model.p.values()], pa.list_(pa.float32()))], ["name", "weight"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", fit_docs: int = 6000, fit_passages: int = 64) -> Attention | None:
    """The model fitted to at most about `fit_docs` labelled documents and `fit_passages` passages of each; None without a label."""
    sample = labelled_sample(docs, labels, label, allowed, fit_docs)
    if sample.isEmpty():
        return None
    model = Attention()
    for row in sample.select("doc_id", "label", passage_features(fit_passages)("text").alias("x")).repartition(1).mapInArrow(_fit, "name string, weight array<float>").collect():
        model.p[row["name"]] = np.array(row["weight"], np.float32).reshape(model.p[row["name"]].shape)
    return model


def scorer(model: Attention | None) -> Callable[[Column], Column]:
    """Column function: text to score, 0 to 1."""
    @arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts) if model is not None else np.full(len(texts), 0.5))
    return score


def classify(docs: DataFrame, model: Attention | None) -> DataFrame:
    """docs with score and predicted (1 if the score is 0.5 or more); columns of these names are replaced."""
    scored = docs.withColumn("score", scorer(model)(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
