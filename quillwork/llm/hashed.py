"""Hashed word and character n-gram features, and linear models over them.

A text has three blocks of features: byte trigrams, words, and pairs of
neighbouring words (an equal pair is one feature of its own). Within a block the
value of a feature is its share of the block. Models are fitted on a bounded
sample of labelled rows and score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .shared import bounded_batches, text_or_empty, written
from .words import Words, mix, slices

#: Features in the blocks (trigrams, words, pairs), as powers of two; where each block begins, and all of them.
BITS = (14, 15, 14)
BEGINS = (0, 1 << 14, (1 << 14) + (1 << 15))
SIZE = 1 << 16


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Feature of the three bytes that start at each position (two fewer than bytes)."""
    b = buf.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS[0])).astype(np.int32)


class Features:
    """For each block: the features in text order and where each text's begin and end."""

    def __init__(self, words: Words):
        tri = trigrams(words.buf) if len(words.buf) > 2 else np.zeros(0, np.int32)
        begin = words.at[:-1]
        end = np.maximum(begin, words.at[1:] - 3)
        word = (words.hash >> np.uint64(64 - BITS[1])).astype(np.int32)
        h = words.hash
        pair = (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(64 - BITS[2])).astype(np.int32)
        pair[h[:-1] == h[1:]] = 0
        first = words.first
        self.blocks = [
            (tri, begin, end),
            (word, first[:-1], first[1:]),
            (pair, first[:-1], np.maximum(first[:-1], first[1:] - 1)),
        ]

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of one text."""
        numbers, values = [], []
        for k, (feature, begin, end) in enumerate(self.blocks):
            found, count = np.unique(feature[begin[d] : end[d]], return_counts=True)
            numbers.append(found + BEGINS[k])
            values.append(count / max(1, end[d] - begin[d]))
        return np.concatenate(numbers).astype(np.uint16), np.concatenate(values).astype(np.float32)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Texts x classes: the dot products with ``weights`` (features x classes)."""
        out = np.zeros((len(self.blocks[0][1]), weights.shape[1]))
        for k, (feature, begin, end) in enumerate(self.blocks):
            for c in range(weights.shape[1]):
                total = np.zeros(len(feature) + 1)
                np.cumsum(weights[BEGINS[k] : BEGINS[k] + (1 << BITS[k]), c][feature], out=total[1:])
                out[:, c] += (total[end] - total[begin]) / np.maximum(1, end - begin)
        return out


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in slices(batch):
            features = Features(Words(texts, lower=False))
            found = [features.of(d) for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(texts)), batch.column(2).slice(row, len(texts)), pa.array([n.tobytes() for n, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                ["label", "fold", "numbers", "values"],
            )


def labelled_sample(docs: DataFrame, labelled: DataFrame, rows_per_label: int) -> tuple[list[dict], dict[int, int]]:
    """Features of at most ``rows_per_label`` documents of each label, chosen by hashes of id and text, and the label counts.

    ``labelled``: ``doc_id, label`` with small integer labels; null ids and labels
    are left out. Where several documents have a labelled id, each counts on its own;
    documents that repeat as a whole count once. Only the sample comes to the driver,
    as features.
    """
    bounded_batches(docs.sparkSession)
    labelled = labelled.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}

    def first(rows: DataFrame, *order: str) -> DataFrame:
        parts = [rows.where(F.col("label") == label).orderBy(*order).limit(rows_per_label) for label in sorted(counts)]
        return reduce(DataFrame.unionByName, parts)

    # Of the ids first, so that what is compared with all documents is small; then of the documents that have them.
    ids = written(first(labelled.distinct().withColumn("fold", F.xxhash64("doc_id")), "fold", "doc_id"), "label-ids")
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.xxhash64("text"))
    found = texts.select("doc_id", "digest").join(F.broadcast(ids), "doc_id").distinct()
    chosen = written(first(found, "fold", "doc_id", "digest"), "label-documents")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["label", "doc_id", "digest"]).select("label", "text", F.pmod("fold", F.lit(5)).cast("int").alias("fold"))
    return rows.mapInArrow(_sample_task, "label int, fold int, numbers binary, values binary").toArrow().to_pylist(), counts


class _Sample:
    """Feature rows one after the other, gone through in parts that bound what is held at once."""

    def __init__(self, rows: list[dict], classes: list[int]):
        rows = [r for r in rows if r["numbers"]]
        self.numbers = np.concatenate([np.frombuffer(r["numbers"], np.uint16) for r in rows])
        self.values = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
        self.bounds = np.concatenate([[0], np.cumsum([len(r["numbers"]) // 2 for r in rows])])
        self.target = np.eye(len(classes), dtype=np.float32)[[classes.index(r["label"]) for r in rows]]

    def parts(self, most: int = 400_000):
        """Rows i to j with about ``most`` features: (i, j, first feature, last feature)."""
        i = 0
        while i < len(self.target):
            j = max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + most, "right")) - 1)
            yield i, j, int(self.bounds[i]), int(self.bounds[j])
            i = j

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.target), weights.shape[1]), np.float32)
        for i, j, a, b in self.parts():
            out[i:j] = np.add.reduceat(self.values[a:b, None] * weights[self.numbers[a:b]], self.bounds[i:j] - a)
        return out

    def pulls(self, gap: np.ndarray) -> np.ndarray:
        """Features x classes: what each feature's weight has to do with the gaps of the rows."""
        out = np.zeros((SIZE, gap.shape[1]))
        for i, j, a, b in self.parts():
            each = np.repeat(gap[i:j], np.diff(self.bounds[i : j + 1]), axis=0) * self.values[a:b, None]
            for c in range(gap.shape[1]):
                out[:, c] += np.bincount(self.numbers[a:b], each[:, c], len(out))
        return out


def _shares(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Model:
    """Multinomial logistic regression, its scores scaled on a held-out fold; with ``level``, to calibrated probabilities."""

    def __init__(self, sample: list[dict], counts: dict[int, int], steps: int = 80, penalty: float = 1e-4, level: bool = False):
        self.classes = sorted(counts)
        # The order of rows from Spark is not fixed; sums of floats depend on it.
        sample = sorted(sample, key=lambda r: (r["fold"], r["label"], r["numbers"], r["values"]))
        every = {r["label"] for r in sample if r["numbers"]}
        fit, held = ([r for r in sample if bool(r["fold"]) == side and r["numbers"]] for side in (True, False))
        fit = fit if {r["label"] for r in fit} == every else sample
        held = held if {r["label"] for r in held} == every else sample
        self.weights, self.bias = self._fit(_Sample(fit, self.classes), steps, penalty)
        self.typical = None
        self.scale, self.shift = (self._calibrate if level else self._scaled)(_Sample(held, self.classes), counts)

    @staticmethod
    def _fit(rows: _Sample, steps: int, penalty: float):
        size, n, classes = SIZE, *rows.target.shape
        mean = np.bincount(rows.numbers, rows.values, size) / n
        spread = np.sqrt(np.maximum(np.bincount(rows.numbers, rows.values**2, size) / n - mean**2, 0)) + 1e-4
        share = (rows.target / np.maximum(1, rows.target.sum(0))).sum(1, keepdims=True) / classes  # every label counts the same
        w, bias = np.zeros((size, classes)), np.zeros(classes)
        m, v, bm, bv = np.zeros_like(w), np.zeros_like(w), np.zeros(classes), np.zeros(classes)
        for step in range(1, steps + 1):
            gap = (_shares(rows.scores((w / spread[:, None]).astype(np.float32)) + bias) - rows.target) * share
            grad, gbias = rows.pulls(gap) / spread[:, None] + penalty * w, gap.sum(0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            bm, bv = 0.9 * bm + 0.1 * gbias, 0.99 * bv + 0.01 * gbias**2
            rate = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            w -= rate * m / (np.sqrt(v) + 1e-8)
            bias -= rate * bm / (np.sqrt(bv) + 1e-8)
        return (w / spread[:, None]).astype(np.float32), bias

    def _scaled(self, rows: _Sample, counts: dict[int, int]):
        """One factor and a shift per class by gradient steps on held-out rows: sharp posteriors, not probabilities.

        Mixing needs them: its targets lie outside of what probabilities that allow
        for wrong labels can add up to.
        """
        raw = (rows.scores(self.weights) + self.bias).astype(float)
        weight = rows.target @ (np.array([counts[c] for c in self.classes]) / np.maximum(1, rows.target.sum(0)))[:, None]
        weight = weight / weight.sum()
        scale, shift = 1.0, np.log(np.array([counts[c] for c in self.classes]) / sum(counts.values()))
        for _ in range(500):
            gap = (_shares(scale * raw + shift) - rows.target) * weight
            scale = max(0.05, scale - 0.5 * float((gap * raw).sum()) / max(1.0, float(np.abs(raw).mean()) ** 2))
            shift = shift - 2.0 * gap.sum(0)
        return scale, shift

    def _calibrate(self, rows: _Sample, counts: dict[int, int]):
        """A factor and a shift per class, fitted on held-out rows weighted to the true label counts.

        They apply to scores that level off (``_levelled``): however far a text lies
        from the boundary, its probability stays within what wrong labels allow.
        Newton's method, with a slight pull to 0 that keeps the system regular.
        """
        raw = (rows.scores(self.weights) + self.bias).astype(float)
        self.typical = float(np.median(np.abs(raw - raw.mean(1, keepdims=True)))) + 1e-6
        x = self._levelled(raw)
        weight = rows.target @ (np.array([counts[c] for c in self.classes]) / np.maximum(1, rows.target.sum(0)))
        weight = weight / weight.sum()
        n, k = x.shape
        found, pull = np.concatenate([[1.0], np.zeros(k)]), 1.0 / max(10, n)
        # Each row's scores are linear in the parameters: k x (1 + k).
        linear = np.concatenate([x[:, :, None], np.broadcast_to(np.eye(k), (n, k, k))], axis=2)

        def loss(at):
            p = _shares(linear @ at)
            return -float(weight @ np.log((p * rows.target).sum(1) + 1e-300)) + pull / 2 * float(at @ at)

        for _ in range(50):
            p = _shares(linear @ found)
            grad = np.einsum("n,nk,nkj->j", weight, p - rows.target, linear) + pull * found
            mean = np.einsum("nk,nkj->nj", p, linear)
            bend = np.einsum("n,nk,nki,nkj->ij", weight, p, linear, linear) - np.einsum("n,ni,nj->ij", weight, mean, mean) + pull * np.eye(1 + k)
            step = np.linalg.solve(bend, grad)
            while np.abs(step).max() > 1e-9 and loss(found - step) > loss(found):
                step = step / 2
            found = found - step
            if np.abs(step).max() <= 1e-9:
                break
        return max(0.05, float(found[0])), found[1:]

    def _levelled(self, raw: np.ndarray) -> np.ndarray:
        """Scores about their mean, between -1 and 1: half of that at the typical distance."""
        off = raw - raw.mean(1, keepdims=True)
        return off / (np.abs(off) + self.typical)

    def state(self) -> tuple:
        """What a worker needs to score: plain values, for a broadcast."""
        return self.classes, self.weights, self.bias, self.typical, self.scale, self.shift

    @classmethod
    def restored(cls, state: tuple) -> Model:
        model = cls.__new__(cls)
        model.classes, model.weights, model.bias, model.typical, model.scale, model.shift = state
        return model

    def probabilities(self, features: Features) -> np.ndarray:
        """Texts x classes, in the order of ``classes``."""
        return self.calibrated(features.scores(self.weights) + self.bias)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return _shares(self.scale * (raw if self.typical is None else self._levelled(raw)) + self.shift)
