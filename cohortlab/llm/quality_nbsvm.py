"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of hashed n-grams: single words and pairs, and
runs of up to three word shapes (case, digits, symbols, length, repetition of
the word before). Class counts of every feature over all labelled training
rows give log-count ratios; indicators scaled by them feed a linear
hinge-loss model, fitted by dual coordinate descent on a bounded sample.
A logistic curve over the sample's margins turns margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.adaptive_rules import word_hashes
from cohortlab.llm.common import arrow, bounded_sample

# Labelled rows per class the hinge-loss model may be fitted on.
SAMPLE_ROWS = 3000

BUCKETS = 1 << 18
SMOOTHING = 1.0
COST = 0.1
PASSES = 12
# Every this many-th sampled row calibrates and is not fitted on.
ASIDE = 5

SHAPES = bytes(
    65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.S)


class ShapeHashes(dict):
    """Hash of a word's shape by the word, remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shape = RUNS.sub(rb"\1+", word.translate(SHAPES)) + b"|%d" % min(4, len(word) // 8)
        code = self[word] = xxhash.xxh3_64_intdigest(shape)
        return code


SHAPE_HASHES = ShapeHashes()
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def spread(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(32))) * A
    return (code >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of one text; a text without words has the single feature of being empty."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(1, np.int32)
    low = np.fromiter(map(word_hashes().__getitem__, (w.lower() for w in words)), np.uint64, len(words))
    shape = np.fromiter(map(SHAPE_HASHES.__getitem__, words), np.uint64, len(words))
    again = np.concatenate([[False], low[1:] == low[:-1]])
    shape = shape * C + again.astype(np.uint64) * B
    found = [low * A, shape + B]
    if len(words) > 1:
        found += [low[:-1] * B + low[1:], shape[:-1] * B + shape[1:] * A + C]
    if len(words) > 2:
        found.append(shape[:-2] * B + shape[1:-1] * C + shape[2:] * A)
    return np.unique(spread(np.concatenate(found)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(len(at)) + self.bias)

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -30, 30))))


def ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-count ratios of smoothed class counts."""
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is a constant feature."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    values = [r[at] / np.sqrt(len(at)) for at in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton steps on regularised targets."""
    n_good, n_bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-6), float(b)


def class_counts(labelled: DataFrame, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class that have each feature, over all labelled rows: at most BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (good if k == 1 else bad)[features(t)] += 1
        at = np.flatnonzero(good + bad)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(good[some]), pa.array(bad[some])], names=["f", "good", "bad"])

    parts = arrow(labelled.select(text, label), run, "f long, good long, bad long")
    total = parts.groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = total.column("f").to_numpy()
    good[at], bad[at] = total.column("good").to_numpy(), total.column("bad").to_numpy()
    return good, bad


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Train on rows with label 1 or 0. With one class only, or no rows, the model knows the prior alone."""
    known = labelled.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label), text)
    good, bad = class_counts(known, text, label)
    r = ratios(good, bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(i) for i in ids]), pa.array(labels, pa.int32()), pa.array([features(t).tobytes() for t in texts], pa.binary())],
                names=["key", "label", "at"],
            )

    sample = arrow(bounded_sample(known, rows, key, label), run, "key string, label int, at binary").toArrow()
    data = sorted(zip(*(sample.column(c).to_pylist() for c in ("key", "label", "at")), strict=True))
    at = [np.frombuffer(d[2], np.int32) for d in data]
    y = np.array([1.0 if d[1] == 1 else -1.0 for d in data])
    if len(set(y.tolist())) < 2:
        sure = (4.0 if y[0] > 0 else -4.0) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1e-6, sure)
    aside = np.arange(len(y)) % ASIDE == 0 if len(y) >= 10 * ASIDE else np.zeros(len(y), bool)
    learn = np.flatnonzero(~aside)
    # both classes weigh the same, however many rows each has
    share = {s: (y[learn] == s).sum() for s in (1.0, -1.0)}
    cost = np.array([COST * len(learn) / (2 * max(1, share[y[i]])) for i in learn])
    w, b = descend([at[i] for i in learn], y[learn], r, cost)
    model = Model((w * r).astype(np.float32), b, 1.0, 0.0)
    test = np.flatnonzero(aside) if len(set(y[aside].tolist())) == 2 else learn
    model.slope, model.offset = platt(np.array([model.margin(at[i]) for i in test]), y[test])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Replace the text by its score in (0, 1); null and empty texts get the score of an empty text."""
    rest = docs.drop(out)
    schema = rest.drop(text).withColumn(out, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            scores = [model.score(features(t)) for t in batch.column(at).to_pylist()]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(scores, pa.float64())],
                names=[*(batch.schema.names[i] for i in kept), out],
            )

    return arrow(rest, run, schema)
