"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its hashed byte n-grams; a linear
softmax turns the mean into language scores. Embeddings and softmax are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows.
A part of the sample is set aside: it fits the temperature that calibrates
the scores and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow, bounded_sample

# Labelled rows per language the model may be fitted on.
SAMPLE_ROWS = 1500

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.8
# Share of the sample kept for calibration, and the share of its right predictions that rejection may cost.
CALIBRATION = 0.2
REJECTED = 0.005

UNKNOWN = "und"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(raw: bytes, text: str) -> bool:
    return len(raw.translate(None, LETTERS)) < len(raw) or any(map(str.isalpha, text))


def subwords(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at every position (the last n - 1 positions have none)."""
    code = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) + data[k : len(code) + k]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
    return (code >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1)


def plain(text: str | None) -> bytes:
    """A-Z lower-cased, white space as single spaces, a space at both ends; digits and symbols stay out of n-grams as spaces."""
    raw = (text or "").encode().translate(KEEP)
    return b" " + b" ".join(raw.split()) + b" "


KEEP = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 or i == 39 else 32 for i in range(256))


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    data = np.frombuffer(plain(text), np.uint8).astype(np.uint32)
    found = np.concatenate([subwords(data, n) for n in ORDERS])
    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, len(found))).astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # embeddings times softmax weights: BUCKETS x labels
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities, one row per text."""
        raw = [plain(t) for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        total, count = np.zeros((len(raw), len(self.labels))), np.zeros(len(raw))
        for n in ORDERS:
            value = subwords(data, n)
            for i in range(len(raw)):
                part = value[ends[i] : max(ends[i], ends[i + 1] - n + 1)]
                if len(part):
                    total[i] += np.bincount(part, minlength=BUCKETS) @ self.logits if len(part) > 8192 else self.logits[part].sum(0)
                    count[i] += len(part)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fit on (label, buckets, shares). At least one row is needed."""
    labels = sorted({r[0] for r in rows})
    y = np.array([labels.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside = order[: int(len(rows) * CALIBRATION)]
    learn = order[len(aside) :]
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = np.zeros((DIMENSIONS, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            _, at, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ emb[at]
            error = -softmax(mean @ out + bias)
            error[y[i]] += 1
            back = out @ error
            out += rate * np.outer(mean, error)
            bias += 0.1 * rate * error
            # shares are small; the square root keeps rare and common buckets moving
            emb[at] += rate * np.sqrt(share)[:, None] * back
    logits = emb @ out
    held = aside if len(aside) else learn
    raw = np.stack([rows[i][2] @ logits[rows[i][1]] + bias for i in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(raw / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(raw / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(labels, logits, bias, temperature, float(np.quantile(right, REJECTED)) if len(right) else 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on a bounded sample of the rows of ``docs`` that have a language; None if there are none.

    Rows whose text has no letter teach nothing. The sample's texts are
    turned into at most ``BUCKETS`` shares each by the executors.
    """
    some = bounded_sample(docs.filter(F.col(lang).isNotNull()).select(key, lang, text), rows, key, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(la, *featurise(t)) for la, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and has_letter(t.encode(), t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in found], pa.string()),
                    pa.array([r[1].tobytes() for r in found], pa.binary()),
                    pa.array([r[2].tobytes() for r in found], pa.binary()),
                ],
                names=["lang", "at", "share"],
            )

    sampled = arrow(some.select(lang, text), run, "lang string, at binary, share binary").toArrow()
    data = zip(*(sampled.column(c).to_pylist() for c in ("lang", "at", "share")), strict=True)
    # in a fixed order, whatever order the tasks ended in
    rows_ = sorted((la, at, share) for la, at, share in data)
    ready = [(la, np.frombuffer(at, np.int32), np.frombuffer(share, np.float32)) for la, at, share in rows_]
    return train(ready) if ready else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Replace the text by the predicted language, its calibrated score and whether the score is too low to trust.

    Null texts and texts without a letter, and all texts without a model, are
    ``und`` with score 0 and rejected. Other columns and repeated rows pass through.
    """
    rest = docs.drop(*names)
    schema = rest.drop(text).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0), names[2]: F.lit(True)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            usable = [model is not None and bool(t) and has_letter(t.encode(), t) for t in texts]
            p = model.scores(texts) if model is not None and texts else np.zeros((len(texts), 1))
            best, top = p.argmax(1), p.max(1)
            langs = [model.labels[b] if u else UNKNOWN for u, b in zip(usable, best, strict=True)]
            score = [float(s) if u else 0.0 for u, s in zip(usable, top, strict=True)]
            poor = [not u or s < model.reject_below for u, s in zip(usable, score, strict=True)]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(poor, pa.bool_())],
                names=[*(batch.schema.names[i] for i in kept), *names],
            )

    return arrow(rest, run, schema)
