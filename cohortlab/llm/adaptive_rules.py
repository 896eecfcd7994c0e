"""Quality rules with adaptive thresholds per language and source.

Every document is measured once. The measures of all documents go into
quantile sketches per (lang, source): histograms over logarithmic buckets
(relative error ``GAMMA`` - 1), which merge by adding counts, so a hot source is
combined map-side and the result does not depend on the layout. Limits come
from each sketch's own quantiles and replace fixed cutoffs; a small group
borrows the sketch of its language, then of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow, stage

# Fixed rules on top of the adaptive ones.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Ratio of neighbouring bucket borders.
GAMMA = 1.02
# Groups below this many measured documents use the next wider group.
MIN_GROUP = 200
# A limit lies SPREAD times the way from the median to the outer quantile beyond it.
OUTER, SPREAD = 0.75, 6.0

# Measures and the sides on which they are limited, and the least distance of
# a limit from the median, in the measure's own unit.
MEASURES: dict[str, tuple[str, float]] = {
    "word_length": ("both", 1.5),
    "symbol_ratio": ("high", 0.10),
    "dup_line_ratio": ("high", 0.50),
    "repeat_ratio": ("high", 0.45),
    "upper_ratio": ("high", 0.20),
    "digit_ratio": ("high", 0.25),
    "unique_ratio": ("low", 0.25),
}

SYMBOLS = b"#*$%&|<>"


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SPACE = byte_class(b" \t\n\v\f\r")
SYMBOL = byte_class(SYMBOLS)
DIGIT = byte_class(b"0123456789")
UPPER = byte_class(bytes(range(65, 91)))
LETTER = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)))
POINT = np.array([0 if 0x80 <= i < 0xC0 else 1 for i in range(256)], np.uint8)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; long words are not remembered."""

    LIMIT, LONGEST = 200_000, 64

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = code
        return code


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``bounds``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each text; null counts as empty."""
    raw = [(t or "").encode() for t in texts]
    split = [r.split() for r in raw]
    n_words = np.array([len(w) for w in split], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    filled = ends[1:] > ends[:-1]

    def of(kind: np.ndarray) -> np.ndarray:
        """Bytes of a class in each text: one byte of scratch per byte of text."""
        out = np.zeros(len(raw), np.int64)
        if filled.any():
            out[filled] = np.add.reduceat(kind[data], ends[:-1][filled], dtype=np.int64)
        return out

    points, spaces = of(POINT), of(SPACE)

    code = np.fromiter(map(word_hashes().__getitem__, (w for words in split for w in words)), np.uint64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(raw), dtype=np.uint64), n_words)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    repeat = np.zeros(len(code), bool)
    if len(code) >= 3:
        windows = ((code[:-2] * M1 ^ (code[1:-1] >> np.uint64(7))) * M2 + code[1:-1]) * M3 + code[2:] * M2
        windows = (windows ^ (windows >> np.uint64(31))) * M1 + doc[2:] * M3
        windows ^= windows >> np.uint64(29)
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        order = inside[np.argsort(windows[inside], kind="stable")]
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        for k in range(3):
            repeat[at + k] = True
    own = code * M1 + doc * M3
    own ^= own >> np.uint64(29)
    order = np.argsort(own, kind="stable")
    first = np.zeros(len(own), bool)
    if len(own):
        first[order] = np.concatenate([[True], own[order][1:] != own[order][:-1]])

    n_dup, n_lines = [], []
    for r in raw:
        lines = [x for x in r.split(b"\n") if x.strip()]
        n_dup.append(len(lines) - len(set(lines)))
        n_lines.append(len(lines))
    return {
        "n_words": n_words,
        "word_chars": points - spaces,
        "n_symbols": of(SYMBOL),
        "n_dup_lines": np.array(n_dup, np.int64),
        "n_repeat_words": per_document(repeat, bounds),
        "n_lines": np.array(n_lines, np.int64),
        "n_unique_words": per_document(first, bounds),
        "n_upper": of(UPPER),
        "n_letters": of(LETTER),
        "n_digits": of(DIGIT),
    }


COUNTS = tuple(measure([]))
PREFIX = "_q_"


def score(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the counts of ``COUNTS`` as ``_q_`` columns; without ``keep_text`` the text itself goes."""
    names = [PREFIX + c for c in COUNTS]
    docs = docs.drop(*names)
    kept = docs if keep_text else docs.drop(text)
    schema = kept.withColumns({n: F.lit(0).cast("long") for n in names}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            counts = measure(batch.column(at).to_pylist())
            rest = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), *(pa.array(v, pa.int64()) for v in counts.values())],
                names=[*(batch.schema.names[i] for i in rest), *names],
            )
        word_hashes().clear()

    return arrow(docs, run, schema)


def ratios() -> dict[str, Column]:
    c = {name: F.col(PREFIX + name).cast("double") for name in COUNTS}
    over = lambda a, b: F.when(b > 0, a / b)
    return {
        "word_length": over(c["word_chars"], c["n_words"]),
        "symbol_ratio": over(c["n_symbols"], c["n_words"]),
        "dup_line_ratio": over(c["n_dup_lines"], c["n_lines"]),
        "repeat_ratio": over(c["n_repeat_words"], c["n_words"]),
        "upper_ratio": over(c["n_upper"], c["n_letters"]),
        "digit_ratio": over(c["n_digits"], c["word_chars"]),
        # distinct words fall behind with length as a root of it; Guiraud's index levels that
        "unique_ratio": over(c["n_unique_words"], F.sqrt(c["n_words"])),
    }


def sketches(scored: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts per group and measure: (lang, source, measure, bucket, n). Sketches merge by summing n.

    Documents that fail the fixed rules are left out, so junk does not move the limits.
    Bucket k > 0 holds values up to ``GAMMA`` ** (k - 1000); bucket 0 holds zeros.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("v")) for m, v in ratios().items()])
    bucket = F.when(F.col("v") > 0, F.greatest(F.ceil(F.log("v") / np.log(GAMMA)) + 1000, F.lit(1))).otherwise(0).cast("int")
    return (
        scored.filter(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
        .select("lang", "source", "p.*")
        .filter("v IS NOT NULL")
        .groupBy("lang", "source", "measure", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def base_failed(n_words: str = PREFIX + "n_words", n_repeat: str = PREFIX + "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT_PERCENT * F.col(n_words))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower and upper limits per group of ``keys``: one row with ``docs`` and a map from measure to (low, high)."""
    group = Window.partitionBy(*keys, "measure")
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.withColumns({"cum": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 1000.5))
    at = lambda p: F.min(F.when(F.col("cum") >= p * F.col("all"), value))
    q = ranked.groupBy(*keys, "measure").agg(
        at(1 - OUTER).alias("lo"), at(0.5).alias("mid"), at(OUTER).alias("hi"), F.max("all").alias("docs")
    )
    side, least = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (which, by) in MEASURES.items():
        side = F.when(F.col("measure") == name, F.lit(which)).otherwise(side)
        least = F.when(F.col("measure") == name, F.lit(by) * (F.col("mid") if name in ("unique_ratio",) else F.lit(1.0))).otherwise(least)
    low = F.when(side != "high", F.col("mid") - F.greatest(SPREAD * (F.col("mid") - F.col("lo")), least))
    high = F.when(side != "low", F.col("mid") + F.greatest(SPREAD * (F.col("hi") - F.col("mid")), least))
    return q.groupBy(*keys).agg(
        F.max("docs").alias("docs"),
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct(low.alias("low"), high.alias("high"))))).alias("limits"),
    )


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Limits per (lang, source) with back-off to (lang) and to all; null is a language and a source of its own."""
    fine = limits(sketch, ["lang", "source"])
    by_lang = limits(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), F.col("limits").alias("l_limits"))
    whole = limits(sketch.withColumn("g", F.lit(0)), ["g"]).select(F.col("limits").alias("a_limits"))
    # ``whole`` has one row
    return (
        fine.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
        .join(F.broadcast(whole), F.lit(True), "left")
        .select(
            F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source"),
            F.when(F.col("docs") >= min_group, F.col("limits"))
            .when(F.col("l_docs") >= min_group, F.col("l_limits"))
            .otherwise(F.col("a_limits")).alias("_t_limits"),
        )
    )


def judge(scored: DataFrame, limit: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``reasons`` (sorted names of broken limits).

    A document is kept if it passes the fixed rules and no measure lies
    outside its group's limits; a measure without a value never fails. A
    group without limits has only documents that fail the fixed rules.
    """
    broken = []
    for name, v in ratios().items():
        at = F.col("_t_limits")[name]
        broken.append(F.when(F.coalesce((v < at["low"]) | (v > at["high"]), F.lit(False)), F.lit(name)))
    out = scored.join(limit, F.col(lang).eqNullSafe(F.col("_t_lang")) & F.col(source).eqNullSafe(F.col("_t_source")), "left")
    return (
        out.withColumns({"base_failed": base_failed(), "reasons": F.array_sort(F.array_compact(F.array(*broken)))})
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
        .drop("_t_lang", "_t_source", "_t_limits")
    )


def verdicts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and verdict of every document; null and empty texts have no words and fail."""
    scored = stage(score(docs.select(key, "lang", "source", "text"), keep_text=False), "measured")
    judged = judge(scored, stage(thresholds(sketches(scored)), "limits"))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(key, *[F.col(PREFIX + c).alias(c) for c in shown], "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    columns = docs.columns
    clash = {c: f"_own_{c}" for c in ("base_failed", "kept", "reasons") if c in columns}
    scored = stage(score(docs.withColumnsRenamed(clash)), "measured")
    judged = judge(scored, stage(thresholds(sketches(scored)), "limits"))
    return judged.filter("kept").select(*[F.col(clash.get(c, c)).alias(c) for c in columns])
