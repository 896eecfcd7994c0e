"""Benchmark decontamination: windows of test items found in training texts.

Benchmark items are cut into windows of ``size`` normalised words. Their hash
set goes to every task as a Spark broadcast of bounded size; each document is
scanned once, window hashes that hit are verified word by word, and hit words
are reported or removed. A larger benchmark is split into blocks of bounded
size, each scanned against all documents, and the hits are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.llm.common import arrow, stage

WINDOW = 10
# Most benchmark text that is broadcast at once; its index takes about 30 times as much.
BLOCK_BYTES = 4 << 20
# A document that loses more than this share of its words goes as a whole.
DROP_SHARE = 0.5

# Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased.
WORDS = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` ids."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * MIX + ids[k : len(out) + k].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """Windows of one block of items, by their number of words."""

    vocabulary: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    items: dict[tuple[int, ...], list[str]]


# Words as they stand in a text, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def build(items: list[tuple[str, str | None]], size: int) -> Index:
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        n = min(size, len(ids))
        for i in range(len(ids) - n + 1 if n else 0):
            windows.setdefault(tuple(ids[i : i + n]), set()).add(item)
    hashes = {}
    for n in {len(w) for w in windows}:
        rows = np.array([w for w in windows if len(w) == n], np.int64)
        out = np.zeros(len(rows), np.uint64)
        for k in range(n):
            out = out * MIX + rows[:, k].astype(np.uint64)
            out ^= out >> np.uint64(29)
        hashes[n] = np.unique(out)
    return Index(vocabulary, hashes, {w: sorted(found) for w, found in windows.items()})


def hits(texts: list[str | None], index: Index) -> Iterator[tuple[int, list[int], list[str]]]:
    """Per text: number of words, positions of hit words in order, items with an occurring window."""
    get = index.vocabulary.get
    split = [words_of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])])
    # a zero between documents and for every word that no item has
    ids = np.zeros(int(starts[-1]), np.int64)
    for words, at in zip(split, starts, strict=False):
        ids[at : at + len(words)] = [get(w, 0) for w in words]
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    found: dict[int, tuple[set[int], set[str]]] = {}
    for n, hashes in index.hashes.items():
        if len(ids) < n:
            continue
        whole = np.flatnonzero(known[n:] - known[:-n] == n)
        if not len(whole):
            continue
        code = np.zeros(len(whole), np.uint64)
        for k in range(n):
            code = code * MIX + ids[whole + k].astype(np.uint64)
            code ^= code >> np.uint64(29)
        at = np.searchsorted(hashes, code)
        whole = whole[hashes[np.minimum(at, len(hashes) - 1)] == code]
        for i, doc in zip(whole.tolist(), (np.searchsorted(starts, whole, "right") - 1).tolist(), strict=True):
            items = index.items.get(tuple(ids[i : i + n].tolist()))
            if items:
                words, names = found.setdefault(doc, (set(), set()))
                words.update(range(i - int(starts[doc]), i - int(starts[doc]) + n))
                names.update(items)
    for doc, words in enumerate(split):
        at, names = found.get(doc, ((), ()))
        yield len(words), sorted(at), sorted(names)


def pieces(benchmark: DataFrame, item: str, text: str, size: int, piece_bytes: int) -> DataFrame:
    """Different (i, t) of the benchmark; longer texts in pieces that share ``size`` - 1 words, so together they have the same windows.

    A piece has about ``piece_bytes``. Items without an id go by the name ``null``.
    """
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).distinct()
    long = F.octet_length("t") > piece_bytes
    words = rows.filter(long).select("i", F.octet_length("t").alias("bytes"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    step = F.greatest(F.floor(n * (piece_bytes / F.col("bytes"))), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), step)
    cut = words.filter(n > 0).select("i", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("w", at + 1, step + size - 1), " "))).alias("t"))
    return rows.filter(F.coalesce(~long, F.lit(True))).unionByName(cut).distinct()


def blocks(benchmark: DataFrame, item: str, text: str, size: int, block_bytes: int) -> tuple[int, Iterator[Index]]:
    """How many bounded blocks the benchmark has, and their indexes, each built when it is asked for; one empty index for an empty benchmark."""
    rows = stage(pieces(benchmark, item, text, size, block_bytes // 8), "benchmark-pieces")
    total = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n = -(-total // block_bytes)
    n = 2 * n if n > 1 else 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, (build([tuple(r) for r in rows.filter(part == k).collect()], size) for k in range(n))


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as no column begins with."""
    while any(c.lower().startswith(name) for c in columns):
        name = "_" + name
    return name


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """Replace the text by what the benchmark hits: ``n_words``, ``hit_words`` (positions), ``items`` (ids as sorted strings).

    An item of fewer than ``size`` words is one window; items and documents
    without words (null, empty, symbols only) never match. Every row of
    ``docs`` gives one row; other columns pass through (columns with the names
    of the three new ones are replaced; ``prefix`` renames the new ones).
    Items with the same id count once.
    """
    n_words, hit_words, found_items = (prefix + name for name in ("n_words", "hit_words", "items"))
    sc = docs.sparkSession.sparkContext
    rest = docs.drop(n_words, hit_words, found_items)
    new = {n_words: F.lit(0).cast("long"), hit_words: F.lit(None).cast("array<int>"), found_items: F.lit(None).cast("array<string>")}
    shape = rest.drop(text).withColumns(new).schema

    def one(sent: Broadcast, source: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                n, words, items = zip(*hits(batch.column(at).to_pylist(), sent.value), strict=True) if batch.num_rows else ((), (), ())
                out = [pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                kept = [i for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), *out],
                    names=[*(batch.schema.names[i] for i in kept), n_words, hit_words, found_items],
                )

        return arrow(source, run, shape)

    n, indexes = blocks(benchmark, item, "text", size, block_bytes)
    if n == 1:
        return one(sc.broadcast(next(indexes)), rest)
    # rows are told apart by a number that is fixed before the first scan
    row = unused(docs.columns, "_row")
    numbered = stage(rest.withColumn(row, F.monotonically_increasing_id()), "numbered")
    shape = T.StructType([T.StructField(row, T.LongType()), *shape.fields[-3:]])
    found = []
    for index in indexes:
        # one index at a time, on the driver as on the executors
        sent = sc.broadcast(index)
        found.append(stage(one(sent, numbered.select(row, text)).filter(F.size(found_items) > 0), "hits"))
        sent.destroy()
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    union = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in (hit_words, found_items)}
    merged = merged.groupBy(row).agg(*[c.alias(name) for name, c in union.items()])
    counted = one(sc.broadcast(Index({}, {}, {})), numbered.select(row, text)).select(row, n_words)
    empty = {hit_words: F.coalesce(hit_words, F.array().cast("array<int>")), found_items: F.coalesce(found_items, F.array().cast("array<string>"))}
    return numbered.drop(text).join(counted, row).join(merged, row, "left").withColumns(empty).drop(row)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per document and a digest of the items found in it."""
    return scan(docs.select(key, "text"), benchmark).select(
        key,
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def cut(text: str, positions: list[int]) -> str:
    """``text`` without the words at ``positions`` and what stands between two of them; the rest is unchanged."""
    ends, raw = [], text.encode()
    plain, at = raw.translate(WORDS), 0
    for word in plain.split():
        begin = plain.index(word, at)
        at = begin + len(word)
        ends.append((begin, at))
    out, kept, i = [], 0, 0
    while i < len(positions):
        j = i
        while j + 1 < len(positions) and positions[j + 1] == positions[j] + 1:
            j += 1
        out.append(raw[kept : ends[positions[i]][0]])
        kept, i = ends[positions[j]][1], j + 1
    return b"".join([*out, raw[kept:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = DROP_SHARE) -> DataFrame:
    """Documents without their hit spans, all columns kept.

    A document of which more than ``drop_share`` of the words are hit is
    removed; clean documents pass unchanged. ``n_chars``, if there, follows
    a changed text.
    """
    own = unused(docs.columns, "_scan_")
    both = scan(docs.withColumn(own + "text", F.col(text)), benchmark, text=own + "text", prefix=own)
    schema = docs.schema
    kept = both.filter(F.size(own + "hit_words") <= drop_share * F.col(own + "n_words")).select(*docs.columns, own + "hit_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.schema.names[:-1], batch.columns[:-1]
            words = batch.column(batch.num_columns - 1).to_pylist()
            if any(words):
                at = names.index(text)
                texts = [cut(t, w) if w else t for t, w in zip(columns[at].to_pylist(), words, strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    n = columns[names.index("n_chars")]
                    new = [len(t) if w else k for t, w, k in zip(texts, words, n.to_pylist(), strict=True)]
                    columns[names.index("n_chars")] = pa.array(new, n.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow(kept, run, schema)
