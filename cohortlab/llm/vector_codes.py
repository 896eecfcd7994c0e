"""Short codes for vectors: one small codebook per part of the vector, in exact integers.

Components are scaled to integers, vectors are cut into equal parts, and each
part is coded by the nearest of its codebook's entries. Entries are fitted by
rounds over all rows: tasks add up the parts of each entry, Spark adds up the
tasks, and what reaches the driver is one row per part and entry.

The nearest entry is found by slice and intersect. Per dimension the entries'
coordinates are sorted, and prefix masks say which entries come before a place
in that order. Two binary searches around a coordinate, a radius apart, give
the entries of a slice as the difference of two prefix masks; the AND over all
dimensions gives the entries in a cube. Only these are measured. If the best of
them is no farther than the radius, no entry outside can be as near; otherwise
the search is repeated with the distance found, or twice the radius if
the cube was empty. So the result is exact for any first radius, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow, sized, stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Scaled components stay below this, so that squared distances and sums are exact in 64 bits.
LARGEST = 1 << 28
WORD = 64


class Slices:
    """One part's codebook: nearest entry of many points by masks of sorted coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        n, dims = self.entries.shape
        self.words = -(-n // WORD)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.coordinates = [self.entries[order[:, j], j] for j in range(dims)]
        bits = np.zeros((n, self.words), np.uint64)
        bits[np.arange(n), np.arange(n) // WORD] = np.uint64(1) << (np.arange(n) % WORD).astype(np.uint64)
        # prefix[j][i]: the entries at the first i places of dimension j
        self.prefix = [np.vstack([np.zeros((1, self.words), np.uint64), np.bitwise_or.accumulate(bits[order[:, j]])]) for j in range(dims)]
        self.full = np.bitwise_or.reduce(bits)

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words of the entries within ``radius`` of each point in every dimension."""
        found = np.repeat(self.full[None, :], len(points), axis=0)
        for j, (line, masks) in enumerate(zip(self.coordinates, self.prefix, strict=True)):
            low = np.searchsorted(line, points[:, j] - radius, "left")
            high = np.searchsorted(line, points[:, j] + radius, "right")
            found &= masks[high] & ~masks[low]
        return found

    def nearest(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of equals) and its squared distance."""
        n = len(points)
        index, best = np.full(n, -1, np.int64), np.full(n, np.iinfo(np.int64).max)
        reach = np.full(n, max(1, radius), np.int64)
        rest = np.arange(n)
        while len(rest):
            some, limit = points[rest], reach[rest]
            masks = self.candidates(some, limit)
            nearest, least = np.full(len(rest), -1, np.int64), np.full(len(rest), np.iinfo(np.int64).max)
            for e in range(len(self.entries)):
                hit = np.flatnonzero(masks[:, e // WORD] >> np.uint64(e % WORD) & np.uint64(1))
                gap = some[hit] - self.entries[e]
                far = np.einsum("ij,ij->i", gap, gap)
                closer = far < least[hit]
                least[hit[closer]], nearest[hit[closer]] = far[closer], e
            sure = least <= limit * limit
            index[rest[sure]], best[rest[sure]] = nearest[sure], least[sure]
            # the cube around the best distance holds every entry as near as that one
            grown = np.where(nearest < 0, 2 * limit, np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1)
            reach[rest] = grown
            rest = rest[~sure]
        return index, best


@dataclass
class Codebooks:
    """Entries per part (parts x entries x dimensions) and a first search radius per part."""

    entries: np.ndarray
    radius: list[int]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, comma-joined."""
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scaled(vectors: DataFrame, key: str, vector: str, keep: list[str], scale: int = SCALE) -> DataFrame:
    """(key, kept columns, v): vectors as integers, without those that are null or hold null or non-finite components."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_large = F.exists(value, lambda x: F.abs(x) * scale >= LARGEST)
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    checked = F.when(too_large, F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("array<int>")).otherwise(whole)
    return vectors.filter(value.isNotNull() & finite).select(key, *keep, checked.alias("v"))


def matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x dimensions, as 64-bit integers."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, -1)


def seeds(rows: DataFrame, key: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest keys; None without a vector."""
    first = rows.orderBy(F.col(key).asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    dims = {len(r.v) for r in first}
    if len(dims) > 1 or max(dims) % parts:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}")
    found = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    # half the usual distance between entries, a guess that only affects speed
    gaps = [int(np.median(np.abs(part - part.mean(0)).sum(1))) // 2 for part in found] if found.size else [1] * parts
    return Codebooks(found, [max(1, g) for g in gaps])


def refit(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every used entry moves to the floor of its parts' mean."""
    parts, _, dims = books.entries.shape
    entries, radius = books.entries, books.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in entries]
        size = entries.shape[1]
        sums, counts, far = np.zeros((parts, size, dims), np.int64), np.zeros((parts, size), np.int64), np.zeros((parts, size), np.float64)
        for batch in batches:
            v = matrix(batch.column(0), parts)
            for p, search in enumerate(slices):
                index, distance = search.nearest(v[:, p], radius[p])
                np.add.at(sums[p], index, v[:, p])
                counts[p] += np.bincount(index, minlength=size)
                far[p] += np.bincount(index, distance.astype(np.float64), minlength=size)
        used = np.argwhere(counts > 0)
        if len(used):
            at = tuple(used.T)
            columns = [pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(counts[at]), pa.array(far[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "far", "sums"])

    told = arrow(rows.select("v"), run, "part long, entry long, n long, far double, sums array<long>")
    total = told.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.sum("far").alias("far"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(dims)]).alias("sums")
    )
    moved, spread = books.entries.copy(), [[0.0, 0] for _ in range(parts)]
    for r in total.collect():  # one row per part and used entry
        moved[r.part, r.entry] = [s // r.n for s in r.sums]
        spread[r.part][0] += r.far
        spread[r.part][1] += r.n
    return Codebooks(moved, [max(1, isqrt(int(2 * far / max(1, n)))) for far, n in spread])


def fit(rows: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    books = seeds(rows, key, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refit(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks, key: str, keep: list[str]) -> DataFrame:
    """(key, kept columns, code, error): entry numbers in part order, two hex digits each, and the squared distance."""
    entries, radius = books.entries, books.radius
    parts, digits = entries.shape[0], max(2, len(f"{entries.shape[1] - 1:x}"))
    schema = rows.select(key, *keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(e) for e in entries]
        for batch in batches:
            v = matrix(batch.column(batch.num_columns - 1), parts)
            error, codes = np.zeros(len(v), np.int64), np.zeros((len(v), parts), np.int64)
            for p, search in enumerate(slices):
                codes[:, p], distance = search.nearest(v[:, p], radius[p])
                error += distance
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            rest = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(text, pa.string()), pa.array(error)], names=schema.names)

    return arrow(rows.select(key, *keep, "v"), run, schema)


def label_totals(coded: DataFrame, label: str) -> DataFrame:
    """Add ``label_error``: the errors of a label's rows summed, null being a label. Totals are combined map-side.

    A small table of totals is broadcast. A larger one is joined by shuffle on
    (label, salt), each total once per salt, so that a frequent label spreads.
    """
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    totals = stage(named.groupBy("_label").agg(F.sum("error").alias("label_error")), "code-labels")
    side = sized(totals, F.length("_label") + 48)
    if side is not totals:
        return named.join(side, "_label").drop("_label")
    salts = 32
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return named.withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(salts)).cast("int")).join(salted, ["_label", "_salt"]).drop("_label", "_salt")


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Per usable vector: key, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out;
    the others must be of one length that ``parts`` divides. Codebooks start
    from the ``entries`` smallest keys (null keys last, equal ones by vector;
    fewer vectors give fewer entries). Repeated rows are coded each. Further
    columns are ignored. Without a usable vector there are no rows.
    """
    source = vectors.select(F.col(key).cast("long"), F.col(label), F.col(vector))
    rows = stage(scaled(source, key, vector, [label], scale), "code-vectors")
    books = fit(rows, key, parts, entries, rounds)
    if books is None:
        empty = rows.select(key, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit(""))
    coded = stage(encode(rows, books, key, [label]), "code-codes")
    return label_totals(coded, label).select(key, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
