"""Fixed-window rate limiting over a table of requests.

A window opens at the first request after the previous one ended and admits
``max_requests``; denied requests do not count. Times are whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.scale import stage

MAX_REQUESTS, WINDOW_MS = 100, 3_600_000  # fixed values: 100 requests per hour
# Requests without a key share one bucket.
NO_KEY = "unknown"


# Blocks that one task links together, and windows in a block of the lowest tier: a group holds at most
# the distinct milliseconds of so many windows.
FAN = 8

Pieces = tuple[np.ndarray, np.ndarray]


def _successor(pieces: Pieces, at: np.ndarray) -> np.ndarray:
    """Exit of a block for each entry time: the exit of the first piece that ends at or after it."""
    upto, out = pieces
    return out[np.searchsorted(upto, at)]


def _tick_pieces(ms: np.ndarray, begin: int, end: int, window_ms: int) -> Pieces:
    """A block's exit as a step function of the time from which a window may open.

    Entries lie in the block's first window; ``upto`` holds the ticks there, at
    which the outcome changes, and the block's end. The exit is the end of
    the last window, or the block's end if that is later.
    """
    n = len(ms)
    jump, last = np.append(np.searchsorted(ms, ms + window_ms), n), np.arange(n + 1)
    # pointer doubling: after each round twice as many windows are followed, ``last`` is the latest start on the way
    while (jump < n).any():
        last, jump = np.where(jump < n, last[jump], last), jump[jump]
    done = np.append(np.maximum(ms[np.minimum(last[:-1], n - 1)] + window_ms, end), end)
    inside = np.searchsorted(ms, begin + window_ms)
    return np.append(ms[:inside], end), np.append(done[:inside], done[inside])


def _starts(ms: np.ndarray, entry: int, window_ms: int) -> list[int]:
    """Window starts among sorted ticks, the first one not before ``entry``."""
    out, at = [], int(np.searchsorted(ms, entry))
    while at < len(ms):
        out.append(int(ms[at]))
        at = int(np.searchsorted(ms, ms[at] + window_ms))
    return out


def _grouped(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows of ``size`` neighbouring blocks of a key together, in order."""
    work = df.withColumn("above", F.floor(F.col("block") / size))
    return work.repartition("key", "above").sortWithinPartitions("key", "above", *order)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each (key, above) of a sorted stream; holds one group."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in batches:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        key, above = columns["key"], columns["above"]
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (above[1:] != above[:-1])) + 1).tolist(), len(pdf)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if held and (held[0]["key"][0], held[0]["above"][0]) != (key[lo], above[lo]):
                yield whole()
                held = []
            held.append({c: v[lo:hi] for c, v in columns.items()})
    if held:
        yield whole()


def _frames(rows: Iterator[tuple], names: list[str], size: int = 2_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


NAMES = ["key", "block", "begin", "upto", "exits"]
PIECES = "key string, block long, begin long, upto array<long>, exits array<long>"


def _lowest(blocks: DataFrame, origin: int, window_ms: int) -> DataFrame:
    """Step function of every block of ``FAN`` windows that has a tick (key, block, ms)."""
    span = FAN * window_ms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple]:
            for group in _groups(batches):
                block = int(group["above"][0])
                begin = origin + block * span
                yield group["key"][0], block, begin, *_tick_pieces(group["ms"], begin, begin + span, window_ms)

        yield from _frames(pieces(), NAMES)

    return _grouped(blocks, 1, "ms").mapInPandas(run, PIECES)


def _linked(tier: DataFrame) -> DataFrame:
    """Step functions of ``FAN`` neighbouring blocks each, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple]:
            for group in _groups(batches):
                upto, exits = np.asarray(group["upto"][0]), np.asarray(group["exits"][0])
                for begin, *piece in zip(group["begin"][1:], group["upto"][1:], group["exits"][1:], strict=True):
                    exits = _successor((np.asarray(piece[0]), np.asarray(piece[1])), np.maximum(exits, begin))
                yield group["key"][0], int(group["above"][0]), int(group["begin"][0]), upto, exits

        yield from _frames(pieces(), NAMES)

    return _grouped(tier, FAN, "block").mapInPandas(run, PIECES)


def _entries(tier: DataFrame, above: DataFrame) -> DataFrame:
    """Entry time of every block from the entries (key, block, entry) of the tier above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries() -> Iterator[tuple]:
            for group in _groups(batches):
                at = int(group["entry"][0])  # the entry sorts first
                for block, begin, upto, exits in zip(*(group[c][1:] for c in ("block", "begin", "upto", "exits")), strict=True):
                    at = max(at, int(begin))
                    yield group["key"][0], int(block), at
                    at = int(_successor((np.asarray(upto), np.asarray(exits)), np.array([at]))[0])

        yield from _frames(entries(), ["key", "block", "entry"])

    told = above.select("key", (F.col("block") * FAN).alias("block"), F.lit(0).alias("role"), "entry")
    both = tier.withColumn("role", F.lit(1)).unionByName(told, allowMissingColumns=True).na.fill(0, ["begin", "entry"])
    return _grouped(both, FAN, "role", "block").mapInPandas(run, "key string, block long, entry long")


def window_starts(requests: DataFrame, key: str, ms: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Start of every window per key: (key, window_start).

    Requests collapse to distinct milliseconds with map-side combining. Time
    is cut into blocks of ``FAN`` windows. What a block does to the time from
    which the next window may open is a step function of that time on entry, so
    blocks are worked off independently, ``FAN`` of them are linked to one
    function of the next tier, and so on until a key is one block; entries are
    then handed down again. No step gathers a key: a group is ``FAN`` blocks.
    """
    named = requests.select(F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"), F.col(ms).cast("long").alias("ms"))
    ticks = stage(named.filter("ms IS NOT NULL").distinct(), "ticks")
    origin, latest = ticks.agg(F.min("ms"), F.max("ms")).first()
    if origin is None:
        return ticks.select("key", F.col("ms").alias("window_start"))
    blocks = ticks.withColumn("block", F.floor((F.col("ms") - origin) / (FAN * window_ms)))
    tiers, top = [stage(_lowest(blocks, origin, window_ms), "blocks")], (latest - origin) // (FAN * window_ms)
    while top > 0:
        tiers.append(stage(_linked(tiers[-1]), "blocks"))
        top //= FAN
    # the highest tier has one block a key; its first window opens with the first request
    entries = tiers[-1].select("key", "block", F.col("begin").alias("entry"))
    for tier in tiers[-2::-1]:
        entries = stage(_entries(tier, entries), "entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def starts() -> Iterator[tuple]:
            for group in _groups(batches):
                for at in _starts(group["ms"][1:], int(group["entry"][0]), window_ms):  # the entry sorts first
                    yield group["key"][0], at

        yield from _frames(starts(), ["key", "window_start"])

    both = blocks.select("key", "block", F.lit(1).alias("role"), "ms").unionByName(
        entries.select("key", "block", F.lit(0).alias("role"), "entry"), allowMissingColumns=True
    )
    both = both.na.fill(0, ["ms", "entry"])
    return _grouped(both, 1, "role", "ms").mapInPandas(run, "key string, window_start long")


def rate_limit(
    requests: DataFrame, key: str, ms: str, seq: str, max_requests: int = MAX_REQUESTS, window_ms: int = WINDOW_MS
) -> DataFrame:
    """Add window_start, allowed and remaining to each request.

    ``seq`` is unique and orders requests of the same millisecond.
    """
    # staged: the placement and the ranking below both read the few window rows
    starts = stage(window_starts(requests, key, ms, window_ms), "windows")
    # a window touches two aligned buckets: an equi-join that also splits hot keys by time
    first = F.floor(F.col("window_start") / window_ms)
    by_bucket = starts.select("key", "window_start", F.explode(F.array(first, first + 1)).alias("_bucket"))
    rows = requests.withColumns(
        {"_key": F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)), "_ms": F.col(ms).cast("long"), "_bucket": F.floor(F.col(ms) / window_ms)}
    )
    placed = rows.join(
        by_bucket.withColumnRenamed("key", "_key"), ["_key", "_bucket"]
    ).filter((F.col("_ms") >= F.col("window_start")) & (F.col("_ms") < F.col("window_start") + window_ms))
    # each task keeps its first max_requests per window before the shuffle
    order = Window.partitionBy("_key", "window_start").orderBy("_ms", seq)
    admitted = (
        placed.select("_key", "window_start", "_ms", seq)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= max_requests)
        .select(seq, "_rank")
    )
    return (
        placed.join(admitted, seq, "left")
        .withColumns(
            {
                "allowed": F.col("_rank").isNotNull(),
                "remaining": F.coalesce(F.lit(max_requests) - F.col("_rank"), F.lit(0)),
            }
        )
        .drop("_key", "_ms", "_bucket", "_rank")
    )
