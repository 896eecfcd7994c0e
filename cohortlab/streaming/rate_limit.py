"""The rate limiter as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortlab.operators.rate_limit import MAX_REQUESTS, NO_KEY, WINDOW_MS

OUTPUT = "key string, seq long, ms long, window_start long, allowed boolean, remaining long"
STATE = "window_start long, used long"
# Decisions that leave at a time.
CHUNK = 10_000


def decide(ms: np.ndarray, opened: int | None, used: int, max_requests: int, window_ms: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Window start and number of earlier requests in it, for sorted times; then the open window and its requests."""
    start, rank = np.zeros(len(ms), np.int64), np.zeros(len(ms), np.int64)
    at = 0
    while at < len(ms):
        if opened is None or ms[at] - opened >= window_ms:
            opened, used = int(ms[at]), 0
        to = int(np.searchsorted(ms, opened + window_ms))
        start[at:to], rank[at:to] = opened, used + np.arange(to - at)
        used, at = used + to - at, to
    return start, rank, opened, used


def _admit(max_requests: int, window_ms: int):
    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # the window is over; the next request opens one anyway
            return
        # two numbers a request are held, as the chunks come in no order
        held = [(b["ms"].to_numpy(np.int64), b["seq"].to_numpy(np.int64)) for b in batches]
        ms, seq = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((seq, ms))
        ms, seq = ms[order], seq[order]
        opened, used = state.get if state.exists else (None, 0)
        start, rank, opened, used = decide(ms, opened, used, max_requests, window_ms)
        state.update((int(opened), int(min(used, max_requests))))
        state.setTimeoutTimestamp(max(int(opened) + window_ms, state.getCurrentWatermarkMs() + 1))
        for lo in range(0, len(ms), CHUNK):
            to = slice(lo, lo + CHUNK)
            left = np.maximum(max_requests - rank[to] - 1, 0)
            yield pd.DataFrame({"key": key[0], "seq": seq[to], "ms": ms[to], "window_start": start[to], "allowed": rank[to] < max_requests, "remaining": left})

    return admit


def rate_limit_stream(
    requests: DataFrame, key: str, ms: str, seq: str, max_requests: int = MAX_REQUESTS, window_ms: int = WINDOW_MS, delay: str = "1 hour"
) -> DataFrame:
    """Decide each request by its time; state is one window per key, which expires.

    A timer at the end of a key's window removes its state once the watermark
    (the latest time seen less ``delay``) has passed it, so the state holds only
    keys with a request within the last window and delay. Requests that
    arrive later than ``delay`` are not decided. Size micro-batches with the
    source's admission options: 16 bytes a request of a key in one
    micro-batch are held while they are sorted.
    """
    rows = requests.select(
        F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"), F.col(ms).cast("long").alias("ms"), F.col(seq).cast("long").alias("seq"),
        # the first watermark is time zero: nothing may count as late then
        F.timestamp_millis(F.greatest(F.col(ms).cast("long"), F.lit(1))).alias("at"),
    )
    return rows.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        _admit(max_requests, window_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
