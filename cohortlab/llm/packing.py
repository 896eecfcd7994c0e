"""Packing documents into token sequences with a grouping genetic algorithm.

Documents become ids, long ones are cut, and the pieces go into as few
sequences as possible. Only the lengths matter for that, and there are at most
``capacity`` different ones, so the instance is a table of counts however many
documents there are. A group of the algorithm is a pattern (which lengths a
sequence holds) with its multiplicity, and an individual is a table of patterns.

Crossover injects whole well-filled sequences of one parent into the other,
removes the sequences there that hold items twice, and best-fits the displaced
items. Islands evolve as Spark tasks; between epochs each sends its best
individuals to the next island. The winner is turned into ranges of ranks per
length, and every piece finds its place from its rank, computed by Spark.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.byte_bpe import pieces as safe_pieces
from cohortlab.llm.common import arrow, stage
from cohortlab.scale import row_numbers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
END_ID = 2
CAPACITY = 1024

ISLANDS = 6
EPOCHS = 3
GENERATIONS = 40
MEMBERS = 6
ELITE = 2
# Largest individual that is kept. Best fit over counts opens a few patterns per length, so this is far off.
MAX_PATTERNS = 8_192

# A pattern: (length, times) pairs, longest first. An individual: pattern -> number of sequences.
Pattern = tuple[tuple[int, int], ...]
Bins = dict[Pattern, int]


# --- ids ------------------------------------------------------------------


class Encoder:
    """Ids of the tokenizers library for a byte-level BPE file.

    The library itself encodes about a megabyte of text a second and core. If
    the file is plain byte-level BPE whose ids are its merge ranks, its
    vocabulary is run by tiktoken, with the file's added tokens cut out first
    as the library does; any other file is left to the library.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks(), special_tokens={}) if self.plain(told) else None

    def plain(self, told: dict) -> bool:
        model, first = told["model"], told["pre_tokenizer"] or {}
        if told["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            return False
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return merged == sorted(merged)

    def ranks(self) -> dict[bytes, int]:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = self.library.get_vocab(with_added_tokens=False)
        return {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.added}

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
        found = [
            np.array([self.added[part]], "<u4") if i % 2 else self.fast.encode_to_numpy(piece, disallowed_special=()).astype("<u4")
            for i, part in enumerate(parts)
            for piece in ([part] if i % 2 else safe_pieces(part))
        ]
        return found[0] if len(found) == 1 else np.concatenate(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(n: int, capacity: int) -> range:
    """Where pieces of ``n`` ids begin: full pieces at the end, the first one takes what is left."""
    return range(n % capacity - capacity if n % capacity else 0, n, capacity)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids) of every whole text; null as empty, which is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4")
        names = [key, "piece", "start", "length", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([coder.ids(t or ""), end])
                for i, at in enumerate(cut_points(len(ids), capacity)):
                    raw = ids[max(0, at) : at + capacity].tobytes()
                    rows.append((k, i, max(0, at), len(raw) // 4, zlib.crc32(raw), raw))
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 4096]), types, strict=True)], names=names)

    return arrow(docs.select(F.col(key).cast("long"), text), run, f"{key} long, piece int, start long, length long, ids_crc32 long, ids binary")


# --- the genetic algorithm over patterns ------------------------------------


def fill(pattern: Pattern) -> int:
    return sum(size * times for size, times in pattern)


def with_items(pattern: Pattern, size: int, times: int) -> Pattern:
    held = dict(pattern)
    held[size] = held.get(size, 0) + times
    return tuple(sorted(held.items(), reverse=True))


def best_fit(bins: Bins, loose: dict[int, int], capacity: int, order: Sequence[int] | None = None) -> Bins:
    """Put loose items (length -> count) where the least room stays, a whole group of equal sequences at a time.

    Every step uses up a group, the room in it, or the items of a length, so the
    work depends on the number of patterns and lengths, not on the counts.
    """
    bins = dict(bins)
    by_gap: dict[int, list[Pattern]] = {}
    for p in bins:
        if gap := capacity - fill(p):
            by_gap.setdefault(gap, []).append(p)
    gaps = sorted(by_gap)

    def put(p: Pattern, times: int) -> None:
        gap = capacity - fill(p)
        if p in bins:
            bins[p] += times
            return
        bins[p] = times
        if gap:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append(p)

    for size in sorted(loose, reverse=True) if order is None else order:
        left = loose.get(size, 0)
        while left:
            i = bisect_left(gaps, size)
            if i < len(gaps):
                gap = gaps[i]
                p = by_gap[gap].pop()
                have = bins.pop(p)
                if not by_gap[gap]:
                    del by_gap[gap], gaps[i]
            else:
                gap, p, have = capacity, (), left
            each = min(gap // size, left)
            used = min(have, left // each)
            left -= used * each
            if p and have > used:
                put(p, have - used)
            put(with_items(p, size, each), used)
    return bins


def exchange(bins: Bins, loose: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    """Best-fit loose items after trading them in: one or two items of a sequence for one or two loose ones that fill it better.

    The items that come out are smaller or fewer, so they fit elsewhere more easily.
    """
    bins, loose = dict(bins), {s: n for s, n in loose.items() if n}
    order = [p for p in bins if fill(p) < capacity]
    rng.shuffle(order)
    for p in order:
        if not loose:
            break
        room = capacity - fill(p)
        held = [s for s, times in p for _ in range(min(times, 2))][:8]
        sizes = sorted(loose)
        some = sizes if len(sizes) <= 24 else sorted(rng.sample(sizes, 24))
        best: tuple = (0, (), ())
        for out in [(a,) for a in held] + [(a, b) for i, a in enumerate(held) for b in held[i + 1 :]]:
            free = room + sum(out)
            for first in (0, *some):
                k = bisect_left(sizes, free - first + 1) - 1
                if first > free or k < 0:
                    continue
                second = sizes[k]
                if second == first and loose[first] < 2:
                    continue
                put = (second, first) if first else (second,)
                gain = sum(put) - sum(out)
                if gain > best[0] or (gain == best[0] and gain and len(put) < len(best[2])):
                    best = (gain, out, put)
        gain, out, put = best
        if not gain:
            continue
        n = min(bins[p], *(loose[s] // put.count(s) for s in put))
        new = dict(p)
        for s in out:
            new[s] -= 1
            loose[s] = loose.get(s, 0) + n
        for s in put:
            new[s] = new.get(s, 0) + 1
            loose[s] -= n
        bins[p] -= n
        if not bins[p]:
            del bins[p]
        q = tuple(sorted(((s, t) for s, t in new.items() if t), reverse=True))
        bins[q] = bins.get(q, 0) + n
        loose = {s: t for s, t in loose.items() if t}
    return best_fit(bins, loose, capacity)


def fitness(bins: Bins) -> tuple[int, int]:
    """Smaller is better: number of sequences, then even filling (squares of the fill, negated)."""
    return sum(bins.values()), -sum(fill(p) ** 2 * n for p, n in bins.items())


def crossover(a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled sequences of ``b`` into ``a``; sequences of ``a`` with items met twice go, the rest of their items is best-fitted."""
    ranked = sorted(b, key=lambda p: (-fill(p), p))
    best = ranked[: max(1, int(len(ranked) * rng.uniform(0.1, 0.9)))]
    share = rng.uniform(0.1, 0.9)
    child: Bins = {p: rng.randint(1, b[p]) for p in best if rng.random() < share}
    double: dict[int, int] = {}
    for p, n in child.items():
        for size, times in p:
            double[size] = double.get(size, 0) + times * n
    loose: dict[int, int] = {}
    # an equal sequence is the cleanest removal; then the worst filled first
    for p, n in sorted(a.items(), key=lambda x: (x[0] not in child, fill(x[0]), x[0])):
        gone = max((-(-double.get(size, 0) // times) for size, times in p), default=0)
        if p in child:
            gone = min((double.get(size, 0) // times for size, times in p), default=0)
        gone = min(n, gone)
        for size, times in p:
            met = min(double.get(size, 0), times * gone)
            if met:
                double[size] -= met
            if times * gone > met:
                loose[size] = loose.get(size, 0) + times * gone - met
        if n > gone:
            child[p] = child.get(p, 0) + n - gone
    # what an equal sequence left over is taken from any sequence that holds it
    while any(double.values()):
        for p in sorted((p for p in child if any(double.get(size, 0) for size, _ in p)), key=lambda p: (fill(p), p)):
            gone = min(child[p], max(-(-double.get(size, 0) // times) for size, times in p))
            if not gone:
                continue
            child[p] -= gone
            if not child[p]:
                del child[p]
            for size, times in p:
                met = min(double.get(size, 0), times * gone)
                if met:
                    double[size] -= met
                if times * gone > met:
                    loose[size] = loose.get(size, 0) + times * gone - met
    return exchange(child, loose, capacity, rng) if rng.random() < 0.5 else best_fit(child, loose, capacity)


def mutate(bins: Bins, capacity: int, rng: random.Random) -> Bins:
    """Dissolve some sequences, mostly badly filled ones, and put their items back by exchange or in a slightly shuffled order."""
    ranked = sorted(bins, key=lambda p: (fill(p), p))
    kept, loose = dict(bins), {}
    n_bad = rng.randint(1, max(1, min(len(ranked) // 4, rng.choice((4, 40, 400)))))
    for p in {*ranked[:n_bad], *rng.sample(ranked, min(len(ranked), rng.randint(1, 8)))}:
        n = rng.randint(1, kept[p])
        kept[p] -= n
        if not kept[p]:
            del kept[p]
        for size, times in p:
            loose[size] = loose.get(size, 0) + times * n
    if rng.random() < 0.7:
        return exchange(kept, loose, capacity, rng)
    order = sorted(loose, key=lambda s: s * rng.uniform(0.9, 1.0), reverse=True)
    return best_fit(kept, loose, capacity, order)


def evolve(members: list[Bins], capacity: int, generations: int, least: int, rng: random.Random) -> list[Bins]:
    """Steady state: children of two parents replace the worst member if they are better."""
    members = sorted(members, key=fitness)
    for _ in range(generations):
        if sum(members[0].values()) <= least:
            break
        a, b = (min(rng.sample(members, 2), key=fitness) for _ in range(2))
        child = mutate(a, capacity, rng) if a is b or rng.random() < 0.3 else crossover(a, b, capacity, rng)
        if len(child) <= MAX_PATTERNS and child not in members and fitness(child) < fitness(members[-1]):
            members = sorted([*members[:-1], child], key=fitness)
    return members


def as_text(bins: Bins) -> str:
    return json.dumps([[n, *p] for p, n in bins.items()])


def from_text(genes: str) -> Bins:
    return {tuple(tuple(x) for x in p): n for n, *p in json.loads(genes)}


def plan(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, members: int = MEMBERS, elite: int = ELITE) -> Bins:
    """Sequences for the given number of items of each length. Its cost depends on ``capacity``, not on the counts."""
    full = {((capacity, 1),): n for size, n in counts.items() if size == capacity}
    loose = {size: n for size, n in counts.items() if 0 < size < capacity and n}
    start = best_fit({}, loose, capacity)
    least = -(-sum(size * n for size, n in loose.items()) // capacity)
    if sum(start.values()) <= least or len(start) > MAX_PATTERNS:
        return full | start

    def run(epoch: int):
        def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[Bins]] = {}
            for batch in batches:
                for k, genes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(k, []).append(from_text(genes) if genes else start)
            for k, group in held.items():
                rng = random.Random(f"{epoch}-{k}")
                if epoch == 0:
                    group = [start] + [mutate(start, capacity, rng) for _ in range(members - 1)]
                group = evolve(group, capacity, generations, least, rng)[:members]
                # the best ones travel on as copies, so that a good individual also stays at home
                away = [((k + 1) % islands, g) for g in group[:elite]] if islands > 1 else []
                rows = [(k, as_text(g)) for g in group] + [(to, as_text(g)) for to, g in away]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["island", "genes"])

        return island

    found = spark.range(0, islands, 1, islands).select(F.col("id").alias("island"), F.lit("").alias("genes"))
    for epoch in range(epochs):
        found = stage(arrow(found.repartition(islands, "island").sortWithinPartitions("island", "genes"), run(epoch), "island long, genes string"), "packing-islands")
    # islands x (members + elite) individuals of bounded size
    return full | min((from_text(r.genes) for r in found.collect()), key=lambda g: (fitness(g), as_text(g)))


# --- from the plan to places ------------------------------------------------


def ranges(bins: Bins, counts: dict[int, int]) -> np.ndarray:
    """Rows (first rank, first sequence, offset, times, length): pieces sorted by length find their sequence there."""
    base, at = {}, 0
    for size in sorted(counts):
        base[size], at = at, at + counts[size]
    rows, sequence = [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for size, times in pattern:
            rows.append((base[size], sequence, offset, times, size))
            base[size] += n * times
            offset += size * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(numbered: DataFrame, table: np.ndarray, rank: str = "_rank") -> DataFrame:
    """Add sequence_id and offset to pieces numbered from 1 in order of their length."""
    keep = numbered.drop("sequence_id", "offset")
    schema = keep.drop(rank).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(rank)
            g = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            first, sequence, offset, times, size = table[np.searchsorted(table[:, 0], g, "right") - 1].T
            rest = [(c, n) for i, (c, n) in enumerate(zip(batch.columns, batch.schema.names, strict=True)) if i != at]
            columns = [*(c for c, _ in rest), pa.array(sequence + (g - first) // times), pa.array(offset + (g - first) % times * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for _, n in rest), "sequence_id", "offset"])

    return arrow(keep, run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, **search) -> tuple[DataFrame, DataFrame]:
    """Pieces with their ids, and their places (key, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are pieces of the end id alone. Rows with a null or
    repeated key are packed as documents of their own. Only documents longer
    than ``capacity`` are cut. Further columns are ignored. An empty table
    gives no pieces.
    """
    cut = stage(pieces(docs, key, text, tokenizer, end_id, capacity), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    bins = plan(docs.sparkSession, counts, capacity, **search)
    narrow = cut.select(key, "piece", "start", "length", "ids_crc32")
    numbered = row_numbers(narrow, ["length", key, "piece", "ids_crc32"], "_rank")
    return cut, place(numbered, ranges(bins, counts))


def sequences(cut: DataFrame, places: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, length, ids, parts) of every sequence: its pieces in order of their offsets. Keys must be unique."""
    both = places.join(cut.select(key, "piece", "ids"), [key, "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", key, "piece", "length", "ids")))
    return both.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "").alias("_hex"),
        F.transform("p", lambda x: x.dropFields("ids")).alias("parts"),
    ).select("sequence_id", "length", F.unhex("_hex").alias("ids"), "parts")
