"""Merkle manifest of a dataset: one tree per language, one proof per document.

Time-forward processing over node labels (tree, level, position): a node sends
its digest to its parent, and the parent is worked off once all digests sent to
it have arrived. The external priority queue that orders the messages is a
sorted shuffle between tiers of ``height`` levels, with a heap inside a task for
the levels of one block; a block holds at most ``arity ** height`` nodes, so
neither a task nor the driver ever holds a tree. A reversed sweep then runs from
the root down: a block gets one message with the proof suffix of its own root
and delivers to every node below it that node's siblings and the suffix.

The size of a tier falls by ``arity ** height`` each time, so the shuffles after
the first one cost next to nothing. Every tier is staged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import arrow, sized, stage
from cohortlab.scale import row_numbers

ARITY = 2
# Levels of a block: at most 128 leaves with two children a node.
HEIGHT = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Row = tuple
DIGEST = 64


def leaf(columns: Sequence[Column | str] = COLUMNS) -> Column:
    """SHA-256 of the fields in order, each as its UTF-8 byte count, ``:`` and value, or ``-`` if null."""

    def field(c: Column | str) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def joined(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int, arity: int, height: int) -> int:
    """Levels above the nodes of a block in a tree that has ``n`` nodes at this tier."""
    levels = 0
    while n > 1 and levels < height:
        n, levels = -(-n // arity), levels + 1
    return levels


def climb(digests: Sequence[str], levels: int, arity: int) -> list[list[str]]:
    """All nodes of a block by level. Messages leave the heap in the order of their labels (level, position)."""
    queue = [(0, i, d) for i, d in enumerate(digests)]
    found: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, i, digest = heapq.heappop(queue)
        run = [digest]
        while level < levels and queue and queue[0][0] == level and queue[0][1] // arity == i // arity:
            run.append(heapq.heappop(queue)[2])
        found[level] += run
        if level < levels:
            heapq.heappush(queue, (level + 1, i // arity, joined(run)))
    return found


def descend(found: list[list[str]], arity: int, suffix: str) -> list[str]:
    """Path of every node at the bottom of a block, handed down from the block's root."""
    paths = [suffix] * len(found[-1])
    for level in reversed(found[:-1]):
        below = []
        for i in range(len(level)):
            first = i // arity * arity
            own = f"{i - first}:" + "".join(level[first:i] + level[i + 1 : first + arity])
            above = paths[i // arity]
            below.append(f"{own},{above}" if above else own)
        paths = below
    return paths


def folded(digest: str, path: str) -> str:
    """The root that a leaf digest and its path lead to."""
    for step in path.split(",") if path else ():
        at, siblings = step.split(":")
        run = [siblings[k : k + DIGEST] for k in range(0, len(siblings), DIGEST)]
        digest = joined([*run[: int(at)], digest, *run[int(at) :]])
    return digest


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
    """Rows of each block (tree and block are the first two columns) of a sorted stream; holds one block."""
    held: list[Row] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def records(rows: Iterator[Row], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def by_block(nodes: DataFrame, span: int, *rest: str) -> DataFrame:
    work = nodes.select("tree", F.floor(F.col("pos") / span).cast("long").alias("block"), "pos", *rest)
    return work.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def forward(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Tiers from the leaves (tree, pos, n, digest) to one node per tree; ``n`` is the tree's size at that tier."""
    span, tiers = arity**height, [nodes]
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def roots() -> Iterator[Row]:
            for rows in blocks(batches):
                tree, block, _, n, _ = rows[0]
                yield tree, block, -(-n // span), climb([r[4] for r in rows], levels_of(n, arity, height), arity)[-1][0]

        yield from records(roots(), out)

    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        tiers.append(stage(arrow(by_block(tiers[-1], span, "n", "digest"), run, "tree string, pos long, n long, digest string"), "merkle-tier"))
        largest = -(-largest // span)
    return tiers


def backward(tiers: list[DataFrame], top: DataFrame, arity: int, height: int, carry: Sequence[str] = ()) -> DataFrame:
    """Paths of the nodes of the lowest tier: (tree, path, subroot, digest, carry columns).

    ``top`` holds (tree, path, subroot): what stands above each tree.
    """
    span = arity**height
    letters = top.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    for depth in range(len(tiers) - 1, -1, -1):
        more = list(carry) if depth == 0 else []
        own = tiers[depth].select("tree", "pos", "n", "digest", *more)
        if depth == len(tiers) - 1:
            # one node per tree: its path is what stands above the tree
            found = own.join(sized(stage(top, "merkle-top"), F.length("path") + 200), "tree").select("tree", "pos", "path", "subroot", "digest", *more)
        else:
            work = own.withColumn("block", F.floor(F.col("pos") / span).cast("long")).unionByName(letters, allowMissingColumns=True)
            work = work.select("tree", "block", "pos", "n", "digest", "path", "subroot", *more)
            # the message of a block sorts before its nodes (null first)
            work = work.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("pos").asc_nulls_first())
            schema = work.select("tree", "pos", "path", "subroot", "digest", *more).schema

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                first = next(batches, None)
                if first is None:
                    return
                types = [first.schema.field(name) for name in ("tree", "pos", "path", "subroot", "digest", *first.schema.names[7:])]

                def stream() -> Iterator[pa.RecordBatch]:
                    yield first
                    yield from batches

                def paths() -> Iterator[Row]:
                    for letter, *rows in blocks(stream()):
                        levels = levels_of(rows[0][3], arity, height)
                        found = climb([r[4] for r in rows], levels, arity)
                        for r, path in zip(rows, descend(found, arity, letter[5]), strict=True):
                            yield r[0], r[2], path, letter[6], r[4], *r[7:]

                yield from records(paths(), pa.schema(types), 256)

            found = arrow(work, run, schema)
        if depth:
            found = stage(found.select("tree", "pos", "path", "subroot"), "merkle-paths")
            letters = found.withColumnRenamed("pos", "block")
    return found


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0, in ``order`` within a tree) and ``n`` (leaves of the tree)."""
    placed = stage(row_numbers(leaves, list(order), "_number", ["tree"]).withColumn("pos", F.col("_number") - 1).drop("_number"), "merkle-leaves")
    sizes = stage(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-sizes")
    return placed.join(sized(sizes, F.length("tree") + 40), "tree")


def manifest(docs: DataFrame, arity: int = ARITY, height: int = HEIGHT, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, path and the ``carry`` columns.

    ``path`` lists the levels from the leaf to the root, comma-joined: the
    node's place in its run, ``:``, the digests of the others in that run.
    A tree is a value of ``lang``, null being one of them and the first;
    leaves ascend by doc_id, nulls first, equal ids by leaf digest, so repeated
    rows are leaves of their own. Null fields count as ``-``. An empty table
    gives no rows. Further columns are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = stage(docs.select(F.col("doc_id").cast("long"), tree.alias("tree"), leaf().alias("digest"), *carry), "merkle-digests")
    tiers = forward(numbered(leaves, ["doc_id", "digest"]), arity, height)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = forward(numbered(subroots, ["name"]), arity, height)
    root = F.col("digest").alias("subroot")
    above = upper[-1].select("tree", F.lit("").alias("path"), root)
    named = backward(upper, above, arity, height, ["name"])
    top = stage(named.select(F.col("name").alias("tree"), "path", F.struct("digest", "subroot").alias("roots")), "merkle-subroots")
    # the two roots travel as one text, so that a message has one column for them
    top = top.select("tree", "path", F.concat("roots.digest", "roots.subroot").alias("subroot"))
    found = backward(tiers, top, arity, height, ["doc_id", *carry])
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), F.left("subroot", F.lit(DIGEST)).alias("subroot"), F.right("subroot", F.lit(DIGEST)).alias("root"),
        "path", *carry,
    )


def siblings(path: Column | str = "path") -> Column:
    """The digests of a path alone, from the leaf's level upwards, left to right."""
    return F.regexp_replace(path, "(^|,)[0-9]+:", "")


def fold(proofs: DataFrame, digest: str = "leaf", path: str = "path", out: str = "folded_root") -> DataFrame:
    """Add ``out``: the root recomputed from a leaf digest and its path (null if either is null)."""
    keep = proofs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (digest, path)), strict=True)
            roots = [None if d is None or p is None else folded(d, p) for d, p in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, out])

    return arrow(keep, run, keep.withColumn(out, F.lit(None).cast("string")).schema)


def verify(docs: DataFrame, claimed: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Documents against an earlier manifest (doc_id, path, root): doc_id, leaf, folded_root, verified.

    Rows without a proof are not verified. doc_id must be unique in both.
    """
    now = docs.select("doc_id", leaf().alias("leaf"))
    both = now.join(claimed.select("doc_id", "path", "root"), "doc_id", "left")
    return fold(both).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False))).drop("path", "root")
