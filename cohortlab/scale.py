"""Building blocks that keep hot groups out of single tasks.

* ``stage``          write a table once to the shared folder and read it back
* ``lookup_join``    join to a per-group table, broadcast only if counted small
* ``group_quantile`` exact interpolated quantile without buffering a group
* ``running_total``  running sums in a total order without a one-task window
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Most rows a side may have to be shipped to every executor. The side is
# counted with a bounded read; above it the join is an ordinary shuffled one.
LOOKUP_ROWS = 20_000
# And most bytes, as rows with arrays or texts can be large.
LOOKUP_BYTES = 8 << 20


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, from the session.

    Only a local session (tests) may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cohortlab.stage.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cohortlab-")
        spark.conf.set("cohortlab.stage.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/cohortlab/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Later passes then prune columns and push filters into the scan, and a lost
    executor costs a re-read instead of the whole lineage.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few small files over all cores, for costly projections.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Distinct values of one group's bracket that one task sorts, and parts a wider one is cut into.
BRACKET_VALUES, BRACKET_PARTS, MAX_NARROWINGS = 100_000, 64, 30


def lookup_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join ``big`` to a per-group table whose size is not known up front.

    At most ``max_rows + 1`` rows are read to learn the size. A small side is
    broadcast from those rows; a larger one is joined by shuffle, where
    adaptive skew handling splits hot keys.
    """
    head = small.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= LOOKUP_BYTES:
        side = small.sparkSession.createDataFrame(head, schema=small.schema)
        return big.join(F.broadcast(side), list(on), how)
    return big.join(small, list(on), how)


def settle(small: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Evaluate a per-group table once, for plans that use it several times.

    Up to ``max_rows`` rows become a local relation, a larger table is staged.
    """
    head = small.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= LOOKUP_BYTES:
        return small.sparkSession.createDataFrame(head, schema=small.schema)
    return stage(small, "settled")


def quantile_brackets(src: DataFrame, keys: list[str], ps: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, _b, _rows): per wanted quantile ``i`` of column ``_v<i>`` the values ``lo`` and ``hi`` around its rank, by a fixed-size sketch.

    ``size`` is how many distinct values a bracket may hold.
    """
    # sketch error is 1/accuracy of the group; a bracket is also at least three ranks wide
    margins = [m for m in (1.0, 0.1, 0.01, 0.001) if m > 4.0 / accuracy] + [4.0 / accuracy]
    brackets = []
    for i, p in enumerate(ps):
        ends = [max(0.0, p - m) for m in margins] + [min(1.0, p + m) for m in margins]
        sketch, n = F.percentile_approx(f"_v{i}", ends, accuracy), F.count(f"_v{i}")
        level = F.lit(0)
        for at, m in enumerate(margins):
            level = F.when(n * m >= 3, F.lit(at)).otherwise(level)
        brackets.append(
            F.struct(
                F.lit(i).alias("i"), F.get(sketch, level).alias("lo"), F.get(sketch, level + len(margins)).alias("hi"),
                n.alias("n"), F.lit(p).alias("p"), (F.get(F.array(*map(F.lit, margins)), level) * 2 * n).cast("long").alias("size"),
            )
        )
    return src.groupBy(*keys).agg(F.array(*brackets).alias("_b"), F.count(F.lit(1)).alias("_rows"))


def narrowed(src: DataFrame, keys: list[str], bracket: DataFrame, n_wanted: int, accuracy: int) -> DataFrame:
    """The settled brackets, cut down until each has at most ``BRACKET_VALUES`` distinct values.

    A round counts the rows below a bracket and sketches those inside, so a
    bracket becomes the few of ``BRACKET_PARTS`` parts around its rank. One that does
    not hold its rank is opened to all values and cut down again.
    """
    for _ in range(MAX_NARROWINGS):
        wide = F.exists("_b", lambda b: (b["size"] > BRACKET_VALUES) & (b["lo"] < b["hi"]))
        if bracket.filter(wide).isEmpty():
            return bracket
        near = lookup_join(src, bracket.filter(wide), keys)
        aggs = []
        for i in range(n_wanted):
            v, lo, hi = F.col(f"_v{i}"), F.get("_b", F.lit(i))["lo"], F.get("_b", F.lit(i))["hi"]
            # rows equal to an end are counted apart: however many they are, the parts are cut among the others
            inside = F.when((v > lo) & (v < hi), v)
            grid = [k / BRACKET_PARTS for k in range(BRACKET_PARTS + 1)]
            aggs += [
                F.count(F.when(v < lo, v)).alias(f"_below{i}"), F.count(F.when(v == lo, v)).alias(f"_low{i}"), F.count(F.when(v == hi, v)).alias(f"_high{i}"),
                F.count(inside).alias(f"_inside{i}"), F.approx_count_distinct(inside).alias(f"_distinct{i}"),
                F.percentile_approx(inside, grid, accuracy).alias(f"_grid{i}"),
            ]
        counts = near.groupBy(*keys).agg(*aggs)
        cut = []
        for i in range(n_wanted):
            b, inside, distinct = F.get("_b", F.lit(i)), F.col(f"_inside{i}"), F.col(f"_distinct{i}")
            pos, begin = (b["n"] - 1) * b["p"], F.col(f"_below{i}") + F.col(f"_low{i}")
            first, last = ((at - begin) * BRACKET_PARTS / F.greatest(inside, F.lit(1)) for at in (F.floor(pos), F.ceil(pos)))
            grid = lambda k, i=i: F.get(f"_grid{i}", F.least(F.greatest(k, F.lit(0)), F.lit(BRACKET_PARTS)).cast("int"))
            # one part to spare on each side
            lo = F.when(F.floor(pos) < begin, b["lo"]).when(F.floor(pos) >= begin + inside, b["hi"]).otherwise(grid(F.floor(first) - 1))
            hi = F.when(F.ceil(pos) < begin, b["lo"]).when(F.ceil(pos) >= begin + inside, b["hi"]).otherwise(grid(F.ceil(last) + 1))
            missed = (F.floor(pos) < F.col(f"_below{i}")) | (F.ceil(pos) >= begin + inside + F.col(f"_high{i}"))
            told = lambda lo, hi, size, b=b: F.struct(b["i"].alias("i"), lo.alias("lo"), hi.alias("hi"), b["n"].alias("n"), b["p"].alias("p"), size.cast("long").alias("size"))
            cut.append(
                # brackets that are narrow enough, and groups without a value, are as they were
                F.when(F.coalesce((b["size"] <= BRACKET_VALUES) | (b["n"] == 0), F.lit(True)), b)
                .when(missed, told(F.lit(float("-inf")), F.lit(float("inf")), b["n"]))
                .when(distinct <= BRACKET_VALUES, told(b["lo"], b["hi"], distinct))
                .otherwise(told(lo, hi, distinct))
            )
        again = bracket.filter(wide).join(counts, keys).select(*keys, F.array(*cut).alias("_b"), "_rows")
        bracket = settle(bracket.filter(~F.coalesce(wide, F.lit(False))).unionByName(again))
    raise RuntimeError("quantile brackets did not settle")


def ranked_in(src: DataFrame, keys: list[str], bracket: DataFrame, n_wanted: int) -> DataFrame:
    """(keys, _rows, _lo<i>, _hi<i>, _part<i>, _missed<i>): the values next to each rank, from the values inside its bracket."""
    near = lookup_join(src, bracket, keys)
    values = F.array(*[F.col(f"_v{i}") for i in range(n_wanted)])
    # rows above a bracket never matter, rows below only as a count (null v)
    cells = F.filter(
        F.transform(
            "_b",
            lambda b: F.struct(
                b["i"].alias("i"), b["n"].alias("n"), b["p"].alias("p"),
                (F.get(values, b["i"]) <= b["hi"]).alias("near"),
                F.when(F.get(values, b["i"]) >= b["lo"], F.get(values, b["i"])).alias("v"),
            ),
        ),
        lambda c: c["near"],
    )
    counted = (
        near.select(*keys, "_rows", F.explode(cells).alias("_c"))
        .groupBy(*keys, "_rows", "_c")
        .agg(F.count(F.lit(1)).alias("_k"))
        .select(*keys, "_rows", "_c.i", "_c.n", "_c.p", "_c.v", "_k")
    )
    upto = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())
    pos = (F.col("n") - 1) * F.col("p")
    ranked = counted.withColumn("_cum", F.sum("_k").over(upto))
    aggs: list[Column] = [F.max("_rows").alias("_rows")]
    for i in range(n_wanted):
        mine = F.col("i") == i
        # the rank must lie inside the bracket: not among the rows below, not beyond the last one
        early = F.bool_or(mine & F.col("v").isNull() & (F.col("_cum") > F.floor(pos)))
        reach = F.max(F.when(mine, F.col("_cum") - F.ceil(pos)))
        aggs += [
            F.min(F.when(mine & (F.col("_cum") > F.floor(pos)), F.col("v"))).alias(f"_lo{i}"),
            F.min(F.when(mine & (F.col("_cum") > F.ceil(pos)), F.col("v"))).alias(f"_hi{i}"),
            F.max(F.when(mine, pos - F.floor(pos))).alias(f"_part{i}"),
            (early | (reach <= 0)).alias(f"_missed{i}"),
        ]
    return ranked.groupBy(*keys).agg(*aggs)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000, count: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per ``keys``, one row per group.

    ``wanted`` maps result names to (column, p). A fixed-size sketch brackets
    each rank; in very large groups the brackets are narrowed until they hold a
    fixed number of distinct values. One more pass counts the rows below
    the bracket and the distinct values inside it, so what one task sorts is
    bounded. A bracket that missed its rank is opened and narrowed again.
    Nulls are ignored. With no keys there is one row (none for empty
    input). ``count`` adds the number of rows per group.
    """
    keys = list(keys)
    one_group = not keys
    names = list(wanted)
    src = df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, (c, _) in enumerate(wanted.values())])
    if one_group:
        src, keys = src.withColumn("_all", F.lit(1)), ["_all"]

    bracket = settle(quantile_brackets(src, keys, [p for _, p in wanted.values()], accuracy))
    done = None
    for _ in range(MAX_NARROWINGS):
        found = settle(ranked_in(src, keys, narrowed(src, keys, bracket, len(names), accuracy), len(names)))
        missed = F.lit(False)
        for i in range(len(names)):
            # without a value at or below the bracket there is no row
            missed = missed | ((F.get("_b", F.lit(i))["n"] > 0) & F.coalesce(f"_missed{i}", F.lit(True)))
        told = settle(bracket.join(found.drop("_rows"), keys, "left").withColumn("_missed", missed))
        good = told.filter(~F.col("_missed")).drop("_b", "_missed")
        done = good if done is None else done.unionByName(good)
        again = told.filter("_missed")
        if again.isEmpty():
            break
        open_end = lambda b: b.withField("lo", F.lit(float("-inf"))).withField("hi", F.lit(float("inf"))).withField("size", b["n"])
        bracket = settle(again.select(*keys, F.transform("_b", open_end).alias("_b"), "_rows"))
    else:
        raise RuntimeError("quantile brackets did not settle")

    value = lambda i: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")
    return done.select(*([] if one_group else keys), *[value(i).alias(name) for i, name in enumerate(names)], *([F.col("_rows").alias(count)] if count else []))


def group_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str = "threshold") -> DataFrame:
    return group_quantiles(df, keys, {out: (value, p)})


def one_value(df: DataFrame):
    """The only cell of a one-row result, None if there is no row."""
    row = df.limit(1).toArrow()
    return row.column(0)[0].as_py() if row.num_rows else None


def running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    amounts: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add running sums (current row included) per ``keys`` in ``order``.

    Rows are range partitioned by keys and order, so a hot key spreads over
    many partitions. Each partition is summed on its own; the totals of the
    earlier partitions of the same key are added. A partition can continue
    only one key, so the offsets are at most one row per partition.
    ``order`` must be unique within a key.
    """
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    tmp = {name: f"_amt_{i}" for i, name in enumerate(amounts)}
    work = df.withColumns({tmp[name]: expr for name, expr in amounts.items()})
    # staged, so that the partition numbers both branches see are the same
    work = stage(work.repartitionByRange(*keys, *order_cols).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = work.groupBy("_part", *keys).agg(*[F.sum(c).alias(c) for c in tmp.values()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select("_part", *keys, *[F.sum(c).over(earlier).alias(f"{c}_off") for c in tmp.values()])
        .filter(F.greatest(*[F.col(f"{c}_off") for c in tmp.values()], F.lit(None).cast("double")).isNotNull())
    )
    # at most one row per range partition
    work = work.join(F.broadcast(offsets), ["_part", *keys], "left")
    here = Window.partitionBy("_part", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumns(
        {name: F.coalesce(F.col(f"{c}_off"), F.lit(0)) + F.sum(c).over(here) for name, c in tmp.items()}
    )
    return work.drop("_part", *tmp.values(), *[f"{c}_off" for c in tmp.values()])


def row_numbers(df: DataFrame, order: Sequence[Column | str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``row_number`` in a total order per key, spread over range partitions."""
    return running_total(df, order, {out: F.lit(1).cast("long")}, keys)
