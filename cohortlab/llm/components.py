"""Connected components of a table of links, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import stage

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every linked node; ``component`` is its smallest node.

    Alternates two star steps: each node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows. Minima are combined
    map-side and joined back, so a hub's links are never gathered in one task.
    Each round is staged; the rounds grow with the logarithm of the longest
    chain. Links may repeat, point either way or to themselves; nulls are ignored.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stage(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high, low).filter("u <> v").distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = edges.agg(mark).first()[0]
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = edges.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    root = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
