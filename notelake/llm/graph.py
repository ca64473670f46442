"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.session import written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """e has u > v in every row."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) other than the roots; the root is the least node of its component.

    A star's hot centre is only summed (min) and joined, which AQE may split; nothing of a component meets in one task.
    """
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    seen = mark(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        now = written(_small(_large(now)), "cc")
        if (found := mark(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
