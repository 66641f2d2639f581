"""Connected components of a link table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inklattice.llm.common import discard, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``edges`` (u, v): comp is the smallest id that links reach.

    Each round writes its links to the shared folder, so a lost executor costs one round at most.  Ends when
    every link points from a member to its component's smallest id (the links are then a set of stars).
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        after = materialize(_small_star(_large_star(edges)), "links")
        # Stars: no id is both a member (u) and a centre (v), and each member has one centre.
        loose = after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or after.groupBy("u").count().filter("count > 1").limit(1).count()
        discard(edges)
        edges = after
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
