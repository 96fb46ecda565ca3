"""Connected components of a link table, by alternating star contractions.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) rewrite the links until each node points at the
smallest node it can reach. Minima are pre-aggregated before each shuffle and
joined back, so a node with very many links is no group in one task; adaptive
skew joins split its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = least.select("a", F.col("m").alias("b"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionAll(moved).distinct()


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    links: columns a and b, in any order and possibly repeated; self-links are ignored, rows with nulls too.
    """
    scratch = Scratch(spark, "components")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = scratch.keep(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now, seen = after, before
        before = mark(now)
        if tuple(before) == tuple(seen):
            break
    else:
        raise RuntimeError(f"components didn't settle within {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
