"""Connected components of an edge table, distributed.

Alternating large-star and small-star contraction (Kiveris et al., 2014): every
round is two aggregations and joins over the edges, which shrink towards one star
around the smallest node of each component.  Edges are written to the shared
folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.sources.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("k")).where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    joined = down.join(least, F.col("a") == F.col("k"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the
    smallest node of the component.  Null nodes and loops are ignored."""
    edges = edges.where("a <> b").select("a", "b").distinct()
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        state = (sums.n, sums.h)
        if not sums.n or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = written(_small_star(_large_star(edges)), "stars")
