"""Connected components of an edge table that never meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import stage


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges ``a > b`` is either the larger end of one edge or the smaller end of any number."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    other = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 or ups = 1 and low = 0")
    return other.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges(a, b)``: columns ``node``, ``root``.

    Alternating large-star and small-star steps until the edges are stars, which no step changes; each step only takes
    minima per node, so a node with any number of neighbours is summed before it is shuffled. Edges with a null end and
    loops are left out; no edges give an empty table.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a is not null and b is not null and a <> b").distinct(), "edges")
    while not _stars(current):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node move to the smallest node around it; never more rows than edges
        large = both.join(lowest.hint("merge"), "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        current = stage(small, "edges")
    # every node now points at its root; roots point at themselves
    return (current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
