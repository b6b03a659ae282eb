"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.anchors import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for all ends of edges (u, v): root is the least end of u's component.

    Each round points every vertex's larger neighbours, then its smaller ones, to the
    least vertex near it.  Minima are taken before they are shuffled, and a vertex with
    very many neighbours is a skewed join, which Spark splits; nothing is collected.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = _state(e)
        if new == state:
            roots = e.select(F.col("v").alias("u")).distinct()
            return e.select("u", F.col("v").alias("root")).union(roots.join(e.select("u"), "u", "left_anti").select("u", F.col("u").alias("root")))
        state = new
