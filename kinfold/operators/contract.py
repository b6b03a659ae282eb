"""Contraction of communities to hypernodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contract(edges: DataFrame, assign: DataFrame, r: float | None = None) -> DataFrame:
    """Edges (u, v, w) among communities, self-loops kept; with the largest d2 and a flag where the edges have them.

    A merged edge is violated if one of its edges is, or the largest distance exceeds r.
    """
    a = assign.select(F.col("h").alias("u"), F.col("c").alias("cu"))
    b = assign.select(F.col("h").alias("v"), F.col("c").alias("cv"))
    ends = edges.join(a, "u").join(b, "v")
    more = []
    if "flag" in edges.columns:
        broken = F.bool_or(F.col("flag") == "violated") | (F.max("d2") > (float("inf") if r is None else r * r))
        unknown = F.bool_or(F.col("flag") == "unknown")
        more = [F.max("d2").alias("d2"), F.when(broken, "violated").when(unknown, "unknown").otherwise("satisfied").alias("flag")]
    return ends.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w"), *more)


def relabel(membership: DataFrame, assign: DataFrame) -> DataFrame:
    """(h, node) where h is the new hypernode, named by its community."""
    return membership.join(assign, "h").select(F.col("c").alias("h"), "node")


def by_least_member(membership: DataFrame) -> DataFrame:
    """(c, node) where c is the smallest node of the community: a name that does not depend on the run's order."""
    least = membership.groupBy("h").agg(F.min("node").alias("c"))
    return membership.join(least, "h").select("c", "node")


def dense_numbers(communities: DataFrame) -> DataFrame:
    """(c, number): communities counted from 0 in ascending order.

    A global order needs all ids in one sequence; positions come from the sizes of
    range partitions, so that no task holds them all.
    """
    ids = communities.select("c").distinct().repartitionByRange("c").sortWithinPartitions("c")
    ids = ids.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id() % (1 << 33)})
    before = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return ids.join(F.broadcast(before), "part").select("c", (F.col("at") + F.coalesce("start", F.lit(0))).alias("number"))


def largest_keeps_id(parts: DataFrame) -> DataFrame:
    """(c, sub, name) of split communities (c, sub, node): the largest part keeps c, others are named by their least node."""
    sized = parts.groupBy("c", "sub").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    order = Window.partitionBy("c").orderBy(F.desc("n"), "least")
    return sized.withColumn("rank", F.row_number().over(order)).select("c", "sub", F.when(F.col("rank") == 1, F.col("c")).otherwise(F.col("least")).alias("name"))
