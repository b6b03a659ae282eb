"""Scores and audits of a partition (node, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.operators.predicates import PairPredicate, exact
from kinfold.sources.storage import cut


def intra_weight(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(c, w_in): weight inside each community, both directions counted."""
    a = partition.select(F.col("node").alias("u"), F.col("c").alias("cu"))
    b = partition.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    inside = edges.join(a, "u").join(b, "v").where("cu = cv")
    return inside.groupBy(F.col("cu").alias("c")).agg((2 * F.sum("w")).alias("w_in"))


def modularity(edges: DataFrame, partition: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row, q; 0 for a graph without edges."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w").join(partition, "node")
    parts = ends.groupBy("c").agg(F.sum("w").alias("s")).join(intra_weight(edges, partition), "c", "left")
    two_m = F.sum("s").cast("double")
    inside, squares = F.coalesce(F.sum("w_in"), F.lit(0)).cast("double"), F.sum(F.col("s").cast("double") * F.col("s"))
    return parts.agg(F.when(two_m > 0, inside / two_m - gamma * squares / (two_m * two_m)).otherwise(0.0).alias("q"))


def inner_pairs(partition: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(c, i, j, a, b): all pairs of nodes of one community, i before j."""
    x = partition.join(nodes.select(F.col("id").alias("node"), F.struct(*columns).alias("x")), "node")
    a = x.select("c", F.col("node").alias("i"), F.col("x").alias("a"))
    b = x.select("c", F.col("node").alias("j"), F.col("x").alias("b"))
    return a.join(b, "c").where("i < j")


def audit(partition: DataFrame, nodes: DataFrame, r: float, test: PairPredicate | None = None) -> DataFrame:
    """(c, pairs, violations) of communities of two nodes or more."""
    columns = test.columns if test else ["attrs"]
    bad = (test or exact)(F.col("a"), F.col("b"), r * r)
    return inner_pairs(partition, nodes, columns).groupBy("c").agg(F.count("*").alias("pairs"), F.count_if(bad).alias("violations"))


def farthest_candidates(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, node, attrs): of each community of several different vectors those that its farthest pair can hold.

    Twins count once.  Seen from the mean, a pair is at most as far apart as its two
    distances to it together; the farthest vector from the mean and the farthest from
    that are a pair, and a vector that reaches less even with the outermost one falls out.
    """
    x = partition.join(nodes.select(F.col("id").alias("node"), "attrs"), "node").groupBy("c", "attrs").agg(F.min("node").alias("node"))
    x = cut(x.where(F.size("attrs") > 0))
    mean = x.select("c", F.posexplode("attrs")).groupBy("c", "pos").agg(F.avg("col").alias("x")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    x = cut(x.join(mean, "c").withColumn("d", V.dist(F.col("attrs"), F.transform("m", lambda s: s["x"]))).drop("m"))
    out = x.groupBy("c").agg(F.count("*").alias("n"), F.max(F.struct("d", "node", "attrs")).alias("o")).where("n > 1").select("c", "o")
    x = x.join(out, "c")
    low = x.groupBy("c").agg(F.max(V.dist(F.col("attrs"), F.col("o.attrs"))).alias("low"))
    reach = F.col("d") + F.col("o.d")
    return cut(x.join(low, "c").where(~(reach < F.col("low") - 1e-9 * (F.col("low") + 1))).select("c", "node", "attrs"))


def diameters(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, size, diameter): the largest distance within each community, 0 for one node."""
    few = farthest_candidates(partition, nodes)
    pairs = inner_pairs(few.select("c", "node"), few.select(F.col("node").alias("id"), "attrs"), ["attrs"])
    d = pairs.groupBy("c").agg(F.sqrt(F.max(V.sq_dist(F.col("a.attrs"), F.col("b.attrs")))).alias("d"))
    sizes = partition.groupBy("c").agg(F.count("*").alias("size"))
    return sizes.join(d, "c", "left").select("c", "size", F.coalesce("d", F.lit(0.0)).alias("diameter"))


def mean_pair_distance(nodes: DataFrame) -> DataFrame:
    """One row, mean_d2, over all pairs: from sums of components alone, however many nodes there are."""
    n = nodes.agg(F.count("*").alias("n"), F.sum(V.sq_norm(F.col("attrs"))).alias("s"))
    parts = nodes.select(F.posexplode("attrs")).groupBy("pos").agg(F.sum("col").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(parts).select(F.when(F.col("n") > 1, (F.col("n") * F.col("s") - F.col("t2")) / pairs).otherwise(0.0).alias("mean_d2"))
