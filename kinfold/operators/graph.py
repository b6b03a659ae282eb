"""Attributed graphs: nodes (id, attrs), undirected edges (u, v, w)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import vectors as V


@dataclass(frozen=True)
class AttributedGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_text(cls, spark: SparkSession, folder: str, tolerant: bool = False) -> AttributedGraph:
        from kinfold.sources import text

        return cls(*text.read_graph(spark, folder, tolerant))

    @classmethod
    def from_parquet(cls, spark: SparkSession, nodes: str, edges: str) -> AttributedGraph:
        return cls(spark.read.parquet(nodes), spark.read.parquet(edges))

    def with_stats(self) -> AttributedGraph:
        return AttributedGraph(node_stats(self.nodes), self.edges)


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns(V.stats(F.col("attrs")))


def validate(g: AttributedGraph) -> DataFrame:
    """One row of counts; all but n_nodes, n_edges and the dimensions are 0 (and min_dim equals max_dim) in a valid graph."""
    nodes = g.nodes.agg(
        F.count("*").alias("n_nodes"), F.min(F.size("attrs")).alias("min_dim"), F.max(F.size("attrs")).alias("max_dim"),
        F.count_if(F.coalesce(F.size("attrs") <= 0, F.lit(True))).alias("empty_nodes"),
    )
    ends = g.edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.explode(F.array("u", "v")).alias("id"))
    dangling = ends.join(g.nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("dangling_ends"))
    pairs = g.edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("k"))
    edges = pairs.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("k"))), F.lit(0)).alias("self_loops"),
        F.count_if((F.col("k") > 1) & F.col("a").isNotNull()).alias("multi_edges"),
        F.coalesce(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), F.col("k"))), F.lit(0)).alias("malformed"),
    )
    return nodes.join(dangling).join(edges)  # three tables of one row


def check(g: AttributedGraph) -> None:
    """Raise ValueError for a graph that cannot be used."""
    r = validate(g).first()
    wrong = [k for k in ("empty_nodes", "dangling_ends", "self_loops", "malformed") if r[k]]
    if r["n_nodes"] and r["min_dim"] != r["max_dim"]:
        wrong.append("dimensions")
    if wrong:
        raise ValueError(f"invalid graph: {', '.join(wrong)}")


def simple_edges(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Each undirected edge once, the weights of its repeats summed; self-loops only if asked for."""
    e = edges if loops else edges.where("u <> v")
    return e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a self-loop once."""
    return edges.select("u", "v", "w").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of all nodes; a self-loop counts twice, a node without edges has 0."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def ends_of(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """edges with structs a and b of the named columns of both end nodes."""
    part = nodes.select("id", F.struct(*columns).alias("x"))
    a = part.select(F.col("id").alias("u"), F.col("x").alias("a"))
    b = part.select(F.col("id").alias("v"), F.col("x").alias("b"))
    return edges.join(a, "u").join(b, "v")


def annotate(edges: DataFrame, nodes: DataFrame, r: float | None) -> DataFrame:
    """edges with d2 and flag: violated beyond r, else satisfied; unknown, and no distance, where r is None."""
    if r is None:
        return edges.withColumns({"d2": F.lit(None).cast("double"), "flag": F.lit("unknown")})
    both = ends_of(edges, nodes, ["attrs"]).withColumn("d2", V.sq_dist(F.col("a.attrs"), F.col("b.attrs")))
    return both.withColumn("flag", F.when(F.col("d2") > r * r, "violated").otherwise("satisfied")).drop("a", "b")


def total_weight(edges: DataFrame) -> int:
    return int(edges.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("m")).first()["m"])
