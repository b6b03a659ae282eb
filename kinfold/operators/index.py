"""Pivot indexes: distances of all nodes to a few pivots, and among those."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.sources.text import file_name

#: Most numbers in the pivots sent with an expression (k times dimension).
MOST_VALUES = 2_000_000


@dataclass(frozen=True)
class PivotIndex:
    pivots: list[list[float]]

    @classmethod
    def fit(cls, nodes: DataFrame, k: int = 200, max_iter: int = 8, seed: int = 19260817, jl_above: int = 32) -> PivotIndex:
        """k-means pivots; vectors of more than ``jl_above`` dimensions are clustered after a random projection.

        The pivots are means in the original space either way.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        first = nodes.select(F.size("attrs").alias("d")).first()
        if first is None:
            return cls([])
        low = nodes.select("id", "attrs", (F.col("attrs") if first["d"] <= jl_above else V.project(F.col("attrs"), V.jl_matrix(first["d"], jl_above))).alias("low"))
        low = low.withColumn("features", array_to_vector("low"))
        n = nodes.count()
        model = KMeans(k=max(2, min(k, n)), maxIter=max_iter, seed=seed).fit(low) if n > 1 and k > 1 else None
        grouped = model.transform(low).select(F.col("prediction").alias("pivot"), "attrs") if model else low.select(F.lit(0).alias("pivot"), "attrs")
        return cls([r["centroid"] for r in centroids(grouped).orderBy("pivot").collect()])

    @classmethod
    def from_pivots(cls, pivots: DataFrame) -> PivotIndex:
        """From (pivot, attrs), numbered anew in the order of pivot."""
        return cls([list(r["attrs"]) for r in pivots.select("pivot", V.as_vector("attrs").alias("attrs")).orderBy("pivot").collect()])

    def __post_init__(self) -> None:
        if self.pivots and len(self.pivots) * len(self.pivots[0]) > MOST_VALUES:
            raise ValueError("too many pivots to send along with an expression")

    def table(self) -> list[float]:
        """Squared distances among the pivots, row by row."""
        return [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for p in self.pivots for q in self.pivots]

    def distances(self, attrs: Column) -> Column:
        every = F.from_json(F.lit(json.dumps(self.pivots)), "array<array<double>>")  # one literal, folded before the query runs
        return F.transform(every, lambda p: V.sq_dist(attrs, p))

    def attach(self, nodes: DataFrame) -> DataFrame:
        """nodes with d2s, the squared distances to all pivots, and pivot, the nearest (the first among equals)."""
        with_d = nodes.withColumn("d2s", self.distances(F.col("attrs")))
        return with_d.withColumn("pivot", (F.array_position("d2s", F.array_min("d2s")) - 1).cast("int"))

    def save(self, spark: SparkSession, path: str, nodes: DataFrame, **meta: object) -> None:
        """Pivots and attached nodes as Parquet, with what the index was built from; what is at path is replaced."""
        self.attach(nodes).write.mode("overwrite").parquet(f"{path}/point_pivot")
        spark.createDataFrame(list(enumerate(self.pivots)), "pivot int, attrs array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
        row = described(nodes) | {"k": len(self.pivots)} | meta
        spark.createDataFrame([{k: str(v) for k, v in row.items()}]).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, nodes: DataFrame, **meta: object) -> PivotIndex:
        """The index at path; ValueError if it was built from other nodes or, as far as they are given here, with other parameters."""
        have = spark.read.json(f"{path}/meta").first().asDict()
        unlike = [k for k, v in (described(nodes) | meta).items() if have.get(k) != str(v)]
        if unlike:
            raise ValueError("the index was built with another " + ", ".join(unlike))
        return cls.from_pivots(spark.read.parquet(f"{path}/pivots"))

    @classmethod
    def built(cls, spark: SparkSession, folder: str, name: str, nodes: DataFrame, k: int = 200, max_iter: int = 8) -> PivotIndex:
        """The index kept in folder for these nodes and parameters; where there is none that fits, it is fitted and kept."""
        about = described(nodes)
        path = f"{folder}/" + file_name(name, f"k{k}", f"n{about['n']}", f"d{about['d']}", f"iter{max_iter}")
        asked = {"asked": k, "max_iter": max_iter}
        try:
            return cls.load(spark, path, nodes, **asked)
        except (AnalysisException, ValueError):  # none there, or one of other nodes
            index = cls.fit(nodes, k, max_iter)
            index.save(spark, path, nodes, **asked)
            return index


def fingerprint(nodes: DataFrame) -> int:
    """A sum over the rows' hashes: equal for equal content in any order."""
    return described(nodes)["fingerprint"]


def described(nodes: DataFrame) -> dict[str, int]:
    """The number of nodes, the largest dimension, and the fingerprint of the content."""
    hashes = F.sum(F.xxhash64("id", "attrs") % (1 << 40))
    row = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("attrs")), F.lit(0)).alias("d"), F.coalesce(hashes, F.lit(0)).alias("fingerprint")).first()
    return row.asDict()


def centroids(assigned: DataFrame) -> DataFrame:
    """(pivot, centroid) of rows (pivot, attrs): means by component."""
    parts = assigned.select("pivot", F.posexplode("attrs")).groupBy("pivot", "pos").agg(F.avg("col").alias("x"))
    rows = parts.groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return rows.select("pivot", F.transform("xs", lambda s: s["x"]).alias("centroid"))


def lloyd_step(nodes: DataFrame, index: PivotIndex) -> DataFrame:
    """(pivot, centroid) after one assignment of the nodes; a pivot without nodes keeps its place."""
    spark = nodes.sparkSession
    new = centroids(index.attach(nodes).select("pivot", "attrs"))
    old = spark.createDataFrame(list(enumerate(index.pivots)), "pivot int, old array<double>")
    return old.join(new, "pivot", "left").select("pivot", F.coalesce("centroid", "old").alias("centroid"))


def top_degree(degrees: DataFrame, n: int) -> DataFrame:
    """The n nodes of the largest degree, smaller ids first among equals."""
    return degrees.orderBy(F.desc("degree"), "id").limit(n)


def medoids(attached: DataFrame, index: PivotIndex) -> DataFrame:
    """(pivot, medoid, size, cost): the member nearest to each pivot, the members, and the sum of their squared distances."""
    d = F.get(F.col("d2s"), F.col("pivot"))
    return attached.groupBy("pivot").agg(
        F.min(F.struct(F.round(d, 9).alias("d"), "id"))["id"].alias("medoid"), F.count("*").alias("size"), F.sum(d).alias("cost")
    )


def top_degree_pivots(nodes: DataFrame, degrees: DataFrame, k: int, max_iter: int = 8) -> PivotIndex:
    """Pivots among the well connected: Lloyd's steps over the top candidates, snapped to the nearest candidates."""
    import math

    n = nodes.count()
    candidates = nodes.join(top_degree(degrees, max(k, math.ceil(math.sqrt(n) * math.log2(max(2, n))))).select("id"), "id")
    index = PivotIndex.from_pivots(candidates.orderBy("id").limit(k).select(F.col("id").alias("pivot"), "attrs"))
    for _ in range(max_iter):
        new = PivotIndex([r["centroid"] for r in lloyd_step(candidates, index).orderBy("pivot").collect()])
        if new == index:
            break
        index = new
    chosen = medoids(index.attach(candidates), index).select(F.col("medoid").alias("id"))
    return PivotIndex.from_pivots(candidates.join(chosen.distinct(), "id").select(F.col("id").alias("pivot"), "attrs"))
