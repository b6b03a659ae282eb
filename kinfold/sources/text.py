"""Attributed graphs as text: nodes.txt holds a vector a line, edges.txt two node numbers a line."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value), numbered from 0 in file order; numbering is the one step that needs an RDD."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("line", T.LongType())])
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    return spark.createDataFrame(rows, schema).select("line", "value")


def read_nodes(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(id, attrs): id is the line number.  A token that is no number ends its row.

    Strict reading keeps blank lines as empty vectors, for validation to reject;
    tolerant reading leaves them out.
    """
    tokens = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    until = F.array_position(F.transform(tokens, lambda x: x.isNull().cast("int")), 1)
    attrs = F.when(until > 0, F.slice(tokens, 1, (until - 1).cast("int"))).otherwise(tokens)
    rows = read_lines(spark, path).select(F.col("line").alias("id"), attrs.alias("attrs"))
    return rows.where(F.size("attrs") > 0) if tolerant else rows


def read_edges(spark: SparkSession, path: str, tolerant: bool = False, first: int = 0) -> DataFrame:
    """(u, v, w): w is 1; more tokens are ignored.  Malformed lines have null ends, or are left out by tolerant reading.

    Node numbers in the file start at ``first``; those read start at 0.
    """
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select((F.get(t, 0).try_cast("long") - first).alias("u"), (F.get(t, 1).try_cast("long") - first).alias("v"), F.lit(1).cast("long").alias("w"), F.size(t).alias("n"))
    if tolerant:
        rows = rows.where((F.col("n") == 2) & F.col("u").isNotNull() & F.col("v").isNotNull())
    return rows.drop("n")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Undirected edges without repeats, as for a comparison with a library."""
    e = read_edges(spark, path, tolerant=True)
    return e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("w", F.lit(1).cast("long"))


def remove_self_loops(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write the lines of an edge file that don't join a node to itself; (lines, self_loops) of the file and (remaining) of what was written."""
    t = F.split(F.trim("value"), r"\s+")
    loop = F.coalesce(F.get(t, 0) == F.get(t, 1), F.lit(False))
    lines = spark.read.text(path)
    lines.where(~loop).write.text(out)
    remaining = spark.read.text(out).agg(F.count_if(loop).alias("remaining"))
    return lines.agg(F.count("*").alias("lines"), F.count_if(loop).alias("self_loops")).join(remaining)


def read_graph(spark: SparkSession, folder: str, tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    return read_nodes(spark, os.path.join(folder, "nodes.txt"), tolerant), read_edges(spark, os.path.join(folder, "edges.txt"), tolerant)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Vectors in the order of ids, one a line; the range partitions keep that order."""
    line = F.array_join(F.col("attrs").cast("array<string>"), " ")
    nodes.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Distinct edges as ``smaller larger``, self-loops kept."""
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    e.select(F.concat_ws(" ", "a", "b").alias("value")).write.text(path)


def write_partition(membership: DataFrame, path: str) -> None:
    """A line for each community: its members in ascending order."""
    dump(membership).select(F.array_join(F.col("members").cast("array<string>"), " ").alias("value")).write.text(path)


def dump(membership: DataFrame) -> DataFrame:
    """(c, members) of a membership (node, c)."""
    return membership.groupBy("c").agg(F.array_sort(F.collect_list("node")).alias("members"))


def file_name(*parts: object) -> str:
    """Parts as a name for a file or folder: what is no letter, digit, dot or hyphen becomes an underscore."""
    return "_".join(re.sub(r"[^\w.-]+", "_", str(p)) for p in parts)


#: Metrics of a run's log: name and the pattern whose first group is the value.
LOG_METRICS = {
    "modularity": r"Modularity\D*?(-?[0-9.]+(?:[eE][-+]?\d+)?)",
    "main_seconds": r"Main algorithm time\D*?([0-9.]+(?:[eE][-+]?\d+)?)",
    "prep_seconds": r"preprocessing time\D*?([0-9.]+(?:[eE][-+]?\d+)?)",
    "load_seconds": r"LoadGraph time\D*?([0-9.]+(?:[eE][-+]?\d+)?)",
    "total_seconds": r"Total time cost\D*?([0-9.]+(?:[eE][-+]?\d+)?)",
    "distances": r"Total distance calculation\D*?([0-9]+)",
}


def log_metrics(lines: DataFrame) -> DataFrame:
    """One row for each run of (run, line, value): the metrics of its log, null where the log has none.

    A log that repeats a metric counts with its first value, the main time with its last.
    """
    def of(name: str, pattern: str) -> Column:
        pick = F.max_by if name == "main_seconds" else F.min_by
        found = F.col("value").rlike(pattern)
        return pick(F.when(found, F.regexp_extract("value", pattern, 1).try_cast("double")), F.when(found, F.col("line")))

    return lines.groupBy("run").agg(*[of(k, p).alias(k) for k, p in LOG_METRICS.items()])


#: How a run's log gives the largest distances in communities.
COMMUNITY_MAXIMUM = r"Community \d+: .*? Max distance = ([\d.]+)"
GLOBAL_MAXIMUM = r"Global maximum distance: ([\d.]+)"
AVERAGE_MAXIMUM = r"Average max distance per community: ([\d.]+)"


def community_maxima(lines: DataFrame) -> DataFrame:
    """One row for each run of (run, line, value) whose log lists communities: their number, the largest, mean and smallest of their maxima, and the log's own two figures, the last of each."""
    def of(pattern: str) -> Column:
        return F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1).try_cast("double"))

    def last(pattern: str) -> Column:
        return F.max_by(of(pattern), F.when(F.col("value").rlike(pattern), F.col("line")))

    each = of(COMMUNITY_MAXIMUM)
    figures = [F.count(each).alias("communities"), F.max(each).alias("largest"), F.avg(each).alias("mean"), F.min(each).alias("smallest")]
    return lines.groupBy("run").agg(*figures, last(GLOBAL_MAXIMUM).alias("global_max"), last(AVERAGE_MAXIMUM).alias("average_max")).where("communities > 0")
