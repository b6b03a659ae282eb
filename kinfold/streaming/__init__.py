"""Graphs that grow: degrees and volumes of an edge stream.

The engine itself is a batch one; this keeps the sums that a later batch run
starts from, so that they need not be counted anew.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running degrees (id, degree) of a streamed or static edge table (u, v, w); a self-loop counts twice."""
    ends = F.explode(F.array("u", "v"))
    return edges.select(ends.alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
