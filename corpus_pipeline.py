"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and, but for the last, returns the columns of documents, whatever
their names: extra ones come through as they are.  Null and empty texts pass every
filter; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, decontam, jaccard, queries, secrets, toxicity
from kinfold.llm.anchors import written
from kinfold.llm.common import table


def _private(docs: DataFrame, *used: str) -> DataFrame:
    """docs with names of its own for all columns but those used, so that no operator's column meets one of them."""
    return docs.toDF(*[c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)])


def _as_were(found: DataFrame, work: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, of a result over its private form."""
    return found.select(*work.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5, by a model of the labelled ones among them (folds 1 to 4)."""
    work = _private(docs, "doc_id", "text")
    model = queries.toxicity_model(work, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _as_were(toxicity.score(work, model).where("toxicity < 0.5"), work, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document of the smallest id; of copies that repeat its id, the one of the least text hash.

    Rows that share no more than an id, or a null one, are all kept.
    """
    work = _private(docs, "doc_id", "text")
    found = jaccard.near_duplicates(work, sets_too=True)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = found.where((F.col("class_id") == own) & F.col("set_id").eqNullSafe(F.col("first_set")))
    if work.groupBy(own.alias("d")).count().where("count > 1").isEmpty():
        return _as_were(kept, work, docs)
    kept = written(kept)
    several = F.col("set_id").isNotNull() & (F.col("n_copies") > 0)
    row = F.struct(*work.columns)
    ones = kept.where(several).groupBy("set_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(*work.columns))).alias("row"))
    return _as_were(kept.where(~several).select(*work.columns).union(ones.select("row.*")), work, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 or more."""
    work = _private(docs, "text")
    return _as_were(decontam.contained(work, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0), work, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted again where that changed the text."""
    work = _private(docs, "text", "n_chars")
    out = secrets.redact(secrets.scan(work, queries.secret_model(spark, work)))
    return _as_were(out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), work, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of all documents."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"], cache=200_000)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", tokenize),
]

#: Toxicity scores come from trained trees, and tokens from a vocabulary: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
