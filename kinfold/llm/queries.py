"""The llm queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import ann, bpe, bwt, chat, decontam, jaccard, langid, secrets, substrings, toxicity
from kinfold.llm.anchors import written
from kinfold.llm.common import bounded_sample, fold, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class, the number of its links, and how many of those have an equal set."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


OP10_SQL = r"""
WITH RECURSIVE doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM doc_words, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v, k = x.n AND k = y.n AS copy FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), classes AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n_links, count(*) FILTER (copy) AS n_copies FROM links GROUP BY u)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 0)::BIGINT AS n_copies
FROM documents d JOIN classes c ON d.doc_id = c.u LEFT JOIN counts n ON d.doc_id = n.u
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the items it holds to 0.8 or more, by five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contained(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    return out.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.array_join(F.transform("matches", lambda m: m["item_id"].cast("string")), ",").alias("item_ids"),
        F.round(F.coalesce(best, F.lit(0.0)), 6).alias("containment"),
    )


#: Items of fewer than five words have one shingle of all their words, and documents have shingles of every such width too.
OP2_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM item_words, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM item_words WHERE len(w) > 0),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM doc_words, widths, unnest(range(1, greatest(len(w) - k + 2, 1))) t(i)
), pairs AS (
  SELECT doc_id, item_id, count(*) AS shared FROM shingles JOIN items USING (s) GROUP BY ALL
), hits AS (
  SELECT doc_id, item_id, shared / n AS containment FROM pairs JOIN sizes USING (item_id) WHERE shared >= 0.8 * n
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids, max(containment) AS most FROM hits GROUP BY doc_id
)
SELECT d.doc_id, f.n IS NOT NULL AS contaminated, coalesce(f.n, 0)::BIGINT AS n_items, coalesce(f.ids, '') AS item_ids,
  round(coalesce(f.most, 0), 6)::DOUBLE AS containment
FROM documents d LEFT JOIN found f USING (doc_id)
"""


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % 20 == 0)
    return ann.search(rows, queries, ann.fit(rows, queries=queries))


def op4_bpe(spark: SparkSession, sf_dir: str, spec_path: str | None = None) -> DataFrame:
    path = spec_path or public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, keep=["doc_id"])
    out = bpe.decode(ids, path, keep=["doc_id", "ids"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def secret_model(spark: SparkSession, docs: DataFrame) -> secrets.MarkovRatio:
    """The model of random strings, trained on made random strings and identifiers, and on the words of at most 2,000 documents."""
    samples = secrets.random_samples(spark).union(secrets.made_identifiers(spark)).union(secrets.identifier_samples(docs, "text"))
    return secrets.train(written(samples))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secret_model(spark, docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    count = {k: of_kind(k) for k in secrets.KINDS}
    return found.select(
        "doc_id",
        *[count[k].alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count["random"].alias("n_random"),
    )


#: One conversation whose texts hold control strings, formatted with the others.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    out = chat.format_trees(chat.chain_messages(turns))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted")))
    loss = F.array_join(chat.read_mask(F.col("formatted"), F.col("mask")), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> toxicity.ToxicityModel:
    """Fitted to labels of the folds 1 to 4 only; the ids of the bounded sample are small enough to send to every task."""
    seen = labels.where((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = bounded_sample(seen, "doc_id", rows)
    return toxicity.train(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), rows)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    out = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_decontamination": op2_decontamination, "op3_ann": op3_ann, "op4_bpe": op4_bpe, "op5_secrets": op5_secrets, "op6_chat": op6_chat, "op7_toxicity": op7_toxicity, "op8_langid": op8_langid, "op9_substring_dedup": op9_substring_dedup, "op10_jaccard": op10_jaccard}
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS text_chars,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(10), '')) AS role_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + role_chars + 1 + text_chars + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op6_chat": OP6_SQL, "op10_jaccard": OP10_SQL}
