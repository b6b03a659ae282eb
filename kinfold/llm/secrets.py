"""Secret scans, with built-in functions only.

Three pattern kinds find secrets by their form.  A fourth, ``random``, finds
strings that look drawn at random: two character Markov models, one of random
strings and one of ordinary identifiers, are trained from labelled samples, and
a string's log-likelihood ratio a character decides.  The threshold is learned from
a quarter of the samples that trains no model.  The trained table has one number
for each pair of the 66 characters, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_sample

#: Fixed patterns, as Java reads them; each kind with the group whose length counts and the least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so that shorter ones never matter
}
#: Cheap tests that every text with a match of the kind passes.
MAYBE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,end:int,kind:int,size:int,value:string>>"
MARK, PLAIN = "\u0001", "\u0002"  # neither is in a class of any pattern; one stands for the other in the text searched


@dataclass(frozen=True)
class MarkovRatio:
    """log P(b|a) under the model of random strings less that under the model of identifiers; row a, column b."""

    ratio: tuple[float, ...]
    threshold: float

    def score(self, s: Column) -> Column:
        """The mean log-likelihood ratio of a string's character pairs; null for under two characters."""
        n, table = len(ALPHABET), F.array(*[F.lit(float(x)) for x in self.ratio])
        code = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        pairs = F.zip_with(F.slice(code, 1, F.length(s) - 1), F.slice(code, 2, F.length(s) - 1), lambda a, b: (a - 1) * n + b)
        return F.when(
            F.length(s) > 1, F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(table, i - 1), F.lit(0.0))) / (F.length(s) - 1)
        )


#: Words that names in programs, paths and logs are made of.
WORDS = (
    "account address api archive async author axis backup bank binary bonus box branch buffer byte cache chunk city click client clock crypto currency daily data date "
    "debug default deploy depth detail device digest display document domain driver dynamic edge email encoding engine entry error event example exact export family "
    "feature field file filter flag flow folder font forecast fuzzy galaxy gap gauge global group growth half handler health helper history hook hybrid icon import index "
    "inner input invoice java job journal jwt kernel kilo known label language latency legacy length library limit list lock logic lower main manager market maximum "
    "member memory message middle minimum mobile model month music native network notify null object offset oxygen package parser payload physics pixel policy pool "
    "priority proxy public puzzle quality quick quota random range ready region remote report request reset rhythm right route runway salary search segment server session "
    "shadow sky snapshot source split status style subject switch symbol system task template text theme ticket toggle tower track traffic type update upper url user "
    "utility value variable vehicle version video virtual volume warning wave web weight width window wizard work yard year yield zero zone"
).split()


def _digits(seed: Column) -> Column:
    """Some dozens of digits that depend on the seed."""
    hexes = F.concat(*[F.sha2(F.concat(seed, F.lit(f":{k}")), 256) for k in range(2)])
    return F.translate(hexes, "abcdef", "147036")


def random_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled samples of random strings, derived from digests of the row number, of 20 to 64 characters.

    Base 64 of both kinds, letters and digits of either case or one only; hexadecimal ones have a kind of their own.
    """
    seed = F.col("id").cast("string")
    digest = F.concat(*[F.sha2(F.concat(seed, F.lit(f":{k}")), 256) for k in range(2)])
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n=]", "")
    plain = F.regexp_replace(b64, "[+/]", "")
    kind = F.col("id") % 6
    value = F.when(kind == 0, b64).when(kind == 1, F.translate(b64, "+/", "-_")).when(kind == 2, F.lower(plain)).when(kind == 3, F.upper(plain)).otherwise(plain)
    size = 20 + F.pmod(F.xxhash64("id"), F.lit(45)).cast("int")
    return spark.range(n).select(F.substring(value, F.lit(1), size).alias("value"), F.lit(True).alias("random"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("held"))


def made_identifiers(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """Labelled samples of ordinary strings by the rules of program text: names of several words in all spellings, paths, locales, versions, dates, counters, UUIDs and rules of one sign.

    A quarter of them, made of words that the others do not have, is held out.
    """
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0

    def word(k: int) -> Column:
        def of(words: list[str]) -> Column:
            return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))

        return F.when(held, of(WORDS[::4])).otherwise(of([w for i, w in enumerate(WORDS) if i % 4]))

    def some(most: int, k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(1000 + k)), F.lit(most)).cast("int")

    w = [word(k) for k in range(6)]
    big = [F.initcap(x) for x in w]
    seed = F.col("id").cast("string")
    digits, digest = _digits(seed), F.sha2(seed, 256)
    year, number = (2000 + some(30, 1)).cast("string"), some(100, 2).cast("string")
    signs = F.array(*map(F.lit, "=-_/+AaXx0z9"))
    locale = F.concat(F.substring(w[4], 1, 2), F.lit("_"), F.upper(F.substring(w[5], 1, 2)))
    pair = lambda at: F.substring(digits, at, 2)
    dated = F.concat_ws("-", year, pair(1), pair(3), pair(5), pair(7), pair(9), F.substring(digits, 11, 3), pair(14))
    uuid = F.concat_ws("-", *[F.substring(digest, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    forms = [
        F.concat_ws("_", *w[:4]),
        F.concat_ws("-", *w[:4]),
        F.concat(w[0], *big[1:5]),
        F.concat(*big[:5]),
        F.upper(F.concat_ws("_", *w[:4])),
        F.concat_ws("/", *w[:4], F.concat(*big[4:6])),
        F.concat_ws("_", w[0], w[1], year, w[2], F.concat(F.lit("v"), number), w[3]),
        F.concat_ws("/", locale, F.upper(F.concat_ws("_", w[0], w[1])), w[2]),
        F.concat(w[0], big[1], F.upper(F.substring(w[2], 1, 2)), F.lit("_"), w[3], number, big[4]),
        dated,
        F.concat(F.substring(digits, 1, 20 + some(20, 3)), F.when(some(3, 4) == 0, F.concat(F.lit("_"), w[0])).otherwise("")),
        uuid,
        F.repeat(F.element_at(signs, some(12, 5) + 1), 20 + some(40, 6)),
        F.concat_ws("-", w[0], F.concat(F.lit("v"), number), year, pair(1), F.concat(w[1], pair(3)), w[2]),
    ]
    value = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    return spark.range(n).select(value.alias("value"), F.lit(False).alias("random"), held.alias("held"))


def identifier_samples(docs: DataFrame, text_col: str, documents: int = 2000) -> DataFrame:
    """Labelled samples of ordinary strings: the words of a bounded sample of documents that no base pattern matches.

    The bound is about ``documents`` documents, by the hash of the text; words next to each other
    are joined by underscores, hyphens and slashes, as identifiers and paths are.
    """
    some = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("t"))
    some = bounded_sample(some, "t", documents)
    for kind in BASE:
        some = some.where(~F.col("t").rlike(MAYBE[kind]))
    words = F.regexp_extract_all("t", F.lit(r"([A-Za-z]{3,})"), 1)
    joined = some.select(F.explode(words).alias("w"), F.xxhash64("t").alias("h"))
    sep = F.element_at(F.array(*map(F.lit, ("_", "-", "/", ""))), (F.pmod(F.xxhash64("w", "h"), F.lit(4)) + 1).cast("int"))
    return joined.select(F.concat("w", sep, F.lower("w")).alias("value"), F.lit(False).alias("random"), F.lit(False).alias("held"))


def train(samples: DataFrame) -> MarkovRatio:
    """Both models from the samples (value string, random and held boolean) that are not held out, by counts of character pairs, and the threshold from those that are.

    Pairs back off to the counts of their second character, those with a half added.
    The threshold is the ratio at which the smaller of two shares is largest, that of
    random strings above it and that of ordinary ones not above it, among samples of
    the candidates' form; the middle, where many are as good.  The counts that reach the driver are at most two for each
    pair of characters, and two for each hundredth of a ratio.  Without samples of
    both kinds nothing is called random.
    """
    samples = samples.where(F.length("value") > 1)
    code = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(code, 1, F.length("value") - 1), F.slice(code, 2, F.length("value") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = samples.where("NOT held").select("random", F.explode(pairs).alias("p")).where("p.a > 0 AND p.b > 0").groupBy("random", "p.a", "p.b").count().collect()
    n = len(ALPHABET)
    count = np.zeros((2, n, n))
    for r in rows:
        count[int(r["random"]), r["a"] - 1, r["b"] - 1] += r["count"]
    single = count.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    logs = np.log((count + 30 * single[:, None, :]) / (count.sum(axis=2, keepdims=True) + 30))
    model = MarkovRatio(tuple(np.round(logs[1] - logs[0], 6).ravel().tolist()), float("inf"))
    tried = samples.where(F.col("held") & F.col("value").rlike(f"^{CANDIDATE}$")).select("random", F.floor(model.score(F.col("value")) * 100).alias("s"))
    bins = sorted((r["s"], r["random"], r["count"]) for r in tried.groupBy("random", "s").count().collect())
    total = [sum(k for _, label, k in bins if label is kind) for kind in (False, True)]
    if not all(total):
        return model
    best, above, below = (-1.0, 0.0), total[1], 0
    for (s, label, k), (after, _, _) in zip(bins, [*bins[1:], bins[-1]], strict=True):
        above, below = above - k * label, below + k * (not label)
        best = max(best, (min(above / total[1], below / total[0]), (s + 1 + after) / 200))
    return MarkovRatio(model.ratio, best[1])


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """The text cut at the pattern's matches: gap, match, group, gap, match, group, ..., gap."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}${group}{MARK}"), MARK, -1)


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (start, end, kind, size, value): all matches, with start and end in code points; size is the group's."""
    none = F.array().cast(SPANS)
    step = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("start"), F.lit("").alias("value"), none.alias("found")
    )

    def add(acc: Column, x: Column) -> Column:
        """turn counts gap, match, group; a match is appended when its group has come."""
        is_group, is_match = acc["turn"] == 2, acc["turn"] == 1
        span = F.struct(
            acc["start"].alias("start"), acc["at"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            F.length(x).alias("size"), acc["value"].alias("value"),
        )
        return F.struct(
            F.when(is_group, acc["at"]).otherwise(acc["at"] + F.length(x)).alias("at"),
            ((acc["turn"] + 1) % 3).alias("turn"),
            F.when(is_match, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(is_match, x).otherwise(acc["value"]).alias("value"),
            F.when(is_group, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(_pieces(text, pattern, group), step, add, lambda acc: acc["found"])


def _long(least: int, x: Column) -> Column:
    return x["size"] >= least


def scan(docs: DataFrame, model: MarkovRatio, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of spans (start, end, kind, value), by start, then kind as listed in KINDS.

    start and end count code points, the end exclusive.  A null or empty text has
    no spans.  Spans of different kinds may overlap, but for ``random``, which
    reports no string that touches a span of another kind.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), MARK, PLAIN)
    none = F.array().cast(SPANS)
    work = docs.withColumn("__text", text)
    for kind, (pattern, group, least) in BASE.items():
        found = F.filter(_found(F.col("__text"), kind, pattern, group), partial(_long, least))
        work = work.withColumn(f"__{kind}", F.when(F.col("__text").rlike(MAYBE[kind]), found).otherwise(none))
    base = F.concat("__assign", "__access", "__hex")
    work = work.withColumn("__base", F.array_sort(base))
    loose = F.filter(
        _found(F.col("__text"), "random", CANDIDATE, 0),
        lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    loose = F.filter(loose, lambda x: model.score(x["value"]) > model.threshold)
    work = work.withColumn("__random", F.when(F.col("__text").rlike(MAYBE["random"]), loose).otherwise(none))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.concat("__base", "__random")),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"), x["value"].alias("value")),
    )
    return work.withColumn(out, spans).drop("__text", "__base", "__random", *[f"__{k}" for k in BASE])


def redact(docs: DataFrame, spans_col: str = "secrets", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of text under overlapping spans replaced by the mark; texts without spans stay as they are."""
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["done"], gap, F.lit(mark))).otherwise(acc["done"]).alias("done"),
        )

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text))
