"""N-gram Jaccard join by chosen paths.

Every set of word shingles is embedded as min-hashes: two sets agree on a sampled
coordinate with the probability of their Jaccard similarity.  A run samples a
coordinate and splits the sets into buckets by its value; a bucket that is still too
large is split again on further sampled coordinates, unless its sets are mostly
alike; small buckets are compared by brute force.  Runs are repeated until a pair
at the threshold escapes all of them with less than the probability asked for.

Buckets give only the edges of spanning forests.  Within a component of those,
every set is compared with every other by exact counts, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.anchors import written
from kinfold.llm.common import MASK, WordHashes, arrow_columns, mix
from kinfold.llm.components import components
from kinfold.llm.decontam import shingles, word_hashes

#: Coordinates of the embedding; two bytes of each are kept for comparing and splitting.
COORDINATES = 64
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def embed(s: np.ndarray) -> np.ndarray:
    """The min-hashes of a set of 64-bit shingles."""
    base, least = mix(s), np.full(COORDINATES, MASK, np.uint64)
    for lo in range(0, len(s), 2048):
        h = base[lo : lo + 2048, None] * _MULTIPLIERS
        h ^= h >> np.uint64(29)
        least = np.minimum(least, h.min(axis=0))
    return mix(least)


def identity(s: np.ndarray) -> bytes:
    """128 bits that stand for the set, whatever its order."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).tobytes()


def chances(threshold: float, escape: float) -> tuple[int, int]:
    """Runs, and coordinates in which sketches have to agree, so that a pair at the threshold is lost by either with less than ``escape`` in all.

    The runs come first; what they leave of ``escape`` is the sketch's: its agreements
    are binomial, and as many are asked for as keep the lower tail within that.
    """
    runs = 1
    while (1 - threshold) ** runs >= escape:
        runs += 1
    left, agree, tail = escape - (1 - threshold) ** runs, 0, 0.0
    while agree < COORDINATES:
        tail += math.comb(COORDINATES, agree) * threshold**agree * (1 - threshold) ** (COORDINATES - agree)
        if tail >= left:
            break
        agree += 1
    return runs, agree


def forest(n: np.ndarray, sketch: np.ndarray, threshold: float, agree: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over sets whose sizes and sketches allow the threshold: each search step tests one set against all not reached."""
    rest, edges = np.arange(len(n)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = (sketch[rest] == sketch[x]).sum(axis=1) >= agree
            near &= np.minimum(n[rest], n[x]) >= threshold * np.maximum(n[rest], n[x]) - 1e-9
            edges += [(x, int(y)) for y in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return edges


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of incidence matrices a few thousand shingles at a time."""
    if len(a) * len(b) <= 64:
        return np.array([[np.intersect1d(x, y, assume_unique=True).size for y in b] for x in a], np.int64).reshape(len(a), len(b))
    every, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(every), columns):
        i, j = np.searchsorted(code, [lo, lo + columns])
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[row[i:j], code[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return np.rint(out).astype(np.int64)


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    escape: float = 1e-6, limit: int = 2048, block: int = 768, splits: int = 3, sets_too: bool = False,
) -> DataFrame:
    """docs with class_id (long), n_links (long) and n_copies (long).

    Words are runs of letters and digits of the lower-cased text; a shingle is
    ``size`` words, or all words of a shorter text.  Documents are linked if the
    Jaccard similarity of their shingle sets is at least the threshold; n_links counts
    a document's links, n_copies those with an equal set.  class_id is the smallest id
    in the component of links.  A text without words (null and empty ones too) has no
    links and is a class of its own.  A null id counts as the least long.  Repeated
    rows are documents of their own, linked to each other.

    ``sets_too`` adds set_id (binary), which stands for a document's set, and first_set
    (binary), the least set_id among those of class_id in its component.  Unlike
    class_id, first_set tells components of one id apart.  Both are null without words.

    ``escape`` is the probability with which a pair at the threshold may be missed, by
    the runs or by the sketches that choose pairs for the exact count (see chances).
    Buckets over ``limit`` are split up to ``splits`` times; what is left then, or
    is mostly alike, is compared in blocks, so that no pair is given up.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("class_id", "n_links", "n_copies", *(["set_id", "first_set"] if sets_too else []))]
    runs, agree = chances(threshold, escape)
    base = docs.withColumn("__d", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    outputs = T.StructType([T.StructField("__k", T.BinaryType()), T.StructField("__n", T.IntegerType()), T.StructField("__roots", T.ArrayType(T.LongType())), T.StructField("__sketch", T.BinaryType())])

    def make():
        hashes = WordHashes()

        def fn(texts: pa.Array) -> list:
            keys, counts, roots, sketches = [], [], [], []
            for text in texts.to_pylist():
                s = shingles(word_hashes(text, hashes), size)
                counts.append(len(s))
                if not len(s):
                    keys.append(None), roots.append(None), sketches.append(None)
                    continue
                e = embed(s)
                keys.append(identity(s))
                roots.append(mix(e[:runs] + np.arange(runs, dtype=np.uint64)).view(np.int64))
                sketches.append((e & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            return [keys, counts, roots, sketches]

        return fn

    # Written once, with the columns that the result keeps.
    sets = written(arrow_columns(base, [text_col], outputs, make, keep=["__d"] if names == [id_col] else [*names, "__d"]))
    nodes = sets.where("__n > 0").groupBy(F.col("__k").alias("k")).agg(
        F.min("__d").alias("d"), F.count("*").alias("m"), F.any_value("__n").alias("n"), F.any_value("__roots").alias("roots"), F.any_value("__sketch").alias("sketch")
    )
    nodes = written(nodes)

    # Splitting into buckets, until they are small or alike.
    level = nodes.select("k", F.explode("roots").alias("b"))
    ready = None
    for depth in range(splits + 1):
        counts = level.groupBy("b").count().where("count > 1")
        level = level.join(counts, "b")
        if depth:
            level = written(level)
        big = level.where(F.col("count") > limit)
        alike = F.col("count") > 0.5 * F.col("parent") if depth else F.lit(False)
        done = level if depth == splits else level.where((F.col("count") <= limit) | alike)
        ready = done.select("k", "b", "count") if ready is None else ready.union(done.select("k", "b", "count"))
        if depth == splits:
            break
        big = big.where(~alike)
        if depth and big.isEmpty():
            break
        sampled = F.transform(
            F.sequence(F.lit(0), F.lit(runs - 1)), lambda j: F.pmod(F.xxhash64("b", j), F.lit(COORDINATES)).cast("int")
        )
        big = big.join(nodes.select("k", "sketch"), "k").withColumn("j", F.explode(F.array_distinct(sampled)))
        level = big.select("k", F.xxhash64("b", "j", F.substring("sketch", F.col("j") * 2 + 1, F.lit(2))).alias("b"), F.col("count").alias("parent"))

    ready = ready.join(nodes.select("k", "n", "sketch"), "k")
    groups = F.ceil(F.col("count") / limit).cast("int")
    mine = F.pmod(F.xxhash64("k"), groups).cast("int")
    pair = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(F.least(g, mine).alias("i"), F.greatest(g, mine).alias("j")))
    parts = ready.withColumn("p", F.explode(pair)).select("b", "p.i", "p.j", "k", "n", "sketch")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches, 6), key=lambda r: r[:3]):
            rows = list(rows)
            if len(rows) > 1:
                keys = [r[3] for r in rows]
                found = forest(np.array([r[4] for r in rows]), np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), -1), threshold, agree)
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in found], pa.binary()), pa.array([keys[y] for _, y in found], pa.binary())], names=["u", "v"])

    edges = parts.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(link, "u binary, v binary")
    likely = written(components(edges))

    # Exact counts within components.
    wide = likely.groupBy("root").count()
    members = likely.join(wide, "root").join(nodes.select(F.col("k").alias("u"), "d", "m"), "u")
    whole = base.select("__d", F.col(text_col).alias("text")).join(members.select("d").distinct().hint("shuffle_hash"), F.col("__d") == F.col("d"), "left_semi")
    full = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("set", T.BinaryType())])

    def make_sets():
        hashes = WordHashes()

        def fn(texts: pa.Array) -> list:
            s = [shingles(word_hashes(t, hashes), size) for t in texts.to_pylist()]
            return [[identity(x) if len(x) else None for x in s], [x.tobytes() for x in s]]

        return fn

    whole = arrow_columns(whole, ["text"], full, make_sets, keep=["__d"]).dropDuplicates(["u"]) if _repeated(base) else arrow_columns(whole, ["text"], full, make_sets, keep=["__d"])
    groups = F.ceil(F.col("count") / block).cast("int")
    mine = F.pmod(F.xxhash64("u"), groups).cast("int")
    pair = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(F.least(g, mine).alias("i"), F.greatest(g, mine).alias("j")))
    blocks = members.join(whole, "u").withColumn("mine", mine).withColumn("p", F.explode(pair)).select("root", "p.i", "p.j", "mine", "u", "m", "set")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groupby(_rows(batches, 7), key=lambda r: r[:3]):
            rows = list(rows)
            left = [r for r in rows if r[3] == i]
            right = left if i == j else [r for r in rows if r[3] == j]
            if not left or not right:
                continue
            a, b = ([np.frombuffer(r[6], np.uint64) for r in side] for side in (left, right))
            both = shared_counts(a, b)
            total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - both
            linked = both >= threshold * total - 1e-9
            if i == j:
                np.fill_diagonal(linked, False)
            u, v, n = [r[4] for r in left], [], (linked * np.array([r[5] for r in right])).sum(axis=1).tolist()
            if i != j:
                u = u + [r[4] for r in right]
                n = n + (linked.T * np.array([r[5] for r in left])).sum(axis=1).tolist()
            v = [None] * len(u)
            for x, y in _spanning(linked, i == j):
                u.append(left[x][4]), v.append(right[y][4]), n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    checked = written(blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "u binary, v binary, n long"))
    links = checked.where("v IS NULL").groupBy(F.col("u").alias("k")).agg(F.sum("n").alias("links"))
    classes = components(checked.where("v IS NOT NULL").select("u", "v")).select(F.col("u").alias("k"), "root")
    labelled = nodes.select("k", "d", "m").join(classes, "k", "left").join(links, "k", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "k"))
    least = labelled.groupBy("root").agg(F.min(F.struct("d", "k")).alias("least")).select("root", F.col("least.d").alias("class_id"), F.col("least.k").alias("first_set"))
    final = labelled.join(least, "root").select(
        F.col("k").alias("__k"), "class_id", "first_set", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), (F.col("m") - 1).alias("n_copies")
    )
    rows = sets.select(*([] if names == [id_col] else [F.col(f"`{c}`") for c in names]), "__k", "__d")
    out = rows.join(final, "__k", "left").withColumns({"class_id": F.coalesce("class_id", "__d"), "n_links": F.coalesce("n_links", F.lit(0)), "n_copies": F.coalesce("n_copies", F.lit(0))})
    if names == [id_col]:
        out = out.withColumn(id_col, F.when(F.col("__d") > -(1 << 63), F.col("__d")))
    more = [F.col("__k").alias("set_id"), "first_set"] if sets_too else []
    return out.select(*[F.col(f"`{c}`") for c in names], "class_id", "n_links", "n_copies", *more)


def _repeated(base: DataFrame) -> bool:
    return not base.groupBy("__d").count().where("count > 1").isEmpty()


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield from zip(*(part.column(i).to_pylist() for i in range(width)), strict=True)


def _spanning(linked: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges of linked that join all that it joins: a breadth-first forest over rows and columns."""
    rows, cols = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    out = []
    for start in range(linked.shape[0]):
        if not rows[start]:
            continue
        rows[start] = False
        if square:
            cols[start] = False
        queue = [(start, True)]
        while queue:
            x, is_row = queue.pop()
            near = np.flatnonzero(linked[x] & cols) if is_row else np.flatnonzero(linked[:, x] & rows)
            for y in near.tolist():
                out.append((x, y) if is_row else (y, x))
                if square:
                    rows[y] = cols[y] = False
                elif is_row:
                    cols[y] = False
                else:
                    rows[y] = False
                queue.append((y, square or not is_row))
    return out
