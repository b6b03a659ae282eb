"""Approximate nearest neighbours by largest inner product.

An inverted file of coarse centroids holds every row's residual in product
codes.  A query visits the lists whose centroids promise most, scores their
codes by a table of its inner products with the code words, and the best by
code are ranked again by exact inner products of the original vectors.  How many
lists, and how large a part of each, is measured with the queries to be asked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_columns, bounded_sample, checkpoint


def usable(v: Column) -> Column:
    """Whether a vector is not null or zero and all its components are finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of x, k at most; an emptied cluster takes the point farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centre = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(x, centre)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        far = np.argsort(-((x - new[near]) ** 2).sum(axis=1), kind="stable")
        empty = np.flatnonzero(count == 0)
        new[empty] = x[far[: len(empty)]]
        if np.array_equal(new, centre):
            break
        centre = new
    return centre


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x**2).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norm = (centre**2).sum(axis=1)
    return np.concatenate([(norm - 2 * x[i : i + 4096] @ centre.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def assign(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The list of each row: its nearest coarse centroid, then the finer one nearest to what is left."""
    near = nearest(x, coarse)
    return near * len(fine) + nearest(x - coarse[near], fine)


@dataclass
class IvfPq:
    """The trained part: centroids, code words of each subspace, and how many lists a query visits.

    Lists are pairs of a coarse centroid and of a finer one that all coarse ones share, so that
    many lists need no larger sample.
    """

    dim: int
    coarse: np.ndarray  # coarse centroid, component
    fine: np.ndarray  # finer centroid, component
    centroids: np.ndarray  # list, component: all sums of both
    words: np.ndarray  # subspace, word, component
    parts: list[tuple[int, int]]  # each subspace's components
    probes: int
    share: float  # of a visited list's rows, those that are ranked again
    reach: float  # rows farther from their centroid than this form a last list, which all queries visit and rank as a whole

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes of the residual's direction, and its length: close to a centroid, codes are as fine as elsewhere."""
        lists = assign(x, self.coarse, self.fine)
        rest, length = unit(x - self.centroids[lists])
        return np.where(length > self.reach, len(self.centroids), lists), length, np.stack([nearest(rest[:, a:b], self.words[m][:, : b - a]) for m, (a, b) in enumerate(self.parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """query, subspace, word: inner products."""
        return np.stack([q[:, a:b] @ self.words[m][:, : b - a].T for m, (a, b) in enumerate(self.parts)], axis=1)

    def visit(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Of each query, the lists of the largest inner products: ``probes`` lists, and more until they hold ``least`` rows; and the last."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(sizes[: len(self.centroids)][order], axis=1)
        n = np.maximum(self.probes, (held < least).sum(axis=1) + 1)
        last = np.flatnonzero(sizes[len(self.centroids) :]) + len(self.centroids)
        return [np.concatenate([o[:k], last]) for o, k in zip(order, n, strict=True)]

    def scores(self, q: np.ndarray, codes: np.ndarray, length: np.ndarray, place: int) -> np.ndarray:
        """query, row: inner products with the rows of one list by their codes."""
        table = self.tables(q).astype(np.float32)
        near = np.zeros((len(q), len(codes)), np.float32)
        for m in range(codes.shape[1]):
            near += np.take(table[:, m, :], codes[:, m], axis=1)
        near *= length
        near += (q @ self.centroids[place])[:, None].astype(np.float32)
        return near


def fit(
    vectors: DataFrame, vector: str = "embedding", sample: int = 16_384, subspaces: int = 16, recall: float = 0.99, k: int = 20, queries: DataFrame | None = None,
) -> IvfPq | None:
    """Train on a sample of about ``sample`` rows, by the hash of the vector, the only rows that reach the driver.

    The number of lists is half the root of the number of rows; over 1,024 they have
    two levels.  The number of lists visited is the least that finds ``recall`` of the
    true k nearest in the sample for 300 different vectors of queries (None: of the sample).
    The share of a list ranked again is the least that holds ``recall`` of those of them that
    are in a quarter of the sample kept out of training, by their places among the list's codes.  The index
    holds vectors of the sample's most common length.  Without usable vectors there is
    no index (None).
    """
    good = vectors.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    rows = bounded_sample(good, "v", sample).collect()
    if not rows:
        return None
    lengths = pd.Series([len(r["v"]) for r in rows])
    dim = int(lengths.mode()[0])
    every = np.array([r["v"] for r in rows if len(r["v"]) == dim])
    every = every[np.random.default_rng(5).permutation(len(every))]
    x = every[: math.ceil(0.75 * len(every))]
    total = good.count()
    lists = max(1, round(math.sqrt(total) / 2))
    levels = math.ceil(lists / 1024)
    coarse = kmeans(x, math.ceil(lists / levels))
    fine = kmeans(x - coarse[nearest(x, coarse)], levels) if levels > 1 else np.zeros((1, dim))
    centroids = (coarse[:, None, :] + fine[None, :, :]).reshape(-1, dim)
    rest, _ = unit(x - centroids[assign(x, coarse, fine)])
    bounds = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    widest = max(b - a for a, b in parts)
    words = np.full((len(parts), 256, widest), 0.0)
    for m, (a, b) in enumerate(parts):
        w = kmeans(rest[:, a:b], 256, rounds=6)
        words[m, : len(w), : b - a] = w
        words[m, len(w) :, : b - a] = w[0]
    apart, firsts = np.unique(every, axis=0, return_index=True)  # copies of one vector would pass for many found neighbours
    probe = apart
    if queries is not None:
        asked = queries.where(usable(F.col(vector)) & (F.size(vector) == dim)).select(F.col(vector).cast("array<double>").alias("v"))
        asked = bounded_sample(asked, "v", 600).collect()
        probe = np.unique(np.array([r["v"] for r in asked]), axis=0) if asked else apart
    probe = probe[np.random.default_rng(11).permutation(len(probe))[:300]]
    scores = probe @ apart.T
    where = {v.tobytes(): i for i, v in enumerate(apart)}
    for i, v in enumerate(probe):
        if v.tobytes() in where:
            scores[i, where[v.tobytes()]] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(apart) - 1))]
    index = IvfPq(dim, coarse, fine, centroids, words, parts, 1, 1.0, math.inf)
    own, length, codes = index.encode(apart)
    rank = np.argsort(np.argsort(-(probe @ centroids.T), axis=1), axis=1)

    def least(needed: np.ndarray) -> float:
        return np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]

    index.probes = int(least(np.take_along_axis(rank, own[top], axis=1).ravel())) + 1
    index.reach = float(length.max())
    shares = []
    for c in np.unique(own[top]):
        held = np.flatnonzero(own == c)
        mine, which = np.nonzero((own[top] == c) & (firsts[top] >= len(x)))
        for lo in range(0, len(probe), 32):
            some = (mine >= lo) & (mine < lo + 32)
            if some.any():
                near = index.scores(probe[lo : lo + 32], codes[held], length[held].astype(np.float32), c)[mine[some] - lo]
                value = near[np.arange(len(near)), np.searchsorted(held, top[mine[some], which[some]])]
                shares.append((near >= value[:, None]).sum(axis=1) / len(held))
    if shares:
        index.share = float(least(np.concatenate(shares)))
    return index


def search(
    rows: DataFrame, queries: DataFrame, index: IvfPq | None, k: int = 20, row_id: str = "vec_id", vector: str = "embedding",
    row_block: int = 4096, query_block: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query, ties to the smaller id.

    rows and queries hold row_id (long) and vector.  A row of the query's own id is
    no candidate; a query with fewer candidates gets all.  Unusable vectors, null
    ids and an index of None give no rows.  Vectors of another length than the index's
    are compared with all of their own length, in blocks.  Lists are cut into blocks of about
    row_block rows and the queries that visit them into blocks of about query_block;
    of equal vectors in a block, only the k+1 smallest ids can matter and are ranked.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    if index is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(index)

    def clean(df: DataFrame, own: bool = True) -> DataFrame:
        fits = F.size(vector) == index.dim
        good = df.where(usable(F.col(vector)) & F.col(row_id).isNotNull() & (fits if own else ~fits))
        return good.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def matrix(v: pa.ListArray) -> np.ndarray:
        return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, sent.value.dim)

    def make_rows():
        def fn(v: pa.ListArray) -> list:
            x = np.ascontiguousarray(matrix(v))
            lists, length, codes = sent.value.encode(x)
            return [pa.array(lists.astype(np.int32)), pa.array(length), [c.tobytes() for c in codes], [r.tobytes() for r in x]]

        return fn

    out = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("length", T.DoubleType()), T.StructField("codes", T.BinaryType()), T.StructField("raw", T.BinaryType())])
    coded = checkpoint(arrow_columns(clean(rows), ["v"], out, make_rows, keep=["id"]))
    sizes = np.zeros(len(index.centroids) + 1, np.int64)
    for r in coded.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]

    def make_queries():
        def fn(v: pa.ListArray) -> list:
            q = np.ascontiguousarray(matrix(v))
            return [[x.tolist() for x in sent.value.visit(q, sizes, 10 * k)], [r.tobytes() for r in q]]

        return fn

    out = T.StructType([T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("raw", T.BinaryType())])
    asked = checkpoint(arrow_columns(clean(queries), ["v"], out, make_queries, keep=["id"]))
    visits = asked.select("id", "raw", F.explode("lists").alias("list"))
    wanted = np.zeros(len(sizes), np.int64)
    for r in visits.groupBy("list").count().collect():
        wanted[r["list"]] = r["count"]
    row_blocks = np.maximum(1, -(-sizes // row_block))
    query_blocks = np.maximum(1, -(-wanted // query_block))
    blocks = F.array(*[F.struct(F.lit(int(a)).alias("r"), F.lit(int(b)).alias("q")) for a, b in zip(row_blocks, query_blocks, strict=True)])
    n = F.get(blocks, F.col("list"))
    left = coded.withColumn("rb", F.pmod(F.xxhash64("id"), n["r"]).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), n["q"] - 1)))
    right = visits.withColumn("qb", F.pmod(F.xxhash64("id"), n["q"]).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), n["r"] - 1)))

    def rank(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if r.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index, r = sent.value, r.sort_values("id", kind="stable")
        x = np.frombuffer(b"".join(r["raw"]), np.float64).reshape(len(r), -1)
        ids, codes = r["id"].to_numpy(), np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(len(r), -1)
        _, copy_of = np.unique(r["raw"].to_numpy(), return_inverse=True)
        order = np.argsort(copy_of, kind="stable")
        place = np.empty(len(r), np.int64)
        place[order] = np.arange(len(r)) - np.repeat(np.flatnonzero(np.diff(copy_of[order], prepend=-1)), np.bincount(copy_of))
        keep = place <= k
        length = r["length"].to_numpy()[keep].astype(np.float32)
        x, ids, codes, copies = x[keep], ids[keep], codes[keep], np.bincount(copy_of[keep], minlength=1).max()
        y = np.frombuffer(b"".join(q["raw"]), np.float64).reshape(len(q), -1)
        number = int(r["list"].iat[0])
        # codes say little about the rows of the last list
        depth = len(ids) if number == len(index.centroids) else min(len(ids), max(4 * k, math.ceil(index.share * len(ids))) * int(copies))
        names, found = q["id"].to_numpy(), [[], [], []]
        for lo in range(0, len(y), 32):
            part = y[lo : lo + 32]
            if depth < len(ids):
                best = np.argpartition(-index.scores(part, codes, length, number), depth - 1, axis=1)[:, :depth]
            else:
                best = np.broadcast_to(np.arange(len(ids)), (len(part), len(ids)))
            score = np.stack([(x[b] * p).sum(axis=1) for b, p in zip(best, part, strict=True)])
            for i, name in enumerate(names[lo : lo + 32]):
                other = ids[best[i]] != name
                s, c = score[i][other], ids[best[i]][other]
                top = np.lexsort((c, -s))[:k]
                for column, v in zip(found, (np.full(len(top), name), c[top], s[top]), strict=True):
                    column.append(v)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, found), strict=True)))

    pairs = left.groupBy("list", "rb", "qb").cogroup(right.groupBy("list", "rb", "qb")).applyInPandas(rank, "query_id long, vec_id long, score double")
    others = clean(queries, False)
    if not others.isEmpty():
        pairs = pairs.union(_exact(clean(rows, False), others, k, row_block, query_block))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, queries: DataFrame, k: int, row_block: int, query_block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of rows for each query among the vectors of its length."""

    def blocked(df: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        sized = df.withColumn("dim", F.size("v"))
        counts = sized.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{name}"))
        return sized.join(counts, "dim").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int")), counts

    left, r = blocked(rows, row_block, "rb")
    right, q = blocked(queries, query_block, "qb")
    left = left.join(q, "dim").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)))
    right = right.join(r, "dim").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("n_rb") - 1)))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(a) and len(b):
            x, ids = np.array(a["v"].tolist()), a["id"].to_numpy()
            for name, v in zip(b["id"], b["v"], strict=True):
                score = np.where(ids == name, -np.inf, (x * np.asarray(v)).sum(axis=1))
                top = np.lexsort((ids, -score))[: k + 1]
                top = top[ids[top] != name][:k]
                out.append(pd.DataFrame({"query_id": name, "vec_id": ids[top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["dim", "rb", "qb"]
    return left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
