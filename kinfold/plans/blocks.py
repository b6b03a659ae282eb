"""Local moving inside blocks of communities, one task a block, before rounds over the whole graph.

Communities fall into blocks by hash, as many as keep a block's edges and vectors under a
bound.  A task moves its own hypernodes among communities of its own, one after the
other, by exact gains: degrees and the total weight are those of the whole graph, and a
community that holds no node of another block has no weight there that a move within the
block would change.  Passes deal the communities anew; what is still left, moves between
blocks, is for the rounds that follow.  One block of all has no move left and needs no rounds:
its task contracts communities itself and goes on with the next level, to the end of the run.
"""

from __future__ import annotations

import math
import time
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges and vector components of a block, at about most.
BLOCK = 2_000_000
#: Most distinct vectors, and most components of all, for which decided pairs are kept.
KEPT, KEPT_VALUES = 8_192, 200_000


class Pairs:
    """Whether nodes lie farther apart than the root of rr, by the bounds of predicates.predicate; decided pairs cost no distance."""

    def __init__(self, x: pd.DataFrame, steps: list[str], table: list[float] | None, rr: float) -> None:
        self.rr, self.steps, self.eps = rr, steps, 1e-9 * (1 + abs(rr))
        every = np.array(x["attrs"].tolist(), float).reshape(len(x), -1)
        _, firsts, self.of = np.unique(every, axis=0, return_index=True, return_inverse=True)
        self.of = self.of.reshape(-1)  # of each row its vector: twins are looked at once
        x, self.attrs = x.iloc[firsts], every[firsts]
        if {"stat", "norm"} & {*steps}:
            self.sqr, self.sum, self.top, self.low, self.signed = (x[c].to_numpy() for c in ("attr_sqr", "abs_sum", "abs_max", "abs_min", "negative"))
        if table is not None:
            self.d2s, self.pivot = np.array(x["d2s"].tolist(), float), x["pivot"].to_numpy()
            self.table = np.array(table).reshape(self.d2s.shape[1], -1)
        self.distances = 0
        n, self.all = len(firsts), np.arange(len(firsts))
        keep = n <= KEPT and self.attrs.size <= KEPT_VALUES
        self.apart = np.zeros((n, n), bool) if keep else None  # of those with a row: which vectors are too far
        self.known = np.zeros(n, bool)

    def row(self, i: int) -> np.ndarray:
        """Of every vector whether it is too far from i; decided once."""
        if not self.known[i]:
            self.apart[i] = self.decided(np.array([i]), self.all)[0]
            self.known[i] = True
        return self.apart[i]

    def decided(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        beyond, left = np.zeros((len(i), len(j)), bool), np.ones((len(i), len(j)), bool)
        for step in self.steps:
            lo, hi = self.bounds(step, i, j)
            out = left & ~(lo <= self.rr + self.eps)
            beyond |= out
            left &= ~out & ~(hi < self.rr - self.eps)
        a, b = np.nonzero(left)
        d = self.attrs[i[a]] - self.attrs[j[b]]
        self.distances += len(d)
        beyond[a, b] = np.einsum("ij,ij->i", d, d) > self.rr
        return beyond

    def bounds(self, step: str, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if step in ("stat", "norm"):
            s = self.sqr[i][:, None] + self.sqr[j]
            signed = self.signed[i][:, None] | self.signed[j]
            most = np.minimum(self.sum[i][:, None] * self.top[j], self.top[i][:, None] * self.sum[j])
            least = np.maximum(self.sum[i][:, None] * self.low[j], self.low[i][:, None] * self.sum[j])
            lo, hi = s - 2 * most, np.where(signed, s + 2 * most, s - 2 * least)
            if step == "stat":
                return lo, hi
            t = 2 * np.sqrt(self.sqr[i][:, None] * self.sqr[j])
            return np.where(signed, s - t, lo), np.where(signed, s + t, hi)
        p, q = self.pivot[i], self.pivot[j]
        a1, a2 = self.d2s[i, p][:, None], self.d2s[np.ix_(i, q)]
        b1, b2 = self.d2s[np.ix_(j, p)].T, self.d2s[j, q][None, :]
        s = self.table[np.ix_(p, q)]
        ra, rb = np.sqrt(a1), np.sqrt(b1)
        if step == "bipolar":
            alpha, beta, apart = (a1 + s - a2) / 2, (b1 + s - b2) / 2, s > 1e-9
            safe = np.where(apart, s, 1.0)
            f = a1 + b1 - 2 * alpha * beta / safe
            t = 2 * np.sqrt(np.maximum(0.0, a1 - alpha * alpha / safe) * np.maximum(0.0, b1 - beta * beta / safe))
            return np.where(apart, f - t, (ra - rb) ** 2), np.where(apart, f + t, (ra + rb) ** 2)
        lo = np.maximum(np.abs(ra - rb), np.abs(np.sqrt(a2) - np.sqrt(b2)))
        hi = np.minimum(ra + rb, np.sqrt(a2) + np.sqrt(b2))
        if step == "centroid":
            hi = np.minimum(hi, ra + np.sqrt(s) + np.sqrt(b2))
        return lo * lo, hi * hi

    def far(self, i: np.ndarray, j: np.ndarray) -> int:
        """The place in j of a vector too far from one of i, or -1; some rows at a time."""
        if self.apart is not None:
            for a in i.tolist():
                beyond = self.row(a)[j]
                if beyond.any():
                    return int(beyond.argmax())
            return -1
        width = max(1, 500_000 // max(1, len(j) * self.attrs.shape[1]))
        for at in range(0, len(i), width):
            rows = i[at : at + width]
            left = None
            for step in self.steps:
                lo, hi = self.bounds(step, rows, j)
                open_ = (lo <= self.rr + self.eps) if left is None else left & (lo <= self.rr + self.eps)
                beyond = ~open_ if left is None else left & ~open_
                if beyond.any():
                    return int(np.nonzero(beyond)[1][0])
                left = open_ & ~(hi < self.rr - self.eps)
                if not left.any():
                    break
            if left is None:
                self.distances += len(rows) * len(j)
                d = self.attrs[rows][:, None, :] - self.attrs[j]
                beyond = np.einsum("ijk,ijk->ij", d, d) > self.rr
                if beyond.any():
                    return int(np.nonzero(beyond)[1][0])
            elif left.any():
                a, b = np.nonzero(left)
                for lo_ in range(0, len(a), 500_000):
                    d = self.attrs[rows[a[lo_ : lo_ + 500_000]]] - self.attrs[j[b[lo_ : lo_ + 500_000]]]
                    self.distances += len(d)
                    beyond = np.einsum("ij,ij->i", d, d) > self.rr
                    if beyond.any():
                        return int(b[lo_ + int(beyond.argmax())])
        return -1


def drawn(u: int, offers: list[tuple], m: int, seed: int) -> list[tuple]:
    """Offers in the order of draws by weight: a Gumbel number beside half the rise in modularity, as moves.weighted has it."""

    def key(offer: tuple) -> float:
        uniform = (((hash((u, offer[1], seed)) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 24) + 0.5
        return offer[0] * 0.5 / (2.0 * m * m) - math.log(-math.log(uniform / (1 << 40)))

    return sorted(offers, key=key, reverse=True)


def move_block(
    start: dict[int, int], degree: dict[int, int], links: dict[int, dict[int, tuple]], held: dict[int, np.ndarray], pairs: Pairs | None, m: int,
    gamma: float, least: float, choice: str, sweeps: int | None = None, parent: dict[int, int] | None = None, finish: bool = True,
) -> tuple[dict[int, int], tuple[int, int, int]]:
    """The community of each hypernode once no move within the block raises modularity, and the moves tried, refused, and made.

    start: the communities to begin with.  links: of each hypernode its neighbours with
    (weight, violated).  held: its nodes' rows in pairs.  A hypernode takes its ``best``
    feasible move, the ``first`` one met, or one drawn by its gain (``weighted``); its
    neighbours are then looked at again, and, to ``finish``, after them all near communities that
    changed, until nothing moves; or there are at most ``sweeps`` over all.  parent: moves between different ones are left out.
    """
    community = dict(start)
    inside: dict[int, set] = defaultdict(set)
    sums: dict[int, int] = defaultdict(int)
    for h, c in community.items():
        inside[c].add(h)
        sums[c] += degree[h]
    version: dict[int, int] = defaultdict(int)
    refused: dict[tuple[int, int], int] = {}  # the version of the community that refused
    rows: dict[int, tuple[list, np.ndarray]] = {}
    friends: dict[int, set] = defaultdict(set)  # of hypernodes of many vectors, those found near enough
    foes: dict[int, set] = defaultdict(set)  # and of all, those found too far
    tried = blocked = made = number = 0
    touched: set[int] = set()  # communities that gained or lost a member since the sweep began
    waiting = set(degree)
    while waiting and (sweeps is None or number < sweeps):
        queue = deque(sorted(waiting))
        touched.clear()
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            s, k = community[u], degree[u]
            weight: dict[int, int] = {s: 0}
            broken = set()
            for v, (w, bad) in links.get(u, {}).items():
                c = community[v]
                weight[c] = weight.get(c, 0) + w
                if bad:
                    broken.add(c)
            own = weight.pop(s)
            base = k - sums[s]
            offers = []
            for c, w in weight.items():
                g = 2 * m * (w - own) - gamma * k * (sums[c] + base)
                if g >= least and c not in broken and (parent is None or parent[c] == parent[u]):
                    offers.append((g, c))
            if len(offers) > 1 and choice != "first":
                offers = drawn(u, offers, m, number) if choice == "weighted" else sorted(offers, reverse=True)
            for _, c in offers:
                if pairs is not None:
                    if refused.get((u, c)) == version[c]:
                        continue
                    tried += 1
                    if not (apart := u in foes and not foes[u].isdisjoint(inside[c])):
                        if many := len(held[u]) > 8:
                            others = list(inside[c] - friends[u])
                            j = np.concatenate([held[h] for h in others]) if others else held[u][:0]
                        else:
                            if c not in rows:
                                rows[c] = ((others := list(inside[c])), np.concatenate([held[h] for h in others]))
                            others, j = rows[c]
                        at = pairs.far(held[u], j)
                        if apart := at >= 0:
                            for h in others:
                                at -= len(held[h])
                                if at < 0:
                                    foes[u].add(h)
                                    foes[h].add(u)
                                    break
                        elif many:
                            friends[u].update(others)
                            for h in others:
                                friends[h].add(u)
                    if apart:
                        refused[u, c] = version[c]
                        blocked += 1
                        continue
                community[u] = c
                inside[s].discard(u)
                inside[c].add(u)
                sums[s] -= k
                sums[c] += k
                for x in (s, c):
                    version[x] += 1
                    rows.pop(x, None)
                touched.update((s, c))
                made += 1
                if sweeps is None:
                    for v in links.get(u, {}):
                        if community[v] != c and v not in waiting:
                            waiting.add(v)
                            queue.append(v)
                break
        if not finish:
            break
        # A community that changed opens or shuts moves for its members and all their neighbours.
        members = [h for c in touched for h in inside[c]]
        waiting = set(members).union(*(links.get(h, ()) for h in members)) if sweeps is None else set(degree) if touched else set()
        number += 1
    return community, (tried, blocked, made)


def contracted(community: dict[int, int], degree: dict[int, int], links: dict[int, dict[int, tuple]], held: dict[int, np.ndarray]) -> tuple[dict, dict, dict]:
    """degree, links and held (see move_block) of communities as hypernodes; a link is violated if one of its own is."""
    sums: dict[int, int] = defaultdict(int)
    near: dict[int, dict[int, tuple]] = defaultdict(dict)
    rows: dict[int, list] = defaultdict(list)
    for h, c in community.items():
        sums[c] += degree[h]
        if h in held:
            rows[c].append(held[h])
        mine = near[c]
        for v, (w, bad) in links.get(h, {}).items():
            if (d := community[v]) != c:
                old = mine.get(d)
                mine[d] = (w, bad) if old is None else (old[0] + w, old[1] or bad)
    return dict(sums), near, {c: x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for c, x in rows.items()}


def quality(degree: dict[int, int], links: dict[int, dict[int, tuple]], community: dict[int, int], m: int, gamma: float) -> float:
    sums: dict[int, int] = defaultdict(int)
    for h, c in community.items():
        sums[c] += degree[h]
    across = sum(w for u, near in links.items() for v, (w, _) in near.items() if community[u] != community[v])
    return 1 - across / (2 * m) - gamma * sum(k * k for k in sums.values()) / (4 * m * m)


def all_levels(
    degree: dict[int, int], links: dict[int, dict[int, tuple]], held: dict[int, np.ndarray], pairs: Pairs | None, m: int, gamma: float, least: float,
    choice: str, rounds: int | None = None, levels: int | None = None, sweeps: int | None = None,
) -> tuple[dict[int, int], list[tuple]]:
    """The community of each hypernode after all levels of a graph of one block, and the figures of each level.

    sweeps: Leiden; communities are refined by so many sweeps of drawn moves, the refined parts
    are contracted, and the partition of the highest modularity over the levels counts.
    """
    overall = {h: h for h in degree}
    best, top = overall, quality(degree, links, overall, m, gamma) if sweeps is not None else 0.0
    log: list[tuple] = []
    done = 0

    def moved(began: float, found: dict, figures: tuple) -> int:
        tried, blocked, made = figures
        log.append((done, tried, blocked, (pairs.distances if pairs else 0) - sum(x[3] for x in log), made, time.time() - began))
        return made

    while levels is None or done < levels:
        began, start = time.time(), {h: h for h in degree}
        found, figures = move_block(start, degree, links, held, pairs, m, gamma, least, choice, rounds, finish=False)
        if not moved(began, found, figures):
            break
        parts = found
        if sweeps is not None:
            q = quality(degree, links, found, m, gamma)
            if q > top:
                best, top = {h: found[c] for h, c in overall.items()}, q
            began = time.time()
            parts, figures = move_block(start, degree, links, {}, None, m, gamma, least, "weighted", sweeps, parent=found)
            if not moved(began, parts, figures):
                break
        overall = {h: parts[c] for h, c in overall.items()}
        degree, links, held = contracted(parts, degree, links, held)
        done += 1
    return overall if sweeps is None else best, log


def block_count(edges: int, nodes: DataFrame, r: float | None) -> int:
    """The blocks of a graph of so many edges, and of the nodes' vectors where a constraint reads them."""
    n = nodes.agg(F.count("*").alias("n"), F.max(F.size("attrs")).alias("d")).first()
    return max(1, math.ceil((edges + n["n"] * (1 if r is None else 1 + (n["d"] or 0))) / BLOCK))


def _read(e: pd.DataFrame, x: pd.DataFrame, constrained: bool, steps: list[str], table: list[float] | None, rr: float) -> tuple:
    """The communities to begin with, degree, links, held and pairs (see move_block) of a task's tables."""
    near: dict[int, dict[int, tuple]] = defaultdict(dict)
    for u, v, w, broken in zip(e["u"].tolist(), e["v"].tolist(), e["w"].tolist(), e["bad"].tolist(), strict=True):
        near[u][v] = near[v][u] = (w, broken)
    hs = x["h"].to_numpy()
    order = np.argsort(hs, kind="stable")
    pairs = Pairs(x, steps, table, rr) if constrained else None
    held = {}
    if pairs:
        each = np.split(pairs.of[order], np.flatnonzero(np.diff(hs[order])) + 1)
        held = {h: a if len(a) == 1 else np.unique(a) for h, a in zip(np.unique(hs).tolist(), each, strict=True)}
    start = dict(zip(hs.tolist(), x["c"].tolist(), strict=True))
    return start, dict(zip(hs.tolist(), x["k"].tolist(), strict=True)), near, held, pairs


def whole_run(
    edges: DataFrame, membership: DataFrame, nodes: DataFrame, m: int, r: float | None, test, gamma: float, least: float, choice: str,
    rounds: int | None = None, levels: int | None = None, sweeps: int | None = None,
) -> DataFrame:
    """(h, c, log) after all_levels of a graph of one block, in one task; one row has the figures of the levels."""
    bad = F.col("flag") == "violated" if "flag" in edges.columns else F.lit(False)
    links = edges.where("u <> v").select("u", "v", "w", bad.alias("bad"), F.lit(0).alias("b"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("h"), "w").groupBy("h").agg(F.sum("w").alias("k"))
    constrained = r is not None
    at = membership if constrained else membership.select("h").distinct()
    at = at.join(ends, "h", "left").withColumns({"k": F.coalesce("k", F.lit(0)).cast("long"), "c": F.col("h"), "b": F.lit(0)})
    if constrained:
        at = at.join(nodes.select(F.col("id").alias("node"), *test.columns), "node").drop("node")
    steps, table, rr = getattr(test, "steps", []), getattr(test, "table", None), (r or 0.0) ** 2

    def run(e: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"h": [], "c": [], "log": []})
        _, degree, near, held, pairs = _read(e, x, constrained, steps, table, rr)
        found, log = all_levels(degree, near, held, pairs, m, gamma, least, choice, rounds, levels, sweeps)
        out = pd.DataFrame({"h": list(found), "c": list(found.values())})
        names = ("level", "attempts", "blocked", "distances", "made", "seconds")
        out["log"] = [[dict(zip(names, row, strict=True)) for row in log]] + [None] * (len(out) - 1)
        return out

    schema = "h long, c long, log array<struct<level int, attempts long, blocked long, distances long, made long, seconds double>>"
    return links.groupBy("b").cogroup(at.groupBy("b")).applyInPandas(run, schema)


def moved_in_blocks(
    edges: DataFrame, membership: DataFrame, nodes: DataFrame, degree: DataFrame, assign: DataFrame | None, m: int, r: float | None, test, gamma: float, least: float,
    choice: str, blocks: int, seed: int = 0, within: DataFrame | None = None, sweeps: int | None = None, finish: bool = True,
) -> DataFrame:
    """(h, c, moved, attempts, blocked, distances, made) after moving in blocks; figures stand in one row of each block.

    assign (h, c) has the communities to begin with, None: each hypernode its own.  within
    (h, parent): moves stay inside parents, which are whole in a block; parents that keep the
    constraint need no check of it.
    """
    block = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(blocks)).cast("int")
    bad = F.col("flag") == "violated" if "flag" in edges.columns else F.lit(False)
    links = edges.where("u <> v").select("u", "v", "w", bad.alias("bad"))
    at = degree.withColumn("c", F.col("h")) if assign is None else degree.join(assign.select("h", "c"), "h")
    at = at.withColumn("b", block("c")) if within is None else at.join(within, "h").withColumn("b", block("parent"))
    if blocks == 1:
        links = links.withColumn("b", F.lit(0))
    elif assign is None and within is None:
        links = links.where(block("u") == block("v")).withColumn("b", block("u"))
    else:
        x, y = at.select(F.col("h").alias("u"), F.col("b").alias("bu")), at.select(F.col("h").alias("v"), F.col("b").alias("bv"))
        links = links.join(x, "u").join(y, "v").where("bu = bv").select(F.col("bu").alias("b"), "u", "v", "w", "bad")
    constrained = r is not None and within is None
    if constrained:
        at = at.join(membership, "h").join(nodes.select(F.col("id").alias("node"), *test.columns), "node").drop("node")
    steps, table, rr, parents = getattr(test, "steps", []), getattr(test, "table", None), (r or 0.0) ** 2, within is not None

    def run(e: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        names = ("attempts", "blocked", "distances", "made")
        if x.empty:
            return pd.DataFrame({c: [] for c in ("h", "c", "moved", *names)})
        start, degrees, near, held, pairs = _read(e, x, constrained, steps, table, rr)
        parent = dict(zip(x["h"].tolist(), x["parent"].tolist(), strict=True)) if parents else None
        found, (tried, blocked, made) = move_block(start, degrees, near, held, pairs, m, gamma, least, choice, sweeps, parent, finish)
        out = pd.DataFrame({"h": list(found), "c": list(found.values())})
        out["moved"] = out["c"].to_numpy() != np.fromiter(start.values(), "int64", len(start))
        for name, value in zip(names, (tried, blocked, pairs.distances if pairs else 0, made), strict=True):
            out[name] = [value] + [0] * (len(out) - 1)
        return out

    together = links.groupBy("b").cogroup(at.groupBy("b"))
    return together.applyInPandas(run, "h long, c long, moved boolean, attempts long, blocked long, distances long, made long")
