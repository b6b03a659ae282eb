"""Constrained Louvain: rounds of local moving to a fixpoint, then contraction, level after level.

A level moves inside blocks, one task each; where that finds nothing and there are several
blocks, rounds over the whole graph follow, so that a run ends only with no move left.
A graph of one block, from the first level or from a later one, is run to its end in one task.
Rounds move many hypernodes at once, by moves.accept: modularity rises each round,
and moves into one community are checked against each other as well as against it.
The driver sees a few numbers a round; all tables are cut into the shared checkpoint folder.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import contract as C
from kinfold.operators import graph as G
from kinfold.operators import moves as M
from kinfold.operators.index import PivotIndex
from kinfold.operators.modularity import modularity
from kinfold.operators.predicates import predicate
from kinfold.plans.blocks import block_count, moved_in_blocks, whole_run
from kinfold.sources.storage import cut, discard


@dataclass
class Run:
    """The final membership (c, node), c being the least node of its community, and the figures of each round."""

    membership: DataFrame
    q: float
    rounds: list[dict] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        schema = "level int, round int, attempts long, blocked long, distances long, moves long, seconds double"
        return self.membership.sparkSession.createDataFrame([tuple(r.values()) for r in self.rounds], schema)


#: The least rise in modularity that a run takes for one.
RISE = 1e-10

#: Settings of the algorithms by the code of a command line.
ALGORITHMS = {
    8: {"policy": "active", "pruning": "stat", "edge_flags": True, "feasibility_cache": True},
    9: {"policy": "active", "pruning": "stat", "edge_flags": True},
    91: {"policy": "sweep", "pruning": "stat", "edge_flags": True},
    10: {"policy": "sweep", "pruning": "none"},
    11: {"policy": "active", "pruning": "none", "choice": "first"},
    14: {"policy": "active", "pruning": "hybrid", "edge_flags": True, "feasibility_cache": True},
    15: {"policy": "active", "pruning": "triangle_hybrid", "edge_flags": True, "feasibility_cache": True},
    20: {"policy": "sweep", "r": None},
}


def prepare(g: G.AttributedGraph, pruning: str, pivots: int = 16, index: PivotIndex | None = None):
    """The nodes with what the predicate reads, and the predicate."""
    if pruning in ("none", "stat"):
        return (g.nodes if pruning == "none" else G.node_stats(g.nodes)), predicate(pruning)
    index = index or PivotIndex.fit(g.nodes, pivots)
    return index.attach(G.node_stats(g.nodes)), predicate(pruning, index.table())


def local_moving(
    edges: DataFrame, membership: DataFrame, nodes: DataFrame, r: float | None, test, policy: str = "active", gamma: float = 1.0,
    feasibility_cache: bool = False, max_rounds: int | None = None, within: DataFrame | None = None, level: int = 0, log: list[dict] | None = None,
    choice: str = "best", most: int | None = None, blocks: bool = False, rise: float = 0.0, finish: bool = True,
) -> tuple[DataFrame, int]:
    """(assign, moves) once no move is left, or after max_rounds.

    feasibility_cache keeps pairs (u, c) found infeasible as long as c gains or loses
    no member.  within, a table (h, parent), forbids moves between different parents.
    choice: the ``best`` move of a hypernode, the ``first`` improving one, or one drawn
    by its gain (``weighted``).  blocks: move within blocks first, one task each (see
    plans/blocks.py); its moves count as round -1.  Rounds follow where there are several
    blocks; within parents, which blocks do not divide, max_rounds bounds the sweeps of a block.
    most: moves of one community looked at in a round, 1,000, or 16 where they have to be
    checked against each other.  rise: the least rise in modularity that counts.  finish: False
    leaves it, where blocks have moved something, to the next level to go on.
    """
    most = most or (1000 if r is None else 16)
    hypers = membership.select("h").distinct()
    size = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("m")).first()
    m = int(size["m"])
    degree = cut(G.degrees(hypers.withColumnRenamed("h", "id"), edges).select(F.col("id").alias("h"), F.col("degree").alias("k")))
    total, number, assign = 0, 0, None
    if blocks and m:
        count = block_count(size["n"], nodes, r)
        passes = 1 if count == 1 or within is not None else count + 2
        for seed in range(passes):
            began = time.time()
            settled = cut(moved_in_blocks(edges, membership, nodes, degree, assign, m, r, test, gamma, M.least_gain(m, gamma, rise), choice, count, seed, within, max_rounds, finish))
            sums = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("attempts", "blocked", "distances")]
            figures = settled.agg(*sums, F.coalesce(F.sum("made"), F.lit(0)).alias("moves"), F.count("*").alias("n")).first().asDict()
            n = figures.pop("n")
            discard(assign)
            assign = settled
            total += figures["moves"]
            if log is not None:
                log.append({"level": level, "round": -1} | figures | {"seconds": time.time() - began})
            if figures["moves"] * 1000 < n:
                break
        if within is not None or (total if not finish else count == 1) or (count == 1 and not total):  # else moves may be left between blocks
            discard(degree)
            return assign.select("h", "c"), total
    assign = cut(hypers.select("h", F.col("h").alias("c"), F.lit(False).alias("moved"))) if assign is None else assign
    adj = G.adjacency(edges) if "flag" not in edges.columns else edges.select("u", "v", "w", "flag").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "flag"))
    if within is not None:
        a, b = within.select(F.col("h").alias("u"), F.col("parent").alias("pu")), within.select(F.col("h").alias("v"), F.col("parent").alias("pv"))
        adj = adj.join(a, "u").join(b, "v").where("pu = pv").drop("pu", "pv")
    adj = cut(adj)
    active, known = None, None
    while m and (max_rounds is None or number < max_rounds):
        began = time.time()
        now = assign.select("h", "c")
        offers = M.proposals(adj, now, degree, m, gamma, active, rise)
        figures = {"attempts": 0, "blocked": 0, "distances": 0}
        tables = []
        if r is not None:
            if known is not None:
                offers = offers.join(known, ["u", "c"], "left_anti")
            offers = cut(offers)
            tried = cut(M.feasibility(offers, now, membership, nodes, r, test))
            tables += [offers, tried]
            bad = tried.where("bad").select("u", "c")
            figures = tried.agg(F.count("*").alias("attempts"), F.count_if("bad").alias("blocked"), F.coalesce(F.sum("exact"), F.lit(0)).alias("distances")).first().asDict()
            if feasibility_cache:
                known = bad if known is None else known.union(bad)
            offers = offers.join(bad, ["u", "c"], "left_anti")
        chosen = M.weighted(offers, m, number) if choice == "weighted" else M.first_improving(offers, number) if choice == "first" else M.best(offers)
        chosen = cut(chosen)
        accepted = M.accept(chosen, adj, most)
        tables.append(chosen)
        if r is not None:
            accepted = cut(accepted)
            tables.append(accepted)
            if not accepted.where("place > 1").isEmpty():
                accepted = accepted.join(M.clashing(accepted, membership, nodes, r, test), "u", "left_anti")
        after = cut(M.apply(now, accepted))
        moved = after.where("moved").count()
        if log is not None:
            log.append({"level": level, "round": number} | figures | {"moves": moved, "seconds": time.time() - began})
        number += 1
        if not moved:
            if active is None:
                break
            active = None  # the queue has run dry: one look at all nodes ends the level, or finds more
            continue
        total += moved
        old, assign = (assign, active, known), after
        if policy == "active" or known is not None:
            changed = assign.where("moved").select(F.col("h"), F.col("c")).join(now.select("h", F.col("c").alias("s")), "h")
            touched = cut(changed.select(F.explode(F.array("s", "c")).alias("c")).distinct())
            tables.append(touched)
        if policy == "active":
            # A community that changed opens or shuts moves for all its neighbours, not only the moved node's.
            inside = assign.join(touched, "c", "left_semi").select("h")
            near = adj.join(inside.withColumnRenamed("h", "v"), "v", "left_semi").select(F.col("u").alias("h"))
            active = cut(inside.union(near).distinct())
        if known is not None:
            known = cut(known.join(touched, "c", "left_anti"))
        discard(*tables, *old)
    discard(adj, degree)
    return assign.select("h", "c"), total


def in_one_block(
    edges: DataFrame, membership: DataFrame, nodes: DataFrame, r: float | None, test, gamma: float, choice: str, level: int, log: list[dict],
    rounds: int | None = None, levels: int | None = None, sweeps: int | None = None,
) -> DataFrame | None:
    """(h, c) at the end of the run, if the graph is one block and has edges, else None; log gets the figures of the levels."""
    size = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("m")).first()
    m = int(size["m"])
    if not m or block_count(size["n"], nodes, r) > 1:
        return None
    done = cut(whole_run(edges, membership, nodes, m, r, test, gamma, M.least_gain(m, gamma, RISE), choice, rounds, levels, sweeps))
    for x in done.where("log IS NOT NULL").first()["log"]:
        figures = {k: x[k] for k in ("attempts", "blocked", "distances")}
        log.append({"level": level + x["level"], "round": -1} | figures | {"moves": x["made"], "seconds": x["seconds"]})
    return done.select("h", "c")


def constrained_louvain(
    g: G.AttributedGraph, r: float | None, policy: str = "active", pruning: str = "none", edge_flags: bool = False, feasibility_cache: bool = False,
    gamma: float = 1.0, pivots: int = 16, index: PivotIndex | None = None, max_rounds: int | None = None, max_levels: int | None = None, choice: str = "best", blocks: bool = True,
) -> Run:
    """A partition of high modularity in which no two nodes of a community lie farther apart than r (None: no constraint).

    Multi-edges are summed.  Nodes without edges stay alone.  policy: ``sweep`` looks at
    all hypernodes each round, ``active`` at those near the last moves.  edge_flags rules
    out communities by violated edges before any pair of nodes is looked at.  choice and blocks: see local_moving.
    """
    nodes, test = prepare(g, pruning if r is not None else "none", pivots, index)
    nodes = cut(nodes)
    base = cut(G.simple_edges(g.edges, loops=True))
    edges = cut(G.annotate(base, nodes, r)) if edge_flags and r is not None else base
    membership = cut(nodes.select(F.col("id").alias("h"), F.col("id").alias("node")))
    log: list[dict] = []
    level = 0
    while True:
        left = None if max_levels is None else max_levels - level
        if blocks and (whole := in_one_block(edges, membership, nodes, r, test, gamma, choice, level, log, max_rounds, left)) is not None:
            membership = C.relabel(membership, whole)
            break
        assign, moved = local_moving(edges, membership, nodes, r, test, policy, gamma, feasibility_cache, max_rounds, level=level, log=log, choice=choice, blocks=blocks, rise=RISE, finish=False)
        if not moved:
            break
        assign = cut(assign)
        edges, membership = cut(C.contract(edges, assign, r)), cut(C.relabel(membership, assign))
        level += 1
        if max_levels is not None and level >= max_levels:
            break
    final = cut(C.by_least_member(membership))
    return Run(final, modularity(base, final, gamma).first()["q"] or 0.0, log)


def run_code(g: G.AttributedGraph, code: int, r: float, pivots: int = 200) -> Run:
    """By the code of a command line; ValueError for codes that name no algorithm."""
    if code not in ALGORITHMS:
        raise ValueError(f"no algorithm {code}")
    return constrained_louvain(g, **({"r": r, "pivots": pivots} | ALGORITHMS[code]))
