"""The four-node graph whose figures are worked out by hand, and properties on random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.operators import contract as C
from kinfold.operators import graph as G
from kinfold.operators import index as I
from kinfold.operators import modularity as Q
from kinfold.operators import moves as M
from kinfold.operators import predicates as P
from kinfold.plans import blocks, leiden, louvain
from kinfold.sources import text as X

NODES = [[1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [1, 4, 3, 5, 2], [2, 3, 4, 5, 1]]
EDGES = [(1, 2), (3, 0), (0, 1), (2, 3)]


def graph(spark, nodes=NODES, edges=EDGES):
    n = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(nodes)], "id long, attrs array<double>")
    e = spark.createDataFrame([(u, v, 1) for u, v in edges], "u long, v long, w long")
    return G.AttributedGraph(n, e)


def groups(membership):
    out = {}
    for r in membership.collect():
        out.setdefault(r["c"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_figures_of_the_small_graph(spark):
    g = graph(spark)
    G.check(g)
    s = G.node_stats(g.nodes).orderBy("id").collect()
    assert [(r.attr_sqr, r.abs_sum, r.abs_max, r.abs_min, r.negative) for r in s] == [(55.0, 15.0, 5.0, 1.0, False)] * 4
    assert [r.degree for r in G.degrees(g.nodes, g.edges).collect()] == [2] * 4
    flags = {(r.u, r.v): (r.d2, r.flag) for r in G.annotate(g.edges, g.nodes, 5.0).collect()}
    assert flags == {(1, 2): (26.0, "violated"), (3, 0): (20.0, "satisfied"), (0, 1): (40.0, "violated"), (2, 3): (4.0, "satisfied")}
    assert Q.mean_pair_distance(g.nodes).first()[0] == pytest.approx(124 / 6)
    part = lambda c: spark.createDataFrame(list(enumerate(c)), "node long, c long")
    for c, q in (([0, 1, 2, 3], -0.25), ([0, 1, 2, 2], -0.125), ([0, 1, 1, 0], 0.0), ([0, 0, 0, 0], 0.0)):
        assert Q.modularity(g.edges, part(c)).first()[0] == pytest.approx(q)


@pytest.mark.parametrize(("r", "want"), [(1.9, [[0], [1], [2], [3]]), (2.0, [[0], [1], [2, 3]]), (5.2, [[0, 3], [1, 2]])])
def test_louvain_on_the_small_graph(spark, r, want):
    for code in (8, 10, 91):
        run = louvain.run_code(graph(spark), code, r)
        assert groups(run.membership) in (want, [[0, 1], [2, 3]] if r > 6.4 else want)
    with pytest.raises(ValueError):
        louvain.run_code(graph(spark), 12, r)


def test_text_round_trip_and_validation(spark, tmp_path):
    (tmp_path / "nodes.txt").write_text("\n".join(" ".join(map(str, v)) for v in NODES) + "\n")
    (tmp_path / "edges.txt").write_text("1 2\n3 0 9\n0 1\n2 3\n")
    g = G.AttributedGraph.from_text(spark, str(tmp_path))
    G.check(g)
    assert [r.attrs for r in g.nodes.orderBy("id").collect()] == [[float(x) for x in v] for v in NODES]
    assert X.read_edges(spark, str(tmp_path / "edges.txt"), tolerant=True).count() == 3
    X.write_edges(g.edges, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0 1", "0 3", "1 2", "2 3"]
    (tmp_path / "nodes.txt").write_text("1 2\n\n3 4 5\n")
    (tmp_path / "edges.txt").write_text("0 0\n0 7\nx y\n")
    with pytest.raises(ValueError, match="empty_nodes.*dangling_ends.*self_loops.*malformed"):
        G.check(G.AttributedGraph.from_text(spark, str(tmp_path)))


def random_graph(seed, n=14, m=40, d=4, signed=True):
    rng = random.Random(seed)
    nodes = [[float(rng.randint(-4 if signed else 0, 5)) for _ in range(d)] for _ in range(n)]
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return nodes, edges


@pytest.mark.parametrize("signed", [True, False])
def test_predicates_agree_with_the_exact_one(spark, signed):
    nodes, edges = random_graph(3, signed=signed)
    g = graph(spark, nodes, list(itertools.combinations(range(len(nodes)), 2)))
    index = I.PivotIndex(nodes[:3])
    full = index.attach(G.node_stats(g.nodes))
    for rr in (0.0, 16.5, 30.0, 90.0):
        for kind in ("stat", "bipolar", "triangle", "centroid", "hybrid", "triangle_hybrid", "both"):
            test = P.predicate(kind, index.table())
            rows = G.ends_of(g.edges, full, list({*test.columns, "attrs", "pivot", "d2s"}))
            wrong = rows.where(test(F.col("a"), F.col("b"), rr) != (V.sq_dist(F.col("a.attrs"), F.col("b.attrs")) > rr))
            assert wrong.isEmpty(), (kind, rr)


def test_runs_keep_the_constraint(spark):
    nodes, edges = random_graph(5)
    g = graph(spark, nodes, edges)
    r = 6.1
    for code in (8, 10, 11):
        a = louvain.constrained_louvain(g, **({"r": r} | louvain.ALGORITHMS[code]))
        assert Q.audit(a.membership, g.nodes, r).where("violations > 0").isEmpty()
        assert a.q == pytest.approx(Q.modularity(g.edges, a.membership).first()[0])
        assert a.q > 0
        assert sum(x["distances"] for x in a.rounds) >= sum(x["blocked"] for x in a.rounds) * (code != 8)


@pytest.mark.parametrize("bound", [2_000_000, 60])
@pytest.mark.parametrize("r", [None, 6.1])
def test_blocks_and_rounds_leave_no_move(spark, monkeypatch, r, bound):
    """One block or several, or none: the constraint holds, the score is right, and no single move is left."""
    monkeypatch.setattr(blocks, "BLOCK", bound)
    nodes, edges = random_graph(21, n=30, m=120)
    g = graph(spark, nodes, edges)
    singles = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    test = P.predicate("none")
    for use in (True, False):
        log = []
        assign, moves = louvain.local_moving(g.edges, singles, g.nodes, r, test, blocks=use, log=log)
        assert moves >= sum(x["moves"] for x in log) > 0
        degree = G.degrees(g.nodes, g.edges).select(F.col("id").alias("h"), F.col("degree").alias("k"))
        left = M.proposals(G.adjacency(g.edges), assign, degree, len(edges))
        if r:
            assert Q.audit(assign.withColumnRenamed("h", "node"), g.nodes, r).where("violations > 0").isEmpty()
            left = left.join(M.infeasible(left, assign, singles, g.nodes, r, test), ["u", "c"], "left_anti")
        assert left.isEmpty()


@pytest.mark.parametrize("r", [None, 6.1])
def test_modularity_rises_with_every_round(spark, r):
    nodes, edges = random_graph(11, n=40, m=160)
    g = graph(spark, nodes, edges)
    singles = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    scores, joined = [], 0
    for rounds in range(5):
        assign, _ = louvain.local_moving(g.edges, singles, g.nodes, r, P.predicate("none"), "sweep", max_rounds=rounds)
        part = assign.select(F.col("h").alias("node"), "c")
        scores.append(Q.modularity(g.edges, part).first()[0])
        if r:
            assert Q.audit(part, g.nodes, r).where("violations > 0").isEmpty()
        joined = max(joined, part.groupBy("c").count().agg(F.max("count")).first()[0])
    assert scores == sorted(scores)
    assert scores[2] > scores[0]
    assert joined > 2


def test_weighted_choice_follows_the_gains(spark):
    moves = spark.range(4000).select(F.col("id").alias("u"), F.lit(0).alias("s"), F.explode(F.array(F.lit(1), F.lit(2))).alias("c"), F.lit(1).alias("k")).withColumn("gain", F.when(F.col("c") == 1, 4).otherwise(0))
    m = 1
    share = M.weighted(moves, m, 3).where("c = 1").count() / 4000
    want = 1 / (1 + 2.718281828 ** (-0.5 * 4 / 2))
    assert abs(share - want) < 0.03
    assert M.first_improving(moves).count() == 4000


def test_free_runs(spark):
    nodes, edges = random_graph(5)
    g = graph(spark, nodes, edges)
    r = 6.1
    free = louvain.constrained_louvain(g, None)
    wide = louvain.constrained_louvain(g, 1e6)
    assert groups(free.membership) == groups(wide.membership)
    assert leiden.constrained_leiden(g, r).q >= -1
    low = leiden.constrained_leiden(g, r)
    assert Q.audit(low.membership, g.nodes, r).where("violations > 0").isEmpty()


def test_edge_cases_of_runs(spark):
    alone = graph(spark, [[1.0], [2.0]], [])
    run = louvain.constrained_louvain(alone, 1.0)
    assert groups(run.membership) == [[0], [1]]
    assert run.q == 0
    twins = graph(spark, [[1.0], [1.0], [9.0]], [(0, 1), (1, 2)])
    assert groups(louvain.constrained_louvain(twins, 0.0).membership) == [[0, 1], [2]]
    triangles = graph(spark, [[0.0]] * 6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
    best = louvain.constrained_louvain(triangles, None)
    assert groups(best.membership) == [[0, 1, 2], [3, 4, 5]]
    assert best.q == pytest.approx(2 * (6 / 14 - 0.25))


def test_contraction_keeps_weight_degree_and_modularity(spark):
    nodes, edges = random_graph(8)
    g = graph(spark, nodes, edges)
    assign = g.nodes.select(F.col("id").alias("h"), (F.col("id") % 4).alias("c"))
    small = C.contract(g.edges, assign)
    assert G.total_weight(small) == G.total_weight(g.edges)
    hyper = spark.range(4)
    assert G.degrees(hyper, small).agg(F.sum("degree")).first()[0] == 2 * len(edges)
    q1 = Q.modularity(g.edges, assign.withColumnRenamed("h", "node")).first()[0]
    q2 = Q.modularity(small, hyper.select(F.col("id").alias("node"), F.col("id").alias("c"))).first()[0]
    assert q1 == pytest.approx(q2)


def test_index_round_trip(spark, tmp_path):
    nodes, _ = random_graph(2)
    g = graph(spark, nodes, [])
    index = I.PivotIndex.fit(g.nodes, 3)
    index.save(spark, str(tmp_path / "index"), g.nodes, max_iter=8)
    assert I.PivotIndex.load(spark, str(tmp_path / "index"), g.nodes) == index
    with pytest.raises(ValueError):
        I.PivotIndex.load(spark, str(tmp_path / "index"), g.nodes.limit(5))
    kept = I.PivotIndex.built(spark, str(tmp_path), "a/b c", g.nodes, 4, 5)
    assert I.PivotIndex.built(spark, str(tmp_path), "a/b c", g.nodes, 4, 5) == kept
    path = str(next(p for p in tmp_path.iterdir() if p.name.startswith("a_b_c_k4_")))
    for other in ({"max_iter": 6}, {"asked": 5}):
        with pytest.raises(ValueError):
            I.PivotIndex.load(spark, path, g.nodes, **other)
    moved = g.nodes.withColumn("attrs", F.transform("attrs", lambda x: x + 1))
    assert I.PivotIndex.built(spark, str(tmp_path), "a/b c", moved, 4, 5) != kept


def test_files_with_loops_and_numbers_from_one(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("1 2\n2 2\n\nx 3\n3 1\n")
    path = str(tmp_path / "edges.txt")
    assert {(r["u"], r["v"]) for r in X.read_edges(spark, path, tolerant=True, first=1).collect()} == {(0, 1), (1, 1), (2, 0)}
    assert X.remove_self_loops(spark, path, str(tmp_path / "clean")).first().asDict() == {"lines": 5, "self_loops": 1, "remaining": 0}


def test_logs_with_repeated_metrics(spark):
    lines = ["Main algorithm time: 2", "Modularity: 0.5", "Main algorithm time: 1", "Modularity: 0.75", "Community 3: 2 nodes, Max distance = 1.5", "Global maximum distance: 1.5"]
    logs = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)] + [(2, 0, "none")], "run int, line int, value string")
    got = {r["run"]: r for r in X.log_metrics(logs).collect()}
    assert (got[1]["main_seconds"], got[1]["modularity"], got[2]["modularity"]) == (1.0, 0.5, None)
    assert [tuple(r) for r in X.community_maxima(logs).collect()] == [(1, 1, 1.5, 1.5, 1.5, 1.5, None)]


def test_small_gains_of_heavy_graphs_are_moves(spark):
    """A gain of 1 where 2e-10 of the squared weight is 2: SQL has it, and so do the proposals."""
    edges = spark.createDataFrame([(0, 1, 100_000), (1, 2, 1)], "u long, v long, w long")
    assign = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "h long, c long")
    degree = G.degrees(spark.range(3), edges).select(F.col("id").alias("h"), F.col("degree").alias("k"))
    got = [tuple(r) for r in M.proposals(G.adjacency(edges), assign, degree, 100_001).collect()]
    assert got == [(2, 2, 0, 1, 1)]
    assert M.proposals(G.adjacency(edges), assign, degree, 100_001, rise=1e-10).isEmpty()


def test_a_run_of_one_block_needs_no_rounds_and_keeps_the_constraint(spark):
    nodes, edges = random_graph(5)
    g = graph(spark, nodes * 3, edges + [(a, a + 14) for a in range(28)])
    for settings in (louvain.ALGORITHMS[14], louvain.ALGORITHMS[20]):
        run = louvain.constrained_louvain(g, **({"r": 6.1, "index": I.PivotIndex(nodes[:3])} | settings))
        assert {x["round"] for x in run.rounds} == {-1}
        assert run.rounds[-1]["moves"] == 0 < run.rounds[0]["moves"]
        if settings.get("r", 1):
            assert Q.audit(run.membership, g.nodes, 6.1).where("violations > 0").isEmpty()
        far = {r["c"]: r["diameter"] for r in Q.diameters(run.membership, g.nodes).collect()}
        held = groups(run.membership)
        want = {c[0]: max(sum((x - y) ** 2 for x, y in zip((nodes * 3)[i], (nodes * 3)[j], strict=True)) ** 0.5 for i in c for j in c) for c in held}
        assert far == pytest.approx(want)
    parts = Q.farthest_candidates(spark.range(42).select(F.col("id").alias("node"), F.lit(0).alias("c")), g.nodes)
    assert parts.count() <= 14


@pytest.mark.parametrize("signed", [True, False])
def test_bounds_of_blocks_agree_with_exact_distances(spark, signed):
    import numpy as np

    nodes, _ = random_graph(3, signed=signed)
    index = I.PivotIndex(nodes[:3])
    x = index.attach(G.node_stats(graph(spark, nodes, []).nodes)).orderBy("id").toPandas()
    exact = ((np.array(nodes)[:, None] - np.array(nodes)) ** 2).sum(axis=2)
    for kind in ("none", "stat", "bipolar", "triangle", "centroid", "hybrid", "triangle_hybrid", "both"):
        test = P.predicate(kind, index.table())
        for rr in (0.0, 16.5, 30.0, 90.0):
            pairs = blocks.Pairs(x, test.steps, test.table, rr)
            for i, j in itertools.product(range(len(nodes)), repeat=2):
                assert (pairs.far(pairs.of[[i]], pairs.of[[j]]) >= 0) == (exact[i, j] > rr), (kind, rr, i, j)
            assert pairs.distances <= len(nodes) ** 2


def test_all_levels_in_one_task_keep_weight_constraint_and_score():
    """Louvain and Leiden inside a task: every hypernode stays, no pair is too far apart, the score is the one of the graph."""
    import numpy as np
    import pandas as pd

    nodes, edges = random_graph(21, n=40, m=160)
    degree, links = dict.fromkeys(range(len(nodes)), 0), {}
    for a, b in {(min(e[:2]), max(e[:2])) for e in edges if e[0] != e[1]}:
        for u, v in ((a, b), (b, a)):
            links.setdefault(u, {})[v] = (1, False)
            degree[u] += 1
    m = sum(degree.values()) // 2
    exact = ((np.array(nodes)[:, None] - np.array(nodes)) ** 2).sum(axis=2)
    for sweeps, rr, kept in itertools.product((None, 5), (16.5, 37.2), (8192, 0)):
        blocks_kept, blocks.KEPT = blocks.KEPT, kept
        pairs = blocks.Pairs(pd.DataFrame({"attrs": nodes}), [], None, rr)
        blocks.KEPT = blocks_kept
        held = {h: pairs.of[h : h + 1] for h in degree}
        found, log = blocks.all_levels(degree, links, held, pairs, m, 1.0, 1, "best", sweeps=sweeps)
        assert set(found) == set(degree)
        assert len({x[0] for x in log}) > 1
        assert log[0][4] > 0
        assert all(exact[i, j] <= rr for i in found for j in found if found[i] == found[j])
        alone, _, _ = blocks.contracted(found, degree, links, held)
        assert sum(alone.values()) == 2 * m
        assert blocks.quality(degree, links, found, m, 1.0) > blocks.quality(degree, links, {h: h for h in degree}, m, 1.0)


def test_the_grid_of_results_is_whole(spark, monkeypatch):
    from kinfold.plans import catalogue, experiment

    nodes, edges = random_graph(5)
    monkeypatch.setattr(catalogue, "users", lambda *a: graph(spark, nodes, edges))
    seen = []
    real = experiment.constrained_louvain
    monkeypatch.setattr(experiment, "constrained_louvain", lambda g, **k: seen.append(1) or real(g, **k))
    rows = catalogue.results_grid(spark, "").collect()
    assert {(r["algorithm"], r["percentile"]) for r in rows} == {(str(c), p) for c in louvain.ALGORITHMS for p in (20, 40, 60, 80)}
    assert len(rows) == 32 == len(seen) + 3
    free = {r["modularity"] for r in rows if r["algorithm"] == "20"}
    assert len(free) == 1
