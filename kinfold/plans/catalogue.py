"""The queries over graphs derived from the test tables, and DuckDB SQL for the same results.

parts: parts sold in one order, weighted by how often, with size and price as attributes.
users: users who act one after the other on a day, with counts of event types as attributes.
vectors: the five nearest neighbours of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.operators import contract as C
from kinfold.operators import graph as G
from kinfold.operators import index as I
from kinfold.operators import modularity as Q
from kinfold.operators import moves as M
from kinfold.operators import predicates as P
from kinfold.operators import profile as S
from kinfold.plans import leiden, louvain
from kinfold.sources import text as X
from kinfold.sources.storage import cut

TYPES = ("click", "error", "purchase", "signup", "view")
R2 = 40.5  # users' squared distances are whole numbers, so that none equals this
R = R2**0.5
PART_R = 50.0
GROUPS = 25


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> G.AttributedGraph:
    nodes = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("attrs"))
    line = _read(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    a, b = line.select("l_orderkey", F.col("l_partkey").alias("u")), line.select("l_orderkey", F.col("l_partkey").alias("v"))
    return G.AttributedGraph(nodes, a.join(b, "l_orderkey").where("u < v").groupBy("u", "v").agg(F.count("*").alias("w")))


def users(spark: SparkSession, sf: str) -> G.AttributedGraph:
    from pyspark.sql import Window

    e = _read(spark, sf, "events").where("user_id IS NOT NULL")
    counts = [F.count_if(F.col("event_type") == t).cast("double") for t in TYPES]
    nodes = e.groupBy(F.col("user_id").alias("id")).agg(F.array(*counts).alias("attrs"))
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    pairs = e.select(F.col("user_id").alias("a"), F.lead("user_id").over(day).alias("b")).where("a <> b")
    edges = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("w", F.lit(1).cast("long"))
    return G.AttributedGraph(nodes, edges)


def vectors(spark: SparkSession, sf: str) -> G.AttributedGraph:
    nodes = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_vector("embedding").alias("attrs"))
    return G.AttributedGraph(nodes, S.nearest_edges(nodes))


SQL_PARTS = """pn AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS attrs FROM part),
pe AS (SELECT a.l_partkey AS u, b.l_partkey AS v, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"""
SQL_USERS = """un AS (SELECT user_id AS id, [{counts}] AS attrs FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
ul AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS b FROM events WHERE user_id IS NOT NULL),
ue AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, 1::BIGINT AS w FROM ul WHERE a <> b)""".format(
    counts=", ".join(f"(count(*) FILTER (event_type = '{t}'))::DOUBLE" for t in TYPES)
)
SQL_VECTORS = """vn AS (SELECT vec_id AS id, embedding::DOUBLE[] AS attrs FROM embeddings),
vp AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.attrs, b.attrs) ** 2, 9), b.id) AS k FROM vn a JOIN vn b ON a.id <> b.id),
ve AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, 1::BIGINT AS w FROM vp WHERE k <= 5)"""


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _stats_sql(nodes: str) -> str:
    return f"""ns AS (SELECT id, attrs, list_sum(list_transform(attrs, lambda x: x * x)) AS attr_sqr, list_sum(list_transform(attrs, lambda x: abs(x))) AS abs_sum,
  list_max(list_transform(attrs, lambda x: abs(x))) AS abs_max, list_min(list_transform(attrs, lambda x: abs(x))) AS abs_min, len(list_filter(attrs, lambda x: x < 0)) > 0 AS negative FROM {nodes})"""


def _grouped(g: G.AttributedGraph) -> DataFrame:
    """A given partition: ids by their remainder."""
    return g.nodes.select(F.col("id").alias("h"), (F.col("id") % GROUPS).alias("c"))


def _partition(g: G.AttributedGraph) -> DataFrame:
    return _grouped(g).withColumnRenamed("h", "node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


STATS = ("attr_sqr", "abs_sum", "abs_max", "abs_min")
_STATS_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in STATS)


@query("node_stats", f"WITH {SQL_PARTS}, {_stats_sql('pn')} SELECT id, {_STATS_OUT}, negative FROM ns")
def node_stats(spark, sf):
    return _rounded(G.node_stats(parts(spark, sf).nodes).drop("attrs"), *STATS)


@query("node_stats_signed", f"WITH vn AS (SELECT vec_id AS id, embedding::DOUBLE[] AS attrs FROM embeddings), {_stats_sql('vn')} SELECT id, {_STATS_OUT}, negative FROM ns")
def node_stats_signed(spark, sf):
    nodes = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_vector("embedding").alias("attrs"))
    return _rounded(G.node_stats(nodes).drop("attrs"), *STATS)


#: Raw edges with loops and repeats: parts on lines of one order next to each other.
SQL_RAW = "raw AS (SELECT a.l_partkey AS u, b.l_partkey AS v, 1::BIGINT AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber)"


def raw_edges(spark, sf):
    line = _read(spark, sf, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("u"))
    b = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("v"))
    return a.join(b, ["l_orderkey", "n"]).select("u", "v", F.lit(1).cast("long").alias("w"))


@query("graph_validate", f"""WITH {SQL_PARTS}, {SQL_RAW},
x AS (SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS k FROM raw GROUP BY ALL)
SELECT (SELECT count(*) FROM pn) AS n_nodes, (SELECT min(len(attrs)) FROM pn)::INT AS min_dim, (SELECT max(len(attrs)) FROM pn)::INT AS max_dim, 0::BIGINT AS empty_nodes,
(SELECT count(*) FROM (SELECT u AS id FROM raw UNION ALL SELECT v FROM raw) WHERE id NOT IN (SELECT id FROM pn)) AS dangling_ends,
(SELECT sum(k) FROM x)::BIGINT AS n_edges, (SELECT coalesce(sum(k), 0) FROM x WHERE a = b)::BIGINT AS self_loops, (SELECT count(*) FROM x WHERE k > 1) AS multi_edges, 0::BIGINT AS malformed""")
def graph_validate(spark, sf):
    return G.validate(G.AttributedGraph(parts(spark, sf).nodes, raw_edges(spark, sf)))


@query("edge_dedup_no_loops", f"WITH {SQL_RAW} SELECT least(u, v) AS u, greatest(u, v) AS v, sum(w)::BIGINT AS w FROM raw WHERE u <> v GROUP BY ALL")
def edge_dedup_no_loops(spark, sf):
    return G.simple_edges(raw_edges(spark, sf))


@query("adjacency", f"WITH {SQL_PARTS} SELECT u, v, w FROM pe UNION ALL SELECT v, u, w FROM pe")
def adjacency(spark, sf):
    return G.adjacency(parts(spark, sf).edges)


@query("degrees", f"WITH {SQL_PARTS}, e AS (SELECT u AS id, w FROM pe UNION ALL SELECT v, w FROM pe) SELECT id, coalesce(sum(w), 0)::BIGINT AS degree FROM pn LEFT JOIN e USING (id) GROUP BY id")
def degrees(spark, sf):
    g = parts(spark, sf)
    return G.degrees(g.nodes, g.edges)


_ENDS = "FROM {e} e JOIN {n} a ON e.u = a.id JOIN {n} b ON e.v = b.id"


@query("edge_distance", f"WITH {SQL_PARTS} SELECT u, v, w, round({_d2('a.attrs', 'b.attrs')}, 6) AS d2 {_ENDS.format(e='pe', n='pn')}")
def edge_distance(spark, sf):
    g = parts(spark, sf)
    return _rounded(G.annotate(g.edges, g.nodes, PART_R).drop("flag"), "d2")


_UFLAG = f"uf AS (SELECT u, v, w, {_d2('a.attrs', 'b.attrs')} AS d2, CASE WHEN {_d2('a.attrs', 'b.attrs')} > {R2} THEN 'violated' ELSE 'satisfied' END AS flag {_ENDS.format(e='ue', n='un')})"


@query("edge_flags", f"WITH {SQL_USERS}, {_UFLAG} SELECT u, v, w, d2, flag FROM uf")
def edge_flags(spark, sf):
    g = users(spark, sf)
    return G.annotate(g.edges, g.nodes, R).select("u", "v", "w", "d2", "flag")


_UPAIRS = f"up AS (SELECT a.id % {GROUPS} AS c, a.id AS i, b.id AS j, a.attrs AS x, b.attrs AS y FROM un a JOIN un b ON a.id % {GROUPS} = b.id % {GROUPS} AND a.id < b.id)"


@query("pair_distance", f"WITH {SQL_USERS}, {_UPAIRS} SELECT c, i, j, {_d2('x', 'y')} AS d2 FROM up")
def pair_distance(spark, sf):
    g = users(spark, sf)
    return Q.inner_pairs(_partition(g), g.nodes, ["attrs"]).select("c", "i", "j", V.sq_dist(F.col("a.attrs"), F.col("b.attrs")).alias("d2"))


@query("distance_percentiles", f"""WITH {SQL_PARTS}, d AS (SELECT sqrt({_d2('a.attrs', 'b.attrs')}) AS d {_ENDS.format(e='pe', n='pn')})
SELECT p::INT AS p, round(d, 6) AS d FROM (SELECT unnest([20, 40, 60, 80]) AS p, unnest(quantile_cont(d, [0.2, 0.4, 0.6, 0.8])) AS d FROM d)""")
def distance_percentiles(spark, sf):
    g = parts(spark, sf)
    return _rounded(S.distance_percentiles(S.edge_distances(g.edges, g.nodes)), "d")


@query("avg_pair_distance", f"WITH {SQL_USERS} SELECT round(avg({_d2('a.attrs', 'b.attrs')}), 6) AS mean_d2 FROM un a JOIN un b ON a.id < b.id")
def avg_pair_distance(spark, sf):
    return _rounded(Q.mean_pair_distance(users(spark, sf).nodes), "mean_d2")


# One round of moves from the given partition.

def _round_sql(graph: str, prefix: str, flagged: bool = False) -> str:
    e = f"{prefix}f" if flagged else f"{prefix}e"
    more = ", flag" if flagged else ""
    bad = "bool_or(flag = 'violated')" if flagged else "false"
    return f"""{graph}, adj AS (SELECT u, v, w{more} FROM {e} UNION ALL SELECT v, u, w{more} FROM {e} WHERE u <> v),
asg AS (SELECT id AS h, id % {GROUPS} AS c FROM {prefix}n),
deg AS (SELECT h, coalesce(sum(w), 0)::BIGINT AS k FROM asg LEFT JOIN adj ON h = u GROUP BY h), m AS (SELECT sum(w)::BIGINT AS m FROM {e}),
sums AS (SELECT c, sum(k)::BIGINT AS s FROM asg JOIN deg USING (h) GROUP BY c),
kuc AS (SELECT u, c, sum(w)::BIGINT AS w, {bad} AS violated FROM adj JOIN asg ON v = h WHERE u <> v GROUP BY ALL),
own AS (SELECT h AS u, asg.c AS s, k, sums.s AS s_own FROM asg JOIN deg USING (h) JOIN sums USING (c)),
offers AS (SELECT * FROM (SELECT k.u, o.s, k.c, 2 * m * (k.w - coalesce(x.w, 0)) - o.k * (t.s - o.s_own + o.k) AS gain, o.k
  FROM kuc k JOIN own o ON k.u = o.u LEFT JOIN kuc x ON x.u = o.u AND x.c = o.s JOIN sums t ON t.c = k.c, m WHERE k.c <> o.s AND NOT k.violated) WHERE gain >= 1)"""


def _accept_sql(best: str, n: str = "", most: int = 1000) -> str:
    """The moves of a table best that are accepted, as taken; n marks the names of one round."""
    over = "PARTITION BY {} ORDER BY gain DESC, u"
    return f"""crossed{n} AS (SELECT x.u FROM {best} x JOIN adj e ON e.u = x.u JOIN {best} y ON e.v = y.u WHERE (x.c = y.s OR x.s = y.c) AND (y.gain > x.gain OR y.gain = x.gain AND y.u < x.u)),
cand{n} AS (SELECT * FROM {best} ANTI JOIN crossed{n} USING (u)),
outs{n} AS (SELECT *, row_number() OVER ({over.format('s')}) AS rs, sum(k) OVER ({over.format('s')} ROWS UNBOUNDED PRECEDING) - k AS bs FROM cand{n}),
ins{n} AS (SELECT *, row_number() OVER ({over.format('c')}) AS place, sum(k) OVER ({over.format('c')} ROWS UNBOUNDED PRECEDING) - k AS bc FROM outs{n} WHERE rs <= {most}),
taken{n} AS (SELECT u, s, c, gain, k, place FROM ins{n} WHERE place <= {most} AND 2 * k * bs <= gain AND 2 * k * bc <= gain)"""


def _chosen_sql(offers: str) -> str:
    return f"best AS (SELECT u, s, c, gain, k FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY gain DESC, c DESC) AS n FROM {offers}) WHERE n = 1), {_accept_sql('best')}"


_PROUND, _UROUND = _round_sql(SQL_PARTS, "p"), _round_sql(f"{SQL_USERS}, {_UFLAG}", "u", True)
_UBAD = f"""bad AS (SELECT DISTINCT o.u, o.c FROM offers o JOIN un a ON a.id = o.u JOIN un b ON b.id % {GROUPS} = o.c WHERE {_d2('a.attrs', 'b.attrs')} > {R2}),
feas AS (SELECT o.* FROM offers o ANTI JOIN bad USING (u, c))"""


def _setting(g: G.AttributedGraph, r: float | None = None):
    edges = G.annotate(g.edges, g.nodes, r) if r else g.edges
    adj = edges.select("u", "v", "w", "flag").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "flag")) if r else G.adjacency(edges)
    degree = G.degrees(g.nodes, edges).select(F.col("id").alias("h"), F.col("degree").alias("k"))
    return adj, _grouped(g), degree


def _offers(g: G.AttributedGraph, r: float | None = None) -> DataFrame:
    adj, assign, degree = _setting(g, r)
    return M.proposals(adj, assign, degree, G.total_weight(g.edges))


def _feasible(g: G.AttributedGraph) -> DataFrame:
    offers = cut(_offers(g, R))
    membership = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    return offers.join(M.infeasible(offers, _grouped(g), membership, g.nodes, R, P.predicate("none")), ["u", "c"], "left_anti").select("u", "s", "c", "gain", "k")


@query("neighbor_comm_weight", f"WITH {_PROUND} SELECT u, c, w FROM kuc")
def neighbor_comm_weight(spark, sf):
    adj, assign, _ = _setting(parts(spark, sf))
    return M.neighbour_weights(adj, assign).drop("violated")


@query("neighbor_comm_flagged", f"WITH {_UROUND} SELECT u, c, w, violated FROM kuc")
def neighbor_comm_flagged(spark, sf):
    adj, assign, _ = _setting(users(spark, sf), R)
    return M.neighbour_weights(adj, assign)


@query("community_degree_sum", f"WITH {_PROUND} SELECT c, s FROM sums")
def community_degree_sum(spark, sf):
    _, assign, degree = _setting(parts(spark, sf))
    return M.community_degrees(assign, degree)


@query("move_gain", f"WITH {_PROUND} SELECT u, s, c, gain::BIGINT AS gain FROM offers")
def move_gain(spark, sf):
    return _offers(parts(spark, sf)).drop("k")


@query("best_move_unconstrained", f"WITH {_PROUND}, {_chosen_sql('offers')} SELECT u, s, c, gain::BIGINT AS gain FROM best")
def best_move_unconstrained(spark, sf):
    return M.best(_offers(parts(spark, sf))).drop("k")


@query("accept_moves", f"WITH {_PROUND}, {_chosen_sql('offers')} SELECT u, s, c, gain::BIGINT AS gain, place FROM taken")
def accept_moves(spark, sf):
    g = parts(spark, sf)
    return M.accept(cut(M.best(_offers(g))), G.adjacency(g.edges)).drop("k")


@query("shifted_weights", f"""WITH {_PROUND}, {_chosen_sql('offers')}, after AS (SELECT h, coalesce(t.c, a.c) AS c FROM asg a LEFT JOIN taken t ON a.h = t.u)
SELECT u, c, sum(w)::BIGINT AS w FROM adj JOIN after ON v = h WHERE u <> v GROUP BY ALL""")
def shifted_weights(spark, sf):
    """Weights to communities after a round, from those before it and the moves alone."""
    g = parts(spark, sf)
    adj, assign, _ = _setting(g)
    return M.shifted_weights(M.neighbour_weights(adj, assign), adj, cut(M.accept(cut(M.best(_offers(g))), adj)))


@query("apply_moves", f"WITH {_PROUND}, {_chosen_sql('offers')} SELECT h, coalesce(t.c, a.c) AS c, t.c IS NOT NULL AS moved FROM asg a LEFT JOIN taken t ON a.h = t.u")
def apply_moves(spark, sf):
    g = parts(spark, sf)
    return M.apply(_grouped(g), M.accept(cut(M.best(_offers(g))), G.adjacency(g.edges)))


@query("next_active_set", f"""WITH {_PROUND}, {_chosen_sql('offers')} SELECT u AS h FROM taken UNION SELECT a.u FROM adj a JOIN taken t ON a.v = t.u""")
def next_active_set(spark, sf):
    g = parts(spark, sf)
    return M.next_active(cut(M.apply(_grouped(g), M.accept(cut(M.best(_offers(g))), G.adjacency(g.edges)))), G.adjacency(g.edges))


@query("feasible_moves", f"WITH {_UROUND}, {_UBAD} SELECT u, s, c, gain::BIGINT AS gain FROM feas")
def feasible_moves(spark, sf):
    return _feasible(users(spark, sf)).drop("k")


@query("best_move_constrained", f"WITH {_UROUND}, {_UBAD}, {_chosen_sql('feas')} SELECT u, s, c, gain::BIGINT AS gain FROM best")
def best_move_constrained(spark, sf):
    return M.best(_feasible(users(spark, sf))).drop("k")


@query("move_statistics", f"""WITH {_UROUND}, {_UBAD}, {_chosen_sql('feas')}
SELECT (SELECT count(*) FROM offers) AS attempts, (SELECT count(*) FROM bad) AS distance_failed, (SELECT count(*) FROM taken) AS moves""")
def move_statistics(spark, sf):
    g = users(spark, sf)
    offers = cut(_offers(g, R))
    membership = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    bad = cut(M.infeasible(offers, _grouped(g), membership, g.nodes, R, P.predicate("none")))
    return M.statistics(offers, bad, M.accept(cut(M.best(offers.join(bad, ["u", "c"], "left_anti"))), G.adjacency(g.edges)))


# Contraction.

@query("contract", f"WITH {SQL_PARTS} SELECT least(u % {GROUPS}, v % {GROUPS}) AS u, greatest(u % {GROUPS}, v % {GROUPS}) AS v, sum(w)::BIGINT AS w FROM pe GROUP BY ALL")
def contract(spark, sf):
    g = parts(spark, sf)
    return C.contract(g.edges, _grouped(g))


@query("contract_flags", f"""WITH {SQL_USERS}, {_UFLAG} SELECT least(u % {GROUPS}, v % {GROUPS}) AS u, greatest(u % {GROUPS}, v % {GROUPS}) AS v, sum(w)::BIGINT AS w, max(d2) AS d2,
CASE WHEN bool_or(flag = 'violated') THEN 'violated' ELSE 'satisfied' END AS flag FROM uf GROUP BY 1, 2""")
def contract_flags(spark, sf):
    g = users(spark, sf)
    return C.contract(G.annotate(g.edges, g.nodes, R), _grouped(g), R)


@query("membership_relabel", f"WITH {SQL_PARTS} SELECT min(id) OVER (PARTITION BY id % {GROUPS}) AS c, id AS node FROM pn")
def membership_relabel(spark, sf):
    g = parts(spark, sf)
    singles = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    return C.by_least_member(C.relabel(singles, _grouped(g)))


@query("dense_numbers", f"WITH {SQL_PARTS} SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS number FROM (SELECT DISTINCT id * 3 % 1009 AS c FROM pn)")
def dense_numbers(spark, sf):
    return C.dense_numbers(parts(spark, sf).nodes.select((F.col("id") * 3 % 1009).alias("c")))


@query("partition_dump", f"WITH {SQL_PARTS} SELECT id % {GROUPS} AS c, string_agg(id::VARCHAR, ' ' ORDER BY id) AS members FROM pn GROUP BY 1")
def partition_dump(spark, sf):
    return X.dump(_partition(parts(spark, sf))).select("c", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


# Scores and audits.

def _q_sql(gamma: float) -> str:
    return f"""WITH {SQL_PARTS}, e AS (SELECT u % {GROUPS} AS a, v % {GROUPS} AS b, w FROM pe), t AS (SELECT 2.0 * sum(w) AS m2 FROM e),
s AS (SELECT c, sum(w) AS s FROM (SELECT a AS c, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY c)
SELECT round((SELECT 2.0 * sum(w) FROM e WHERE a = b) / m2 - {gamma} * (SELECT sum(s::DOUBLE * s) FROM s) / (m2 * m2), 6) AS q FROM t"""


@query("modularity", _q_sql(1.0))
def modularity(spark, sf):
    g = parts(spark, sf)
    return _rounded(Q.modularity(g.edges, _partition(g)), "q")


@query("modularity_gamma", _q_sql(0.7))
def modularity_gamma(spark, sf):
    g = parts(spark, sf)
    return _rounded(Q.modularity(g.edges, _partition(g), 0.7), "q")


@query("constraint_audit", f"WITH {SQL_USERS}, {_UPAIRS} SELECT c, count(*) AS pairs, count(*) FILTER ({_d2('x', 'y')} > {R2}) AS violations FROM up GROUP BY c")
def constraint_audit(spark, sf):
    g = users(spark, sf)
    return Q.audit(_partition(g), g.nodes, R)


@query("community_diameter", f"""WITH {SQL_USERS}, {_UPAIRS}, d AS (SELECT c, sqrt(max({_d2('x', 'y')})) AS d FROM up GROUP BY c)
SELECT c, count(*) AS size, round(coalesce(max(d), 0), 6) AS diameter FROM (SELECT id % {GROUPS} AS c FROM un) LEFT JOIN d USING (c) GROUP BY c""")
def community_diameter(spark, sf):
    g = users(spark, sf)
    return _rounded(Q.diameters(_partition(g), g.nodes), "diameter")


# Pair predicates; the pivots are fixed vectors, as bounds hold for any.

PIVOTS = [[2.0, 1.0, 3.0, 0.0, 9.0], [20.0, 12.0, 11.0, 9.0, 40.0], [12.0, 13.0, 15.0, 14.0, 12.0], [70.0, 60.0, 75.0, 66.0, 71.0]]
_INDEX = I.PivotIndex(PIVOTS)


@query("stat_bounds", f"""WITH {SQL_USERS}, {_stats_sql('un')} SELECT u, v,
round(a.attr_sqr + b.attr_sqr - 2 * least(a.abs_sum * b.abs_max, b.abs_sum * a.abs_max), 6) AS lo, round(a.attr_sqr + b.attr_sqr - 2 * greatest(a.abs_sum * b.abs_min, b.abs_sum * a.abs_min), 6) AS hi {_ENDS.format(e='ue', n='ns')}""")
def stat_bounds(spark, sf):
    g = users(spark, sf).with_stats()
    lo, hi = P.stat_bounds(F.col("a"), F.col("b"))
    return _rounded(G.ends_of(g.edges, g.nodes, list(P.predicate("stat").columns)).select("u", "v", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


_EXACT = f"WITH {SQL_USERS} SELECT u, v, {_d2('a.attrs', 'b.attrs')} > {R2} AS violates {_ENDS.format(e='ue', n='un')}"


def _predicate_query(kind: str) -> None:
    @query(f"pred_{kind}", _EXACT)
    def run(spark, sf):
        g = users(spark, sf).with_stats()
        test = P.predicate(kind, _INDEX.table() if kind not in ("none", "stat") else None)
        nodes = _INDEX.attach(g.nodes) if kind not in ("none", "stat") else g.nodes
        return G.ends_of(g.edges, nodes, test.columns).select("u", "v", test(F.col("a"), F.col("b"), R2).alias("violates"))


for _kind in ("none", "stat", "bipolar", "triangle", "centroid", "hybrid", "triangle_hybrid", "both"):
    _predicate_query(_kind)


@query("pruning_rate")
def pruning_rate(spark, sf):
    """For each predicate the pairs it was asked about, and those it left to an exact distance."""
    g = users(spark, sf).with_stats()
    ends = G.ends_of(g.edges, _INDEX.attach(g.nodes), ["attrs", *STATS, "negative", "pivot", "d2s"])
    kinds = ("stat", "bipolar", "triangle", "hybrid", "triangle_hybrid")
    open_ = [F.count_if(P.predicate(k, _INDEX.table()).decided(F.col("a"), F.col("b"), R2).isNull()).alias(k) for k in kinds]
    wide = ends.agg(F.count("*").alias("pairs"), *open_)
    return wide.select("pairs", F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("predicate", "exact"))


# Pivot indexes.

@query("pred_hybrid_kmeans", _EXACT)
def pred_hybrid_kmeans(spark, sf):
    """The hybrid predicate by k-means pivots fitted on the table."""
    g = users(spark, sf).with_stats()
    g = G.AttributedGraph(cut(g.nodes), g.edges)
    index = I.PivotIndex.fit(g.nodes, 16)
    test = P.predicate("hybrid", index.table())
    return G.ends_of(g.edges, index.attach(g.nodes), test.columns).select("u", "v", test(F.col("a"), F.col("b"), R2).alias("violates"))


@query("kmeans_index")
def kmeans_index(spark, sf):
    """k-means pivots of projected vectors: the member nearest to each, the members, and the sum of their squared distances."""
    nodes = cut(_read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_vector("embedding").alias("attrs")))
    index = I.PivotIndex.fit(nodes, 16)
    return _rounded(I.medoids(index.attach(nodes), index), "cost")


_PIVOTS_SQL = "pv AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p}::DOUBLE[])" for i, p in enumerate(PIVOTS)) + ") t(piv, attrs))"
_NEAR = f"nearp AS (SELECT id, attrs, arg_min(piv, (d2, piv)) AS piv, min(d2) AS d2 FROM (SELECT n.id, n.attrs, p.piv, {_d2('n.attrs', 'p.attrs')} AS d2 FROM un n, pv p) GROUP BY id, attrs)"


@query("point_pivot", f"WITH {SQL_USERS}, {_PIVOTS_SQL}, {_NEAR} SELECT id, piv::INT AS \"pivot\", round(d2, 6) AS d2 FROM nearp")
def point_pivot(spark, sf):
    at = _INDEX.attach(users(spark, sf).nodes)
    return at.select("id", "pivot", F.round(F.get(F.col("d2s"), F.col("pivot")), 6).alias("d2"))


@query("pivot_pairs", f"WITH {_PIVOTS_SQL} SELECT a.piv::INT AS p, b.piv::INT AS q, round({_d2('a.attrs', 'b.attrs')}, 6) AS d2 FROM pv a, pv b")
def pivot_pairs(spark, sf):
    k = len(PIVOTS)
    return spark.createDataFrame([(i // k, i % k, d) for i, d in enumerate(_INDEX.table())], "p int, q int, d2 double")


@query("kmeans_lloyd_step", f"""WITH {SQL_USERS}, {_PIVOTS_SQL}, {_NEAR}, x AS (SELECT piv, i, avg(attrs[i]) AS x FROM nearp, unnest([1, 2, 3, 4, 5]) t(i) GROUP BY ALL)
SELECT p.piv::INT AS "pivot", (i - 1)::INT AS pos, round(coalesce(x, p.attrs[i]), 6) AS x FROM pv p CROSS JOIN unnest([1, 2, 3, 4, 5]) t(i) LEFT JOIN x USING (piv, i)""")
def kmeans_lloyd_step(spark, sf):
    new = I.lloyd_step(users(spark, sf).nodes, _INDEX)
    return _rounded(new.select("pivot", F.posexplode("centroid").alias("pos", "x")), "x")


JL = [[((i * 37 + j * 101) % 19 - 9) / 9.0 for j in range(5)] for i in range(3)]


@query("jl_projection", f"""WITH {SQL_USERS} SELECT id, {', '.join(f'round(list_sum(list_transform(list_zip(attrs, {row}::DOUBLE[]), lambda p: p[1] * p[2])), 6) AS y{i}' for i, row in enumerate(JL))} FROM un""")
def jl_projection(spark, sf):
    nodes = users(spark, sf).nodes.withColumn("y", V.project(F.col("attrs"), JL))
    return nodes.select("id", *[F.round(F.get("y", i), 6).alias(f"y{i}") for i in range(3)])


@query("top_degree_candidates", f"""WITH {SQL_PARTS}, e AS (SELECT u AS id, w FROM pe UNION ALL SELECT v, w FROM pe)
SELECT id, coalesce(sum(w), 0)::BIGINT AS degree FROM pn LEFT JOIN e USING (id) GROUP BY id ORDER BY degree DESC, id LIMIT 100""")
def top_degree_candidates(spark, sf):
    g = parts(spark, sf)
    return I.top_degree(G.degrees(g.nodes, g.edges), 100)


@query("cluster_medoids", f"""WITH {SQL_USERS}, {_PIVOTS_SQL}, {_NEAR} SELECT piv::INT AS "pivot", arg_min(id, (round(d2, 9), id)) AS medoid, count(*) AS size, round(sum(d2), 6) AS cost FROM nearp GROUP BY piv""")
def cluster_medoids(spark, sf):
    return _rounded(I.medoids(_INDEX.attach(users(spark, sf).nodes), _INDEX), "cost")


# Figures about datasets.

_NEARFAR = f"nf AS (SELECT a.id, sqrt(min({_d2('a.attrs', 'b.attrs')})) AS nearest, sqrt(max({_d2('a.attrs', 'b.attrs')})) AS farthest FROM vn a JOIN vn b ON a.id <> b.id GROUP BY a.id)"
_VN = "vn AS (SELECT vec_id AS id, embedding::DOUBLE[] AS attrs FROM embeddings)"


def _near_far(spark, sf):
    nodes = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_vector("embedding").alias("attrs"))
    return S.near_far(nodes, nodes)


@query("nn_far", f"WITH {_VN}, {_NEARFAR} SELECT id, round(nearest, 6) AS nearest, round(farthest, 6) AS farthest FROM nf")
def nn_far(spark, sf):
    return _rounded(_near_far(spark, sf), "nearest", "farthest")


@query("nn_histogram", f"""WITH {_VN}, {_NEARFAR}, e AS (SELECT min(round(nearest, 9)) AS a, max(round(nearest, 9)) AS b FROM nf),
k AS (SELECT least(floor((round(nearest, 9) - a) / ((b - a) / 20)), 19)::INT AS bin, count(*) AS n FROM nf, e GROUP BY 1)
SELECT r.bin::INT AS bin, round(a + r.bin * ((b - a) / 20), 6) AS lo, round(a + (r.bin + 1) * ((b - a) / 20), 6) AS hi, coalesce(n, 0)::BIGINT AS n FROM range(20) r(bin) CROSS JOIN e LEFT JOIN k USING (bin)""")
def nn_histogram(spark, sf):
    return _rounded(S.histogram(cut(_near_far(spark, sf).select(F.round("nearest", 9).alias("nearest"))), "nearest"), "lo", "hi")


@query("nn_summary", f"WITH {_VN}, {_NEARFAR} SELECT count(*) AS n, round(min(nearest), 6) AS lo, round(max(nearest), 6) AS hi, round(avg(nearest), 6) AS mean, round(stddev_pop(nearest), 6) AS std, round(median(nearest), 6) AS median FROM nf")
def nn_summary(spark, sf):
    return _rounded(S.summary(_near_far(spark, sf), "nearest"), "lo", "hi", "mean", "std", "median")


def _profile_sql(name: str, n: str, e: str) -> str:
    return f"""SELECT '{name}' AS dataset, (SELECT count(*) FROM {n}) AS n_nodes, (SELECT count(*) FROM {e}) AS n_edges, (SELECT max(len(attrs)) FROM {n})::BIGINT AS dims,
(SELECT sum(len(list_filter(attrs, lambda x: x < 0))) FROM {n})::BIGINT AS negative, (SELECT sum(len(list_filter(attrs, lambda x: x = 0))) FROM {n})::BIGINT AS zeros, (SELECT sum(len(attrs)) FROM {n})::BIGINT AS total"""


@query("dataset_profile", f"""WITH {SQL_PARTS}, {SQL_USERS}, a AS ({_profile_sql('parts', 'pn', 'pe')} UNION ALL {_profile_sql('users', 'un', 'ue')}),
b AS (SELECT * FROM a UNION ALL SELECT 'total', sum(n_nodes)::BIGINT, sum(n_edges)::BIGINT, max(dims), sum(negative)::BIGINT, sum(zeros)::BIGINT, sum(total)::BIGINT FROM a)
SELECT *, round(zeros / total, 6) AS sparsity FROM b""")
def dataset_profile(spark, sf):
    p, u = parts(spark, sf), users(spark, sf)
    return _rounded(S.dataset_profile({"parts": (p.nodes, p.edges), "users": (u.nodes, u.edges)}), "sparsity")


@query("sparsity", f"WITH {SQL_USERS} SELECT round(sum(len(list_filter(attrs, lambda x: x <> 0))) / sum(len(attrs)), 6) AS nonzero_ratio, sum(len(list_filter(attrs, lambda x: x <> 0))) / sum(len(attrs)) < 0.5 AS is_sparse FROM un")
def sparsity(spark, sf):
    return _rounded(S.sparsity(users(spark, sf).nodes), "nonzero_ratio")


_JLV = "[" + ", ".join(f"list_sum(list_transform(list_zip(attrs, {row}::DOUBLE[]), lambda p: p[1] * p[2]))" for row in JL) + "]"


@query("distortion", f"""WITH {SQL_USERS}, {_UPAIRS}, y AS (SELECT id, {_JLV} AS y FROM un),
d AS (SELECT sqrt({_d2('x', 'y')}) AS d, i, j FROM up), z AS (SELECT d, sqrt({_d2('a.y', 'b.y')}) AS p FROM d JOIN y a ON a.id = i JOIN y b ON b.id = j WHERE d > 0)
SELECT round(avg(abs(p - d) / d), 6) AS rel_mean, round(stddev_pop(abs(p - d) / d), 6) AS rel_std, round(avg(abs(p - d)), 6) AS mae, round(sqrt(avg((p - d) ** 2)), 6) AS rmse, round(corr(d, p), 6) AS pearson FROM z""")
def distortion(spark, sf):
    g = users(spark, sf)
    pairs = Q.inner_pairs(_partition(g), g.nodes.withColumn("y", V.project(F.col("attrs"), JL)), ["attrs", "y"])
    both = pairs.select(V.dist(F.col("a.attrs"), F.col("b.attrs")).alias("d"), V.dist(F.col("a.y"), F.col("b.y")).alias("p"))
    return _rounded(S.distortion(both), "rel_mean", "rel_std", "mae", "rmse", "pearson")


@query("explained_variance")
def explained_variance(spark, sf):
    nodes = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_vector("embedding").alias("attrs"))
    return S.explained_variance(nodes, 10)


@query("knn_edges", f"WITH {SQL_VECTORS} SELECT u, v, w FROM ve")
def knn_edges(spark, sf):
    return vectors(spark, sf).edges


@query("log_metrics", """SELECT run, round(-0.5 + run / 1000.0, 6) AS modularity, round(run / 10.0, 6) AS main_seconds, NULL::DOUBLE AS prep_seconds, round(run / 100.0, 6) AS load_seconds,
round(run / 5.0, 6) AS total_seconds, (run * 7)::DOUBLE AS distances FROM (SELECT DISTINCT o_custkey % 100 AS run FROM orders)""")
def log_metrics(spark, sf):
    """Logs of made-up runs, read back."""
    runs = _read(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("run")).distinct()
    num = lambda c: c.cast("decimal(12,6)").cast("string")
    run = F.col("run")
    lines = F.array(
        F.concat(F.lit("LoadGraph time: "), num(run / 100)), F.concat(F.lit("Main algorithm time: "), num(run / 10 + 1)), F.concat(F.lit("Main algorithm time: "), num(run / 10)), F.concat(F.lit("Total time cost: "), num(run / 5)),
        F.concat(F.lit("Total distance calculation: "), (run * 7).cast("string")), F.concat(F.lit("Modularity: "), num(run / 1000 - 0.5)), F.lit("Modularity: 0.9"), F.lit("done"),
    )
    return X.log_metrics(runs.select("run", F.posexplode(lines).alias("line", "value")))


@query("community_maxima", """SELECT run, run + 1 AS communities, round(0.5 + run, 6) AS largest, round(0.5 + run / 2.0, 6) AS mean, 0.5::DOUBLE AS smallest, round(0.5 + run, 6) AS global_max, round(run / 2.0 + 0.5, 6) AS average_max
FROM (SELECT DISTINCT o_custkey % 20 AS run FROM orders)""")
def community_maxima(spark, sf):
    """Logs of made-up runs that list the largest distances of their communities, read back."""
    runs = _read(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("run")).distinct()
    run = F.col("run")
    each = F.transform(F.sequence(F.lit(0).cast("long"), run), lambda i: F.concat(F.lit("Community "), i, F.lit(": 4 nodes, Max distance = "), (i + 0.5).cast("decimal(9,3)").cast("string")))
    ends = F.array(F.lit("Global maximum distance: 0.001"), F.concat(F.lit("Global maximum distance: "), (run + 0.5).cast("decimal(9,3)")), F.concat(F.lit("Average max distance per community: "), (run / 2 + 0.5).cast("decimal(9,3)")))
    return _rounded(X.community_maxima(runs.select("run", F.posexplode(F.concat(each, ends)).alias("line", "value"))), "largest", "mean", "global_max", "average_max")


# Whole runs.

def _communities(g: G.AttributedGraph, run: louvain.Run) -> DataFrame:
    """(c, size, diameter, w_in) of a run, with its modularity."""
    inside = Q.intra_weight(g.edges, run.membership)
    out = Q.diameters(run.membership, g.nodes).join(inside, "c", "left")
    return out.select("c", "size", F.round("diameter", 6).alias("diameter"), F.coalesce("w_in", F.lit(0)).cast("long").alias("w_in"), F.round(F.lit(run.q), 6).alias("q"))


def _held(g: G.AttributedGraph) -> G.AttributedGraph:
    return G.AttributedGraph(cut(g.nodes), cut(g.edges))


def _run_query(name: str, **settings) -> None:
    @query(name)
    def run(spark, sf):
        g = _held(users(spark, sf))
        if settings.get("pruning") in ("bipolar", "hybrid", "triangle_hybrid"):
            settings.setdefault("index", _INDEX)
        return _communities(g, louvain.constrained_louvain(g, **({"r": 2 * R} | settings)))


_run_query("louvain_pure", **louvain.ALGORITHMS[20])
_run_query("louvain_baseline", **louvain.ALGORITHMS[10])
_run_query("louvain_flm", **louvain.ALGORITHMS[11])
_run_query("louvain_heap_flm", **louvain.ALGORITHMS[9])
_run_query("louvain_heap", **louvain.ALGORITHMS[91])
_run_query("louvain_plus_plus", **louvain.ALGORITHMS[8])
_run_query("louvain_hybrid", **louvain.ALGORITHMS[14])
_run_query("louvain_triangle", **louvain.ALGORITHMS[15])
_run_query("louvain_bipolar", policy="active", pruning="bipolar", edge_flags=True)
_run_query("louvain_kmeans", policy="active", pruning="hybrid", edge_flags=True, pivots=16, index=None)
_run_query("louvain_gamma", r=None, gamma=0.7, policy="sweep")


@query("louvain_vectors")
def louvain_vectors(spark, sf):
    g = _held(vectors(spark, sf))
    return _communities(g, louvain.constrained_louvain(g, 1.4364, edge_flags=True))


@query("leiden_constrained")
def leiden_constrained(spark, sf):
    g = _held(users(spark, sf))
    return _communities(g, leiden.constrained_leiden(g, 2 * R))


WIDE2 = 162.5  # between the whole numbers that users' squared distances are
WIDE = WIDE2**0.5


def rounds_sql(n: int, rr: float | None = None) -> str:
    """n rounds from single nodes, written out one after the other; with a bound on squared distances, moves that break it are left out."""
    out = [f"{SQL_USERS}, adj AS (SELECT u, v, w FROM ue UNION ALL SELECT v, u, w FROM ue), m AS (SELECT sum(w)::BIGINT AS m FROM ue)",
           "deg AS (SELECT id AS h, coalesce(sum(w), 0)::BIGINT AS k FROM un LEFT JOIN adj ON id = u GROUP BY id)", "a0 AS (SELECT id AS h, id AS c FROM un)"]
    if rr:
        out.append(f"far AS (SELECT a.id AS i, b.id AS j FROM un a, un b WHERE {_d2('a.attrs', 'b.attrs')} > {rr})")
    for i in range(n):
        out += [
            f"s{i} AS (SELECT c, sum(k)::BIGINT AS s FROM a{i} JOIN deg USING (h) GROUP BY c)",
            f"k{i} AS (SELECT u, c, sum(w)::BIGINT AS w FROM adj JOIN a{i} ON v = h WHERE u <> v GROUP BY ALL)",
            f"w{i} AS (SELECT h AS u, a.c AS s, k, t.s AS so FROM a{i} a JOIN deg USING (h) JOIN s{i} t ON t.c = a.c)",
            f"o{i} AS (SELECT * FROM (SELECT k.u, o.s, k.c, 2 * m * (k.w - coalesce(x.w, 0)) - o.k * (t.s - o.so + o.k) AS gain, o.k FROM k{i} k JOIN w{i} o ON k.u = o.u LEFT JOIN k{i} x ON x.u = o.u AND x.c = o.s JOIN s{i} t ON t.c = k.c, m WHERE k.c <> o.s) WHERE gain >= 1)",
        ]
        if rr:
            out.append(f"p{i} AS (SELECT * FROM o{i} ANTI JOIN (SELECT DISTINCT o.u, o.c FROM o{i} o JOIN a{i} a ON a.c = o.c JOIN far f ON f.i = o.u AND f.j = a.h) USING (u, c))")
        out.append(f"b{i} AS (SELECT u, s, c, gain, k FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY gain DESC, c DESC) AS n FROM {'p' if rr else 'o'}{i}) WHERE n = 1)")
        out.append(_accept_sql(f"b{i}", str(i), 16 if rr else 1000))
        made = f"SELECT u, c FROM taken{i}"
        if rr:
            made += f" ANTI JOIN (SELECT x.u FROM taken{i} x JOIN taken{i} y ON x.c = y.c AND y.place < x.place JOIN far f ON f.i = x.u AND f.j = y.u) USING (u)"
        out.append(f"a{i + 1} AS (SELECT h, coalesce(t.c, a.c) AS c FROM a{i} a LEFT JOIN ({made}) t ON a.h = t.u)")
    return "WITH " + ", ".join(x.replace(" AS (", " AS MATERIALIZED (") for x in out) + f" SELECT h, c FROM a{n}"


@query("louvain_rounds_4", rounds_sql(4))
def louvain_rounds_4(spark, sf):
    g = _held(users(spark, sf))
    singles = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    return louvain.local_moving(g.edges, singles, g.nodes, None, None, "sweep", max_rounds=4)[0]


@query("louvain_rounds_constrained", rounds_sql(4, WIDE2))
def louvain_rounds_constrained(spark, sf):
    g = _held(users(spark, sf))
    singles = g.nodes.select(F.col("id").alias("h"), F.col("id").alias("node"))
    return louvain.local_moving(g.edges, singles, g.nodes, WIDE, P.predicate("none"), "sweep", max_rounds=4)[0]


@query("results_grid")
def results_grid(spark, sf):
    from kinfold.plans.experiment import vary_r

    return vary_r({"users": _held(users(spark, sf))})
