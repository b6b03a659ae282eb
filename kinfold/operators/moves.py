"""One round of local moving: weights, gains, feasibility, choice, and moves that do not disturb each other.

Tables: adj (u, v, w) both directions, assign (h, c), degree (h, k),
membership (h, node) where hypernodes hold several nodes.
With weights that are whole numbers every gain is one too:
2m (k_uc - k_us) - k_u (S_c - S_s + k_u), which is 2 m^2 times the rise in modularity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.predicates import PairPredicate


def neighbour_weights(adj: DataFrame, assign: DataFrame) -> DataFrame:
    """(u, c, w, violated): weight from u to each community near it, itself left out; violated if one of those edges is.

    An edge table without flags counts as one without violations.
    """
    bad = F.bool_or(F.col("flag") == "violated") if "flag" in adj.columns else F.lit(False)
    near = adj.where("u <> v").join(assign.select(F.col("h").alias("v"), "c"), "v")
    return near.groupBy("u", "c").agg(F.sum("w").alias("w"), bad.alias("violated"))


def community_degrees(assign: DataFrame, degree: DataFrame) -> DataFrame:
    return assign.join(degree, "h").groupBy("c").agg(F.sum("k").alias("s"))


def gain(two_m: int, to: Column, own: Column, k: Column, s_to: Column, s_own: Column, gamma: float = 1.0) -> Column:
    if gamma == 1.0:
        return F.lit(two_m) * (to - own) - k * (s_to - s_own + k)
    return F.round(F.lit(float(two_m)) * (to - own) - F.lit(float(gamma)) * k * (s_to - s_own + k), 6)


def least_gain(m: int, gamma: float = 1.0, rise: float = 0.0) -> float:
    """The least gain that counts as one: whole gains have no rounding, others have to rise by 1e-10 at least."""
    return max(1.0, 2 * rise * m * m) if gamma == 1.0 else 2 * max(rise, 1e-10) * m * m


def proposals(adj: DataFrame, assign: DataFrame, degree: DataFrame, m: int, gamma: float = 1.0, active: DataFrame | None = None, rise: float = 0.0) -> DataFrame:
    """(u, s, c, gain, k): moves of u, of degree k, from community s to a neighbour's community c that raise modularity and break no edge.

    active, if given, holds the hypernodes (h) whose moves are looked at; rise is the least rise in modularity looked at.
    """
    if active is not None:
        adj = adj.join(active.select(F.col("h").alias("u")), "u", "left_semi")
    kuc = neighbour_weights(adj, assign)
    sums = community_degrees(assign, degree)
    own = assign.join(degree, "h").join(sums, "c").select(F.col("h").alias("u"), F.col("c").alias("s"), "k", F.col("s").alias("s_own"))
    rows = kuc.join(own, "u")
    # The weight to the own community travels with each row: no second aggregate, no join of its own.
    w_own = F.coalesce(F.max(F.when(F.col("c") == F.col("s"), F.col("w"))).over(Window.partitionBy("u")), F.lit(0))
    rows = rows.withColumn("w_own", w_own).where("c <> s AND NOT violated").join(sums.select("c", F.col("s").alias("s_to")), "c")
    rows = rows.withColumn("gain", gain(2 * m, F.col("w"), F.col("w_own"), F.col("k"), F.col("s_to"), F.col("s_own"), gamma))
    return rows.where(F.col("gain") >= least_gain(m, gamma, rise)).select("u", "s", "c", "gain", "k")


def feasibility(moves: DataFrame, assign: DataFrame, membership: DataFrame, nodes: DataFrame, r: float, test: PairPredicate) -> DataFrame:
    """(u, c, bad, exact) of each move: whether it would bring two nodes farther apart than r into one community, and the pairs that no bound decided.

    A move's pairs meet in a join and leave as one boolean; nothing is collected.
    """
    columns = F.struct(*test.columns)
    at = membership.join(nodes.select(F.col("id").alias("node"), columns.alias("x")), "node")
    left = at.select(F.col("h").alias("u"), F.col("x").alias("a"))
    right = at.join(assign, "h").select("c", F.col("x").alias("b"))
    pairs = moves.select("u", "c").join(left, "u").join(right, "c")
    a, b = F.col("a"), F.col("b")
    return pairs.groupBy("u", "c").agg(F.bool_or(test(a, b, r * r)).alias("bad"), F.count_if(test.decided(a, b, r * r).isNull()).alias("exact"))


def infeasible(moves: DataFrame, assign: DataFrame, membership: DataFrame, nodes: DataFrame, r: float, test: PairPredicate) -> DataFrame:
    """(u, c) of the moves that would bring two nodes farther apart than r into one community."""
    return feasibility(moves, assign, membership, nodes, r, test).where("bad").select("u", "c")


def best(moves: DataFrame) -> DataFrame:
    """Of each u the move of the largest gain, the larger community first among equals."""
    top = F.max(F.struct("gain", "c", "s", "k")).alias("t")
    return moves.groupBy("u").agg(top).select("u", "t.s", "t.c", "t.gain", "t.k")


def first_improving(moves: DataFrame, seed: int = 0) -> DataFrame:
    """Of each u one improving move, whichever comes first in an order of communities shuffled by seed, as a scan that stops at the first gain has it."""
    top = F.min(F.struct(F.xxhash64("u", "c", F.lit(seed)).alias("at"), "c", "s", "gain", "k")).alias("t")
    return moves.groupBy("u").agg(top).select("u", "t.s", "t.c", "t.gain", "t.k")


def weighted(moves: DataFrame, m: int, seed: int = 0, scale: float = 0.5) -> DataFrame:
    """Of each u one move, drawn with a chance in proportion to exp(scale times its rise in modularity).

    The largest of scaled rises, each with a Gumbel number added, is such a draw; the
    numbers come from hashes of u, c and seed, so that a run can be repeated.
    """
    uniform = (F.pmod(F.xxhash64("u", "c", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    key = F.col("gain") * F.lit(scale / (2.0 * m * m)) - F.log(-F.log(uniform))
    top = F.max(F.struct(key.alias("key"), "c", "s", "gain", "k")).alias("t")
    return moves.groupBy("u").agg(top).select("u", "t.s", "t.c", "t.gain", "t.k")


def accept(chosen: DataFrame, adj: DataFrame, most: int = 1000) -> DataFrame:
    """Moves that may be made at once and raise modularity together: (u, s, c, gain, k, place), place among the moves to c.

    Moves come first by gain, then smaller u.  Of two neighbours, one of which leaves
    what the other joins, the later one stays; for nodes that are no neighbours that costs
    nothing.  Two moves out of, or two into, one community lose at most the product of
    their degrees; a move has to make up, at each end, for all before it there.  Of each
    community the first ``most`` moves in and out are looked at, the rest in later
    rounds, so that no task holds all moves of a large one.
    """
    x = chosen.select("u", F.col("s").alias("su"), F.col("c").alias("cu"), F.col("gain").alias("gu"))
    y = chosen.select(F.col("u").alias("v"), F.col("s").alias("sv"), F.col("c").alias("cv"), F.col("gain").alias("gv"))
    crossed = adj.select("u", "v").join(x, "u").join(y, "v").where("(cu = sv OR su = cv) AND (gv > gu OR gv = gu AND v < u)")
    moves = chosen.join(crossed.select("u"), "u", "left_anti")
    for end in ("s", "c"):
        order = Window.partitionBy(end).orderBy(F.desc("gain"), "u")
        before = F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
        moves = moves.withColumns({"place": F.row_number().over(order), f"before_{end}": before}).where(F.col("place") <= most)
    fits = (2 * F.col("k") * F.col("before_s") <= F.col("gain")) & (2 * F.col("k") * F.col("before_c") <= F.col("gain"))
    return moves.where(fits).select("u", "s", "c", "gain", "k", "place")


def clashing(accepted: DataFrame, membership: DataFrame, nodes: DataFrame, r: float, test: PairPredicate) -> DataFrame:
    """(u): moves that would meet, in their new community, a node too far away that an earlier move brings there."""
    at = membership.join(nodes.select(F.col("id").alias("node"), F.struct(*test.columns).alias("x")), "node")
    a = accepted.select("c", F.col("u").alias("v"), F.col("place").alias("earlier"))
    pairs = accepted.select("c", "u", "place").join(a, "c").where("earlier < place").select("u", "v")
    both = pairs.join(at.select(F.col("h").alias("u"), F.col("x").alias("a")), "u").join(at.select(F.col("h").alias("v"), F.col("x").alias("b")), "v")
    return both.groupBy("u").agg(F.bool_or(test(F.col("a"), F.col("b"), r * r)).alias("bad")).where("bad").select("u")


def shifted_weights(weights: DataFrame, adj: DataFrame, accepted: DataFrame) -> DataFrame:
    """(u, c, w) after the accepted moves, from (u, c, w) before them: only the moved nodes' neighbours are looked up.  Weights are positive."""
    moved = adj.where("u <> v").join(accepted.select(F.col("u").alias("v"), "s", "c"), "v")
    change = moved.select("u", F.explode(F.array(F.struct(F.col("s").alias("c"), (-F.col("w")).alias("w")), F.struct("c", "w"))).alias("x")).select("u", "x.c", "x.w")
    return weights.select("u", "c", "w").union(change).groupBy("u", "c").agg(F.sum("w").alias("w")).where("w <> 0")


def apply(assign: DataFrame, accepted: DataFrame) -> DataFrame:
    """assign after the moves, with moved."""
    to = accepted.select(F.col("u").alias("h"), F.col("c").alias("new"))
    return assign.join(to, "h", "left").select("h", F.coalesce("new", "c").alias("c"), F.col("new").isNotNull().alias("moved"))


def next_active(assign: DataFrame, adj: DataFrame) -> DataFrame:
    """The moved hypernodes and their neighbours."""
    moved = assign.where("moved").select("h")
    near = adj.join(moved.select(F.col("h").alias("v")), "v", "left_semi").select(F.col("u").alias("h"))
    return moved.union(near).distinct()


def statistics(moves: DataFrame, blocked: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row: moves tried, moves that gain but break the constraint, and moves made."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(moves, "attempts").join(one(blocked, "distance_failed")).join(one(accepted, "moves"))
