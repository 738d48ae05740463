"""Fair PageRank: global adjustments, locally fair steps, neighbourhood fairness, quadratic programmes.

Graphs here are directed, ``edges(src, dst)`` and ``nodes(node_id, group_id)``, and ``phi`` holds
each group's target share. An undirected graph comes in as both directions, or as ``Meetings``, whose sums
over neighbours stand for the joins with the edges.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, forget, mark
from .meetings import Meetings

FOLLOW, EPSILON, ROUNDS = 0.85, 1e-4, 100
#: Nodes up to which a programme holds its matrix (32 MB), and edges and nodes that one process
#: may hold for it (24 MB of arrays, some hundred MB while it runs).
DENSE_NODES, PROGRAMME_EDGES = 2_000, 1_000_000


def default_phi(nodes: DataFrame) -> DataFrame:
    """Each group's share of the nodes."""
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.groupBy("group_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("group_id", (F.col("k") / F.col("n")).alias("share"))


def fair_jump(nodes: DataFrame, phi: DataFrame) -> DataFrame:
    """``node_id``, ``jump``: a group's share spread evenly over its nodes."""
    sizes = nodes.groupBy("group_id").agg(F.count("*").alias("size"))
    per = phi.join(sizes, "group_id").select("group_id", (F.col("share") / F.col("size")).alias("jump"))
    return nodes.join(F.broadcast(per), "group_id", "left").select("node_id", F.coalesce("jump", F.lit(0.0)).alias("jump"))


def _settled(state: DataFrame, step, rounds: int, epsilon: float | None) -> DataFrame:
    """Iterate (node_id, value, ...) until the summed change is below ``epsilon``.

    The state is used several times a round, so the plan is cut each round: uncut it would grow
    by that factor every time.
    """
    for _ in range(rounds):
        new = mark(step(state))
        moved = None
        if epsilon is not None:
            old = state.select("node_id", F.col("value").alias("old"))
            moved = new.select("node_id", "value").join(old, "node_id").agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        forget(state)
        state = new
        if moved is not None and moved < epsilon:
            break
    return state


def directed_pagerank(edges: DataFrame, nodes: DataFrame, jump: DataFrame | None = None, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> DataFrame:
    """PageRank with follow rate 0.85; mass that leaks at sinks jumps as well."""
    edges = cut(edges.select("src", "dst"))
    n = nodes.count()
    jump = jump if jump is not None else nodes.select("node_id", F.lit(1.0 / max(1, n)).alias("jump"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out"))
    base = cut(nodes.select("node_id").join(jump, "node_id").join(out, "node_id", "left"))

    def step(state: DataFrame) -> DataFrame:
        flow = edges.join(state.where("out is not null").select(F.col("node_id").alias("src"), (F.col("value") / F.col("out")).alias("part")), "src")
        return _mixed(base, flow.groupBy(F.col("dst").alias("node_id")).agg(F.sum("part").alias("got")))

    return _settled(base.withColumn("value", F.lit(1.0 / max(1, n))), step, rounds, epsilon).select("node_id", "value")


def _kept(edges: DataFrame | Meetings) -> DataFrame | Meetings:
    return edges if isinstance(edges, Meetings) else cut(edges.select("src", "dst"))


def _mixed(base: DataFrame, got: DataFrame) -> DataFrame:
    """0.85 of what was received, and all that is missing to one by the jump vector."""
    rows = base.join(got, "node_id", "left").withColumn("got", FOLLOW * F.coalesce("got", F.lit(0.0)))
    lost = rows.agg((1.0 - F.sum("got")).alias("lost"))  # one row
    return rows.crossJoin(F.broadcast(lost)).withColumn("value", F.col("got") + F.col("lost") * F.col("jump")).drop("got", "lost")


def global_proportional(ranks: DataFrame, nodes: DataFrame, phi: DataFrame) -> DataFrame:
    """Every group's mass scaled to its share."""
    of = ranks.join(nodes, "node_id")
    mass = of.groupBy("group_id").agg(F.sum("value").alias("mass")).join(phi, "group_id")
    return of.join(F.broadcast(mass), "group_id").select("node_id", F.when(F.col("mass") > 0, F.col("value") / F.col("mass") * F.col("share")).otherwise(F.lit(0.0)).alias("value"))


def global_uniform(ranks: DataFrame, nodes: DataFrame, phi: DataFrame, rounds: int = 100) -> DataFrame:
    """(share - mass) / size added to every node of a group; debts below zero are taken from the rest."""
    of = ranks.join(nodes, "node_id")
    sums = of.groupBy("group_id").agg(F.sum("value").alias("mass"), F.count("*").alias("size")).join(phi, "group_id")
    state = mark(of.join(F.broadcast(sums), "group_id").select("node_id", "group_id", (F.col("value") + (F.col("share") - F.col("mass")) / F.col("size")).alias("value")))
    for left in range(rounds, -1, -1):
        debt = state.groupBy("group_id").agg(F.sum(F.when(F.col("value") < 0, -F.col("value")).otherwise(F.lit(0.0))).alias("debt"), F.count_if(F.col("value") > 0).alias("rich"))
        if debt.where("debt > 1e-15 and rich > 0").isEmpty():
            break
        if not left:
            raise RuntimeError(f"debts did not settle in {rounds} rounds")
        paid = F.when(F.col("value") < 0, F.lit(0.0)).when(F.col("value") > 0, F.col("value") - F.col("debt") / F.col("rich")).otherwise(F.col("value"))
        state = mark(state.join(F.broadcast(debt), "group_id").select("node_id", "group_id", paid.alias("value")))
    return state.select("node_id", F.greatest("value", F.lit(0.0)).alias("value"))


def out_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src``, ``group_id``, ``k``: out-neighbours of a node in each group."""
    if isinstance(edges, Meetings):
        return edges.group_counts(nodes)
    return edges.join(nodes.select(F.col("node_id").alias("dst"), "group_id"), "dst").groupBy("src", "group_id").agg(F.count("*").alias("k"))


def neighbourhood_fair(edges: DataFrame, nodes: DataFrame, phi: DataFrame, rounds: int = ROUNDS, epsilon: float | None = EPSILON, targets: DataFrame | None = None) -> DataFrame:
    """Every node passes share_c of its mass to its out-neighbours in group c.

    Without neighbours in c that part goes to c's bucket, spread evenly over c (or over c's
    nodes in ``targets``, which then are the only receivers of buckets).
    """
    nodes = cut(nodes.select("node_id", "group_id"))
    edges, phi = _kept(edges), cut(phi)
    counts = cut(out_counts(edges, nodes))
    met = isinstance(edges, Meetings)
    if met:  # a neighbour's weight depends on the receiver's group only
        widen, direct = edges.by_class(nodes.select("node_id", F.col("group_id").alias("class")))
        # A row a node with a weight a group, so a round unfolds nothing.
        dealt = cut(widen(counts.join(F.broadcast(phi), "group_id").select("src", F.col("group_id").alias("class"), (F.col("share") / F.col("k")).alias("part"))))
    else:
        dealt = edges.join(nodes.select(F.col("node_id").alias("dst"), "group_id"), "dst").join(counts, ["src", "group_id"]).join(F.broadcast(phi), "group_id")
        dealt = cut(dealt.select("src", "dst", (F.col("share") / F.col("k")).alias("weight")).repartition("src"))  # partitioned once for all rounds
    chosen = nodes if targets is None else nodes.join(targets.select("node_id").distinct(), "node_id", "left_semi")
    sizes = cut(chosen.groupBy("group_id").agg(F.count("*").alias("size")).join(phi, "group_id"))  # one row a group
    # The groups that a node has no neighbour in.
    without = cut(nodes.select("node_id").crossJoin(F.broadcast(phi)).join(counts.select(F.col("src").alias("node_id"), "group_id", "k"), ["node_id", "group_id"], "left_anti").select("node_id", "group_id", "share").repartition("node_id"))
    base = cut(fair_jump(nodes, phi).join(nodes, "node_id").repartition("node_id"))
    # Without targets every group's part arrives, directly or through its bucket.
    passed = float(sizes.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]) if targets is None else None
    marked = base if targets is None else base.join(targets.select("node_id", F.lit(True).alias("hit")).distinct(), "node_id", "left")

    def step(state: DataFrame) -> DataFrame:
        if met:
            flow = direct(dealt.join(state.select("node_id", "value"), "node_id").select("node_id", *[(F.col("value") * F.col(c)).alias(c) for c in dealt.columns[1:]]))
        else:
            sent = dealt.join(state.select(F.col("node_id").alias("src"), "value"), "src")
            flow = sent.groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("value") * F.col("weight")).alias("direct"))
        bucket = without.join(state.select("node_id", "value"), "node_id").groupBy("group_id").agg(F.sum(F.col("value") * F.col("share")).alias("bucket"))
        per = sizes.join(bucket, "group_id", "left").select("group_id", (F.coalesce("bucket", F.lit(0.0)) / F.col("size")).alias("even"))
        rows = marked.join(flow, "node_id", "left").join(F.broadcast(per), "group_id", "left")
        even = F.coalesce("even", F.lit(0.0)) if targets is None else F.when(F.col("hit"), F.coalesce("even", F.lit(0.0))).otherwise(F.lit(0.0))
        got = F.coalesce("direct", F.lit(0.0)) + even
        if passed is not None:
            return rows.select(*base.columns, (FOLLOW * got + F.lit(1.0 - FOLLOW * passed) * F.col("jump")).alias("value"))
        return _mixed(base, rows.select("node_id", got.alias("got")))

    return _settled(base.withColumn("value", F.col("jump")), step, rounds, epsilon).select("node_id", "value")


def step_fair(edges: DataFrame, nodes: DataFrame, phi: DataFrame, favoured: int | None = None, excess: DataFrame | None = None, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> DataFrame:
    """Each node passes an equal share x to all neighbours so that no group of them gets more than
    its target, and the rest of each group's target to the bucket of that group.

    With k_c of the neighbours in group c whose share is phi_c: x = min over those groups of
    phi_c / k_c. Any number of groups; with two, the favoured one is given whole by the neighbours.
    Buckets are spread evenly, or by ``excess`` (node_id, weight), within their group.
    """
    nodes, edges, phi = cut(nodes.select("node_id", "group_id")), _kept(edges), cut(phi)
    counts = cut(out_counts(edges, nodes).join(F.broadcast(phi), "group_id"))  # phi: a row a group
    part = counts.groupBy(F.col("src").alias("node_id")).agg(F.min(F.col("share") / F.col("k")).alias("x"))
    x = cut(nodes.select("node_id").join(part, "node_id", "left").select("node_id", F.coalesce("x", F.lit(0.0)).alias("x")))
    # What a node owes each bucket: a row per node and group, as long as the result for all groups.
    owed = x.crossJoin(F.broadcast(phi)).join(counts.select(F.col("src").alias("node_id"), "group_id", "k"), ["node_id", "group_id"], "left")
    owed = cut(owed.select("node_id", "group_id", (F.col("share") - F.col("x") * F.coalesce("k", F.lit(0))).alias("e")).where("e <> 0"))
    weights = nodes.withColumn("w", F.lit(1.0)) if excess is None else nodes.join(excess.select("node_id", F.col("weight").alias("w")), "node_id", "left").fillna(0.0, ["w"])
    totals = weights.groupBy("group_id").agg(F.sum("w").alias("t"))
    spread = weights.join(F.broadcast(totals), "group_id").select("node_id", "group_id", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(F.lit(0.0)).alias("s"))
    base = cut(fair_jump(nodes, phi).join(spread, "node_id"))
    passed = float(phi.join(totals.where("t > 0"), "group_id").agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0])

    def step(state: DataFrame) -> DataFrame:
        sent = state.join(x, "node_id").select("node_id", (F.col("value") * F.col("x")).alias("direct"))
        flow = edges.sums(sent, ["direct"]) if isinstance(edges, Meetings) else edges.join(sent.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("direct").alias("direct"))
        buckets = owed.join(state.select("node_id", "value"), "node_id").groupBy("group_id").agg(F.sum(F.col("value") * F.col("e")).alias("bucket"))  # a row a group
        rows = base.join(flow, "node_id", "left").join(F.broadcast(buckets), "group_id", "left")
        got = F.coalesce("direct", F.lit(0.0)) + F.coalesce("bucket", F.lit(0.0)) * F.col("s")
        if excess is None:  # all buckets are spread whole
            return rows.select(*base.columns, (FOLLOW * got + F.lit(1.0 - FOLLOW * passed) * F.col("jump")).alias("value"))
        return _mixed(base, rows.select("node_id", got.alias("got")))

    return _settled(base.withColumn("value", F.col("jump")), step, rounds, epsilon).select("node_id", "value")


def step_fair_directions(edges: DataFrame, nodes: DataFrame, phi: DataFrame, excess: DataFrame, rounds: int = ROUNDS, epsilon: float | None = EPSILON) -> DataFrame:
    """``direction``, ``node_id``, ``value``: the step rule for many bucket vectors in one loop.

    ``excess`` holds ``direction``, ``node_id``, ``weight``. The state is keyed by (direction, node): a round is one
    join with the edges and one aggregate for all directions, which stop together, when the last one has moved
    by less than ``epsilon``. Each direction's values are those of ``step_fair`` with its own ``excess``.
    """
    nodes, edges, phi = cut(nodes.select("node_id", "group_id")), cut(edges.select("src", "dst")), cut(phi)
    counts = out_counts(edges, nodes).join(F.broadcast(phi), "group_id")  # phi: a row a group
    part = counts.groupBy(F.col("src").alias("node_id")).agg(F.min(F.col("share") / F.col("k")).alias("x"))
    x = cut(nodes.select("node_id").join(part, "node_id", "left").select("node_id", F.coalesce("x", F.lit(0.0)).alias("x")))
    owed = x.crossJoin(F.broadcast(phi)).join(counts.select(F.col("src").alias("node_id"), "group_id", "k"), ["node_id", "group_id"], "left")
    owed = cut(owed.select("node_id", "group_id", (F.col("share") - F.col("x") * F.coalesce("k", F.lit(0))).alias("e")).where("e <> 0"))
    weights = excess.select("direction", "node_id", F.col("weight").alias("w")).join(nodes, "node_id")
    totals = weights.groupBy("direction", "group_id").agg(F.sum("w").alias("t"))  # a row a direction and group
    spread = weights.join(totals, ["direction", "group_id"]).select("direction", "node_id", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(F.lit(0.0)).alias("s"))
    every = nodes.join(fair_jump(nodes, phi), "node_id").join(x, "node_id").join(excess.select("direction").distinct())  # the state itself
    base = cut(every.join(spread, ["direction", "node_id"], "left").fillna(0.0, ["s"]))
    state = mark(base.select("direction", "node_id", F.col("jump").alias("value")))
    links = cut(edges.join(x.withColumnRenamed("node_id", "src"), "src").repartition("src"))
    for _ in range(rounds):
        flow = links.join(state.withColumnRenamed("node_id", "src"), "src").groupBy("direction", F.col("dst").alias("node_id")).agg(F.sum(F.col("value") * F.col("x")).alias("direct"))
        buckets = owed.join(state, "node_id").groupBy("direction", "group_id").agg(F.sum(F.col("value") * F.col("e")).alias("bucket"))
        rows = base.join(flow, ["direction", "node_id"], "left").join(buckets, ["direction", "group_id"], "left")
        rows = rows.withColumn("got", FOLLOW * (F.coalesce("direct", F.lit(0.0)) + F.coalesce("bucket", F.lit(0.0)) * F.col("s")))
        lost = rows.groupBy("direction").agg((1.0 - F.sum("got")).alias("lost"))
        new = rows.join(lost, "direction").select("direction", "node_id", (F.col("got") + F.col("lost") * F.col("jump")).alias("value"))
        new = mark(new.join(state.select("direction", "node_id", F.col("value").alias("old")), ["direction", "node_id"]))
        moved = None if epsilon is None else new.groupBy("direction").agg(F.sum(F.abs(F.col("value") - F.col("old"))).alias("m")).agg(F.max("m")).first()[0] or 0.0
        forget(state)
        state = new
        if moved is not None and moved < epsilon:
            break
    return state.select("direction", "node_id", "value")


def search_excess(edges: DataFrame, nodes: DataFrame, phi: DataFrame, plain: DataFrame, directions: int = 30, iterations: int = 30, step: float = 1.0, least_step: float = 1e-10, seed: int = 42, **how) -> tuple[DataFrame, DataFrame, list[float]]:
    """The bucket vector whose step-fair ranks come nearest to ``plain``, these ranks, and the loss so far at each turn.

    From even buckets on, each turn draws ``directions`` random directions (seeded hashes, length 1), adds
    ``step`` times each to the vector, sets what falls below zero to zero and scales groups back to 1, and
    ranks all of them in one loop. The best one is taken if its squared distance falls, else the step is halved.
    """
    nodes, plain = cut(nodes.select("node_id", "group_id")), cut(plain.select("node_id", F.col("value").alias("aim")))
    edges, phi = cut(edges.select("src", "dst")), cut(phi)

    def scaled(df: DataFrame) -> DataFrame:
        totals = df.groupBy("direction", "group_id").agg(F.sum("weight").alias("t"))
        return df.join(totals, ["direction", "group_id"]).select("direction", "node_id", "group_id", F.when(F.col("t") > 0, F.col("weight") / F.col("t")).otherwise(F.lit(0.0)).alias("weight"))

    def judged(excess: DataFrame) -> tuple[DataFrame, list]:
        values = cut(step_fair_directions(edges, nodes, phi, excess, **how))
        loss = values.join(plain, "node_id").groupBy("direction").agg(F.sum((F.col("value") - F.col("aim")) ** 2).alias("loss"))
        return values, loss.orderBy("loss", "direction").limit(1).collect()  # one row

    now = cut(scaled(nodes.select(F.lit(0).alias("direction"), "node_id", "group_id", F.lit(1.0).alias("weight"))))
    ranks, best = judged(now)
    losses = [best[0]["loss"]] if best else []
    for turn in range(iterations if best else 0):
        if step < least_step:
            break
        number = F.explode(F.sequence(F.lit(1), F.lit(directions))).alias("direction")
        toss = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "direction", "node_id"), F.lit(2**40)) / 2**39 - 1).alias("toss")
        drawn = now.select("node_id", "group_id", "weight", number).select("*", toss)
        length = drawn.groupBy("direction").agg(F.sqrt(F.sum(F.col("toss") ** 2)).alias("length"))
        moved = drawn.join(F.broadcast(length), "direction").select("direction", "node_id", "group_id", F.greatest(F.lit(0.0), F.col("weight") + step * F.col("toss") / F.col("length")).alias("weight"))
        tried = cut(scaled(moved))
        values, best = judged(tried)
        if best[0]["loss"] < losses[-1]:
            chosen = F.col("direction") == best[0]["direction"]
            now, ranks = cut(tried.where(chosen).withColumn("direction", F.lit(0))), values.where(chosen)
            losses.append(best[0]["loss"])
        else:
            step /= 2
            losses.append(losses[-1])
    return now.select("node_id", "weight"), ranks.select("node_id", "value"), losses


def step_fair_proportional(edges: DataFrame, nodes: DataFrame, phi: DataFrame, plain: DataFrame | None = None, **how) -> DataFrame:
    """Buckets spread by plain PageRank, which ``plain`` gives if it is known."""
    weight = (directed_pagerank(edges, nodes) if plain is None else plain).select("node_id", F.col("value").alias("weight"))
    return step_fair(edges, nodes, phi, None, weight, **how)


def unfavoured(ranks: DataFrame, nodes: DataFrame, phi: DataFrame) -> int:
    """The group that plain PageRank keeps furthest below its share; the larger id on ties."""
    mass = group_mass(ranks, nodes).join(phi, "group_id")
    return mass.orderBy(F.desc(F.col("share") - F.col("mass")), F.desc("group_id")).select("group_id").first()[0]


def _top_weights(edges: DataFrame, nodes: DataFrame, phi: DataFrame, k: int, plain: DataFrame | None = None) -> tuple[int, DataFrame]:
    """The unfavoured group and ``node_id``: its k nodes of most PageRank, and all other groups."""
    ranks = cut((directed_pagerank(edges, nodes) if plain is None else plain).join(nodes, "node_id"))
    short = unfavoured(ranks.select("node_id", "value"), nodes, phi)
    top = ranks.where(F.col("group_id") == short).orderBy(F.desc("value"), "node_id").limit(k).select("node_id")
    return short, cut(ranks.where(F.col("group_id") != short).select("node_id").unionAll(top))


def hybrid_top(edges: DataFrame, nodes: DataFrame, phi: DataFrame, k: int, plain: DataFrame | None = None, **how) -> DataFrame:
    """The unfavoured group's bucket goes to its k nodes of most PageRank only."""
    _, chosen = _top_weights(edges, nodes, phi, k, plain)
    return step_fair(edges, nodes, phi, None, chosen.withColumn("weight", F.lit(1.0)), **how)


def hybrid_top_neighbourhood(edges: DataFrame, nodes: DataFrame, phi: DataFrame, k: int, rounds: int = ROUNDS, epsilon: float | None = EPSILON, plain: DataFrame | None = None) -> DataFrame:
    """Neighbourhood fairness whose unfavoured group gets at most 1 / out-degree from a neighbour.

    What that leaves of the group's share, and the whole share where a node has no neighbour in the
    group, goes to the group's k nodes of most PageRank; other groups' buckets are spread evenly.
    """
    short, chosen = _top_weights(edges, nodes, phi, k, plain)
    nodes, edges, phi = cut(nodes.select("node_id", "group_id")), cut(edges.select("src", "dst")), cut(phi)
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    counts = cut(out_counts(edges, nodes).join(degree, "src").join(F.broadcast(phi), "group_id"))
    each = F.when(F.col("group_id") == short, F.least(F.col("share") / F.col("k"), 1 / F.col("out"))).otherwise(F.col("share") / F.col("k"))
    weighed = cut(counts.select("src", "group_id", each.alias("w"), (F.col("share") - each * F.col("k")).alias("left")))
    dealt = cut(edges.join(nodes.select(F.col("node_id").alias("dst"), "group_id"), "dst").join(weighed, ["src", "group_id"]).select("src", "dst", "w"))
    lacks = nodes.select(F.col("node_id").alias("src")).crossJoin(F.broadcast(phi)).join(counts.select("src", "group_id"), ["src", "group_id"], "left_anti").select("src", "group_id", F.col("share").alias("left"))
    owed = cut(weighed.select("src", "group_id", "left").where("left > 0").unionByName(lacks))
    takers = nodes.join(chosen, "node_id", "left_semi")
    sizes = takers.groupBy("group_id").agg(F.count("*").alias("size"))
    spread = takers.join(F.broadcast(sizes), "group_id").select("node_id", (1.0 / F.col("size")).alias("s"))
    base = cut(fair_jump(nodes, phi).join(nodes, "node_id").join(spread, "node_id", "left").fillna(0.0, ["s"]))

    def step(state: DataFrame) -> DataFrame:
        now = state.select(F.col("node_id").alias("src"), "value")
        flow = dealt.join(now, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("value") * F.col("w")).alias("direct"))
        buckets = owed.join(now, "src").groupBy("group_id").agg(F.sum(F.col("value") * F.col("left")).alias("bucket"))
        rows = base.join(flow, "node_id", "left").join(F.broadcast(buckets), "group_id", "left")
        return _mixed(base, rows.select("node_id", (F.coalesce("direct", F.lit(0.0)) + F.coalesce("bucket", F.lit(0.0)) * F.col("s")).alias("got")))

    return _settled(base.withColumn("value", F.col("jump")), step, rounds, epsilon).select("node_id", "value")


def target_fair(edges: DataFrame, nodes: DataFrame, phi: DataFrame, targets: DataFrame, kind: str = "uniform", k: int | None = None, rounds: int = ROUNDS, epsilon: float | None = EPSILON, plain: DataFrame | None = None) -> DataFrame:
    """Two groups: fairness among the nodes of ``targets`` (node_id) only.

    A node with h of its d neighbours in the targets sends them h / d of its mass: each the share x
    that gives the group it favours its target, the rest to the other group's targets, spread
    evenly (``uniform``), by plain PageRank (``proportional``) or over the node's own neighbours in
    that group, over all its targets where there is none (``neighbourhood``). Other neighbours get
    1 / d. What is left jumps: k / n by groups to the targets, evenly to the others.
    """
    nodes, edges, phi = cut(nodes.select("node_id", "group_id")), _kept(edges), cut(phi)
    met = isinstance(edges, Meetings)
    hit = cut(targets.select("node_id").distinct().join(nodes, "node_id"))
    shares = {r["group_id"]: float(r["share"]) for r in phi.orderBy("group_id").collect()}
    if len(shares) != 2 or hit.select("group_id").distinct().count() != 2:
        raise ValueError("target fairness needs two groups, both among the targets")
    (zero, share0), (one, share1) = shares.items()
    n, many = nodes.count(), hit.count()
    k = many if k is None else k
    if met:
        flags = hit.select("node_id", (F.col("group_id") == zero).cast("long").alias("h0"), (F.col("group_id") == one).cast("long").alias("h1"))
        out = edges.degrees().join(edges.sums(flags, ["h0", "h1"]), "node_id", "left").fillna(0, ["h0", "h1"]).select(F.col("node_id").alias("src"), F.col("deg").alias("d"), "h0", "h1")
    else:
        out = edges.join(hit.select(F.col("node_id").alias("dst"), F.col("group_id").alias("g")), "dst", "left").groupBy("src").agg(F.count("*").alias("d"), F.count_if(F.col("g") == zero).alias("h0"), F.count_if(F.col("g") == one).alias("h1"))
    h = F.col("h0") + F.col("h1")
    likes0 = F.col("h0") / h >= share0
    out = out.withColumn("likes", F.when(h > 0, F.when(likes0, zero).otherwise(one)))
    x = F.when(h > 0, h / F.col("d") * F.when(likes0, F.lit(share0) / F.col("h0")).otherwise(F.lit(share1) / F.col("h1"))).otherwise(F.lit(0.0))
    out = out.withColumn("x", x).withColumn("rest", h / F.col("d") - F.col("x") * h).withColumn("to", F.when(F.col("likes") == zero, one).when(F.col("likes") == one, zero))
    out = cut(out.select("src", "d", "x", "rest", "to", F.when(F.col("to") == zero, F.col("h0")).otherwise(F.col("h1")).alias("own")))
    if kind == "proportional":
        weight = (directed_pagerank(edges, nodes) if plain is None else plain).join(hit, "node_id").select("node_id", "group_id", F.col("value").alias("w"))
    else:
        weight = hit.withColumn("w", F.lit(1.0))
    total = weight.groupBy("group_id").agg(F.sum("w").alias("t"))
    sizes = hit.groupBy("group_id").agg(F.count("*").alias("size")).join(phi, "group_id")
    taking = weight.join(F.broadcast(total), "group_id").join(F.broadcast(sizes), "group_id").select("node_id", (F.col("w") / F.col("t")).alias("s"), (F.lit(k / n) * F.col("share") / F.col("size")).alias("j"))
    base = cut(nodes.join(taking, "node_id", "left").select("node_id", "group_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("j", F.lit(1.0 / n)).alias("jump")))
    if met:  # the amount depends on whether the receiver is a target, and of which group
        side = F.when(F.col("g") == zero, 1).when(F.col("g") == one, 2).otherwise(0).alias("class")
        widen, direct = edges.by_class(cut(nodes.select("node_id").join(hit.select("node_id", F.col("group_id").alias("g")), "node_id", "left").select("node_id", side)))
        links = out.withColumn("g", F.explode(F.array(F.lit(None).cast("long"), F.lit(zero).cast("long"), F.lit(one).cast("long")))).withColumn("dst", side)
    else:
        links = edges.join(out, "src").join(hit.select(F.col("node_id").alias("dst"), F.col("group_id").alias("g")), "dst", "left")
    near = (F.col("g") == F.col("to")) & (F.col("own") > 0) if kind == "neighbourhood" else F.lit(False)
    amount = F.when(F.col("g").isNull(), 1 / F.col("d")).otherwise(F.col("x") + F.when(near, F.col("rest") / F.col("own")).otherwise(F.lit(0.0)))
    dealt = cut(links.select("src", "dst", amount.alias("w")))
    owed = cut(out.where("to is not null and rest <> 0" + (" and own = 0" if kind == "neighbourhood" else "")).select("src", F.col("to").alias("group_id"), "rest"))

    def step(state: DataFrame) -> DataFrame:
        now = state.select(F.col("node_id").alias("src"), "value")
        sent = dealt.join(now, "src").select("src", "dst", (F.col("value") * F.col("w")).alias("part"))
        flow = direct(widen(sent.withColumnRenamed("dst", "class"))) if met else sent.groupBy(F.col("dst").alias("node_id")).agg(F.sum("part").alias("direct"))
        buckets = owed.join(now, "src").groupBy("group_id").agg(F.sum(F.col("value") * F.col("rest")).alias("bucket"))
        rows = base.join(flow, "node_id", "left").join(F.broadcast(buckets), "group_id", "left")
        return _mixed(base, rows.select("node_id", (F.coalesce("direct", F.lit(0.0)) + F.coalesce("bucket", F.lit(0.0)) * F.col("s")).alias("got")))

    return _settled(base.withColumn("value", F.lit(1.0 / n)), step, rounds, epsilon).select("node_id", "value")


def top_targets(edges: DataFrame, nodes: DataFrame, k: int, plain: DataFrame | None = None) -> DataFrame:
    """The k nodes of most plain PageRank, ties to the smaller id."""
    return (directed_pagerank(edges, nodes) if plain is None else plain).orderBy(F.desc("value"), "node_id").limit(k).select("node_id")


def attribute_jump(nodes: DataFrame, attributes: DataFrame, attribute: int) -> DataFrame:
    """Equal jumps to the nodes that have an attribute (node_id, attribute)."""
    having = attributes.where(F.col("attribute") == attribute).select("node_id").distinct().join(nodes, "node_id", "left_semi")
    n = having.agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(having.withColumn("in", F.lit(1.0)), "node_id", "left").crossJoin(F.broadcast(n)).select("node_id", F.when(F.col("in").isNotNull(), 1.0 / F.col("n")).otherwise(F.lit(0.0)).alias("jump"))


def node_jump(nodes: DataFrame, node: int) -> DataFrame:
    """All jumps to one node."""
    return nodes.select("node_id", (F.col("node_id") == node).cast("double").alias("jump"))


def all_fair(edges: DataFrame, nodes: DataFrame, phi: DataFrame | None = None, k: int | None = None, **how) -> DataFrame:
    """``algorithm``, ``node_id``, ``value`` of the six algorithms, or with ``k`` of the six top-k ones."""
    phi = cut(default_phi(nodes) if phi is None else phi)
    edges, nodes = cut(edges.select("src", "dst")), cut(nodes.select("node_id", "group_id"))
    plain = cut(directed_pagerank(edges, nodes, **how))
    if k is None:
        made = {
            "global_uniform": global_uniform(plain, nodes, phi), "global_proportional": global_proportional(plain, nodes, phi),
            "lfpr_u": step_fair(edges, nodes, phi, **how), "lfpr_p": step_fair_proportional(edges, nodes, phi, plain, **how),
            "lfpr_n": neighbourhood_fair(edges, nodes, phi, **how),
        }
    else:
        some = cut(top_targets(edges, nodes, k, plain))
        made = {f"lfpr_{name}_topk": target_fair(edges, nodes, phi, some, kind, k, plain=plain, **how) for name, kind in (("n", "neighbourhood"), ("u", "uniform"), ("p", "proportional"))}
        made |= {"lfpr_hu_topk": hybrid_top(edges, nodes, phi, k, plain, **how), "lfpr_hn_topk": hybrid_top_neighbourhood(edges, nodes, phi, k, plain=plain, **how)}
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("algorithm"), "node_id", "value") for name, df in {"pagerank": plain, **made}.items()])


def per_source(edges: DataFrame, nodes: DataFrame, sources: DataFrame, rounds: int = 20) -> DataFrame:
    """``source``, ``group_id``, ``mass``: group masses of PageRank personalised to each source."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    edges = cut(edges.select("src", "dst").join(out, "src"))
    start = sources.select(F.col("node_id").alias("source")).distinct()
    state = start.select("source", F.col("source").alias("node_id"), F.lit(1.0).alias("value"))
    for _ in range(rounds):
        flow = edges.join(state.withColumnRenamed("node_id", "src"), "src").groupBy("source", F.col("dst").alias("node_id")).agg(F.sum(FOLLOW * F.col("value") / F.col("out")).alias("value"))
        back = flow.groupBy("source").agg(F.sum("value").alias("kept"))
        home = start.join(back, "source", "left").select("source", F.col("source").alias("node_id"), (1.0 - F.coalesce("kept", F.lit(0.0))).alias("value"))
        state = flow.unionAll(home).groupBy("source", "node_id").agg(F.sum("value").alias("value"))
        state = mark(state)  # the state is used twice a round: an uncut plan would double each time
    return state.join(nodes.select("node_id", "group_id"), "node_id").groupBy("source", "group_id").agg(F.sum("value").alias("mass"))


def source_masses(edges: DataFrame, nodes: DataFrame, rounds: int = ROUNDS, epsilon: float | None = 1e-9) -> DataFrame:
    """``source``, ``group_id``, ``mass`` of every node as a source, from one vector a group.

    Summed over the targets of a group, PageRank personalised to v is the row of v in (1 - a) (I - a P)^-1 times
    the group's indicator. That product needs no row of its own for each source: y = 1_c + a P y is
    iterated along reversed edges for all sources at once, so the state is nodes times groups and not nodes squared.
    Mass that leaks at sinks returns to its source, which scales a source's masses to 1. Stops when no
    value moves by ``epsilon``, or after ``rounds``; without ``epsilon`` after exactly ``rounds``.
    """
    if isinstance(edges, Meetings):
        return _met_masses(edges, nodes, rounds, epsilon)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    edges = cut(edges.select("src", "dst").join(out, "src").repartition("dst"))
    home = cut(nodes.select("node_id", "group_id", F.lit(1.0).alias("own")))
    state = mark(home.select("node_id", "group_id", F.col("own").alias("value"), F.lit(1.0).alias("moved")))
    for _ in range(rounds):
        back = edges.join(state.select(F.col("node_id").alias("dst"), "group_id", "value"), "dst").groupBy(F.col("src").alias("node_id"), "group_id").agg(F.sum(FOLLOW * F.col("value") / F.col("out")).alias("back"))
        new = back.unionAll(home.select("node_id", "group_id", F.col("own"))).groupBy("node_id", "group_id").agg(F.sum("back").alias("new"))
        new = mark(new.join(state.select("node_id", "group_id", "value"), ["node_id", "group_id"], "left").select("node_id", "group_id", F.col("new").alias("value"), F.abs(F.col("new") - F.coalesce("value", F.lit(0.0))).alias("moved")))
        forget(state)
        state = new
        if epsilon is not None and (state.agg(F.max("moved")).first()[0] or 0.0) < epsilon:
            break
    whole = state.groupBy("node_id").agg(F.sum("value").alias("whole"))
    return state.join(whole, "node_id").select(F.col("node_id").alias("source"), "group_id", (F.col("value") / F.col("whole")).alias("mass"))


def _met_masses(met: Meetings, nodes: DataFrame, rounds: int, epsilon: float | None) -> DataFrame:
    """``source_masses`` of a graph of meetings: a column a group, so a round sums all groups at once."""
    groups = [r[0] for r in nodes.select("group_id").distinct().orderBy("group_id").collect()]  # a row a group
    cols = [f"y{i}" for i in range(len(groups))]
    own = [F.col("group_id").eqNullSafe(F.lit(g)).cast("double") for g in groups]
    home = cut(nodes.join(met.degrees(), "node_id", "left").select("node_id", "group_id", "deg"))
    state = mark(home.select("*", *[o.alias(c) for o, c in zip(own, cols)]))
    for _ in range(rounds):
        got = met.sums(state, cols).select("node_id", *[F.col(c).alias(f"got_{c}") for c in cols])
        new = [o + F.coalesce(FOLLOW * F.col(f"got_{c}") / F.col("deg"), F.lit(0.0)) for o, c in zip(own, cols)]
        moved = F.greatest(F.lit(0.0), *[F.abs(n - F.col(c)) for n, c in zip(new, cols)], F.lit(0.0))
        new = mark(state.drop("moved").join(got, "node_id", "left").select("node_id", "group_id", "deg", *[n.alias(c) for n, c in zip(new, cols)], moved.alias("moved")))
        forget(state)
        state = new
        if epsilon is not None and (state.agg(F.max("moved")).first()[0] or 0.0) < epsilon:
            break
    of = nodes.schema["group_id"].dataType
    each = F.explode(F.array(*[F.struct(F.lit(g).cast(of).alias("group_id"), F.col(c).alias("value")) for g, c in zip(groups, cols)]))
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) if cols else F.lit(1.0)
    rows = state.select(F.col("node_id").alias("source"), whole.alias("whole"), each.alias("e"))
    return rows.where("e.value > 0").select("source", "e.group_id", (F.col("e.value") / F.col("whole")).alias("mass"))


def local_metrics(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, phi: DataFrame | None = None) -> DataFrame:
    """Per node: out and in degree, share of same-group neighbours both ways, position by rank.

    With ``phi`` also ``excess``: the share of its mass that the step rule sends to buckets.
    """
    of = nodes.select("node_id", "group_id")
    if isinstance(edges, Meetings):  # neighbours are both
        met = out_counts(edges, nodes).join(of.select(F.col("node_id").alias("src"), F.col("group_id").alias("gs")), "src").groupBy(F.col("src").alias("node_id"))
        same = F.sum(F.when(F.col("group_id") == F.col("gs"), F.col("k")).otherwise(0)) / F.sum("k")
        out = cut(met.agg(F.sum("k").alias("out_degree"), same.alias("out_homophily")))
        into = out.toDF("node_id", "in_degree", "in_homophily")
    else:
        pairs = edges.join(of.select(F.col("node_id").alias("src"), F.col("group_id").alias("gs")), "src").join(of.select(F.col("node_id").alias("dst"), F.col("group_id").alias("gd")), "dst")
        same = F.avg((F.col("gs") == F.col("gd")).cast("double"))
        out = pairs.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"), same.alias("out_homophily"))
        into = pairs.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"), same.alias("in_homophily"))
    from ..functions.ranks import rank_by

    placed = rank_by(ranks.select("node_id", "value"), F.struct("value", -F.col("node_id")), name="position", kind="competition")
    rows = of.join(out, "node_id", "left").join(into, "node_id", "left").join(placed, "node_id", "left").fillna(0, ["out_degree", "in_degree"])
    if phi is None:
        return rows
    x = out_counts(edges, nodes).join(F.broadcast(phi), "group_id").groupBy(F.col("src").alias("node_id")).agg(F.min(F.col("share") / F.col("k")).alias("x"))
    return rows.join(x, "node_id", "left").withColumn("excess", 1.0 - F.coalesce("x", F.lit(0.0)) * F.col("out_degree")).drop("x")


def neighbour_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id``, ``group_id``, ``n_in``, ``n_out`` and their shares: neighbours of a node in each group."""
    if isinstance(edges, Meetings):  # neighbours are both
        counts = cut(out_counts(edges, nodes))
    else:
        counts = None
    into = (out_counts(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes) if counts is None else counts).select(F.col("src").alias("node_id"), "group_id", F.col("k").alias("n_in"))
    out = (out_counts(edges, nodes) if counts is None else counts).select(F.col("src").alias("node_id"), "group_id", F.col("k").alias("n_out"))
    both = into.join(out, ["node_id", "group_id"], "full").fillna(0, ["n_in", "n_out"])
    total = both.groupBy("node_id").agg(F.sum("n_in").alias("i"), F.sum("n_out").alias("o"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return both.join(total, "node_id").select("node_id", "group_id", "n_in", "n_out", share("n_in", "i").alias("share_in"), share("n_out", "o").alias("share_out"))


def simplex_projection(v: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The nearest point with non-negative entries that add up to ``total``."""
    u = np.sort(v)[::-1]
    below = np.cumsum(u) - total
    k = np.nonzero(u * np.arange(1, len(v) + 1) > below)[0]
    return np.maximum(v - below[k[-1]] / (k[-1] + 1), 0)


class RankOperator:
    """Q of a directed graph, which maps a jump vector v to its PageRank Q v, without the matrix.

    Q v = gamma * sum of ((1 - gamma) P^T)^k v; the series is cut below 1e-13 of the sum. Nodes
    without out-edges link to all. Up to DENSE_NODES nodes Q is held as a matrix.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, gamma: float = 0.15) -> None:
        self.n, self.gamma, out = n, gamma, np.bincount(src, minlength=n)
        self.src, self.dst, self.w, self.sinks = src, dst, 1.0 / out[src], out == 0
        self.q: np.ndarray | None = None
        if n <= DENSE_NODES:
            p = np.zeros((n, n))
            p[src, dst] = self.w
            p[self.sinks] = 1 / n
            self.q = gamma * np.linalg.inv(np.eye(n) - (1 - gamma) * p).T

    def _series(self, x: np.ndarray, move) -> np.ndarray:
        total, term, keep = x.copy(), x, 1 - self.gamma
        while True:
            term = keep * move(term)
            total += term
            if np.abs(term).sum() <= 1e-13 * max(np.abs(total).sum(), 1e-300):
                return self.gamma * total

    def __call__(self, v: np.ndarray) -> np.ndarray:
        if self.q is not None:
            return self.q @ v
        return self._series(v, lambda x: np.bincount(self.dst, x[self.src] * self.w, self.n) + x[self.sinks].sum() / self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        """Q^T r."""
        if self.q is not None:
            return self.q.T @ r
        return self._series(r, lambda x: np.where(self.sinks, x.mean(), np.bincount(self.src, x[self.dst] * self.w, self.n)))


def fair_programme(edges: pd.DataFrame, nodes: pd.DataFrame, row, gamma: float = 0.15, steps: int = 1500, near_itself: bool = False) -> pd.DataFrame | None:
    """min |Qv - p|^2 over v >= 0 with sum 1 and a . v = b, of a graph whose size was checked.

    ``row(Q, plain, groups)`` gives (a, b), one linear condition on the jump vector. Accelerated
    gradients, projected exactly; only products with Q are formed. With ``near_itself`` the target
    is |v - p|^2 (Q = I). None if infeasible; the column ``settled`` tells whether the last step moved less
    than 1e-10, or ``steps`` ran out before.
    """
    ids = np.sort(nodes.node_id.to_numpy())
    n = len(ids)
    q = RankOperator(*[np.searchsorted(ids, edges[c].to_numpy()) for c in ("src", "dst")], n, gamma)
    plain = q(np.full(n, 1 / n))
    a, share = row(q, plain, nodes.sort_values("node_id").group_id.to_numpy())
    if not a.min() - 1e-12 <= share <= a.max() + 1e-12:
        return None

    def project(x: np.ndarray) -> np.ndarray:
        """The nearest feasible point: max(x - l - m a, 0), with l by the simplex and m by bisection.

        a . v falls as m grows, so its target is bracketed and halved.
        """
        low, high = -1.0, 1.0
        while a @ simplex_projection(x - low * a) < share and low > -1e12:
            low *= 2
        while a @ simplex_projection(x - high * a) > share and high < 1e12:
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            if a @ simplex_projection(x - mid * a) > share:
                low = mid
            else:
                high = mid
            if high - low <= 1e-14 * max(1.0, abs(mid)):
                break
        return simplex_projection(x - high * a)

    if near_itself:
        v = project(plain)
        return pd.DataFrame({"node_id": ids, "jump": v, "value": v, "settled": True})
    x = np.full(n, n**-0.5)
    for _ in range(30):  # the largest singular value, from below
        x = q.back(q(x))
        size = np.linalg.norm(x)
        x /= size
    rate = 1 / (1.05 * size)
    v = z = project(np.full(n, 1 / n))
    t, settled = 1.0, False
    for _ in range(steps):
        new = project(z - rate * q.back(q(z) - plain))
        if (z - new) @ (new - v) > 0:  # the momentum points uphill: start it again
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved, v, t = new + (t - 1) / t2 * (new - v), np.abs(new - v).max(), new, t2
        if settled := bool(moved < 1e-10):
            break
    return pd.DataFrame({"node_id": ids, "jump": v, "value": q(v), "settled": settled})


def sensitive_jump(edges: pd.DataFrame, nodes: pd.DataFrame, share: float = 0.5, protected: int = 1, gamma: float = 0.15, steps: int = 1500) -> pd.DataFrame | None:
    """The protected group as a whole gets ``share`` of the rank, whatever the ranking's order."""
    return fair_programme(edges, nodes, lambda q, plain, group: (q.back((group == protected).astype(float)), share), gamma, steps)


def targeted_jump(edges: pd.DataFrame, nodes: pd.DataFrame, share: float, k: int | None = None, targets: list[int] | None = None, protected: int = 1, gamma: float = 0.15, steps: int = 1500, near_itself: bool = False) -> pd.DataFrame | None:
    """Of what the top ``k`` by plain rank (or the ``targets``) get, the protected ones get ``share``."""
    ids = np.sort(nodes.node_id.to_numpy())

    def row(q: RankOperator, plain: np.ndarray, group: np.ndarray):
        top = np.isin(ids, targets) if targets is not None else np.zeros(len(ids), bool)
        if targets is None:
            top[np.argsort(-plain, kind="stable")[:k]] = True
        r = (top & (group == protected)) - share * top
        return (r.astype(float) if near_itself else q.back(r.astype(float))), 0.0

    return fair_programme(edges, nodes, row, gamma, steps, near_itself)


def group_mass(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    return ranks.join(nodes.select("node_id", "group_id"), "node_id").groupBy("group_id").agg(F.sum("value").alias("mass"))


def within_group_position(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    over = Window.partitionBy("group_id").orderBy(F.desc("value"), "node_id")
    return ranks.join(nodes.select("node_id", "group_id"), "node_id").withColumn("position", F.row_number().over(over))


def distance_to(ranks: DataFrame, plain: DataFrame) -> DataFrame:
    """Squared distance between two rank vectors: the programmes' objective."""
    both = ranks.select("node_id", F.col("value").alias("x")).join(plain.select("node_id", F.col("value").alias("y")), "node_id")
    return both.agg(F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2.0))).alias("loss"))
