"""Breadth-first distances, components, closeness and betweenness."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut, forget, iterate, mark
from ..sources.text import Graph

#: Edges and nodes that a worker may be asked to hold for path counting (16 MB of ids, below 150 MB as lists).
WORKER_EDGES = 500_000
#: Pairs of a batch of sources.
BATCH_PAIRS = 200_000_000


def distances(graph: Graph, most: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``d`` of reachable pairs, d from 1, up to ``most`` steps or all.

    One frontier join per step; pairs of the last two steps are removed by anti-joins, and a
    frontier is distinct before it is joined again. All pairs of a large graph are n^2 rows: give
    ``sources`` or ``most`` there.
    """
    adjacency = graph.cut().adjacency
    starts = sources.select(F.col("node_id").alias("src")).distinct() if sources is not None else None
    front = adjacency if starts is None else adjacency.join(starts, "src", "left_semi")
    front = mark(front.select("src", "dst", F.lit(1).alias("d")))
    seen, step, parts = front, 1, [front]
    while most is None or step < most:
        step += 1
        hop = adjacency.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        new = front.join(hop, "dst").where("to <> src").select("src", F.col("to").alias("dst")).distinct()
        for old in parts[-2:]:  # a neighbour of the frontier lies in it, beside it or ahead
            new = new.join(old, ["src", "dst"], "left_anti")
        front = mark(new.withColumn("d", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
        parts.append(front)
    seen._parts = parts
    return seen


def components(graph: Graph) -> DataFrame:
    """``node_id``, ``component``: the smallest node id that is reachable, at any distance."""
    graph = graph.cut()
    adjacency = graph.adjacency

    def step(state: DataFrame) -> DataFrame:
        near = adjacency.join(state.select(F.col("node_id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        low = state.join(near, "node_id", "left").select("node_id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = state.select(F.col("node_id").alias("component"), F.col("component").alias("up"))
        return low.join(up, "component").select("node_id", F.least("component", "up").alias("component"), (F.least("component", "up") < F.col("was")).alias("changed"))

    return iterate(graph.nodes.select("node_id", F.col("node_id").alias("component")), step, "changed")


def largest_component(graph: Graph) -> Graph:
    """The component with most nodes, the one with the smallest id on ties."""
    of = cut(components(graph))
    best = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    chosen = of.join(F.broadcast(best), "component").select("node_id")
    nodes = graph.nodes.join(chosen, "node_id", "left_semi")
    return Graph(nodes, graph.edges.join(chosen.withColumnRenamed("node_id", "src"), "src", "left_semi"))


def waves(graph: Graph, work: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """``work`` over each wave of breadth-first searches from all nodes, 64 sources a word.

    Sources are numbered in blocks of 64 by their place in a written table. The state is a row a
    (block, node) with the words ``seen`` and ``new``, whose bits are the sources that have reached the node
    so far and in the last step; a step is one join with the edges and a ``bit_or``. ``work`` gets the
    rows (block, node_id, new) of a step, the sources (block, bit, node_id) and the distance, and returns
    what it aggregates of them, so pairs of nodes are never stored.
    """
    graph = graph.cut()
    at = F.monotonically_increasing_id()
    sources = cut(graph.nodes.select("node_id", at.alias("at")))
    sources = cut(sources.select("node_id", F.shiftrightunsigned("at", 6).alias("block"), F.expr("cast(at & 63 as int)").alias("bit")))
    adjacency = cut(graph.adjacency.repartition("src"))
    start = sources.groupBy("block", "node_id").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("new"))
    state, d, parts = mark(start.select("block", "node_id", F.col("new").alias("seen"), "new")), 0, []
    while True:
        d += 1
        hop = adjacency.join(state.where("new <> 0").select("block", F.col("node_id").alias("src"), "new"), "src").groupBy("block", F.col("dst").alias("node_id")).agg(F.bit_or("new").alias("hop"))
        both = state.select("block", "node_id", "seen").join(hop, ["block", "node_id"], "full").fillna(0, ["seen", "hop"])
        after = mark(both.select("block", "node_id", F.expr("seen | hop").alias("seen"), F.expr("hop & ~seen").alias("new")))
        forget(state)
        state = after
        if state.where("new <> 0").isEmpty():
            break
        parts.append(cut(work(state.where("new <> 0").select("block", "node_id", "new"), sources, d)))
    if not parts:  # no edges: the first step reached nobody
        return work(state.where("new <> 0").select("block", "node_id", "new"), sources, d)
    return reduce(DataFrame.unionAll, parts)


def per_source(new: DataFrame, sources: DataFrame, sums: dict[str, str]) -> DataFrame:
    """``node_id`` of each source and, over the nodes whose bit it is, the ``sums`` (SQL expressions by name)."""
    parts = [F.struct(F.lit(i).alias("bit"), *[F.sum(F.expr(f"if((new & shiftleft(1L, {i})) <> 0, {x}, null)")).alias(n) for n, x in sums.items()]) for i in range(64)]
    got = new.groupBy("block").agg(F.array(*parts).alias("of")).select("block", F.explode("of").alias("of")).select("block", "of.*")
    return got.where(f"{next(iter(sums))} is not null").join(sources, ["block", "bit"]).select("node_id", *sums)


def distance_counts(graph: Graph) -> DataFrame:
    """``node_id``, ``d``, ``r``: how many nodes each node reaches in d steps and no fewer."""
    return waves(graph, lambda new, sources, d: per_source(new, sources, {"r": "1L"}).select("node_id", F.lit(d).alias("d"), "r"))


def closeness(graph: Graph, pairs: DataFrame | None = None, scaled: bool = True) -> DataFrame:
    """(r - 1) / sum of distances, times (r - 1) / (n - 1) for r reached nodes if ``scaled``."""
    if pairs is None:
        sums = distance_counts(graph).groupBy("node_id").agg(F.sum(F.col("d") * F.col("r")).alias("total"), F.sum("r").alias("r"))
    else:
        sums = pairs.groupBy(F.col("src").alias("node_id")).agg(F.sum("d").alias("total"), F.count("*").alias("r"))
    n = graph.nodes.agg((F.count("*") - 1).alias("n"))
    value = F.col("r") / F.col("total") * ((F.col("r") / F.col("n")) if scaled else F.lit(1.0))
    return graph.nodes.select("node_id").join(sums, "node_id", "left").crossJoin(F.broadcast(n)).select("node_id", F.coalesce(value, F.lit(0.0)).alias("value"))


def _dependencies(graph: Graph, sources: DataFrame) -> DataFrame:
    """``node_id``, ``part``: Brandes' dependencies on ``sources``, level by level over DataFrames.

    Forward: path counts of the next level are sums over the edges from the last one. Backward:
    each level hands (1 + dependency) / paths to its predecessors. A level is one written table.
    """
    adjacency = graph.adjacency
    levels = [mark(sources.select(F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(1.0).alias("paths")))]
    seen = [levels[0].select("s", "v")]
    while True:
        ahead = levels[-1].join(adjacency, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("w")).agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v")
        for old in seen[-2:]:  # a neighbour of a level lies in it, beside it or ahead
            ahead = ahead.join(old, ["s", "v"], "left_anti")
        level = mark(ahead)
        if level.isEmpty():
            break
        levels.append(level)
        seen.append(level.select("s", "v"))
    owed = mark(levels[-1].withColumn("owed", F.lit(0.0)))
    parts = []
    for level in reversed(levels[:-1]):
        parts.append(owed.groupBy(F.col("v").alias("node_id")).agg(F.sum("owed").alias("part")))
        back = owed.select("s", F.col("v").alias("dst"), ((1 + F.col("owed")) / F.col("paths")).alias("give")).join(adjacency, "dst").groupBy("s", F.col("src").alias("v")).agg(F.sum("give").alias("give"))
        owed = mark(level.join(back, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("give", F.lit(0.0))).alias("owed")))
    if not parts:
        return sources.select("node_id", F.lit(0.0).alias("part")).limit(0)
    return reduce(DataFrame.unionAll, parts).groupBy("node_id").agg(F.sum("part").alias("part"))


def path_sums(source: int, near: list[np.ndarray]) -> np.ndarray:
    """Brandes' dependencies of all nodes on one source."""
    n = len(near)
    sigma, d, delta = np.zeros(n), np.full(n, -1), np.zeros(n)
    sigma[source], d[source] = 1, 0
    order, before, queue = [], [[] for _ in range(n)], deque([source])
    while queue:
        u = queue.popleft()
        order.append(u)
        for v in near[u]:
            if d[v] < 0:
                d[v] = d[u] + 1
                queue.append(v)
            if d[v] == d[u] + 1:
                sigma[v] += sigma[u]
                before[v].append(u)
    for w in reversed(order):
        for u in before[w]:
            delta[u] += sigma[u] / sigma[w] * (1 + delta[w])
    delta[source] = 0
    return delta


def betweenness(graph: Graph, sources: DataFrame | None = None, tasks: int = 64, one_task: bool = False) -> DataFrame:
    """Normalised betweenness without endpoints: Brandes level by level, some sources at a time.

    With ``sources`` the sum over those is scaled up to all nodes (an estimate). ``one_task`` broadcasts the
    graph, which may then have WORKER_EDGES edges and nodes at most, and each task takes some sources.
    """
    graph = graph.cut()
    asked = cut((graph.nodes if sources is None else sources).select("node_id").distinct())
    n, k = graph.nodes.count(), asked.count()
    if one_task:
        if n > WORKER_EDGES or graph.edges.limit(WORKER_EDGES + 1).count() > WORKER_EDGES:
            raise ValueError(f"a worker holds {WORKER_EDGES} edges and nodes at most")
        parts = _shared_dependencies(graph, asked.repartition(min(tasks, max(1, k)), "node_id"))
    else:
        batches = max(1, -(-n * k // BATCH_PAIRS))
        dealt = [asked.where(F.pmod(F.xxhash64("node_id"), F.lit(batches)) == i) for i in range(batches)]
        parts = reduce(DataFrame.unionAll, [cut(_dependencies(graph, some)) for some in dealt])
    scale = F.lit((n / max(1, k)) / ((n - 1) * (n - 2)) if n > 2 else 0.0)
    sums = parts.groupBy("node_id").agg(F.sum("part").alias("part"))
    return graph.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", (F.coalesce("part", F.lit(0.0)) * scale).alias("value"))


def _shared_dependencies(graph: Graph, asked: DataFrame) -> DataFrame:
    """The dependencies on ``asked``, each task with the whole graph, whose size was checked."""
    ids = np.array(sorted(r[0] for r in graph.nodes.select("node_id").collect()), np.int64)
    edges = graph.edges.select("src", "dst").toPandas()
    n = len(ids)
    at = [np.searchsorted(ids, edges[c].to_numpy()) for c in ("src", "dst")]
    both = np.concatenate(at), np.concatenate(at[::-1])
    order = np.argsort(both[0], kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(both[0], minlength=n))])
    shared = graph.edges.sparkSession.sparkContext.broadcast((ids, both[1][order], first))

    def run(batches):
        ids, near, first = shared.value
        lists = [near[first[i] : first[i + 1]].tolist() for i in range(len(ids))]
        total = np.zeros(len(ids))
        for pdf in batches:
            for s in np.searchsorted(ids, pdf.node_id.to_numpy()):
                total += path_sums(int(s), lists)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"node_id": ids[some], "part": total[some]})

    return asked.mapInPandas(run, "node_id long, part double")
