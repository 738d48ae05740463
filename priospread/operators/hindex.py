"""The h-index chain and the core number as its fix-point."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut, forget, mark
from ..sources.text import Graph
from .degrees import degree

#: Edges and nodes that one task may be asked to hold: 8 MB of ids as they come, below 60 MB while peeled.
TASK_EDGES = 250_000


def h_index(neighbours: DataFrame, by: str = "src", value: str = "value") -> DataFrame:
    """``node_id``, ``value``: the largest h with h neighbour values of h or more.

    Values are counted per (node, value) first, so a hub is as many rows as it has distinct
    neighbour values: h = max over values of min(value, neighbours at or above it).
    """
    counts = neighbours.groupBy(by, value).agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc(value)))
    got = counts.select(by, F.least(F.col(value), above).alias("_h")).groupBy(by).agg(F.max("_h").alias("value"))
    return got.select(F.col(by).alias("node_id"), F.greatest("value", F.lit(0)).cast("long").alias("value"))


def h_step(adjacency: DataFrame, state: DataFrame) -> DataFrame:
    """One step of the chain over all nodes of ``state``; isolated nodes get 0."""
    near = adjacency.join(state.select(F.col("node_id").alias("dst"), "value"), "dst")
    return state.select("node_id").join(h_index(near), "node_id", "left").select("node_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def h_chain(graph: Graph, k: int) -> DataFrame:
    """The k-th h-index of every node; k = 0 is the degree. Steps share their prefix."""
    if k:
        graph = graph.cut()
    state = degree(graph)
    for _ in range(k):
        state = h_step(graph.adjacency, state)
    return state


def core_numbers(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Core numbers of nodes 0..n-1: nodes leave in rounds, those of the least degree first."""
    ends, other = np.concatenate([src, dst]), np.concatenate([dst, src])
    near = other[np.argsort(ends, kind="stable")]
    deg = np.bincount(ends, minlength=n)
    first = np.concatenate([[0], np.cumsum(deg)])
    core, here, level = np.zeros(n, np.int64), np.ones(n, bool), 0
    go = np.flatnonzero(deg <= level)
    while here.any():
        while len(go):
            core[go], here[go] = level, False
            lost = np.concatenate([near[first[u] : first[u + 1]] for u in go]) if len(go) else go
            lost, times = np.unique(lost[here[lost]], return_counts=True)
            deg[lost] -= times
            go = lost[deg[lost] <= level]
        if here.any():
            level = int(deg[here].min())
            go = np.flatnonzero(here & (deg <= level))
    return core


def _one_task(graph: Graph) -> DataFrame:
    """``coreness`` of a graph whose size was checked, by one task."""
    rows = graph.edges.select("src", "dst").unionAll(graph.nodes.select("node_id", "node_id"))  # nodes ride along as loops

    def run(table: pa.Table) -> pa.Table:
        src, dst = (table[c].to_numpy() for c in ("src", "dst"))
        loops = src == dst
        ids = np.unique(src[loops])
        value = core_numbers(len(ids), *[np.searchsorted(ids, x[~loops]) for x in (src, dst)])
        return pa.table({"node_id": ids, "value": value})

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(run, "node_id long, value long")


def coreness(graph: Graph, one_task: bool = False) -> DataFrame:
    """Core numbers: the h-index chain until it rests, however many rounds that takes.

    A node's value can only fall after a neighbour's did, so a round looks at the neighbours of
    the nodes that fell in the round before (the frontier) and leaves all others alone. A round is
    one written state, whose flag ``fell`` is the next frontier. ``one_task`` lets a single task
    peel the whole graph, which may then have TASK_EDGES edges and nodes at most.
    """
    graph = graph.cut()
    if one_task:
        if any(x.limit(TASK_EDGES + 1).count() > TASK_EDGES for x in (graph.nodes, graph.edges)):
            raise ValueError(f"one task holds {TASK_EDGES} edges and nodes at most")
        return _one_task(graph)
    adjacency = cut(graph.adjacency.repartition("src"))
    state, first = mark(degree(graph).withColumn("fell", F.lit(True))), True
    while first or not state.where("fell").isEmpty():
        values = state.select(F.col("node_id").alias("dst"), "value")
        asked = adjacency
        if not first:
            touched = adjacency.join(state.where("fell").select(F.col("node_id").alias("dst")), "dst").select("src").distinct()
            asked = adjacency.join(touched, "src", "left_semi")
        new = h_index(asked.join(values, "dst")).withColumnRenamed("value", "new")
        low = F.least("value", F.coalesce("new", "value"))
        after = mark(state.join(new, "node_id", "left").select("node_id", low.alias("value"), (low < F.col("value")).alias("fell")))
        forget(state)
        state, first = after, False
    return state.select("node_id", "value")
