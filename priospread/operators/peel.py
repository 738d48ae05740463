"""Peeling by lexicographic degree vectors: the priority core of every node.

The degree vector only falls as nodes leave and has values in a total order, so the generalised
core theorem (Batagelj and Zaversnik 2002) holds and the result does not depend on the order of
ties. Three forms give the same vectors:

* ``frontier_cores``: a local fix-point over DataFrames for any number of rankings at once and graphs of any
  size. A round looks at the neighbours of nodes whose vector fell in the round before and at no others.
* ``fixpoint_cores``: the same fix-point for one ranking, all nodes every round.
* ``grouped_cores``: one task per ranking peels the whole graph; for small graphs, on request, whose edge
  count is checked to be below ``TASK_EDGES``.

Vectors are integers (blends are scaled by 100), so equal vectors are equal exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexi
from ..plans.loops import cut, forget, iterate, mark
from ..sources.text import Graph
from .degrees import degree_vector

#: Edges and nodes that one task may hold: 6 MB of ids as they come, about 250 MB as Python tuples.
TASK_EDGES = 250_000


def _weights(ranking: Sequence[int], beta: int, scale: int) -> list[list[int]]:
    """What a neighbour at each position adds to each component."""
    s = len(ranking)
    out = []
    for pos in range(s):
        row = [0] * s
        row[pos] = scale
        if pos:
            row[pos - 1] = beta
        out.append(row)
    return out


def fixpoint_cores(graph: Graph, ranking: Sequence[int], beta: int = 0, scale: int = 1) -> DataFrame:
    """``node_id``, ``vec``: the peel vector as the largest fix-point of a lexicographic h-index.

    A node's next vector is the larger of its own contribution and the best, over its
    neighbours by falling vector, of the smaller of a neighbour's vector and what the node and
    the neighbours so far add up to.
    """
    s, add = len(ranking), _weights(ranking, beta, scale)
    graph = graph.cut()
    placed = graph.nodes.select("node_id", lexi.position(F.col("group_id"), ranking).alias("pos"))
    own = lambda i: F.expr("CASE pos " + " ".join(f"WHEN {p} THEN {add[p][i]}L" for p in range(s)) + " ELSE 0L END")
    mine = cut(placed.select("node_id", *[own(i).alias(f"o{i}") for i in range(s)]))
    adjacency = cut(graph.adjacency)
    start = degree_vector(graph, ranking).select("node_id", (lexi.blend(F.col("vec"), beta, scale) if scale > 1 or beta else F.col("vec")).alias("vec"))
    self_vec = F.array(*[F.col(f"o{i}") for i in range(s)])

    def step(state: DataFrame) -> DataFrame:
        near = state.join(mine, "node_id").select(F.col("node_id").alias("dst"), "vec", *[f"o{i}" for i in range(s)])
        rows = adjacency.join(near, "dst").groupBy("src", "vec").agg(*[F.sum(f"o{i}").alias(f"o{i}") for i in range(s)])
        down = Window.partitionBy("src").orderBy(F.desc("vec")).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.select("src", "vec", *[F.sum(f"o{i}").over(down).alias(f"c{i}") for i in range(s)])
        owned = sums.join(mine, sums.src == mine.node_id).select("src", F.least(F.col("vec"), F.array(*[F.col(f"c{i}") + F.col(f"o{i}") for i in range(s)])).alias("cand"))
        best = owned.groupBy(F.col("src").alias("node_id")).agg(F.max("cand").alias("cand"))
        new = state.join(mine, "node_id").join(best, "node_id", "left").select("node_id", "vec", F.coalesce(F.greatest(self_vec, "cand"), self_vec).alias("new"))
        return new.select("node_id", F.least("vec", "new").alias("vec"), (F.col("new") < F.col("vec")).alias("changed"))

    return iterate(cut(start), step, "changed")


def frontier_cores(graph: Graph, rankings: Sequence[Sequence[int]], beta: int = 0, scale: int = 1) -> DataFrame:
    """``ranking``, ``node_id``, ``vec`` for all rankings in one loop, keyed by (ranking, node).

    Nodes outside a ranking add nothing to anyone, so only edges towards ranked nodes take part, and only
    ranked nodes that fell make a frontier. A round is one written state with the flag ``fell``. Shorter
    rankings carry zeros up to the longest one's length, which leaves their order as it is.
    """
    graph = graph.cut()
    width = max(len(r) for r in rankings)
    keys = [lexi.ranking_key(r) for r in rankings]
    adjacency = cut(graph.adjacency.repartition("src"))
    pad = lambda row: row + [0] * (width - len(row))
    ranked = F.explode(F.array(*[F.struct(F.lit(k).alias("ranking"), F.array(*[F.lit(int(g)) for g in r]).alias("groups")) for k, r in zip(keys, rankings)]))
    placed = graph.nodes.select("node_id", "group_id", ranked.alias("r")).select("node_id", F.col("r.ranking").alias("ranking"), F.nullif(F.array_position("r.groups", F.col("group_id")), F.lit(0)).alias("pos"))
    adds = {(k, i + 1): pad(row) for k, r in zip(keys, rankings) for i, row in enumerate(_weights(r, beta, scale))}

    def own(i: int):
        out = F
        for (k, pos), row in adds.items():
            out = out.when((F.col("ranking") == k) & (F.col("pos") == pos), F.lit(row[i]).cast("long"))
        return out.otherwise(F.lit(0).cast("long")).alias(f"o{i}")

    each = [f"o{i}" for i in range(width)]
    mine = cut(placed.select("ranking", "node_id", (F.col("pos").isNotNull()).alias("in"), *[own(i) for i in range(width)]))
    towards = mine.where("`in`").select("ranking", F.col("node_id").alias("dst"), *each)
    sums = adjacency.join(towards, "dst").groupBy("ranking", F.col("src").alias("node_id")).agg(*[F.sum(o).alias(f"d{o}") for o in each])
    start = F.array(*[F.col(o) + F.coalesce(f"d{o}", F.lit(0)) for o in each])
    state, first = mark(mine.join(sums, ["ranking", "node_id"], "left").select(*mine.columns, start.alias("vec"), F.lit(True).alias("fell"))), True
    while first or not state.where("fell").isEmpty():
        near = state.where("`in`").select("ranking", F.col("node_id").alias("dst"), "vec", *each, "fell")
        rows = adjacency.join(near, "dst")
        if not first:
            touched = rows.where("fell").select("ranking", "src").distinct()
            rows = rows.join(touched, ["ranking", "src"], "left_semi")
        rows = rows.groupBy("ranking", "src", "vec").agg(*[F.sum(o).alias(o) for o in each])
        down = Window.partitionBy("ranking", "src").orderBy(F.desc("vec")).rowsBetween(Window.unboundedPreceding, 0)
        upto = rows.select("ranking", F.col("src").alias("node_id"), F.col("vec").alias("near"), *[F.sum(o).over(down).alias(f"c{o}") for o in each])
        both = upto.join(mine.select("ranking", "node_id", *each), ["ranking", "node_id"])
        best = both.groupBy("ranking", "node_id").agg(F.max(F.least(F.col("near"), F.array(*[F.col(f"c{o}") + F.col(o) for o in each]))).alias("best"))
        me = F.array(*[F.col(o) for o in each])
        # Nodes that no frontier touches have no ``best`` and stay; the first round touches all that have ranked neighbours.
        low = F.when(F.col("best").isNotNull(), F.least("vec", F.greatest(me, F.col("best")))).otherwise(F.col("vec"))
        after = mark(state.join(best, ["ranking", "node_id"], "left").select(*mine.columns, low.alias("vec"), (low < F.col("vec")).alias("fell")))
        forget(state)
        state, first = after, False
    length = F.size(F.split("ranking", "_"))
    return state.select("ranking", "node_id", F.slice("vec", F.lit(1), length).alias("vec"))


def peel_arrays(n: int, src: np.ndarray, dst: np.ndarray, pos: np.ndarray, add: list[list[int]]) -> list[tuple[int, ...]]:
    """Peel vectors of nodes 0..n-1; ``pos`` is -1 outside the ranking."""
    s = len(add)
    both = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(both[0], kind="stable")
    near, first = both[1][order], np.concatenate([[0], np.cumsum(np.bincount(both[0], minlength=n))])
    table = np.array([*add, [0] * s], np.int64).reshape(s + 1, s)
    vec = table[pos].copy()
    np.add.at(vec, both[0], table[pos[both[1]]])
    now = [tuple(v) for v in vec.tolist()]
    heap = [(v, i) for i, v in enumerate(now)]
    heapq.heapify(heap)
    out: list[tuple[int, ...] | None] = [None] * n
    level = min(now, default=())
    while heap:
        v, u = heapq.heappop(heap)
        if out[u] is not None or v != now[u]:
            continue
        level = max(level, v)
        out[u] = level
        if (p := int(pos[u])) < 0:
            continue
        less = add[p]
        for w in near[first[u] : first[u + 1]].tolist():
            if out[w] is None:
                now[w] = tuple(a - b for a, b in zip(now[w], less))
                heapq.heappush(heap, (now[w], w))
    return out


def grouped_cores(graph: Graph, rankings: Sequence[Sequence[int]], beta: int = 0, scale: int = 1) -> DataFrame:
    """``ranking``, ``node_id``, ``vec`` for several rankings, one task each, of a graph within TASK_EDGES."""
    graph = graph.cut()
    edges, nodes = graph.edges.select("src", "dst"), graph.nodes.select("node_id", "group_id")
    if any(x.limit(TASK_EDGES + 1).count() > TASK_EDGES for x in (edges, nodes)):
        raise ValueError(f"one task holds {TASK_EDGES} edges and nodes at most: use frontier_cores")
    # Nodes ride along as loops (node, node, group); the graph is small and checked.
    rows = edges.select("src", "dst", F.lit(None).cast("int").alias("g")).unionAll(nodes.select("node_id", "node_id", "group_id"))
    keys = F.explode(F.array(*[F.lit(lexi.ranking_key(r)) for r in rankings]))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ranking = [int(x) for x in key[0].split("_")]
        loops = pdf[pdf.src == pdf.dst].drop_duplicates("src").sort_values("src")
        ids = loops.src.to_numpy()
        place = {g: i for i, g in enumerate(ranking)}
        pos = np.array([place.get(g, -1) for g in loops.g], np.int64)
        links = pdf[pdf.src != pdf.dst]
        at = [np.searchsorted(ids, links[c].to_numpy()) for c in ("src", "dst")]
        vecs = peel_arrays(len(ids), *at, pos, _weights(ranking, beta, scale))
        return pd.DataFrame({"ranking": key[0], "node_id": ids, "vec": [list(v) for v in vecs]})

    return rows.select(keys.alias("ranking"), "src", "dst", "g").groupBy("ranking").applyInPandas(run, "ranking string, node_id long, vec array<long>")


def extended(graph: Graph, ranking: Sequence[int]) -> tuple[Graph, list[int]] | None:
    """The graph and ranking with all unranked groups as one last group; None if none is left."""
    groups = graph.group_ids()
    if len(ranking) >= len(groups):
        return None
    rest = max(groups) + 1
    nodes = graph.nodes.withColumn("group_id", F.when(F.col("group_id").isin([int(g) for g in ranking]), F.col("group_id")).otherwise(F.lit(rest)))
    return Graph(nodes, graph.edges), [*ranking, rest]
