"""Personalised PageRank as joins and aggregates, with the jump vectors of the ranking methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexi
from ..plans.loops import cut, forget, mark
from ..sources.text import Graph
from .meetings import Meetings

ALPHA, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def uniform_jump(graph: Graph) -> DataFrame:
    return graph.nodes.select("node_id", F.lit(1.0).alias("jump"))


def ranked_jump(graph: Graph, ranking: Sequence[int]) -> DataFrame:
    """Equal jumps to nodes of ranked groups only; to all nodes if there is none."""
    inside = F.col("group_id").isin([int(g) for g in ranking]).cast("double")
    return graph.nodes.select("node_id", inside.alias("jump"))


def exponential_jump(graph: Graph, ranking: Sequence[int], base: float = 0.5) -> DataFrame:
    """base^place for the group at 0-based ``place``, 0 outside the ranking."""
    pos = lexi.position(F.col("group_id"), ranking)
    return graph.nodes.select("node_id", F.coalesce(F.pow(F.lit(base), pos), F.lit(0.0)).alias("jump"))


def pagerank(graph: Graph, jump: DataFrame | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, every: int = 1) -> DataFrame:
    """``node_id``, ``value``: starts at the jump vector; mass of nodes without edges jumps too.

    Stops when the summed change is below n * tolerance, or, with tolerance None, after exactly
    ``rounds``. Each round is one join with the edges, which stay partitioned by their source,
    and one aggregate; a graph of meetings is summed by its places instead. A round uses the state three times, so the lineage is cut each round.
    """
    graph = graph.cut()
    jump = uniform_jump(graph) if jump is None else jump
    total = jump.agg(F.sum("jump"), F.count("*")).first()
    if not total[0]:
        jump, total = uniform_jump(graph), (total[1], total[1])
    links = graph.links
    met = isinstance(links, Meetings)
    degree = links.degrees() if met else links.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))
    base = cut(
        graph.nodes.select("node_id").join(jump, "node_id").join(degree, "node_id", "left")
        .select("node_id", (F.col("jump") / F.lit(float(total[0]))).alias("p"), F.coalesce("deg", F.lit(0)).alias("deg"))
    )
    adjacency, n = None if met else cut(links.repartition("src")), total[1]
    state = base.select("node_id", "p", "deg", F.col("p").alias("value"))
    made = None
    for i in range(1, rounds + 1):
        parts = state.where("deg > 0").select("node_id", (F.col("value") / F.col("deg")).alias("got"))
        got = links.sums(parts, ["got"]) if met else adjacency.join(parts.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("got").alias("got"))
        loose = state.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("value"))), F.lit(0.0)).alias("loose"))  # one row
        new = state.join(got, "node_id", "left").crossJoin(F.broadcast(loose))
        value = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("p")) + (1 - alpha) * F.col("p")
        state = new.select("node_id", "p", "deg", value.alias("value"), F.abs(value - F.col("value")).alias("change"))
        if i % every == 0 or i == rounds:
            state = mark(state)
            forget(made)
            made = state
            if tolerance is not None and state.agg(F.sum("change")).first()[0] < n * tolerance:
                break
        state = state.drop("change")
    return state.select("node_id", "value")


def target_distribution(nodes: DataFrame, ranking: Sequence[int], base: float = 0.5) -> DataFrame:
    """Normalised share of each group: base^place when ranked, 0.5^(s + 1) otherwise."""
    groups = nodes.select("group_id").distinct()
    weight = F.coalesce(F.pow(F.lit(base), lexi.position(F.col("group_id"), ranking)), F.lit(0.5 ** (len(ranking) + 1)))
    weighed = groups.select("group_id", weight.alias("w"))
    total = weighed.agg(F.sum("w").alias("t"))
    return weighed.crossJoin(F.broadcast(total)).select("group_id", (F.col("w") / F.col("t")).alias("share"))


def binary_target(nodes: DataFrame, ranking: Sequence[int], base: float = 0.5) -> DataFrame | None:
    """The same for rankings of exactly two groups, else None."""
    return target_distribution(nodes, ranking, base) if len(ranking) == 2 else None


def in_ranking(group: Column, ranking: Sequence[int]) -> Column:
    return group.isin([int(g) for g in ranking])
