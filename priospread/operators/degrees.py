"""Degrees and per-group degree vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexi
from ..sources.text import Graph


def degree(graph: Graph) -> DataFrame:
    """``node_id``, ``value``: neighbours of every node, 0 for isolated ones."""
    counts = graph.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("value"))
    return graph.nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def degree_vector(graph: Graph, ranking: Sequence[int], active: DataFrame | None = None) -> DataFrame:
    """``node_id``, ``vec``: neighbours in each ranked group; a node counts itself in its own group.

    With ``active`` (node_id) only those nodes and the edges between them count.
    """
    nodes = graph.nodes if active is None else graph.nodes.join(active.select("node_id").distinct(), "node_id", "left_semi")
    placed = nodes.select("node_id", lexi.position(F.col("group_id"), ranking).alias("pos"))
    towards = placed.where("pos is not null").select(F.col("node_id").alias("dst"), "pos")
    counts = [F.count_if(F.col("pos") == i).alias(f"n{i}") for i in range(len(ranking))]
    seen = graph.adjacency.join(towards, "dst").groupBy(F.col("src").alias("node_id")).agg(*counts)
    own = [(F.coalesce(f"n{i}", F.lit(0)) + F.coalesce((F.col("pos") == i).cast("int"), F.lit(0))).cast("long") for i in range(len(ranking))]
    return placed.join(seen, "node_id", "left").select("node_id", F.array(*own).alias("vec"))


def blended_degree_vector(graph: Graph, ranking: Sequence[int], beta: int, scale: int = 100) -> DataFrame:
    """Degree vectors whose components carry ``beta / scale`` of the next one, as integers."""
    return degree_vector(graph, ranking).select("node_id", lexi.blend(F.col("vec"), beta, scale).alias("vec"))
