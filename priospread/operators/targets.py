"""Group rankings: metrics of groups, the strategies that order them, and their deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut
from ..sources.text import Graph
from .degrees import degree
from .hindex import coreness

# Metric names of the strategies.
METRICS = ("size", "coreness", "degree")
DIRECTIONS = ("top", "bottom", "alt")


def group_metrics(graph: Graph, cores: DataFrame | None = None) -> DataFrame:
    """``group_id``, ``size``, ``coreness``, ``degree``: count and means of each group."""
    cores = coreness(graph) if cores is None else cores
    rows = graph.nodes.join(degree(graph).withColumnRenamed("value", "deg"), "node_id").join(cores.withColumnRenamed("value", "core"), "node_id")
    return rows.groupBy("group_id").agg(F.count("*").cast("double").alias("size"), F.avg("core").alias("coreness"), F.avg("deg").alias("degree"))


def strategy_rankings(metrics: DataFrame, lengths: Sequence[int], random_count: int = 0, seed: int = 42) -> DataFrame:
    """``strategy``, ``length``, ``groups`` of all strategies over one row per group.

    Order: metric falling, ties by group id. top: the first s; bottom: the last s of the same
    order, not reversed; alt: first, last, second, last but one, ...; mixed: the best group by
    one metric, then the best or worst by another, always two groups; random: s groups in the
    order of a seeded hash. alt and mixed need s of 2 or more.
    """
    metrics = cut(metrics)
    n = metrics.count()
    if max(lengths) > n:
        raise ValueError(f"a ranking of {max(lengths)} of {n} groups")
    long = metrics.select("group_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("e")).select("group_id", "e.*")
    down = Window.partitionBy("metric").orderBy(F.desc("v"), "group_id")
    order = long.withColumn("rn", F.row_number().over(down)).withColumn("n", F.lit(n))
    sizes = F.explode(F.array(*[F.lit(s) for s in sorted(set(lengths))]))
    at = order.select("metric", "group_id", "rn", "n", sizes.alias("length"))
    place = F.when(F.col("rn") * 2 <= F.col("n") + 1, 2 * F.col("rn") - 1).otherwise(2 * (F.col("n") - F.col("rn") + 1))
    kinds = F.array(
        F.when(F.col("rn") <= F.col("length"), F.struct(F.lit("top").alias("kind"), F.col("rn").alias("k"))),
        F.when(F.col("rn") > F.col("n") - F.col("length"), F.struct(F.lit("bottom").alias("kind"), F.col("rn").alias("k"))),
        F.when((F.col("length") >= 2) & (place <= F.col("length")), F.struct(F.lit("alt").alias("kind"), place.cast("int").alias("k"))),
    )
    picked = at.select("metric", "length", "group_id", F.explode(F.array_compact(kinds)).alias("e")).select("metric", "length", "group_id", "e.*")
    listed = lambda rows, *keys: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "group_id"))), lambda x: x["group_id"]).alias("groups"))
    plain = listed(picked, "kind", "metric", "length").select(F.concat_ws("_", "kind", "metric").alias("strategy"), "length", "groups")
    ends = order.where("rn = 1 or rn = n")
    first = ends.where("rn = 1").select(F.col("metric").alias("m1"), F.col("group_id").alias("g1"))
    second = ends.select(F.col("metric").alias("m2"), F.col("group_id").alias("g2"), F.explode(F.array_compact(F.array(F.when(F.col("rn") == 1, "top"), F.when(F.col("rn") == F.col("n"), "bottom")))).alias("end"))
    mixed = first.join(second, F.col("m1") != F.col("m2")).select(F.concat_ws("_", F.lit("mixed_top"), "m1", "end", "m2").alias("strategy"), F.array("g1", "g2").alias("groups"))
    mixed = mixed.crossJoin(F.broadcast(metrics.sparkSession.range(1).select(sizes.alias("length")).where("length >= 2"))).select("strategy", "length", "groups")
    out = plain.unionByName(mixed)
    if random_count:
        draws = metrics.select("group_id", F.explode(F.sequence(F.lit(1), F.lit(random_count))).alias("draw"), sizes.alias("length")) if len(set(lengths)) == 1 else metrics.select("group_id", F.explode(F.sequence(F.lit(1), F.lit(random_count))).alias("draw")).select("*", sizes.alias("length"))
        shuffled = Window.partitionBy("draw", "length").orderBy(F.xxhash64(F.lit(seed), "draw", "length", "group_id"), "group_id")
        drawn = draws.withColumn("k", F.row_number().over(shuffled)).where("k <= length")
        out = out.unionByName(listed(drawn, "draw", "length").select(F.concat(F.lit("random_"), F.col("draw").cast("string")).alias("strategy"), "length", "groups"))
    return out


def distinct_rankings(strategies: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``ranking``, ``groups``, ``strategies``: one row per ranking without repeated groups.

    ``names`` keeps strategies by their whole name or their part before the first underscore.
    """
    rows = strategies.where(F.size(F.array_distinct("groups")) == F.size("groups"))
    if names and "all" not in names:
        rows = rows.where(F.col("strategy").isin(list(names)) | F.element_at(F.split("strategy", "_"), 1).isin(list(names)))
    key = F.array_join(F.col("groups").cast("array<string>"), "_").alias("ranking")
    return rows.groupBy(key, "groups").agg(F.transform(F.array_sort(F.collect_list(F.struct("length", "strategy"))), lambda x: x["strategy"]).alias("strategies"))


def ranking_facts(rankings: DataFrame) -> DataFrame:
    """Length and first strategy of each ranking."""
    return rankings.select("ranking", F.size("groups").alias("ranking_length"), F.element_at("strategies", 1).alias("ranking_strategy"))
