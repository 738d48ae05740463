"""Reports on a graph: counts, degrees, clustering, assortativity, components, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from ..sources.text import Graph
from .degrees import degree
from .hindex import coreness
from .local import triangle_counts
from .paths import components, distances, largest_component

#: Nodes up to which path lengths are exact.
PATH_NODES = 10_000
#: Distinct values above which a histogram has buckets.
PLAIN_VALUES = 40


def mixing(graph: Graph) -> DataFrame:
    """``gs``, ``gd``, ``e``: edge ends by the groups of both nodes, both directions."""
    g = graph.nodes
    rows = graph.adjacency.join(g.select(F.col("node_id").alias("src"), F.col("group_id").alias("gs")), "src").join(g.select(F.col("node_id").alias("dst"), F.col("group_id").alias("gd")), "dst")
    return rows.groupBy("gs", "gd").agg(F.count("*").alias("e"))


def attribute_assortativity(graph: Graph) -> DataFrame:
    """(trace - sum of squares) / (1 - sum of squares) of the mixing matrix; null if undefined."""
    m = mixing(graph)
    total = m.agg(F.sum("e").alias("t"))
    a = m.groupBy("gs").agg(F.sum("e").alias("a")).crossJoin(F.broadcast(total)).agg(F.sum(F.col("a") * F.col("a") / F.col("t") / F.col("t")).alias("s"))
    trace = m.crossJoin(F.broadcast(total)).agg(F.sum(F.when(F.col("gs") == F.col("gd"), F.col("e") / F.col("t")).otherwise(F.lit(0.0))).alias("tr"))
    return a.crossJoin(trace).select(F.when(F.abs(1 - F.col("s")) > 1e-12, (F.col("tr") - F.col("s")) / (1 - F.col("s"))).alias("attribute_assortativity"))


def degree_assortativity(graph: Graph) -> DataFrame:
    """Correlation of the degrees at both ends over both directions of every edge."""
    d = cut(degree(graph))
    rows = graph.adjacency.join(d.select(F.col("node_id").alias("src"), F.col("value").cast("double").alias("x")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("value").cast("double").alias("y")), "dst")
    return rows.agg(F.corr("x", "y").alias("degree_assortativity"))


def edge_mix(graph: Graph) -> DataFrame:
    """Edges inside and between groups, and whether there is none inside; unknown groups differ."""
    g = graph.nodes
    rows = graph.edges.join(g.select(F.col("node_id").alias("src"), F.col("group_id").alias("gs")), "src", "left").join(g.select(F.col("node_id").alias("dst"), F.col("group_id").alias("gd")), "dst", "left")
    same = F.coalesce(F.col("gs") == F.col("gd"), F.lit(False))
    return rows.agg(F.count_if(same).alias("intra_edges"), F.count_if(~same).alias("inter_edges")).withColumn("multipartite", F.col("intra_edges") == 0)


def report(graph: Graph, paths: bool = True) -> DataFrame:
    """One row: sizes, density, degrees (upper median), components, clustering, assortativity, paths.

    Transitivity is 3 * triangles / connected triples; path lengths are those of the largest
    component and only for at most PATH_NODES nodes.
    """
    d = cut(degree(graph))
    n_nodes = d.count()
    deg = d.agg(F.count("*").alias("n"), (F.sum("value") / 2).cast("long").alias("m"), F.avg("value").alias("avg_degree"), F.min("value").alias("min_degree"), F.max("value").alias("max_degree"), F.expr("-percentile_disc(0.5) within group (order by -value)").cast("long").alias("median_degree"))
    deg = deg.withColumn("density", F.when(F.col("n") > 1, 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)))
    t = d.join(triangle_counts(graph), "node_id", "left").fillna(0, ["triangles"])
    pairs = F.col("value") * (F.col("value") - 1)
    clustering = t.agg(F.avg(F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(F.lit(0.0))).alias("avg_clustering"), F.when(F.sum(pairs) > 0, 2 * F.sum("triangles") / F.sum(pairs)).otherwise(F.lit(0.0)).alias("transitivity"))
    parts = components(graph).agg(F.countDistinct("component").alias("n_components"))
    out = deg.crossJoin(clustering).crossJoin(parts).crossJoin(edge_mix(graph)).crossJoin(attribute_assortativity(graph)).crossJoin(degree_assortativity(graph))
    if paths and n_nodes <= PATH_NODES:
        far = distances(largest_component(graph)).agg(F.max("d").alias("diameter"), F.avg("d").alias("avg_path_length"))
        out = out.crossJoin(far)
    return out


def graph_facts(graph: Graph) -> DataFrame:
    """One row: n, m, average and largest degree, largest core, groups, assortativity."""
    d = degree(graph).agg(F.count("*").alias("n"), (F.sum("value") / 2).cast("long").alias("m"), F.avg("value").alias("avg_degree"), F.max("value").alias("max_degree"))
    k = coreness(graph).agg(F.max("value").alias("max_coreness"))
    g = graph.nodes.agg(F.countDistinct("group_id").alias("num_groups"))
    return d.crossJoin(k).crossJoin(g).crossJoin(attribute_assortativity(graph))


def histogram(values: DataFrame, value: str = "value") -> DataFrame:
    """``bucket``, ``n``: counts, in buckets of max(1, (max - min + 1) // 40) beyond 40 values."""
    counts = values.groupBy(value).agg(F.count("*").alias("c"))
    facts = counts.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("k"))  # one row
    size = F.when(F.col("k") > PLAIN_VALUES, F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + 1) / PLAIN_VALUES))).otherwise(F.lit(1))
    at = counts.crossJoin(F.broadcast(facts)).select((F.col("lo") + F.floor((F.col(value) - F.col("lo")) / size) * size).cast("long").alias("bucket"), "c")
    return at.groupBy("bucket").agg(F.sum("c").alias("n"))


def equal_width_bins(values: DataFrame, value: str = "value", bins: int = 50) -> DataFrame:
    facts = values.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    at = values.crossJoin(F.broadcast(facts)).select(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).alias("bin"))
    return at.groupBy("bin").agg(F.count("*").alias("n"))
