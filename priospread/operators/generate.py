"""Seeded random graphs: uniform, block model, homophilous growth; group assignment."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.text import Graph
from .degrees import degree


def _coin(seed: int, *cols) -> Column:
    """A uniform number in [0, 1) from a hash: the same on every run and cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def random_pairs(spark: SparkSession, low: int, high: int, low2: int, high2: int, p: float, seed: int) -> DataFrame:
    """Each pair (src, dst) of two id ranges, src < dst, with probability ``p``.

    Geometric skips: per source, the gaps between its partners are drawn, so the cost follows the
    expected edges and not the squared nodes.
    """
    if p <= 0 or high <= low:
        return spark.createDataFrame([], "src long, dst long")
    src = spark.range(low, high).select(F.col("id").alias("src"))
    start = F.greatest(F.lit(low2), F.col("src") + 1)
    if p >= 1:
        return src.where(start < high2).select("src", F.explode(F.sequence(start, F.lit(high2 - 1))).alias("dst"))
    mean = (high2 - low2) * p
    draws = max(8, math.ceil(mean + 10 * math.sqrt(mean + 1)))
    gap = lambda k: F.floor(F.log(1 - _coin(seed, F.col("src"), k)) / F.lit(math.log1p(-p))) + 1
    gaps = src.select("src", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(draws)), gap)).alias("k", "gap"))
    at = F.sum("gap").over(Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.select("src", (start - 1 + at).cast("long").alias("dst")).where(F.col("dst") < high2)


def uniform_graph(spark: SparkSession, n: int, avg_degree: float, seed: int = 42) -> DataFrame:
    """Edges of a uniform random graph with p = avg_degree / (n - 1)."""
    return random_pairs(spark, 0, n, 0, n, min(1.0, avg_degree / max(1, n - 1)), seed)


def block_probabilities(sizes: Sequence[int], avg_degree: float, alpha: float) -> tuple[float, list[float]]:
    """Probability between blocks and inside each, clamped to [0, 1]; a single node has none."""
    n = sum(sizes)
    between = min(1.0, max(0.0, alpha * avg_degree / max(1, n - 1)))
    inside = [min(1.0, max(0.0, (avg_degree - between * (n - c)) / (c - 1))) if c > 1 else 0.0 for c in sizes]
    return between, inside


def block_graph(spark: SparkSession, sizes: Sequence[int], avg_degree: float, alpha: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Edges and blocks (node_id, group_id) of a stochastic block model."""
    between, inside = block_probabilities(sizes, avg_degree, alpha)
    ends = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    edges = None
    for i in range(len(sizes)):
        parts = [random_pairs(spark, ends[i], ends[i + 1], ends[i], ends[i + 1], inside[i], seed + 2 * i)]
        if i + 1 < len(sizes):
            parts.append(random_pairs(spark, ends[i], ends[i + 1], ends[i + 1], ends[-1], between, seed + 2 * i + 1))
        for p in parts:
            edges = p if edges is None else edges.unionAll(p)
    bounds = F.array(*[F.lit(e) for e in ends[1:]])
    return edges, spark.range(ends[-1]).select(F.col("id").alias("node_id"), F.size(F.filter(bounds, lambda b: b <= F.col("id"))).cast("int").alias("group_id"))


def assign_groups(nodes: DataFrame, fractions: Sequence[float], seed: int = 42) -> DataFrame:
    """Random groups of round(fraction * n) nodes, the remainder in the last one.

    Nodes are taken in the order of a seeded hash.
    """
    from ..functions.ranks import rank_by

    n = nodes.count()
    sizes = [round(f * n) for f in fractions[:-1]]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    placed = rank_by(nodes.select("node_id"), F.struct(F.xxhash64(F.lit(seed), "node_id"), "node_id"), name="_at", descending=False, rows=n)
    of = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("_at"))) if ends else F.lit(0)
    return placed.select("node_id", of.cast("int").alias("group_id"))


def grown_graph(spark: SparkSession, n: int, start: int, edges_each: int, minority: float, homophily: float | tuple[float, float], seed: int = 42, tries: int = 1000) -> Graph:
    """Preferential attachment with two groups, on the driver: growth is sequential by nature.

    Starts as a clique with both groups. ``homophily`` is one number or one for each group of the
    new node. A candidate, drawn by its degree before this node came, is tried again if it is linked
    already, if it has the same group and the draw is below the homophily, or if it has the other
    group and the draw is not. An edge that finds no end in ``tries`` is left out; only a node that
    got none at all is linked to one at random. The size is bounded by the driver's memory.
    """
    each = homophily if isinstance(homophily, tuple) else (homophily, homophily)
    rng = random.Random(seed)
    group = [int(rng.random() < minority) for _ in range(n)]
    if start >= 2 and len(set(group[:start])) < 2:
        group[0] = 1 - group[0]
    edges = [(a, b) for b in range(start) for a in range(b)]
    ends = [x for e in edges for x in e]  # a node as often as its degree
    for v in range(start, n):
        chosen: list[int] = []
        for _ in range(edges_each if ends else 0):
            for _ in range(tries):
                u, draw = rng.choice(ends), rng.random()
                same = group[u] == group[v]
                if u not in chosen and not (same and draw < each[group[v]]) and (same or draw < each[group[v]]):
                    chosen.append(u)
                    break
        if not chosen and v:
            chosen = [rng.randrange(v)]
        for u in chosen:
            edges.append((u, v))
            ends += [u, v]
    nodes = spark.createDataFrame(list(enumerate(group)), "node_id long, group_id int")
    return Graph(nodes, spark.createDataFrame(sorted(edges), "src long, dst long"))


def metadata(graph: Graph, name: str, seed: int, replicate: int = 0) -> DataFrame:
    """One row: nodes, edges, actual average degree and the size of each group."""
    d = degree(graph).agg(F.count("*").alias("num_nodes"), (F.sum("value") / 2).cast("long").alias("num_edges"), F.avg("value").alias("actual_avg_degree"))
    g = graph.nodes.groupBy("group_id").agg(F.count("*").alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", "c")))).alias("group_counts"))
    return d.crossJoin(g).select(F.lit(name).alias("name"), F.lit(seed).alias("random_seed"), F.lit(replicate).alias("replicate_id"), "*")


def replicate_seed(base: int, replicate: int) -> int:
    return base + replicate * 1000


def group_sizes(n: int, groups: int, distribution: str, minority: float = 0.1) -> list[int]:
    """Nodes of each group: all alike (``uniform``), or one large group and small ones (``imbalanced``)."""
    if distribution == "uniform":
        return [n // groups + (i < n % groups) for i in range(groups)]
    small = [round(minority * n)] * (groups - 1)
    return [n - sum(small), *small]


def from_config(spark: SparkSession, config: dict, replicate: int = 0) -> tuple[str, Graph]:
    """Name and graph of one entry of a configuration.

    Keys: name, type (ER or SBM), n, avg_degree, num_groups, group_sizes (fractions of n that add
    up to 1), group_assignment (random, or aligned with the communities), and for SBM
    community_sizes and alpha; random_seed, 1000 further for each replicate.
    """
    seed = replicate_seed(int(config.get("random_seed", 42)), replicate)
    n, degree_ = int(config["n"]), float(config["avg_degree"])
    fractions, assignment = [float(f) for f in config["group_sizes"]], config.get("group_assignment", "random")
    if len(fractions) != int(config.get("num_groups", len(fractions))) or abs(sum(fractions) - 1) >= 1e-6:
        raise ValueError(f"group_sizes must be num_groups fractions that add up to 1: {fractions}")
    communities = None
    if config["type"] == "ER":
        edges = uniform_graph(spark, n, degree_, seed)
    elif config["type"] == "SBM":
        sizes = [int(c) for c in config["community_sizes"]]
        if sum(sizes) != n:
            raise ValueError(f"community_sizes must add up to n: {sizes}")
        edges, communities = block_graph(spark, sizes, degree_, float(config.get("alpha", 0.2)), seed)
    else:
        raise ValueError(f"unknown graph type: {config['type']}")
    if assignment == "random":
        nodes = assign_groups(spark.range(n).select(F.col("id").alias("node_id")), fractions, seed)
    elif assignment == "aligned" and communities is not None:
        nodes = communities
    else:
        raise ValueError(f"unknown group assignment for {config['type']}: {assignment}")
    return f"{config['name']}_rep{replicate}", Graph(nodes, edges)


def generate_all(spark: SparkSession, config: dict, folder: str, tier: str = "all") -> list[str]:
    """Write every graph of a configuration's tier (sir_optimal, fast_only or all) in all its replicates."""
    tiers = ("sir_optimal", "fast_only")
    if tier not in (*tiers, "all"):
        raise ValueError(f"unknown tier: {tier}")
    common, names = config["global"], []
    for entry in (x for t in tiers if tier in (t, "all") for x in config["graphs"].get(t) or []):
        entry = entry | {"random_seed": common["random_seed"]}
        for replicate in range(int(common["replicates_per_config"])):
            name, graph = from_config(spark, entry, replicate)
            write_graph(graph, folder, name, replicate_seed(int(entry["random_seed"]), replicate), replicate)
            names.append(name)
    return names


def write_graph(graph: Graph, folder: str, name: str, seed: int, replicate: int = 0) -> None:
    """Edge and group text files (``u v`` and ``node group`` lines) and the metadata as JSON."""
    graph = graph.cut()
    line = lambda df, a, b: df.select(F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("value"))
    line(graph.edges, "src", "dst").write.mode("overwrite").text(f"{folder}/{name}_edges.txt")
    line(graph.nodes, "node_id", "group_id").write.mode("overwrite").text(f"{folder}/{name}_groups.txt")
    files = {"edge_file": f"{name}_edges.txt", "group_file": f"{name}_groups.txt"}
    out = metadata(graph, name, seed, replicate).withColumn("num_groups", F.size("group_counts"))
    out.withColumns({k: F.lit(v) for k, v in files.items()}).write.mode("overwrite").json(f"{folder}/{name}_metadata.json")
