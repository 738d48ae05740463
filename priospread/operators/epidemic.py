"""SIR spreading with deterministic coins, its thresholds, truth ranks and summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import rank_by
from ..plans.loops import cut, iterate, mark
from ..sources.text import Graph
from .degrees import degree

# Fixed values of the coin: a prime modulus and the factors and offsets of its rounds.
PRIME = 2_147_483_647
FACTORS = {"u": 7919, "v": 104729, "seed": 1299709, "sim": 15485863}
OFFSETS = (12345, 67891, 424243)
#: Open edges of one run that a task may hold (16 MB of ids); beyond, labels come from joins.
RUN_EDGES = 1_000_000


def threshold(graph: Graph) -> DataFrame:
    """One row: mean degree, mean squared degree, and <k> / (<k^2> - <k>) over all nodes."""
    k, k2 = F.avg("value"), F.avg(F.col("value") * F.col("value"))
    sums = degree(graph).agg(k.alias("mean_degree"), k2.alias("mean_squared_degree"))
    return sums.withColumn("threshold", F.when(F.col("mean_squared_degree") > F.col("mean_degree"), F.col("mean_degree") / (F.col("mean_squared_degree") - F.col("mean_degree"))))


def probability_grid(graph: Graph, low: float = 0.8, high: float = 2.0, steps: int = 20) -> DataFrame:
    """``step``, ``infection_prob``: evenly spaced multiples of the threshold, ends included."""
    t = threshold(graph).select("threshold", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return t.select("step", (F.col("threshold") * (F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("step") / F.lit(max(1, steps - 1)))).alias("infection_prob"))


def explicit_grid(spark, low: float, high: float, steps: int) -> DataFrame:
    return spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.lit(low) + F.lit(high - low) * F.col("id") / F.lit(max(1, steps - 1))).alias("infection_prob"))


def coin(u: Column, v: Column, seed: Column, sim: Column) -> Column:
    """An integer in [0, PRIME) for one attempt; non-linear, the same in any 64-bit engine."""
    h = (u * FACTORS["u"] + v * FACTORS["v"] + seed * FACTORS["seed"] + sim * FACTORS["sim"] + 17) % PRIME
    for c in OFFSETS:
        h = (h * h + c * (h % 65536) + c) % PRIME
    return h


def spread(graph: Graph, seeds: DataFrame, probability: float, simulations: int) -> DataFrame:
    """``seed``, ``sim``, ``node_id``, ``step``: everyone that each run reaches, the seed included.

    Rounds are synchronous; an infected node tries each susceptible neighbour once and recovers.
    All runs move together: one frontier join a round, keyed by (seed, run, node), until no run
    has an infected node.
    """
    adjacency = graph.cut().adjacency
    front = mark(seeds.select(F.col("node_id").alias("seed")).distinct().select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long"))).alias("sim")).select("seed", "sim", F.col("seed").alias("node_id"), F.lit(0).alias("step")))
    reached = front
    hit = coin(F.col("src"), F.col("dst"), F.col("seed"), F.col("sim")) < F.lit(int(probability * PRIME))
    step = 0
    while not front.isEmpty():
        step += 1
        tries = front.withColumnRenamed("node_id", "src").join(adjacency, "src").where(hit)
        new = tries.select("seed", "sim", F.col("dst").alias("node_id")).distinct().join(reached, ["seed", "sim", "node_id"], "left_anti")
        front = mark(new.withColumn("step", F.lit(step)))
        reached = reached.unionAll(front)
        if step % 8 == 0:
            reached = mark(reached)
    return reached


def reach(graph: Graph, seeds: DataFrame, probability: float, simulations: int) -> DataFrame:
    """``node_id``, ``group_id``, ``mean``, ``std``, ``num_simulations``: reached nodes per group.

    The deviation is that of the population; a group that a run does not reach counts 0. Moments
    come from sums, so the dense (seed, run, group) grid is never built.
    """
    got = spread(graph, seeds, probability, simulations).join(graph.nodes.withColumnRenamed("node_id", "n"), F.col("node_id") == F.col("n"))
    counts = got.groupBy("seed", "sim", "group_id").agg(F.count("*").alias("c"))
    sums = counts.groupBy("seed", "group_id").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    return _moments(graph, seeds, sums, simulations)


def _moments(graph: Graph, seeds: DataFrame, sums: DataFrame, simulations: int) -> DataFrame:
    """Mean and population deviation of every seed and group from the sums of counts and squares."""
    grid = seeds.select(F.col("node_id").alias("seed")).distinct().crossJoin(F.broadcast(graph.nodes.select("group_id").distinct()))  # a row per seed and group: the result itself
    mean = F.coalesce("s", F.lit(0)) / F.lit(simulations)
    var = F.coalesce("s2", F.lit(0)) / F.lit(simulations) - mean * mean
    return grid.join(sums, ["seed", "group_id"], "left").select(F.col("seed").alias("node_id"), "group_id", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), F.lit(simulations).cast("long").alias("num_simulations"))


def open_components(graph: Graph, probability: float, simulations: int, run_edges: int = RUN_EDGES) -> DataFrame:
    """``sim``, ``node_id``, ``component``: nodes with an open edge in a run and the smallest id they reach.

    An edge is open in a run by one coin for both directions. Runs are grouped by their number and
    labelled in one task each while a run's open edges are expected below ``run_edges`` (the edges
    are counted); larger graphs are labelled by joins until no label changes. Both give the same.
    """
    graph = graph.cut()
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long")))
    # Every edge becomes a row a run, so a table of few files is dealt to all cores first.
    edges = graph.edges.select("src", "dst").repartition(graph.edges.sparkSession.sparkContext.defaultParallelism)
    heads = coin(F.col("src"), F.col("dst"), F.lit(0).cast("long"), F.col("sim")) < F.lit(int(probability * PRIME))
    opened = edges.select("src", "dst", runs.alias("sim")).where(heads)
    if graph.edges.count() * probability <= run_edges:
        return opened.groupBy("sim").applyInPandas(_label_run, "sim long, node_id long, component long")
    opened = cut(opened)  # the coins are tossed once
    adjacency = cut(opened.select("sim", "src", "dst").unionAll(opened.select("sim", F.col("dst").alias("src"), F.col("src").alias("dst"))))

    def step(state: DataFrame) -> DataFrame:
        near = adjacency.join(state.select("sim", F.col("node_id").alias("dst"), "component"), ["sim", "dst"]).groupBy("sim", F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        low = state.join(near, ["sim", "node_id"]).select("sim", "node_id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = state.select("sim", F.col("node_id").alias("component"), F.col("component").alias("up"))
        return low.join(up, ["sim", "component"]).select("sim", "node_id", F.col("up").alias("component"), (F.col("up") < F.col("was")).alias("changed"))

    return iterate(adjacency.select("sim", F.col("src").alias("node_id")).distinct().withColumn("component", F.col("node_id")), step, "changed")


def _label_run(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest reachable id of every node of one run: least labels of neighbours, then of labels."""
    ids, codes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    a, b = codes[: len(pdf)], codes[len(pdf) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"sim": pdf["sim"].iloc[0], "node_id": ids, "component": ids[label]})


def percolated_reach(graph: Graph, probability: float, simulations: int, run_edges: int = RUN_EDGES) -> DataFrame:
    """The columns of ``reach`` for every node as a seed, with one set of runs for all seeds.

    Whoever is infected recovers after one round, so an edge is tried at most once in a run and
    whom a seed reaches is its component over the open edges: each seed's reach has the law that
    ``reach`` draws from. Within a run all seeds share the coins, so seeds are not independent of
    each other, runs are. Work grows with edges * runs, not with seeds * reached nodes * runs.
    """
    graph = graph.cut()
    labels = cut(open_components(graph, probability, simulations, run_edges))
    of = labels.join(graph.nodes.select("node_id", "group_id"), "node_id")
    counts = of.groupBy("sim", "component", "group_id").agg(F.count("*").alias("c"))
    sums = labels.join(counts, ["sim", "component"]).groupBy(F.col("node_id").alias("seed"), "group_id").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    # In runs without an open edge a node reaches itself alone.
    runs = labels.groupBy("node_id").agg(F.count("*").alias("joined"))
    alone = F.lit(simulations) - F.coalesce("joined", F.lit(0))
    alone = graph.nodes.select("node_id", "group_id").join(runs, "node_id", "left").select(F.col("node_id").alias("seed"), "group_id", alone.alias("s"), alone.alias("s2"))
    sums = sums.unionByName(alone).groupBy("seed", "group_id").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    return _moments(graph, graph.nodes, sums, simulations)


def reach_vectors(sir: DataFrame, ranking: Sequence[int], value: str = "mean") -> DataFrame:
    """``node_id``, ``vec``: values of the ranked groups in order, 0 where a group is missing."""
    parts = [F.coalesce(F.max(F.when(F.col("group_id") == g, F.col(value))), F.lit(0.0)) for g in ranking]
    return sir.groupBy("node_id").agg(F.array(*parts).alias("vec"))


def truth_rank_raw(sir: DataFrame, ranking: Sequence[int]) -> DataFrame:
    """Competition rank of the mean vectors, falling."""
    return rank_by(reach_vectors(sir, ranking), F.col("vec"), kind="competition")


def sem_bins(sir: DataFrame, percentile: float) -> DataFrame:
    """``bin`` of every (seed, group): mean in units of a noise level of the group.

    The level is the exact percentile of the positive standard errors, 1 / sqrt(n) without any;
    percentile 0 takes the dense index of the mean instead.
    """
    if not percentile:
        low = rank_by(sir, F.col("mean"), ["group_id"], "_r", descending=False)
        return low.select(*sir.columns, (F.col("_r") - 1).cast("long").alias("bin"))
    sem = F.col("std") / F.sqrt("num_simulations")
    eps = sir.groupBy("group_id").agg(F.percentile(F.when(sem > 0, sem), F.lit(percentile / 100)).alias("eps"), F.max(1 / F.sqrt("num_simulations")).alias("floor"))
    return sir.join(F.broadcast(eps), "group_id").select(*sir.columns, F.floor(F.col("mean") / F.coalesce("eps", "floor")).alias("bin"))


def truth_rank_snr(sir: DataFrame, ranking: Sequence[int], percentile: float) -> DataFrame:
    """Competition rank of the vectors of bins."""
    parts = [F.coalesce(F.max(F.when(F.col("group_id") == g, F.col("bin"))), F.lit(0)).cast("long") for g in ranking]
    vectors = sem_bins(sir.where(F.col("group_id").isin([int(g) for g in ranking])), percentile).groupBy("node_id").agg(F.array(*parts).alias("vec"))
    return rank_by(vectors, F.col("vec"), kind="competition")


def truth_rank_blended(sir: DataFrame, ranking: Sequence[int], beta: float, percentile: float = 0.0) -> DataFrame:
    """Bins (when the percentile is positive) or means, blended, then competition ranks."""
    from ..functions.lexi import blend_doubles

    source = sem_bins(sir, percentile).withColumn("v", F.col("bin").cast("double")) if percentile else sir.withColumn("v", F.col("mean"))
    vectors = reach_vectors(source, ranking, "v").select("node_id", blend_doubles(F.col("vec"), beta).alias("vec"))
    return rank_by(vectors, F.col("vec"), kind="competition")


def rank_by_total(sir: DataFrame) -> DataFrame:
    """``node_id``, ``total_mean``, ``rank``: seeds by their reach over all groups, largest first."""
    return rank_by(reach_totals(sir).select("node_id", "total_mean"), F.struct(F.round("total_mean", 9).alias("t")), kind="competition")


def reach_totals(sir: DataFrame) -> DataFrame:
    return sir.groupBy("node_id").agg(F.sum("mean").alias("total_mean"), F.max("num_simulations").alias("num_simulations"))


def summary(graph: Graph, sir: DataFrame, probability: float, coefficient: float = 1.0, least_share: float = 0.01, name: str = "graph") -> DataFrame:
    """One row of totals over seeds; significant: reach share above max(least_share, c * avg degree / n).

    The ratio divides by the graph's nodes, not by the seeds evaluated.
    """
    n, m = graph.nodes.agg(F.count("*").alias("n")), graph.edges.agg(F.count("*").alias("m"))
    t = reach_totals(sir).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m)).withColumn("pct", 100 * F.col("total_mean") / F.col("n"))
    level = F.greatest(F.lit(least_share), F.lit(coefficient) * 2 * F.col("m") / F.col("n") / F.col("n"))
    t = t.withColumn("hit", F.col("total_mean") / F.col("n") > level)
    of = lambda c, p: [F.avg(c).alias(f"mean_{p}"), F.median(c).alias(f"median_{p}"), F.min(c).alias(f"min_{p}"), F.max(c).alias(f"max_{p}"), F.percentile(c, F.lit(0.25)).alias(f"p25_{p}"), F.percentile(c, F.lit(0.75)).alias(f"p75_{p}")]
    out = t.agg(F.max("num_simulations").alias("num_simulations"), F.max("n").alias("num_nodes"), F.count("*").alias("num_nodes_evaluated"), *of("total_mean", "total"), *of("pct", "pct"), (2 * F.max("m") / F.max("n")).alias("avg_degree"), F.count_if("hit").alias("num_significant"))
    return out.select(F.lit(name).alias("graph_name"), F.lit(probability).alias("infection_prob"), *out.columns[:-1], F.lit(coefficient).alias("threshold_coefficient"), F.lit(100 * least_share).alias("significance_pct"), "num_significant", (F.col("num_significant") / F.col("num_nodes")).alias("significant_ratio"))


def usable_probabilities(summaries: DataFrame, low: float = 0.01, high: float = 0.20) -> DataFrame:
    """Rows whose share of significant seeds is neither tiny nor nearly everyone."""
    return summaries.where(F.col("significant_ratio").between(low, high))
