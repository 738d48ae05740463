"""Registered queries: each operator over whole tables, with the DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexi
from ..functions.ranks import fractional_rank, rank_by, restrict, select_nodes, tie_break
from ..operators import agreement, degrees, epidemic, fairrank, generate, graphstats, hindex, local, pagerank, paths, peel, registry, report, rollup, targets
from ..sources.tables import comoment_graph, cosource_graph, nation_trade_graph
from ..sources.text import Graph
from .loops import cut

#: The ranking, blend, spreading probability and runs that the queries use.
RANKING, BETA, PROBABILITY, RUNS, DIGITS = (0, 1), 30, 0.05, 20, 9
#: Runs for each seed on the customer graph, as many as in the reference's experiments.
SIR_RUNS = 1000
#: Betas of the registry query, those of the reference's experiments.
BETAS = (0.99, 0.5, 0.1, 0.01)
#: Rankings of the comparison queries.
RANKINGS = ((0, 1), (1, 0), (2, 3))


def _ranked(graph: Graph, df: DataFrame, value: str = "value", kind: str = "dense") -> DataFrame:
    return rank_by(df, F.col(value), kind=kind, rows=graph.nodes.count())


def _scored(graph: Graph, df: DataFrame) -> DataFrame:
    """Real-valued scores are rounded before they are ranked, so engines agree on ties."""
    return _ranked(graph, df.select("node_id", F.round("value", DIGITS).alias("value")))


def edges_customer_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return cosource_graph(spark, sf).edges


def degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _ranked(g, degrees.degree(g))


def degree_vector_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _ranked(g, degrees.degree_vector(g, RANKING), "vec").select("node_id", lexi.render(F.col("vec")).alias("value"), "rank")


def beta_degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _ranked(g, degrees.blended_degree_vector(g, RANKING, BETA), "vec").select("node_id", lexi.render(F.col("vec")).alias("value"), "rank")


def _h_rank(k: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        g = cosource_graph(spark, sf)
        return _ranked(g, hindex.h_chain(g, k))

    return query


def coreness_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _ranked(g, hindex.coreness(g))


def priority_core_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    cores = peel.frontier_cores(g, [RANKING]).select("node_id", "vec")
    return _ranked(g, cores, "vec").select("node_id", lexi.render(F.col("vec")).alias("value"), "rank")


def priority_core_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the distributed fix-point, on the nation graph."""
    g = nation_trade_graph(spark, sf)
    return _ranked(g, peel.fixpoint_cores(g, RANKING), "vec").select("node_id", lexi.render(F.col("vec")).alias("value"), "rank")


def clustering_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _scored(g, local.clustering_coefficient(g))


def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = targets.group_metrics(cosource_graph(spark, sf))
    return out.select("group_id", "size", F.round("coreness", DIGITS).alias("coreness"), F.round("degree", DIGITS).alias("degree"))


def target_strategies(spark: SparkSession, sf: str) -> DataFrame:
    m = targets.group_metrics(cosource_graph(spark, sf))
    s = targets.strategy_rankings(m.select("group_id", "size", F.round("coreness", DIGITS).alias("coreness"), F.round("degree", DIGITS).alias("degree")), [2, 3])
    return s.where(~F.col("strategy").startswith("mixed")).select("strategy", "length", F.array_join(F.col("groups").cast("array<string>"), "_").alias("ranking"))


def target_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rankings of all strategies, random ones included (their order is a hash)."""
    return targets.distinct_rankings(targets.strategy_rankings(targets.group_metrics(cosource_graph(spark, sf)), [2, 3], random_count=3))


def restricted_degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return restrict(_ranked(g, degrees.degree(g)), g.nodes, RANKING, rows=g.nodes.count()).select("node_id", "value", "rank")


def restricted_first_degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return restrict(_ranked(g, degrees.degree(g)), g.nodes, RANKING, first=True, rows=g.nodes.count()).select("node_id", "value", "rank")


def tiebreak_degree_h1(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf).cut()  # both ranks are of the same edges
    return tie_break(_ranked(g, degrees.degree(g)), _ranked(g, hindex.h_chain(g, 1)), rows=g.nodes.count()).select("node_id", "value", "rank")


def fractional_degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return fractional_rank(_ranked(g, degrees.degree(g), kind="competition"), "rank").select("node_id", "rank", "fractional_rank")


def epidemic_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = epidemic.threshold(cosource_graph(spark, sf))
    return out.select(*[F.round(c, DIGITS).alias(c) for c in out.columns])


def probability_grid(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.probability_grid(cosource_graph(spark, sf)).select("step", F.round("infection_prob", DIGITS).alias("infection_prob"))


def bfs3_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = paths.distances(cosource_graph(spark, sf), 3)
    return pairs.groupBy(F.col("src").alias("node_id"), "d").agg(F.count("*").alias("n"))


def local_gravity_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _scored(g, local.local_gravity(g))


def gravity_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _scored(g, local.gravity_centrality(g))


def extended_gravity_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _scored(g, local.extended_gravity(g))


def gravity_h_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return _scored(g, local.gravity_h_index(g))


def closeness_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    return _scored(g, paths.closeness(g))


def local_global_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    return _scored(g, local.local_global(g))


def entropy_degree_distance_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    return _scored(g, local.entropy_degree_distance(g))


def betweenness_rank(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    return _scored(g, paths.betweenness(g))


def component_ids(spark: SparkSession, sf: str) -> DataFrame:
    return paths.components(nation_trade_graph(spark, sf))


def largest_component_edges(spark: SparkSession, sf: str) -> DataFrame:
    return paths.largest_component(nation_trade_graph(spark, sf)).edges


def pagerank_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    return pagerank.pagerank(g, rounds=20, tolerance=None).select("node_id", F.round("value", DIGITS).alias("value"))


def pagerank_jump_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    return pagerank.pagerank(g, pagerank.exponential_jump(g, RANKING), rounds=20, tolerance=None).select("node_id", F.round("value", DIGITS).alias("value"))


def pagerank_uniform_jump_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    return pagerank.pagerank(g, pagerank.ranked_jump(g, RANKING), rounds=20, tolerance=None).select("node_id", F.round("value", DIGITS).alias("value"))


def target_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return pagerank.target_distribution(comoment_graph(spark, sf).nodes, RANKING).select("group_id", F.round("share", DIGITS).alias("share"))


def global_proportional_fair(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    ranks = pagerank.pagerank(g, rounds=20, tolerance=None)
    return fairrank.global_proportional(ranks, g.nodes, pagerank.target_distribution(g.nodes, RANKING)).select("node_id", F.round("value", DIGITS).alias("value"))


def lfpr_n_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    out = fairrank.neighbourhood_fair(g.links, g.nodes, pagerank.target_distribution(g.nodes, RANKING), rounds=20, epsilon=None)
    return out.select("node_id", F.round("value", DIGITS).alias("value"))


def two_groups(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The nodes as two groups (even, odd), and equal shares of both."""
    nodes = graph.nodes.select("node_id", F.pmod("group_id", F.lit(2)).cast("int").alias("group_id"))
    return nodes, nodes.select("group_id").distinct().withColumn("share", F.lit(0.5))


def lfpr_u_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    out = fairrank.step_fair(g.links, *two_groups(g), rounds=20, epsilon=None)
    return out.select("node_id", F.round("value", DIGITS).alias("value"))


def sir_reach(spark: SparkSession, sf: str) -> DataFrame:
    out = _reach(nation_trade_graph(spark, sf))
    return out.select("node_id", "group_id", F.round("mean", DIGITS).alias("mean"), F.round("std", DIGITS).alias("std"), "num_simulations")


def _reach(g: Graph) -> DataFrame:
    return epidemic.reach(g, g.nodes, PROBABILITY, RUNS)


def sir_truth_rank(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.truth_rank_raw(_reach(nation_trade_graph(spark, sf)), RANKING).select("node_id", "rank")


def sir_snr_rank(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.truth_rank_snr(_reach(nation_trade_graph(spark, sf)), RANKING, 50).select("node_id", "rank")


def sir_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    return epidemic.summary(g, _reach(g), PROBABILITY, name="nations").select("num_nodes", "num_nodes_evaluated", F.round("mean_total", DIGITS).alias("mean_total"), F.round("median_total", DIGITS).alias("median_total"), F.round("p75_total", DIGITS).alias("p75_total"), "num_significant", "significant_ratio")


def _customer_reach(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """The customer graph, which grows with the tables, and its reach in SIR_RUNS runs, each for all seeds."""
    g = cosource_graph(spark, sf)
    g = Graph(cut(g.nodes), cut(g.edges))
    return g, epidemic.percolated_reach(g, PROBABILITY, SIR_RUNS)


def sir_reach_cosource(spark: SparkSession, sf: str) -> DataFrame:
    out = _customer_reach(spark, sf)[1]
    return out.select("node_id", "group_id", F.round("mean", DIGITS).alias("mean"), F.round("std", DIGITS).alias("std"), "num_simulations")


def sir_truth_rank_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.truth_rank_raw(cut(_customer_reach(spark, sf)[1]), RANKING).select("node_id", "rank")


def sir_snr_rank_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.truth_rank_snr(cut(_customer_reach(spark, sf)[1]), RANKING, 50).select("node_id", "rank")


def sir_summary_cosource(spark: SparkSession, sf: str) -> DataFrame:
    g, sir = _customer_reach(spark, sf)
    return epidemic.summary(g, cut(sir), PROBABILITY, name="customers").select("num_nodes", "num_nodes_evaluated", F.round("mean_total", DIGITS).alias("mean_total"), F.round("median_total", DIGITS).alias("median_total"), F.round("p75_total", DIGITS).alias("p75_total"), "num_significant", "significant_ratio")


def component_ids_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return paths.components(cosource_graph(spark, sf))


def largest_component_edges_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return paths.largest_component(cosource_graph(spark, sf)).edges


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``ranking``, ``method``, ``node_id``, ``m``, ``s`` of three methods and rankings."""
    g = nation_trade_graph(spark, sf)
    g = Graph(cut(g.nodes), cut(g.edges))
    sir = cut(_reach(g))
    named = lambda df, name: df.select(F.lit(name).alias("method"), "node_id", "rank")
    fixed = named(_ranked(g, degrees.degree(g)), "degree").unionAll(named(_ranked(g, hindex.h_chain(g, 1)), "h1_index"))
    parts = []
    for r in RANKINGS:
        methods = fixed.unionAll(named(_ranked(g, degrees.degree_vector(g, r), "vec"), "degree_lexicographic"))
        truth = epidemic.truth_rank_raw(sir, r)
        parts.append(agreement.paired(methods, truth).select(F.lit(lexi.ranking_key(r)).alias("ranking"), "method", "node_id", "m", "s"))
    return cut(reduce(DataFrame.unionAll, parts))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.metrics(_pairs(spark, sf), ["ranking", "method"], top=(1, 5), percents=(10,))


def precision_mrr_arhr(spark: SparkSession, sf: str) -> DataFrame:
    out = _metrics(spark, sf)
    return out.select("ranking", "method", "num_common_nodes", "num_truth_top1", *[F.round(c, DIGITS).alias(c) for c in out.columns[4:]])


def kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    out = agreement.kendall_sql(_pairs(spark, sf), ["ranking", "method"])
    return out.select("ranking", "method", F.round("kendall_tau", DIGITS).alias("kendall_tau"))


def weighted_tau(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.kendall(_pairs(spark, sf), ["ranking", "method"])


def tie_statistics(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    out = agreement.tie_statistics(degrees.degree_vector(g, (0, 1, 2)), 3)
    return out.select("component_index", "num_nodes_tied", "num_unique_vectors", "num_nodes", F.round("fraction_tied", DIGITS).alias("fraction_tied"))


def tie_profile(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    out = agreement.tie_profile(_ranked(g, degrees.degree(g)).withColumn("method", F.lit("degree")))
    return out.select("method", "n_nodes", "n_unique_ranks", "max_tie_size", F.round("mean_tie_size", DIGITS).alias("mean_tie_size"), F.round("pct_tied", DIGITS).alias("pct_tied"))


def aggregate_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _metrics(spark, sf).withColumn("ranking_length", F.size(F.split("ranking", "_")))
    return rollup.aggregate_levels(rows, ["mrr", "precision_at_5"], {"by_method": ["method"], "by_ranking": ["method", "ranking"], "by_ranking_length": ["method", "ranking_length"]}, 6)


def _node_ranks(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    methods = pairs.select("ranking", "method", "node_id", F.col("m").alias("rank"))
    truths = pairs.select("ranking", "node_id", F.lit(PROBABILITY).alias("infection_prob"), F.col("s").alias("ground_truth_rank"), F.col("s").alias("sir_rank_snr")).distinct()
    return rollup.node_ranks(methods, truths, "nations")


def node_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _node_ranks(spark, sf).select("node_id", "method", "ground_truth_rank", "method_rank", "ranking", "n_nodes")


def cumulative_score(spark: SparkSession, sf: str) -> DataFrame:
    out = report.cumulative_scores(_node_ranks(spark, sf), [1, 3], [1, 5])
    return out.select("method", "k", "t", F.round("score", DIGITS).alias("score"))


def cumulative_score_percent(spark: SparkSession, sf: str) -> DataFrame:
    out = report.cumulative_scores(_node_ranks(spark, sf), [1], [5, 20], percent=True)
    return out.select("method", "k", "t", F.round("score", DIGITS).alias("score"))


def best_spreaders(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf)
    sir = cut(_reach(g))
    vectors = epidemic.reach_vectors(sir, RANKING).join(epidemic.reach_vectors(sir, RANKING, "std").withColumnRenamed("vec", "sd"), "node_id")
    methods = _ranked(g, degrees.degree(g)).withColumn("method", F.lit("degree")).select("method", "node_id", "rank")
    out = rollup.best_spreaders(methods, vectors, [5, 5])
    return out.select("method", "num_rank1_nodes", "num_best_spreaders", *[F.round(c, DIGITS).alias(c) for c in out.columns if "pct" in c])


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that no other beats in both retail price and size."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return report.pareto_front(part).select("p_partkey", "x", "y")


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    keys = [lexi.ranking_key(r) for r in RANKINGS]
    out = report.metric_table(_metrics(spark, sf).select("method", "ranking", F.round("mrr", DIGITS).alias("mrr")), "ranking", "mrr", keys)
    return out.select("method", *[F.col(k).alias(f"mrr_{k}") for k in keys])


def best_markers(spark: SparkSession, sf: str) -> DataFrame:
    return report.markers(_metrics(spark, sf).select("method", "ranking", F.col("mrr").alias("value")), "ranking").select("method", "ranking", F.round("value", 3).alias("value"), "marker")


def worst_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = _metrics(spark, sf).select(F.col("ranking").alias("graph_name"), "method", F.round("precision_at_5", 6).alias("score"))
    return report.gap_to_best(rows).select("method", F.round("worst_gap", 6).alias("worst_gap"))


def selected_nodes(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    both = _ranked(g, degrees.degree(g)).select("node_id", "rank").withColumn("method", F.lit("degree")).unionAll(_ranked(g, hindex.h_chain(g, 1)).select("node_id", "rank").withColumn("method", F.lit("h1_index")))
    return select_nodes(both, top=25)


def assortativity(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    out = graphstats.attribute_assortativity(g).crossJoin(graphstats.degree_assortativity(g))
    return out.select(*[F.round(c, DIGITS).alias(c) for c in out.columns])


def edge_mix(spark: SparkSession, sf: str) -> DataFrame:
    return graphstats.edge_mix(cosource_graph(spark, sf))


def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return graphstats.histogram(degrees.degree(cosource_graph(spark, sf)))


def graph_report(spark: SparkSession, sf: str) -> DataFrame:
    out = graphstats.report(nation_trade_graph(spark, sf))
    keep = ["n", "m", "min_degree", "max_degree", "median_degree", "n_components", "diameter"]
    return out.select(*[F.col(c).cast("long").alias(c) for c in keep], *[F.round(c, DIGITS).alias(c) for c in ("avg_degree", "density", "avg_clustering", "transitivity", "avg_path_length")])


def uniform_random_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded random graph of as many nodes as there are customers."""
    return generate.uniform_graph(spark, spark.read.parquet(f"{sf}/customer.parquet").count(), 6.0)


def block_random_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    return generate.block_graph(spark, [n // 2, n - n // 2], 6.0, 0.2)[0]


def method_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every named method, with the blended ones of all betas, through the registry on the nation graph."""
    g = nation_trade_graph(spark, sf)
    g = Graph(cut(g.nodes), cut(g.edges))
    return registry.run_methods(g, [RANKING], registry.all_names(BETAS), BETAS, graph_name="nations", workers=8, one_task=True)[0].drop("runtime")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        edges_customer_cosource, degree_rank, degree_vector_rank, beta_degree_rank, coreness_rank, priority_core_rank, priority_core_fixpoint,
        clustering_rank, group_metrics, target_strategies, target_rankings, restricted_degree_rank, restricted_first_degree_rank,
        tiebreak_degree_h1, fractional_degree_rank, epidemic_threshold, probability_grid, bfs3_counts, local_gravity_rank, gravity_rank,
        extended_gravity_rank, gravity_h_rank, closeness_rank, local_global_rank, entropy_degree_distance_rank, betweenness_rank,
        component_ids, largest_component_edges, pagerank_20, pagerank_jump_20, pagerank_uniform_jump_20, target_distribution,
        global_proportional_fair, lfpr_n_20, lfpr_u_20, sir_reach, sir_truth_rank, sir_snr_rank, sir_summary, precision_mrr_arhr,
        kendall_tau, weighted_tau, tie_statistics, tie_profile, aggregate_levels, node_ranks, cumulative_score, cumulative_score_percent,
        best_spreaders, pareto_front, metric_pivot, best_markers, worst_gap, selected_nodes, assortativity, edge_mix, degree_histogram,
        graph_report, uniform_random_graph, block_random_graph, method_registry,
        sir_reach_cosource, sir_truth_rank_cosource, sir_snr_rank_cosource, sir_summary_cosource, component_ids_cosource,
        largest_component_edges_cosource,
    ]
    return {f.__name__: f for f in plain} | {f"h{k}_rank": _h_rank(k) for k in (1, 2, 3)}


FLAGSHIP = degree_vector_rank
