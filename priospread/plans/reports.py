"""Registered queries of report transforms and roll-ups over results drawn from the line items, each with its DuckDB SQL.

A line item is a result: its flag and status name the graph, the quarter of its shipping the ranking, its line
number the method, its tax the probability, and its discount, price and quantity the measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexi
from ..operators import agreement, degrees, epidemic, fairrank, pagerank, report, rollup
from ..sources.tables import comoment_graph, nation_trade_graph
from . import oracles as o
from . import queries as base
from .loops import cut

# What stands for line numbers and for quarters.
METHODS = {1: "lexipeeling", 2: "lexipeeling_degree", 3: "degree", 4: "coreness", 5: "pagerank", 6: "h1_index", 7: "random"}
RANKINGS = {1: "0_1", 2: "1_0", 3: "2_3_0", 4: "3"}


def _map(number, names: dict[int, str]):
    out = F
    for k, v in names.items():
        out = out.when(number == k, v)
    return out.otherwise(F.lit("other"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select(
        F.concat("l_returnflag", "l_linestatus").alias("graph_name"), _map(F.quarter("l_shipdate"), RANKINGS).alias("ranking"), _map(F.col("l_linenumber"), METHODS).alias("method"),
        F.col("l_tax").cast("double").alias("infection_prob"), F.col("l_partkey").cast("long").alias("node_id"), F.col("l_suppkey").cast("long").alias("k"),
        F.col("l_discount").cast("double").alias("mrr"), (F.col("l_extendedprice") / 100_000).alias("arhr"), F.col("l_quantity").cast("double").alias("reach"),
    )


LINES = f"""ln AS MATERIALIZED (SELECT l_returnflag || l_linestatus AS graph_name, CASE quarter(l_shipdate) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in RANKINGS.items())} ELSE 'other' END AS ranking,
  CASE l_linenumber {' '.join(f"WHEN {k} THEN '{v}'" for k, v in METHODS.items())} ELSE 'other' END AS method, l_tax::DOUBLE AS infection_prob, l_partkey::BIGINT AS node_id, l_suppkey::BIGINT AS k,
  l_discount::DOUBLE AS mrr, l_extendedprice / 100000 AS arhr, l_quantity::DOUBLE AS reach FROM lineitem)"""


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("method").agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("arhr"), 3).alias("arhr"), F.round(F.avg("reach"), 1).alias("reach"))


LEVELS = "lv AS (SELECT method, round(avg(mrr), 6) AS mrr, round(avg(arhr), 3) AS arhr, round(avg(reach), 1) AS reach FROM ln GROUP BY method)"
#: Ranks of parts by the lines of a method and ranking.
RANKED = "rk AS MATERIALIZED (SELECT method, ranking, node_id, count(*) AS c, CAST(rank() OVER (PARTITION BY method, ranking ORDER BY count(*) DESC) AS INTEGER) AS rank FROM ln GROUP BY method, ranking, node_id)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.ranks import rank_by

    counts = cut(_lines(spark, sf).groupBy("method", "ranking", "node_id").agg(F.count("*").alias("c")))
    return rank_by(counts, F.col("c"), ["method", "ranking"], "rank", "competition", rows=counts.count())


def metric_selection(spark: SparkSession, sf: str) -> DataFrame:
    return report.selection(_levels(spark, sf), ["mrr", "arhr"], 2)


def method_places(spark: SparkSession, sf: str) -> DataFrame:
    return report.method_order(_levels(spark, sf).select("method"), [["coreness", "degree"], ["random"]])


def peel_variants(spark: SparkSession, sf: str) -> DataFrame:
    return report.variants(_levels(spark, sf)).select("method", "composite", "mrr")


def column_wins(spark: SparkSession, sf: str) -> DataFrame:
    return report.wins(_levels(spark, sf), ["mrr", "arhr", "reach"], 2)


def best_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return report.best_baseline(_levels(spark, sf), "mrr")


def spread_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.aggregate_level(_lines(spark, sf), ["method"], ["reach"], ["k"])
    return report.mean_and_spread(rows, "reach").select("method", "cell", "k_min", "k_max", "count")


def measure_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return report.quartiles(_lines(spark, sf), ["method", "ranking"], "reach")


def strategy_versus(spark: SparkSession, sf: str) -> DataFrame:
    levels = _lines(spark, sf).groupBy("graph_name", F.col("ranking").alias("ranking_strategy"), "method").agg(F.round(F.avg("mrr"), 4).alias("mrr"))
    out = report.strategy_comparison(levels, "lexipeeling", "degree", "mrr", least_datasets=2)
    return out.select("ranking_strategy", F.round("mean_a", 9).alias("mean_a"), F.round("mean_b", 9).alias("mean_b"), "wins", "ties", "losses", "datasets")


def beta_reach_curves(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).groupBy(F.col("ranking").alias("position"), F.col("infection_prob").alias("beta")).agg(F.avg("reach").alias("pct"))
    return report.beta_reach(rows).select("position", "beta", F.round("pct", 9).alias("pct"), F.round("relative", 9).alias("relative"))


def beta_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = report.reach_by_beta(_lines(spark, sf).withColumnRenamed("ranking", "betas_group"))
    return out.select("method", *[F.round(c, 9).alias(f"b_{c}") for c in sorted(RANKINGS.values())])


def sem_tie_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select("method", "ranking", "infection_prob", F.col("reach").alias("sem_0"), (F.col("reach") % 7).alias("sem_50"))
    out = report.sem_ties(rows, ["sem_0", "sem_50"], 0.03)
    return out.select("sem", *[F.round(c, 9).alias(c) for c in ("n_nodes", "n_unique", "mean_tie")])


def cumulative_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative scores of parts that stand high by lines, judged by their rank over all methods, as a table."""
    ranks, whole = _ranked(spark, sf), _lines(spark, sf).groupBy("node_id").agg(F.count("*").alias("all"))
    from ..functions.ranks import rank_by

    truth = rank_by(cut(whole), F.col("all"), (), "sir_rank_snr", "competition")
    n = ranks.groupBy("method", "ranking").agg(F.count("*").alias("n_nodes"))
    rows = ranks.withColumnRenamed("rank", "method_rank").join(truth.select("node_id", "sir_rank_snr"), "node_id").join(n, ["method", "ranking"]).withColumn("infection_prob", F.lit(0.1))
    out = report.cumulative_table(report.cumulative_scores(rows, [50], [100, 500]), 50, [100, 500])
    return out.select("method", *[F.round(str(t), 9).alias(f"t_{t}") for t in (100, 500)])


def enriched_results(spark: SparkSession, sf: str) -> DataFrame:
    comparisons = _lines(spark, sf).groupBy("ranking", "method").agg(F.round(F.avg("mrr"), 6).alias("mrr"))
    rankings = _lines(spark, sf).select("ranking").distinct().where("ranking <> '3'").withColumn("strategies", F.array(F.concat(F.lit("top_"), F.substring("ranking", 1, 1)), F.lit("more")))
    return rollup.enrich(comparisons, rankings, _ranked(spark, sf).where("method <> 'random'"))


def degeneracy_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    vectors = lines.groupBy("ranking").agg(F.array((F.count("*") % 3).cast("long"), (F.count("*") % 2).cast("long")).alias("vec"))
    out = rollup.by_degeneracy(lines, vectors, ["mrr"])
    return out.select("method", lexi.render(F.col("degeneracy")).alias("degeneracy"), "mrr_mean", "mrr_std", "count")


def probability_means(spark: SparkSession, sf: str) -> DataFrame:
    best = _lines(spark, sf).groupBy("graph_name", "ranking", "method", "infection_prob").agg(F.avg("reach").alias("group_1_pct_mean"), F.stddev_pop("reach").alias("group_1_pct_std"), F.count("*").alias("num_rank1_nodes"))
    out = rollup.reach_over_probabilities(best)
    return out.select("graph_name", "ranking", "method", *[F.round(c, 9).alias(c) for c in ("group_1_pct_mean", "group_1_pct_std", "num_rank1_nodes")], "num_probabilities")


def first_node_details(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-1 nations of two methods with truth ranks and total reach."""
    g = nation_trade_graph(spark, sf).cut()
    sir = cut(base._reach(g))
    methods = base._ranked(g, degrees.degree(g)).select(F.lit("degree").alias("method"), "node_id", "rank").unionAll(g.nodes.select(F.lit("all"), "node_id", F.lit(1)))
    out = rollup.top1_detail(methods, epidemic.truth_rank_raw(sir, base.RANKING), epidemic.reach_totals(sir))
    ids = F.array_join(F.transform("nodes", lambda x: F.concat_ws(":", x["node_id"].cast("string"), x["truth"].cast("string"))), ",")
    return out.select("method", ids.alias("nodes"), F.round("mean_sir_total", base.DIGITS).alias("mean_sir_total"), F.round("std_sir_total", base.DIGITS).alias("std_sir_total"))


def tie_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Ties of (quantity, discount, tax) prefixes, per ranking, summed up over rankings."""
    vec = F.array("reach", "mrr", "arhr")
    parts = None
    for r in RANKINGS.values():
        one = agreement.tie_statistics(_lines(spark, sf).where(F.col("ranking") == r).select(vec.alias("vec")), 3)
        parts = one if parts is None else parts.unionAll(one)
    out = agreement.tie_summary(parts)
    return out.select("variant", "component_index", *[F.round(c, 9).alias(c) for c in out.columns if "_mean" in c or c.endswith(("_min", "_max"))], "count")


def top_detail(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_trade_graph(spark, sf).cut()
    sir = cut(base._reach(g))
    methods = base._ranked(g, degrees.degree(g)).select(F.lit("degree").alias("method"), "node_id", "rank")
    out = agreement.top_k_detail(methods, epidemic.truth_rank_raw(sir, base.RANKING), 3, epidemic.reach_vectors(sir, base.RANKING).withColumnRenamed("vec", "reach"))
    return out.select("method", "node_id", "method_rank", "ground_truth_rank", *[F.round(F.col("reach")[i], base.DIGITS).alias(f"reach_{i}") for i in (0, 1)])


def node_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees, homophily both ways and place by PageRank of the moment graph's users, with the step rule's excess."""
    g = comoment_graph(spark, sf).cut()
    scores = pagerank.pagerank(g, rounds=20, tolerance=None).select("node_id", F.round("value", base.DIGITS).alias("value"))
    out = fairrank.local_metrics(g.links, g.nodes, cut(scores), fairrank.default_phi(g.nodes))
    return out.select("node_id", "group_id", "out_degree", "in_degree", *[F.round(c, base.DIGITS).alias(c) for c in ("out_homophily", "in_homophily", "excess")], "position")


def attribute_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """PageRank with jumps to the users of one event type."""
    g = comoment_graph(spark, sf).cut()
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null")
    attributes = events.select(F.col("user_id").cast("long").alias("node_id"), F.pmod(F.dayofmonth("ts"), F.lit(7)).alias("attribute"))
    jump = fairrank.attribute_jump(g.nodes, attributes, 3)
    out = pagerank.pagerank(g, jump, rounds=15, tolerance=None)
    return out.select("node_id", F.round("value", base.DIGITS).alias("value"))


def lfpr_p_10(spark: SparkSession, sf: str) -> DataFrame:
    """The step rule whose buckets are spread by plain PageRank."""
    g = comoment_graph(spark, sf).cut()
    nodes, phi = base.two_groups(g)
    plain = pagerank.pagerank(g, rounds=10, tolerance=None)
    out = fairrank.step_fair_proportional(g.links, nodes, phi, plain=plain, rounds=10, epsilon=None)
    return out.select("node_id", F.round("value", base.DIGITS).alias("value"))


def _fair(spark: SparkSession, sf: str, work) -> DataFrame:
    """``work`` over the moment graph's two groups and plain PageRank of ten rounds."""
    g = comoment_graph(spark, sf).cut()
    nodes, phi = base.two_groups(g)
    plain = cut(pagerank.pagerank(g, rounds=10, tolerance=None))
    return work(g.links, nodes, phi, plain).select("node_id", F.round("value", base.DIGITS).alias("value"))


def global_uniform_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Even corrections that drive nodes below zero: their debts are taken from the rest of the group, round by round."""
    g = comoment_graph(spark, sf).cut()
    ranks = pagerank.pagerank(g, rounds=10, tolerance=None)
    out = fairrank.global_uniform(ranks, g.nodes, pagerank.target_distribution(g.nodes, (0, 1, 2, 3, 4), 0.25))
    return out.select("node_id", F.round("value", base.DIGITS).alias("value"))


def hybrid_top_10(spark: SparkSession, sf: str) -> DataFrame:
    return _fair(spark, sf, lambda e, n, phi, plain: fairrank.hybrid_top(e, n, phi, 7, plain, rounds=10, epsilon=None))


def target_fair_10(spark: SparkSession, sf: str) -> DataFrame:
    """Fairness among the 30 users of most PageRank, the rest spread evenly."""
    return _fair(spark, sf, lambda e, n, phi, plain: fairrank.target_fair(e, n, phi, fairrank.top_targets(e, n, 30, plain), "uniform", 30, 10, None, plain))


def target_fair_near_10(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the rest spread over a node's own neighbours among them."""
    return _fair(spark, sf, lambda e, n, phi, plain: fairrank.target_fair(e, n, phi, fairrank.top_targets(e, n, 30, plain), "neighbourhood", 30, 10, None, plain))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        metric_selection, method_places, peel_variants, column_wins, best_baselines, spread_cells, measure_quartiles, strategy_versus,
        beta_reach_curves, beta_pivot, sem_tie_table, cumulative_pivot, enriched_results, degeneracy_levels, probability_means,
        first_node_details, tie_summaries, top_detail, node_positions, attribute_pagerank, lfpr_p_10,
        global_uniform_debt, hybrid_top_10, target_fair_10, target_fair_near_10,
    )}


def _debts(rounds: int) -> list[str]:
    out = ["ph AS (SELECT group_id, w / sum(w) OVER () AS share FROM (SELECT group_id, pow(0.25::DOUBLE, group_id) AS w FROM (SELECT DISTINCT group_id FROM nodes)))",
           "ms AS (SELECT group_id, sum(value) AS mass, count(*) AS size FROM pr JOIN nodes USING (node_id) GROUP BY group_id)",
           "u0 AS MATERIALIZED (SELECT node_id, n.group_id, value + (share - mass) / size AS value FROM pr JOIN nodes n USING (node_id) JOIN ms ON ms.group_id = n.group_id JOIN ph ON ph.group_id = n.group_id)"]
    for k in range(1, rounds + 1):
        out.append(f"""u{k} AS MATERIALIZED (SELECT node_id, group_id, CASE WHEN value < 0 THEN 0 WHEN value > 0 THEN value - debt / rich ELSE value END AS value FROM (
  SELECT *, sum(CASE WHEN value < 0 THEN -value ELSE 0 END) OVER (PARTITION BY group_id) AS debt, count(*) FILTER (value > 0) OVER (PARTITION BY group_id) AS rich FROM u{k - 1}))""")
    return out


def oracle_sql() -> dict[str, str]:
    q, digits = o.q, base.DIGITS
    vec = [f"coalesce(max(mean) FILTER (group_id = {g}), 0.0)" for g in base.RANKING]
    is_peel = "contains(method, 'lexipeeling')"
    prefixes = " UNION ALL ".join(f"SELECT ranking, {i} AS component_index, [reach, mrr, arhr][1:{i}] AS p FROM ln" for i in (1, 2, 3))
    degeneracy = "gv AS (SELECT ranking, (count(*) % 3) || '_' || (count(*) % 2) AS degeneracy FROM ln GROUP BY ranking)"
    return {
        "metric_selection": q(LINES, LEVELS, "lg AS (SELECT method, 'a' AS m, mrr AS v FROM lv UNION ALL SELECT method, 'b', arhr FROM lv)", "SELECT method FROM (SELECT *, rank() OVER (PARTITION BY m ORDER BY v DESC) AS r FROM lg) WHERE r <= 2 UNION SELECT method FROM lv WHERE method = 'lexipeeling'"),
        "method_places": q(LINES, LEVELS, f"SELECT method, CASE WHEN {is_peel} THEN 0 WHEN method IN ('coreness', 'degree') THEN 1 WHEN method = 'random' THEN 2 ELSE 3 END AS place FROM lv"),
        "peel_variants": q(LINES, LEVELS, f"SELECT method, contains(method, 'lexipeeling_degree') AS composite, mrr FROM lv WHERE {is_peel}"),
        "column_wins": q(LINES, LEVELS, "SELECT method, (round(mrr, 2) = max(round(mrr, 2)) OVER ())::INTEGER + (round(arhr, 2) = max(round(arhr, 2)) OVER ())::INTEGER + (round(reach, 2) = max(round(reach, 2)) OVER ())::BIGINT AS wins FROM lv"),
        "best_baselines": q(LINES, LEVELS, f"SELECT method, mrr AS v FROM lv WHERE NOT {is_peel} ORDER BY mrr DESC, method DESC LIMIT 1"),
        "spread_cells": q(LINES, "st AS (SELECT method, round(avg(reach), 4) AS m, round(stddev_samp(reach), 4) AS s, min(k) AS k_min, max(k) AS k_max, count(*) AS count FROM ln GROUP BY method)", "SELECT method, printf('%.3f', m) || ' ± ' || printf('%.3f', s) || CASE WHEN round(m, 3) = max(round(m, 3)) OVER () THEN '*' ELSE '' END AS cell, k_min, k_max, count FROM st"),
        "measure_quartiles": q(LINES, "SELECT method, ranking, min(reach) AS low, quantile_cont(reach, 0.25) AS q1, quantile_cont(reach, 0.5) AS median, quantile_cont(reach, 0.75) AS q3, max(reach) AS high FROM ln GROUP BY ALL"),
        "strategy_versus": q(
            LINES, "sv AS (SELECT graph_name, ranking AS ranking_strategy, method, round(avg(mrr), 4) AS v FROM ln GROUP BY ALL)",
            "SELECT ranking_strategy, round(avg(a.v), 9) AS mean_a, round(avg(b.v), 9) AS mean_b, count(*) FILTER (a.v - b.v > 1e-6) AS wins, count(*) FILTER (abs(a.v - b.v) <= 1e-6) AS ties, count(*) FILTER (a.v - b.v < -1e-6) AS losses, count(DISTINCT graph_name) AS datasets FROM sv a JOIN sv b USING (graph_name, ranking_strategy) WHERE a.method = 'lexipeeling' AND b.method = 'degree' GROUP BY ranking_strategy HAVING count(DISTINCT graph_name) >= 2"),
        "beta_reach_curves": q(LINES, "br AS (SELECT ranking AS position, infection_prob AS beta, avg(reach) AS pct FROM ln GROUP BY ALL)", "SELECT position, beta, round(pct, 9) AS pct, round(100 * pct / max(pct) OVER (PARTITION BY position), 9) AS relative FROM br"),
        "beta_pivot": q(LINES, "SELECT method, " + ", ".join(f"round(avg(mrr) FILTER (ranking = '{r}'), 9) AS b_{r}" for r in sorted(RANKINGS.values())) + " FROM ln GROUP BY method"),
        "sem_tie_table": q(
            LINES, "sr AS (SELECT ranking, reach AS r0, reach % 7 AS r1 FROM ln WHERE method = 'coreness' AND infection_prob = 0.03::DOUBLE)", "se AS (SELECT ranking, 'sem_0' AS sem, count(*)::DOUBLE AS n, count(DISTINCT r0) AS k FROM sr GROUP BY ranking UNION ALL SELECT ranking, 'sem_50', count(*)::DOUBLE, count(DISTINCT r1) FROM sr GROUP BY ranking)",
            "SELECT sem, round(avg(n), 9) AS n_nodes, round(avg(k), 9) AS n_unique, round(avg(n / k), 9) AS mean_tie FROM se GROUP BY sem"),
        "cumulative_pivot": q(
            LINES, RANKED, "tr AS (SELECT node_id, rank() OVER (ORDER BY count(*) DESC) AS truth FROM ln GROUP BY node_id)",
            "sh AS (SELECT method, ranking, 100 * avg((truth <= 100)::INTEGER) AS a, 100 * avg((truth <= 500)::INTEGER) AS b FROM rk JOIN tr USING (node_id) WHERE rank <= 50 GROUP BY ALL)",
            "SELECT method, round(avg(a), 9) AS t_100, round(avg(b), 9) AS t_500 FROM sh GROUP BY method"),
        "enriched_results": q(
            LINES, RANKED, "cp AS (SELECT ranking, method, round(avg(mrr), 6) AS mrr FROM ln GROUP BY ALL)", "fn AS (SELECT ranking, method, count(*) AS n FROM rk WHERE rank = 1 AND method <> 'random' GROUP BY ALL)",
            "SELECT cp.ranking, cp.method, mrr, CASE WHEN cp.ranking <> '3' THEN len(string_split(cp.ranking, '_'))::INTEGER END AS ranking_length, CASE WHEN cp.ranking <> '3' THEN 'top_' || left(cp.ranking, 1) END AS ranking_strategy, coalesce(n, 0) AS num_rank1_nodes FROM cp LEFT JOIN fn USING (ranking, method)"),
        "degeneracy_levels": q(LINES, degeneracy, "SELECT method, degeneracy, round(avg(mrr), 4) AS mrr_mean, round(stddev_samp(mrr), 4) AS mrr_std, count(*) AS count FROM ln JOIN gv USING (ranking) GROUP BY ALL"),
        "probability_means": q(
            LINES, "bp AS (SELECT graph_name, ranking, method, infection_prob, avg(reach) AS a, stddev_pop(reach) AS s, count(*) AS n FROM ln GROUP BY ALL)",
            "SELECT graph_name, ranking, method, round(avg(a), 9) AS group_1_pct_mean, round(avg(s), 9) AS group_1_pct_std, round(avg(n), 9) AS num_rank1_nodes, count(DISTINCT infection_prob) AS num_probabilities FROM bp GROUP BY ALL"),
        "first_node_details": q(
            o.NATIONS, o.DEGREE, *o.spread(), o.truth(base.RANKING, "tr"), "tt AS (SELECT node_id, sum(mean) AS total FROM sir GROUP BY node_id)",
            "fm AS (SELECT 'degree' AS method, node_id FROM deg WHERE value = (SELECT max(value) FROM deg) UNION ALL SELECT 'all', node_id FROM nodes)",
            f"SELECT method, string_agg(node_id || ':' || rank, ',' ORDER BY node_id) AS nodes, round(avg(total), {digits}) AS mean_sir_total, round(stddev_pop(total), {digits}) AS std_sir_total FROM fm JOIN tr USING (node_id) JOIN tt USING (node_id) GROUP BY method"),
        "tie_summaries": q(
            LINES, f"tb AS (SELECT ranking, component_index, count(*) AS c FROM ({prefixes}) WHERE ranking <> 'other' GROUP BY ranking, component_index, p)",
            "ts AS (SELECT ranking, component_index, coalesce(sum(c) FILTER (c > 1), 0)::DOUBLE AS t, count(*)::DOUBLE AS u, sum(c)::DOUBLE AS n FROM tb GROUP BY ALL)",
            "SELECT 'raw_mean' AS variant, component_index, round(avg(t / n), 9) AS fraction_tied_mean, round(min(t / n), 9) AS fraction_tied_min, round(max(t / n), 9) AS fraction_tied_max, round(avg(t), 9) AS num_nodes_tied_mean, round(avg(u), 9) AS num_unique_vectors_mean, count(*) AS count FROM ts GROUP BY component_index"),
        "top_detail": q(
            o.NATIONS, o.DEGREE, *o.spread(), o.truth(base.RANKING, "tr"), f"rv AS (SELECT node_id, {vec[0]} AS a, {vec[1]} AS b FROM sir GROUP BY node_id)", "dr AS (SELECT node_id, CAST(dense_rank() OVER (ORDER BY value DESC) AS INTEGER) AS r FROM deg)",
            f"SELECT 'degree' AS method, node_id, r AS method_rank, tr.rank AS ground_truth_rank, round(a, {digits}) AS reach_0, round(b, {digits}) AS reach_1 FROM dr JOIN tr USING (node_id) JOIN rv USING (node_id) WHERE r <= 3"),
        "node_positions": q(
            o.COMOMENT, *o.pagerank(20, "1"), f"sc AS (SELECT node_id, round(value, {digits}) AS value FROM pr)", "ph AS (SELECT group_id, count(*)::DOUBLE / (SELECT count(*) FROM nodes) AS share FROM nodes GROUP BY group_id)",
            "ct AS (SELECT src AS node_id, n.group_id, count(*) AS k FROM adj JOIN nodes n ON n.node_id = dst GROUP BY ALL)",
            "od AS (SELECT n.node_id, coalesce(sum(k), 0)::BIGINT AS d, sum(k) FILTER (ct.group_id = n.group_id) AS own, min(share / k) AS x FROM nodes n LEFT JOIN ct ON ct.node_id = n.node_id LEFT JOIN ph ON ph.group_id = ct.group_id GROUP BY n.node_id)",
            f"SELECT n.node_id, n.group_id, d AS out_degree, d AS in_degree, CASE WHEN d > 0 THEN round(coalesce(own, 0) / d::DOUBLE, {digits}) END AS out_homophily, CASE WHEN d > 0 THEN round(coalesce(own, 0) / d::DOUBLE, {digits}) END AS in_homophily, round(1 - coalesce(x, 0) * d, {digits}) AS excess, CAST(rank() OVER (ORDER BY sc.value DESC, n.node_id) AS INTEGER) AS position FROM nodes n JOIN od USING (node_id) JOIN sc USING (node_id)"),
        "attribute_pagerank": q(
            o.COMOMENT, "hv AS MATERIALIZED (SELECT DISTINCT user_id::BIGINT AS u FROM events WHERE user_id IS NOT NULL AND day(ts) % 7 = 3)",
            *[x.replace("(1)::DOUBLE AS j FROM nodes", "(CASE WHEN hv.u IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS j FROM nodes LEFT JOIN hv ON hv.u = nodes.node_id") for x in o.pagerank(15, "1")], f"SELECT node_id, round(value, {digits}) AS value FROM pr"),
        "global_uniform_debt": q(o.COMOMENT, *o.pagerank(10, "1"), *_debts(40), f"SELECT node_id, round(greatest(value, 0), {digits}) AS value FROM u40"),
        "hybrid_top_10": q(o.COMOMENT, *o.hybrid_top(10, 7), f"SELECT node_id, round(value, {digits}) AS value FROM fair"),
        "target_fair_10": q(o.COMOMENT, *o.target_fair(10, 30, False), f"SELECT node_id, round(value, {digits}) AS value FROM fair"),
        "target_fair_near_10": q(o.COMOMENT, *o.target_fair(10, 30, True), f"SELECT node_id, round(value, {digits}) AS value FROM fair"),
        "lfpr_p_10": q(o.COMOMENT, *o.lfpr_p(10), f"SELECT node_id, round(value, {digits}) AS value FROM fair"),
    }
