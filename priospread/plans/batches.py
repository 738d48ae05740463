"""Registered queries of batch comparisons and of agreement on the customer graph, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexi
from ..functions.ranks import rank_by
from ..operators import agreement, batch, degrees, epidemic, hindex
from ..sources.files import read_comparisons
from ..sources.tables import cosource_graph, flag_trade_graphs, nation_trade_graph
from ..sources.text import Graph
from . import oracles as o
from . import queries as base
from .loops import cut, shared_root

#: Probabilities, noise levels and blends of the batch; its rankings are those of the comparison queries.
PROBABILITIES, SEMS, BLEND = (0.03, 0.05, 0.08), (0, 50), 0.5


def _graphs(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    g, names = flag_trade_graphs(spark, sf)
    return Graph(cut(g.nodes), cut(g.edges)), cut(names)


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods, spreading results and graph sizes of the three trade graphs."""
    g, names = _graphs(spark, sf)
    place = lambda df, col: rank_by(df.join(names, "node_id"), F.col(col), ["graph_name"], "rank", rows=0).select("graph_name", "node_id", "rank")
    fixed = {"degree": place(degrees.degree(g), "value"), "h1_index": place(hindex.h_chain(g, 1), "value")}
    parts = [df.withColumn("ranking", F.lit(lexi.ranking_key(r))).withColumn("method", F.lit(m)) for r in base.RANKINGS for m, df in (fixed | {"degree_lexicographic": place(degrees.degree_vector(g, r), "vec")}).items()]
    methods = cut(reduce(DataFrame.unionByName, parts))
    sirs = [epidemic.reach(g, g.nodes, p, base.RUNS).withColumn("infection_prob", F.lit(p)) for p in PROBABILITIES]
    sir = cut(reduce(DataFrame.unionByName, sirs).join(names, "node_id"))
    size = degrees.degree(g).join(names, "node_id").groupBy("graph_name").agg(F.count("*").alias("n"), F.avg("value").alias("avg_degree"))
    return methods, sir, cut(size)


def _batch(spark: SparkSession, sf: str) -> str:
    """The folder of a batch over three graphs, three rankings, three probabilities and two noise levels."""
    methods, sir, graphs = _tables(spark, sf)
    betas = methods.select("graph_name", "ranking").distinct().select("*", F.lit(f"equal_{BLEND}").alias("betas_group"), F.array(F.lit(BLEND)).alias("betas"))
    path = f"{shared_root(spark)}/batch-{uuid.uuid4().hex}"
    # One graph first: the run over all of them then does the other two.
    batch.run_batch(methods.where("graph_name = 'trade_A'"), sir, graphs, path, SEMS, betas, spread_filter=False)
    batch.run_batch(methods, sir, graphs, path, SEMS, betas, spread_filter=False)
    return path


MEASURES = ("kendall_tau", "weighted_tau", "mrr", "precision_at_5", "precision_snr_at_3", "precision_snr_pct_10", "arhr_at_10")


def batch_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = batch.read_batch(spark, _batch(spark, sf))
    return out.select(*batch.KEYS, "betas_group", "method", "num_common_nodes", "num_snr_top1", "num_method_top1", "method_top_1_node", "sir_top_1_node", *[F.round(c, base.DIGITS).alias(c) for c in MEASURES])


def batch_top_k(spark: SparkSession, sf: str) -> DataFrame:
    out = batch.read_batch(spark, _batch(spark, sf), "top_k")
    return out.select(*batch.KEYS, "betas_group", "method", "node_id", "method_rank", "ground_truth_rank", F.round("total_reach_mean", base.DIGITS).alias("total_reach_mean"))


def batch_ties(spark: SparkSession, sf: str) -> DataFrame:
    out = batch.read_batch(spark, _batch(spark, sf), "ties")
    return out.select(*batch.KEYS, "variant", "component_index", "num_nodes_tied", "num_unique_vectors", "num_nodes", F.round("fraction_tied", base.DIGITS).alias("fraction_tied"))


def usable_spreads(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities at which between 20 and 80 percent of a graph's seeds reach more than a fifth of the mean degree."""
    _, sir, graphs = _tables(spark, sf)
    return batch.usable(sir, graphs, 0.2, 0.8, factor=0.2)


def comparison_files(spark: SparkSession, sf: str) -> DataFrame:
    """Means over comparison files of unlike columns, read back by their names."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag", "l_linenumber", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("score"))
    lines = cut(lines)
    folder = f"{shared_root(spark)}/comparisons-{uuid.uuid4().hex}"
    for flag, status, name in (("A", "F", "sem_0/graph_rx_r0_1_p0.0500_comparison"), ("N", "F", "sem_50/graph_rx_r0_1_p0.0500_comparison"), ("N", "O", "sem_0/graph_rx_r2_3_p0.1000_betas_equal_0.5_comparison"), ("R", "F", "sem_50/other_r0_1_2_p0.1000_comparison")):
        rows = lines.where((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)).select(F.col("l_linenumber").cast("string").alias("method"), "n", *(["score"] if flag == "N" else []))
        rows.write.parquet(f"{folder}/{name}.parquet")
    out = read_comparisons(spark, folder)
    return out.groupBy("graph_name", "ranking", "infection_prob", "betas_group", "sem").agg(F.count("method").alias("methods"), F.sum("n").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def _customer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Three rankings of the customers, by two methods, against the ranking's degree vectors."""
    g = cosource_graph(spark, sf)
    g = Graph(cut(g.nodes), cut(g.edges))
    methods = {"degree": base._ranked(g, degrees.degree(g)), "h1_index": base._ranked(g, hindex.h_chain(g, 1))}
    named = cut(reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("method"), "node_id", "rank") for m, df in methods.items()]))
    parts = [agreement.paired(named, base._ranked(g, degrees.degree_vector(g, r), "vec", "competition")).withColumn("ranking", F.lit(lexi.ranking_key(r))) for r in base.RANKINGS]
    return cut(reduce(DataFrame.unionByName, parts))


def kendall_tau_cosource(spark: SparkSession, sf: str) -> DataFrame:
    out = agreement.kendall(_customer_pairs(spark, sf), ["ranking", "method"])
    return out.select("ranking", "method", *[F.round(c, base.DIGITS).alias(c) for c in ("kendall_tau", "weighted_tau")])


def compare_all_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Three methods on the nation graph against the plain truth and a blended one."""
    g = nation_trade_graph(spark, sf).cut()
    sir = cut(base._reach(g))
    scored = {"degree": (degrees.degree(g), "value"), "h1_index": (hindex.h_chain(g, 1), "value"), "degree_lexicographic": (degrees.degree_vector(g, base.RANKING), "vec")}
    methods = cut(reduce(DataFrame.unionByName, [base._ranked(g, df, c).select(F.lit(m).alias("method"), "node_id", "rank") for m, (df, c) in scored.items()]))
    out = agreement.compare_all(methods, epidemic.truth_rank_raw(sir, base.RANKING), {"half": epidemic.truth_rank_blended(sir, base.RANKING, BLEND)})
    return out.select("betas_group", "method", "num_common_nodes", "num_truth_top1", *[F.round(c, base.DIGITS).alias(c) for c in ("kendall_tau", "weighted_tau", "mrr", "precision_at_5", "arhr_at_10")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (batch_comparison, batch_top_k, batch_ties, usable_spreads, comparison_files, kendall_tau_cosource, compare_all_methods)}


FLAGS = """
traded AS MATERIALIZED (
  SELECT l_returnflag AS flag, ascii(l_returnflag) * 100 + least(c_nationkey, s_nationkey)::BIGINT AS src, ascii(l_returnflag) * 100 + greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS MATERIALIZED (SELECT src, dst FROM (SELECT *, avg(w) OVER (PARTITION BY flag) AS mean FROM traded) WHERE w > mean),
nodes AS MATERIALIZED (
  SELECT node_id, n_regionkey AS group_id FROM (SELECT src AS node_id FROM traded UNION SELECT dst FROM traded) JOIN nation ON n_nationkey = node_id % 100),
adj AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
gname AS MATERIALIZED (SELECT node_id, 'trade_' || chr((node_id // 100)::INTEGER) AS graph_name FROM nodes)"""
RANKS = "CAST({kind}() OVER (PARTITION BY {by} ORDER BY {v} DESC) AS INTEGER)"


def _sirs() -> list[str]:
    tags = "abc"
    parts = [x for p, tag in zip(PROBABILITIES, tags) for x in o.spread(probability=p, tag=tag)]
    rows = " UNION ALL ".join(f"SELECT '{p:.4f}' AS prob, * FROM sir{tag}" for p, tag in zip(PROBABILITIES, tags))
    return [FLAGS, *o.h_chain(1), *parts, f"sirs AS MATERIALIZED (SELECT graph_name, prob, node_id, group_id, mean, std FROM ({rows}) JOIN gname USING (node_id))"]


def _levels() -> list[str]:
    err = f"std / sqrt({base.RUNS}::DOUBLE)"
    unit = f"coalesce(quantile_cont(CASE WHEN {err} > 0 THEN {err} END, 0.5) OVER (PARTITION BY graph_name, prob, group_id), 1 / sqrt({base.RUNS}::DOUBLE))"
    out = [f"lv AS MATERIALIZED (SELECT graph_name, prob, 0 AS sem, node_id, group_id, mean, mean AS value FROM sirs UNION ALL SELECT graph_name, prob, 50, node_id, group_id, mean, floor(mean / {unit}) FROM sirs)"]
    rows = []
    for r in base.RANKINGS:
        vec = lambda c: ", ".join(f"coalesce(max({c}) FILTER (group_id = {g}), 0.0)" for g in r)  # noqa: B023, E731
        rows.append(f"SELECT graph_name, '{lexi.ranking_key(r)}' AS ranking, prob, sem, node_id, [{vec('value')}] AS v, [{vec('mean')}] AS raw FROM lv GROUP BY graph_name, prob, sem, node_id")
    out.append("vs AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    return out


def _batch_pairs() -> list[str]:
    key = "graph_name, ranking, prob, sem"
    rank = lambda v, by=key: RANKS.format(kind="rank", by=by, v=v)
    mixed = f"[v[1] + v[2] * {BLEND}::DOUBLE, v[2]]"
    out = [*_sirs(), *_levels(), f"truths AS MATERIALIZED (SELECT {key}, 'none' AS betas_group, node_id, {rank('raw')} AS s_raw, {rank('v')} AS s FROM vs UNION ALL SELECT {key}, 'equal_{BLEND}', node_id, {rank(mixed)}, {rank(mixed)} FROM vs)"]
    rows = []
    for i, r in enumerate(base.RANKINGS):
        out.append(o.vector(r, f"vec{i}"))
        for name, table, value in (("degree", "deg", "value"), ("h1_index", "h1", "value"), ("degree_lexicographic", f"vec{i}", "v")):
            rows.append(f"SELECT graph_name, '{lexi.ranking_key(r)}' AS ranking, '{name}' AS method, node_id, {RANKS.format(kind='dense_rank', by='graph_name', v=value)} AS m FROM {table} JOIN gname USING (node_id)")
    out.append("methods AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    out.append("pairs AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY graph_name, ranking, prob, sem, betas_group, method) AS n FROM methods JOIN truths USING (graph_name, ranking, node_id))")
    return out


def _taus(by: str, rounds: str = "pairs") -> list[str]:
    """Both taus from all pairs of nodes of a group."""
    on = " AND ".join(f"x.{c} = y.{c}" for c in by.split(", "))
    keys = ", ".join(f"x.{c}" for c in by.split(", "))
    weigh = lambda a, b: f"1.0::DOUBLE / row_number() OVER (PARTITION BY {by} ORDER BY {a} DESC, {b} DESC, node_id)"
    part = lambda w: f"sum((x.{w} + y.{w}) * sign(x.m - y.m) * sign(x.s - y.s)) / nullif(sqrt(sum((x.{w} + y.{w}) * abs(sign(x.m - y.m))) * sum((x.{w} + y.{w}) * abs(sign(x.s - y.s)))), 0)"
    plain = "sum(sign(x.m - y.m) * sign(x.s - y.s)) / nullif(sqrt(sum(abs(sign(x.m - y.m)))::DOUBLE * sum(abs(sign(x.s - y.s)))), 0)"
    return [
        f"weighed AS MATERIALIZED (SELECT {by}, node_id, m, s, {weigh('m', 's')} AS w1, {weigh('s', 'm')} AS w2 FROM {rounds})",
        f"taus AS MATERIALIZED (SELECT {keys}, coalesce({plain}, 0.0) AS kendall_tau, ({part('w1')} + {part('w2')}) / 2 AS weighted_tau FROM weighed x JOIN weighed y ON {on} AND x.node_id < y.node_id GROUP BY {keys})",
    ]


def oracle_sql() -> dict[str, str]:
    q, digits = o.q, base.DIGITS
    by = "graph_name, ranking, prob, sem, betas_group, method"
    common = lambda s, k: f"least(count(*) FILTER (m <= {k} AND {s} <= {k}), max({k}))::DOUBLE / max({k})"
    vec = lambda i: f"coalesce(max(mean) FILTER (group_id = {base.RANKING[i]}), 0.0)"
    ten = "greatest(1, floor(n * 10 / 100.0)::BIGINT)"
    measures = f"""SELECT {by}, max(n) AS num_common_nodes, count(*) FILTER (s = 1) AS num_snr_top1, count(*) FILTER (m = 1) AS num_method_top1, arg_min(node_id, m * 100000 + node_id) AS method_top_1_node,
  arg_min(node_id, s_raw * 100000 + node_id) AS sir_top_1_node, avg(1.0::DOUBLE / m) FILTER (s = 1) AS mrr, {common('s_raw', 'least(5, n)')} AS precision_at_5, {common('s', 'least(3, n)')} AS precision_snr_at_3,
  {common('s', ten)} AS precision_snr_pct_10, avg(1.0::DOUBLE / m) FILTER (s <= least(10, n)) AS arhr_at_10 FROM pairs GROUP BY ALL"""
    rounded = ", ".join(f"round({c}, {digits}) AS {c}" for c in MEASURES)
    prefixes = "UNION ALL ".join(f"SELECT graph_name, ranking, prob, sem, '{name}' AS variant, i AS component_index, {v}[1:i] AS prefix FROM vs CROSS JOIN (SELECT unnest([1, 2]) AS i) " for name, v in (("raw_mean", "raw"), ("snr", "v")))
    customers = []
    for i, r in enumerate(base.RANKINGS):
        for name, table in (("degree", "deg"), ("h1_index", "h1")):
            customers.append(f"SELECT '{lexi.ranking_key(r)}' AS ranking, '{name}' AS method, x.node_id, CAST(dense_rank() OVER (ORDER BY x.value DESC) AS INTEGER) AS m, CAST(rank() OVER (ORDER BY v.v DESC) AS INTEGER) AS s FROM {table} x JOIN vec{i} v USING (node_id)")
    files = " UNION ALL ".join(
        f"SELECT '{g}' AS graph_name, '{r}' AS ranking, {p}::DOUBLE AS infection_prob, '{b}' AS betas_group, {sem}::INTEGER AS sem, count(DISTINCT l_linenumber) AS methods, count(*) AS n, round({'sum(l_quantity)::DOUBLE' if flag == 'N' else 'NULL::DOUBLE'}, 2) AS score FROM lineitem WHERE l_returnflag = '{flag}' AND l_linestatus = '{status}' HAVING count(*) > 0"
        for flag, status, sem, g, r, p, b in (("A", "F", 0, "graph_rx", "0_1", 0.05, "none"), ("N", "F", 50, "graph_rx", "0_1", 0.05, "none"), ("N", "O", 0, "graph_rx", "2_3", 0.1, "equal_0.5"), ("R", "F", 50, "other", "0_1_2", 0.1, "none"))
    )
    return {
        "batch_comparison": q(*_batch_pairs(), *_taus(by), f"ms AS ({measures})", f"SELECT {by}, num_common_nodes, num_snr_top1, num_method_top1, method_top_1_node, sir_top_1_node, {rounded} FROM ms JOIN taus USING ({by})"),
        "batch_top_k": q(*_batch_pairs(), "tr AS (SELECT graph_name, prob, node_id, sum(mean) AS total FROM sirs GROUP BY ALL)", f"SELECT {by}, node_id, m AS method_rank, s_raw AS ground_truth_rank, round(total, {digits}) AS total_reach_mean FROM pairs JOIN tr USING (graph_name, prob, node_id) WHERE m <= {batch.DETAIL}"),
        "batch_ties": q(
            *_sirs(), *_levels(), f"bk AS (SELECT graph_name, ranking, prob, sem, variant, component_index, count(*) AS c FROM ({prefixes}) GROUP BY graph_name, ranking, prob, sem, variant, component_index, prefix)",
            f"SELECT graph_name, ranking, prob, sem, variant, component_index, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS num_nodes_tied, count(*) AS num_unique_vectors, sum(c)::BIGINT AS num_nodes, round(coalesce(sum(c) FILTER (c > 1), 0) / sum(c)::DOUBLE, {digits}) AS fraction_tied FROM bk GROUP BY ALL"),
        "usable_spreads": q(
            *_sirs(), "gs AS (SELECT graph_name, count(*) AS n, avg(value) AS avg_degree FROM deg JOIN gname USING (node_id) GROUP BY graph_name)",
            f"tt AS (SELECT graph_name, prob, node_id, sum(mean) AS total FROM sirs GROUP BY ALL), rt AS (SELECT graph_name, prob, count(*) FILTER (total / n >= greatest({batch.LEAST_SHARE}::DOUBLE, 0.2::DOUBLE * avg_degree / n))::DOUBLE / max(n) AS ratio FROM tt JOIN gs USING (graph_name) GROUP BY ALL)",
            "SELECT graph_name, prob::DOUBLE AS infection_prob FROM rt WHERE ratio BETWEEN 0.2 AND 0.8"),
        "comparison_files": files,
        "compare_all_methods": q(
            o.NATIONS, *o.h_chain(1), *o.spread(), o.vector(base.RANKING, "dv"), f"rv AS (SELECT node_id, [{vec(0)}, {vec(1)}] AS v FROM sir GROUP BY node_id)",
            f"truths AS MATERIALIZED (SELECT 'none' AS betas_group, node_id, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS s FROM rv UNION ALL SELECT 'half', node_id, CAST(rank() OVER (ORDER BY [v[1] + v[2] * {BLEND}::DOUBLE, v[2]] DESC) AS INTEGER) FROM rv)",
            "methods AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{m}' AS method, node_id, CAST(dense_rank() OVER (ORDER BY {v} DESC) AS INTEGER) AS m FROM {t}" for m, t, v in (("degree", "deg", "value"), ("h1_index", "h1", "value"), ("degree_lexicographic", "dv", "v"))) + ")",
            "pairs AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY betas_group, method) AS n FROM methods JOIN truths USING (node_id))", *_taus("betas_group, method"),
            f"ms AS (SELECT betas_group, method, max(n) AS num_common_nodes, count(*) FILTER (s = 1) AS num_truth_top1, avg(1.0::DOUBLE / m) FILTER (s = 1) AS mrr, {common('s', 'least(5, n)')} AS precision_at_5, avg(1.0::DOUBLE / m) FILTER (s <= least(10, n)) AS arhr_at_10 FROM pairs GROUP BY ALL)",
            "SELECT betas_group, method, num_common_nodes, num_truth_top1, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in ("kendall_tau", "weighted_tau", "mrr", "precision_at_5", "arhr_at_10")) + " FROM ms JOIN taus USING (betas_group, method)"),
        "kendall_tau_cosource": q(o.COSOURCE, *o.h_chain(1), *[o.vector(r, f"vec{i}") for i, r in enumerate(base.RANKINGS)], "pairs AS MATERIALIZED (" + " UNION ALL ".join(customers) + ")", *_taus("ranking, method"), f"SELECT ranking, method, round(kendall_tau, {digits}) AS kendall_tau, round(weighted_tau, {digits}) AS weighted_tau FROM taus"),
    }
