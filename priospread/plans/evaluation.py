"""Registered queries of roll-ups, reports, selections and fair ranks, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import rank_by, with_ties
from ..operators import agreement, degrees, epidemic, fairrank, pagerank, report, rollup, targets
from ..sources.tables import comoment_graph, cosource_graph, nation_trade_graph
from . import oracles as o
from . import queries as base

# A result table of named methods on named graphs, for the rules of selections.
NAMES = (
    "lexipeeling", "lexipeeling_extended", "lexipeeling_degree", "lexipeeling_coreness", "coreness_lexipeeling", "betas_lexipeeling_0.3",
    "restricted_degree_lexicographic", "degree_lexicographic", "degree", "coreness", "pagerank", "h1_index", "random", "fspr",
)
GRAPHS = ("ER_n100_uniform_rep0", "SBM_aligned_imbalanced_rep12", "SBM_random_uniform", "books", "SBM_x_rep1_rep2", "my_ER_imbalanced")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """``method``, ``score``: a score for each name from the parts of that number, equal for some."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = part.select(F.element_at(names, (F.col("p_partkey") % len(NAMES) + 1).cast("int")).alias("method"), (F.col("p_size") % 7).alias("s"))
    return rows.groupBy("method").agg((F.max("s") * 10 + F.min("s")).cast("double").alias("score"))


LEVELS = f"lv AS (SELECT [{', '.join(repr(n) for n in NAMES)}][(p_partkey % {len(NAMES)} + 1)::INTEGER] AS method, (max(p_size % 7) * 10 + min(p_size % 7))::DOUBLE AS score FROM part GROUP BY 1)"
COMPOSITE = "(" + " OR ".join(f"contains(method, '{p}')" for p in rollup.COMPOSITE_PARTS) + ")"


def selected_methods(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.select_methods(_levels(spark, sf), "score", 3, 2, groups={"a": ["random", "degree", "lexipeeling"], "b": ["fspr"]})


def composite_names(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("method", rollup.is_composite(F.col("method")).alias("composite"), rollup.is_ranking_independent(F.col("method")).alias("independent"))


def robust_methods(spark: SparkSession, sf: str) -> DataFrame:
    return report.robustness(_levels(spark, sf), "score")


def graph_names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in GRAPHS])
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.element_at(names, (F.col("n_nationkey") % len(GRAPHS) + 1).cast("int")).alias("graph_name")).distinct()
    return rollup.graph_features(rows)


def _two_truths(spark: SparkSession, sf: str) -> DataFrame:
    """Node ranks whose rank by total reach differs from the rank by the ranking's vector."""
    pairs = base._pairs(spark, sf)
    sir = base._reach(nation_trade_graph(spark, sf))
    totals = epidemic.rank_by_total(sir).select("node_id", F.col("rank").alias("ground_truth_rank"))
    truths = pairs.select("ranking", "node_id", F.lit(base.PROBABILITY).alias("infection_prob"), F.col("s").alias("sir_rank_snr")).distinct().join(totals, "node_id")
    return rollup.node_ranks(pairs.select("ranking", "method", "node_id", F.col("m").alias("rank")), truths, "nations")


def two_truth_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _two_truths(spark, sf).select("node_id", "method", "ranking", "method_rank", "ground_truth_rank", "sir_rank_snr")


def cumulative_share(spark: SparkSession, sf: str) -> DataFrame:
    """Percent of nodes, by the rule of the tables: 100 * rank / n <= t."""
    out = report.cumulative_scores(_two_truths(spark, sf), [1, 3], [1, 5, 20], percent=True)
    return out.select("method", "k", "t", F.round("score", base.DIGITS).alias("score"))


def strategy_scores(spark: SparkSession, sf: str) -> DataFrame:
    ranks = _two_truths(spark, sf)
    strategies = ranks.select("ranking").distinct().withColumn("ranking_strategy", F.when(F.col("ranking") == "2_3", "bottom").otherwise("top"))
    out = report.strategy_cumulative(ranks, strategies, [5, 20])
    return out.select("ranking_strategy", "method", "t", F.round("score", base.DIGITS).alias("score"))


def tie_curves(spark: SparkSession, sf: str) -> DataFrame:
    out = report.tie_bands(base._pairs(spark, sf).select("method", "ranking", F.col("m").alias("rank")), 11)
    return out.select("method", *[F.round(c, base.DIGITS).alias(c) for c in ("pct", "median", "q25", "q75")])


def total_reach_rank(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.rank_by_total(base._reach(nation_trade_graph(spark, sf))).select("node_id", "rank")


def blended_truth_rank(spark: SparkSession, sf: str) -> DataFrame:
    return epidemic.truth_rank_blended(base._reach(nation_trade_graph(spark, sf)), base.RANKING, 0.5).select("node_id", "rank")


def first_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """What the truth says of the nodes that degree puts first."""
    g = nation_trade_graph(spark, sf)
    truth = epidemic.truth_rank_raw(base._reach(g), base.RANKING)
    out = rollup.top1_simple(base._ranked(g, degrees.degree(g)).withColumn("method", F.lit("degree")), truth)
    return out.withColumn("mean_truth_rank", F.round("mean_truth_rank", base.DIGITS))


def top_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return with_ties(degrees.degree(g), "value", 10, rows=g.nodes.count())


def modal_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Competition ranks of all line items by quantity: few keys, each of many rows."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return rank_by(rows, F.col("l_quantity"), kind="competition", rows=10**9)


def mixed_strategies(spark: SparkSession, sf: str) -> DataFrame:
    m = targets.group_metrics(cosource_graph(spark, sf))
    s = targets.strategy_rankings(m.select("group_id", "size", F.round("coreness", base.DIGITS).alias("coreness"), F.round("degree", base.DIGITS).alias("degree")), [2])
    return s.where(F.col("strategy").startswith("mixed")).select("strategy", "length", F.array_join(F.col("groups").cast("array<string>"), "_").alias("ranking"))


def global_uniform_fair(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf)
    out = fairrank.global_uniform(pagerank.pagerank(g, rounds=20, tolerance=None), g.nodes, pagerank.target_distribution(g.nodes, (0, 1, 2, 3, 4), 0.9))
    return out.select("node_id", F.round("value", base.DIGITS).alias("value"))


def step_fair_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The step rule over all five groups."""
    g = comoment_graph(spark, sf).cut()
    out = fairrank.step_fair(g.links, g.nodes, pagerank.target_distribution(g.nodes, base.RANKING), rounds=10, epsilon=None)
    return out.select("node_id", F.round("value", base.DIGITS).alias("value"))


def neighbour_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf).cut()
    out = fairrank.neighbour_stats(g.links, g.nodes)
    return out.select("node_id", "group_id", "n_in", "n_out", F.round("share_in", base.DIGITS).alias("share_in"), F.round("share_out", base.DIGITS).alias("share_out"))


def metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    """Precision at all default cut-offs."""
    out = agreement.metrics(base._pairs(spark, sf), ["ranking", "method"])
    return out.select("ranking", "method", *[F.round(c, base.DIGITS).alias(c) for c in out.columns if c.startswith("precision")])


def weighted_tau_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = agreement.kendall(base._pairs(spark, sf), ["ranking", "method"])
    return out.select("ranking", "method", F.round("weighted_tau", base.DIGITS).alias("weighted_tau"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        selected_methods, composite_names, robust_methods, graph_names, two_truth_ranks, cumulative_share, strategy_scores, tie_curves,
        total_reach_rank, blended_truth_rank, first_nodes, top_with_ties, modal_ranks, mixed_strategies, global_uniform_fair,
        step_fair_groups, neighbour_groups, metrics_all, weighted_tau_pairs,
    )}


def _step_rounds(rounds: int) -> list[str]:
    out = [o.shares(), o.FAIR_BASE, "gs AS MATERIALIZED (SELECT group_id, count(*) AS size FROM nodes GROUP BY group_id)",
           "ct AS MATERIALIZED (SELECT src, group_id, count(*) AS k FROM adj JOIN nodes ON node_id = dst GROUP BY ALL)",
           "xs AS MATERIALIZED (SELECT n.node_id, coalesce(min(share / k), 0) AS x FROM nodes n LEFT JOIN ct ON src = n.node_id LEFT JOIN phi ON phi.group_id = ct.group_id GROUP BY n.node_id)",
           "ow AS MATERIALIZED (SELECT xs.node_id, phi.group_id, share - x * coalesce(k, 0) AS e FROM xs CROSS JOIN phi LEFT JOIN ct ON ct.src = xs.node_id AND ct.group_id = phi.group_id)",
           "f0 AS MATERIALIZED (SELECT node_id, jump AS value FROM base)"]
    for k in range(1, rounds + 1):
        out.append(f"""f{k} AS MATERIALIZED (
  SELECT b.node_id, 0.85::DOUBLE * (coalesce(d.direct, 0) + coalesce(y.bucket, 0) / gs.size) + 0.15::DOUBLE * b.jump AS value FROM base b JOIN gs USING (group_id)
  LEFT JOIN (SELECT dst AS node_id, sum(f.value * x) AS direct FROM adj JOIN f{k - 1} f ON f.node_id = src JOIN xs ON xs.node_id = src GROUP BY dst) d USING (node_id)
  LEFT JOIN (SELECT group_id, sum(f.value * e) AS bucket FROM ow JOIN f{k - 1} f USING (node_id) GROUP BY group_id) y USING (group_id))""")
    return [*out, f"fair AS (SELECT * FROM f{rounds})"]


def oracle_sql() -> dict[str, str]:
    q, digits = o.q, base.DIGITS
    runs = o.spread()
    totals = "tt AS MATERIALIZED (SELECT node_id, CAST(rank() OVER (ORDER BY round(sum(mean), 9) DESC) AS INTEGER) AS total_rank FROM sir GROUP BY node_id)"
    hits = lambda keys, cond: f"SELECT {keys}method, k, t, ranking, avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END) AS share FROM sized CROSS JOIN ks CROSS JOIN ts WHERE m <= k GROUP BY ALL"
    sized = "sized AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY ranking, method) AS n, CASE WHEN ranking = '2_3' THEN 'bottom' ELSE 'top' END AS ranking_strategy FROM pairs)"
    cuts = [*[(f"at_{k}", f"least({k}, n)") for k in (1, 5, 10, 20, 50)], *[(f"pct_{p}", f"greatest(1, floor(n * {p} / 100.0)::BIGINT)") for p in (1, 3, 5, 10)]]
    precision = ", ".join(f"round(least(count(*) FILTER (m <= {k} AND s <= {k}), max({k}))::DOUBLE / max({k}), {digits}) AS precision_{name}" for name, k in cuts)
    both = lambda a, b: f"""SELECT x.ranking, x.method, sum((x.w + y.w) * sign(x.m - y.m) * sign(x.s - y.s)) / sqrt(sum((x.w + y.w) * abs(sign(x.m - y.m))) * sum((x.w + y.w) * abs(sign(x.s - y.s)))) AS tau
      FROM (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY ranking, method ORDER BY {a} DESC, {b} DESC, node_id) AS w FROM pairs) x
      JOIN (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY ranking, method ORDER BY {a} DESC, {b} DESC, node_id) AS w FROM pairs) y ON x.ranking = y.ranking AND x.method = y.method AND x.node_id < y.node_id GROUP BY ALL"""  # noqa: E731
    vec = ", ".join(f"coalesce(max(mean) FILTER (group_id = {g}), 0.0)" for g in base.RANKING)
    interpolated = """CASE WHEN (SELECT min(x) FROM kn k WHERE k.method = c.method AND k.ranking = c.ranking) >= p THEN (SELECT arg_min(y, x) FROM kn k WHERE k.method = c.method AND k.ranking = c.ranking)
      WHEN p >= 100 THEN (SELECT arg_max(y, x) FROM kn k WHERE k.method = c.method AND k.ranking = c.ranking)
      ELSE (SELECT a.y + (b.y - a.y) * (p - a.x) / (b.x - a.x) FROM kn a JOIN kn b ON a.method = b.method AND a.ranking = b.ranking AND b.i = a.i + 1 WHERE a.method = c.method AND a.ranking = c.ranking AND a.x < p AND b.x >= p) END"""
    place = "row_number() OVER (PARTITION BY kind ORDER BY score DESC, method)"
    return {
        "selected_methods": f"WITH {LEVELS}, kd AS (SELECT *, CASE WHEN {COMPOSITE} THEN 'composite' WHEN method IN ('lexipeeling', 'lexipeeling_extended') THEN 'always' ELSE 'baseline' END AS kind FROM lv), "
        f"pl AS (SELECT *, {place} AS r FROM kd), gr AS (SELECT arg_max(method, score * 1000 - rank_name) AS method FROM (SELECT *, row_number() OVER (ORDER BY method) AS rank_name FROM kd) WHERE kind = 'baseline' AND method IN ('random', 'degree', 'lexipeeling')) "
        "SELECT method, true AS in_full, kind <> 'composite' AS in_basic FROM pl WHERE (kind = 'baseline' AND r <= 3) OR kind = 'always' OR (kind = 'composite' AND r <= 2) OR method = 'fspr' OR method IN (SELECT method FROM gr)",
        "composite_names": f"WITH {LEVELS} SELECT method, {COMPOSITE} AS composite, method NOT IN ('lexipeeling', 'lexipeeling_extended', 'degree_lexicographic', 'random', 'pagerank_uniform_jump', 'pagerank_exponential_jump', 'fairgd', 'adaptgd', 'fspr', 'lfpr_u', 'lfpr_n') AND NOT starts_with(method, 'betas_') AND NOT starts_with(method, 'restricted_') AND NOT {COMPOSITE} AS independent FROM lv",
        "robust_methods": f"WITH {LEVELS}, bl AS (SELECT *, max(score) OVER () AS top, row_number() OVER (ORDER BY score DESC, method) AS r FROM lv WHERE NOT contains(method, 'lexipeeling')) "
        "SELECT method FROM bl WHERE CASE WHEN (SELECT count(*) FROM bl WHERE score = top) > 3 THEN score = top ELSE r <= 3 END UNION SELECT method FROM lv WHERE method = 'lexipeeling'",
        "graph_names": f"WITH g AS (SELECT DISTINCT [{', '.join(repr(n) for n in GRAPHS)}][(n_nationkey % {len(GRAPHS)} + 1)::INTEGER] AS graph_name FROM nation), "
        "t AS (SELECT *, CASE WHEN starts_with(graph_name, 'ER_') THEN 'ER' WHEN starts_with(graph_name, 'SBM_') THEN 'SBM' END AS graph_type FROM g), "
        "a AS (SELECT *, CASE WHEN contains(graph_name, 'uniform') THEN 'uniform' WHEN contains(graph_name, 'imbalanced') THEN 'imbalanced' END AS size_distribution, CASE graph_type WHEN 'ER' THEN 'random' WHEN 'SBM' THEN CASE WHEN contains(graph_name, 'aligned') THEN 'aligned' WHEN contains(graph_name, 'random') THEN 'random' END END AS group_assignment FROM t) "
        "SELECT *, CASE WHEN contains(graph_name, '_rep') THEN array_to_string(string_split(graph_name, '_rep')[:-2], '_rep') ELSE graph_name END AS base_config, CASE graph_type WHEN 'SBM' THEN 'SBM_' || coalesce(group_assignment, 'None') WHEN 'ER' THEN 'ER' ELSE 'real' END AS detailed_type FROM a",
        "two_truth_ranks": q(*o.pairs(), totals, "SELECT node_id, method, ranking, m AS method_rank, total_rank AS ground_truth_rank, s AS sir_rank_snr FROM pairs JOIN tt USING (node_id)"),
        "cumulative_share": q(*o.pairs(), sized, "ks AS (SELECT unnest([1, 3]) AS k)", "ts AS (SELECT unnest([1, 5, 20]) AS t)", f"one AS ({hits('', 's / n::DOUBLE * 100 <= t')})", f"SELECT method, k, t, round(100 * avg(share), {digits}) AS score FROM one GROUP BY ALL"),
        "strategy_scores": q(*o.pairs(), sized, "ks AS (SELECT 1 AS k)", "ts AS (SELECT unnest([5, 20]) AS t)", f"one AS ({hits('ranking_strategy, ', 's <= greatest(1, ceil(n * t / 100.0))')})", f"SELECT ranking_strategy, method, t, round(100 * avg(share), {digits}) AS score FROM one GROUP BY ALL"),
        "tie_curves": q(
            *o.pairs(), "bk AS (SELECT method, ranking, m, count(*)::DOUBLE AS y FROM pairs GROUP BY ALL)",
            "kn AS MATERIALIZED (SELECT *, sum(y) OVER (PARTITION BY method, ranking ORDER BY m) / sum(y) OVER (PARTITION BY method, ranking) * 100 AS x, row_number() OVER (PARTITION BY method, ranking ORDER BY m) AS i FROM bk)",
            f"cv AS (SELECT c.method, c.ranking, p, {interpolated} AS size FROM (SELECT DISTINCT method, ranking FROM bk) c CROSS JOIN (SELECT unnest(range(11)) * 10.0::DOUBLE AS p))",
            f"SELECT method, p AS pct, round(quantile_cont(size, 0.5), {digits}) AS median, round(quantile_cont(size, 0.25), {digits}) AS q25, round(quantile_cont(size, 0.75), {digits}) AS q75 FROM cv GROUP BY ALL"),
        "total_reach_rank": q(o.NATIONS, *runs, totals, "SELECT node_id, total_rank AS rank FROM tt"),
        "blended_truth_rank": q(o.NATIONS, *runs, f"bv AS (SELECT node_id, [{vec}] AS v FROM sir GROUP BY node_id)", "SELECT node_id, CAST(rank() OVER (ORDER BY [v[1] + v[2] * 0.5::DOUBLE, v[2]] DESC) AS INTEGER) AS rank FROM bv"),
        "first_nodes": q(o.NATIONS, o.DEGREE, *runs, o.truth(base.RANKING, "tr"), f"SELECT 'degree' AS method, count(*) AS num_rank1_nodes, min(rank) AS best_truth_rank, round(avg(rank), {digits}) AS mean_truth_rank, max(rank) AS worst_truth_rank, min(rank) = 1 AS hits_top FROM deg JOIN tr USING (node_id) WHERE value = (SELECT max(value) FROM deg)"),
        "top_with_ties": q(o.COSOURCE, o.DEGREE, "SELECT node_id, value FROM (SELECT *, rank() OVER (ORDER BY value DESC) AS r FROM deg) WHERE r <= 10"),
        "modal_ranks": "SELECT l_orderkey, l_linenumber, l_quantity, CAST(rank() OVER (ORDER BY l_quantity DESC) AS INTEGER) AS rank FROM lineitem",
        "mixed_strategies": q(
            o.COSOURCE, *o.CORES, o.GROUPS, "lg AS (SELECT group_id, 'size' AS metric, size AS v FROM gm UNION ALL SELECT group_id, 'coreness', coreness FROM gm UNION ALL SELECT group_id, 'degree', degree FROM gm)",
            "od AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, group_id) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM lg)",
            "SELECT 'mixed_top_' || a.metric || CASE WHEN b.rn = 1 THEN '_top_' ELSE '_bottom_' END || b.metric AS strategy, 2 AS length, a.group_id || '_' || b.group_id AS ranking FROM od a JOIN od b ON a.metric <> b.metric WHERE a.rn = 1 AND (b.rn = 1 OR b.rn = b.n)"),
        "global_uniform_fair": q(
            o.COMOMENT, *o.pagerank(20, "1"), "ph AS (SELECT group_id, w / sum(w) OVER () AS share FROM (SELECT group_id, pow(0.9::DOUBLE, group_id) AS w FROM (SELECT DISTINCT group_id FROM nodes)))",
            "ms AS (SELECT group_id, sum(value) AS mass, count(*) AS size FROM pr JOIN nodes USING (node_id) GROUP BY group_id)",
            f"SELECT node_id, round(value + (share - mass) / size, {digits}) AS value FROM pr JOIN nodes n USING (node_id) JOIN ms ON ms.group_id = n.group_id JOIN ph ON ph.group_id = n.group_id"),
        "step_fair_groups": q(o.COMOMENT, *_step_rounds(10), f"SELECT node_id, round(value, {digits}) AS value FROM fair"),
        "neighbour_groups": q(o.COMOMENT, "ct AS (SELECT src AS node_id, group_id, count(*) AS k FROM adj JOIN nodes ON node_id = dst GROUP BY ALL)", f"SELECT node_id, group_id, k AS n_in, k AS n_out, round(k / (sum(k) OVER (PARTITION BY node_id))::DOUBLE, {digits}) AS share_in, round(k / (sum(k) OVER (PARTITION BY node_id))::DOUBLE, {digits}) AS share_out FROM ct"),
        "metrics_all": q(*o.pairs(), f"SELECT ranking, method, {precision} FROM (SELECT *, count(*) OVER (PARTITION BY ranking, method) AS n FROM pairs) GROUP BY ranking, method"),
        "weighted_tau_pairs": q(*o.pairs(), f"ta AS ({both('m', 's')})", f"tb AS ({both('s', 'm')})", f"SELECT ranking, method, round((ta.tau + tb.tau) / 2, {digits}) AS weighted_tau FROM ta JOIN tb USING (ranking, method)"),
    }
