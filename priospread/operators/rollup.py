"""Enrichment of comparisons and their aggregation on many levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import median_vectors
from ..plans.loops import cut

# The levels of the summary tables.
LEVELS = {
    "by_method": ["method"],
    "by_detailed_type": ["method", "detailed_type"],
    "by_size_distribution": ["method", "size_distribution"],
    "by_base_config": ["method", "base_config"],
    "by_combined": ["method", "graph_type", "size_distribution", "group_assignment"],
    "by_ranking": ["method", "ranking"],
    "by_ranking_strategy": ["method", "ranking_strategy"],
    "by_ranking_length": ["method", "ranking_length"],
    "by_strategy_length": ["method", "ranking_strategy", "ranking_length"],
    "by_infection_prob": ["method", "infection_prob"],
    "by_strategy_prob": ["method", "ranking_strategy", "infection_prob"],
}


def graph_features(df: DataFrame, name: str = "graph_name") -> DataFrame:
    """Type, size distribution, group assignment, base configuration and detailed type from a graph's name.

    What the name does not say is null; graphs that are neither ER nor SBM have the detailed type
    ``real``. The base configuration ends before the last ``_rep``.
    """
    g = F.col(name)
    kind = F.when(g.startswith("ER_"), "ER").when(g.startswith("SBM_"), "SBM")
    size = F.when(g.contains("uniform"), "uniform").when(g.contains("imbalanced"), "imbalanced")
    how = F.when(kind == "ER", "random").when((kind == "SBM") & g.contains("aligned"), "aligned").when((kind == "SBM") & g.contains("random"), "random")
    detail = F.when(kind == "SBM", F.concat(F.lit("SBM_"), F.coalesce(how, F.lit("None")))).otherwise(F.coalesce(kind, F.lit("real")))
    return df.withColumns({"graph_type": kind, "size_distribution": size, "group_assignment": how, "base_config": F.regexp_replace(g, r"(?s)^(.*)_rep.*$", "$1"), "detailed_type": detail})


def enrich(comparisons: DataFrame, rankings: DataFrame, methods: DataFrame) -> DataFrame:
    """Ranking length and strategy, and how many nodes a method puts at rank 1 (0 without any)."""
    facts = rankings.select("ranking", F.size(F.split("ranking", "_")).alias("ranking_length"), F.element_at("strategies", 1).alias("ranking_strategy"))
    first = methods.where("rank = 1").groupBy("ranking", "method").agg(F.count("*").alias("num_rank1_nodes"))
    return comparisons.join(facts, "ranking", "left").join(first, ["ranking", "method"], "left").fillna(0, ["num_rank1_nodes"])


def aggregate_level(df: DataFrame, keys: Sequence[str], values: Sequence[str], counts: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Mean and sample deviation of ``values``, least and most of ``counts``; null keys go."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    cols: list[Column] = []
    for v in values:
        cols += [F.round(F.avg(v), digits).alias(f"{v}_mean"), F.round(F.stddev_samp(v), digits).alias(f"{v}_std")]
    for c in counts:
        cols += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return rows.groupBy(*keys).agg(*cols, F.count("*").alias("count"))


def aggregate_levels(df: DataFrame, values: Sequence[str], levels: dict[str, list[str]] | None = None, digits: int = 4) -> DataFrame:
    """All levels in one pass with grouping sets: ``level``, the keys (null where not grouped), values."""
    levels = {k: v for k, v in (levels or LEVELS).items() if all(c in df.columns for c in v)}
    keys = list(dict.fromkeys(k for v in levels.values() for k in v))
    cols: list[Column] = []
    for v in values:
        cols += [F.round(F.avg(v), digits).alias(f"{v}_mean"), F.round(F.stddev_samp(v), digits).alias(f"{v}_std")]
    bits = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in chosen) for name, chosen in levels.items()}
    level = F.col("_g")
    named = F
    for name, b in bits.items():
        named = named.when(level == b, name)
    got = df.groupingSets([[F.col(k) for k in v] for v in levels.values()], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *cols, F.count("*").alias("count"))
    got = got.withColumn("level", named)
    for i, k in enumerate(keys):  # a null that is data, not the level's, drops the row
        grouped = (F.col("_g").bitwiseAND(1 << (len(keys) - 1 - i))) == 0
        got = got.where(~grouped | F.col(k).isNotNull())
    return got.drop("_g")


def by_degeneracy(comparisons: DataFrame, core_vectors: DataFrame, values: Sequence[str]) -> DataFrame:
    """Aggregated by the vector of the ranking's best core node, shorter vectors first."""
    of = comparisons.join(core_vectors.select("ranking", F.col("vec").alias("degeneracy")), "ranking")
    return aggregate_level(of, ["method", "degeneracy"], values).orderBy(F.size("degeneracy"), "degeneracy", "method")


def node_ranks(methods: DataFrame, truths: DataFrame, graph_name: str) -> DataFrame:
    """Method ranks beside both truth ranks for every probability; no pair of frames is looped over.

    ``truths``: ranking, infection_prob, node_id, ground_truth_rank, sir_rank_snr.
    """
    rows = methods.select("ranking", "method", "node_id", F.col("rank").alias("method_rank")).join(truths, ["ranking", "node_id"])
    n = rows.groupBy("ranking", "method", "infection_prob").agg(F.count("*").alias("n_nodes"))
    return rows.join(n, ["ranking", "method", "infection_prob"]).select("node_id", "method", "ground_truth_rank", "method_rank", "sir_rank_snr", F.lit(graph_name).alias("graph_name"), "ranking", "infection_prob", "n_nodes")


def best_spreaders(methods: DataFrame, vectors: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Per method: rank-1 nodes, those of the best reach vector, and its parts in % of group sizes.

    ``vectors``: node_id, vec (means), sd (deviations). Ties are averaged; a deviation is
    sqrt(mean of the variances + variance of the means).
    """
    first = methods.where("rank = 1").select("method", "node_id").join(vectors, "node_id")
    best = first.groupBy("method").agg(F.count("*").alias("num_rank1_nodes"), F.max("vec").alias("best"))
    rows = first.join(best, "method").where(F.col("vec") == F.col("best"))
    cols = [F.max("num_rank1_nodes").alias("num_rank1_nodes"), F.count("*").alias("num_best_spreaders"), F.array_sort(F.collect_list("node_id")).alias("best_spreader_nodes")]
    for i, size in enumerate(sizes):
        mean, sd = F.col("vec")[i], F.col("sd")[i]
        cols += [(100 * F.avg(mean) / size).alias(f"group_{i + 1}_pct_mean"), (100 * F.sqrt(F.avg(sd * sd) + F.var_pop(mean)) / size).alias(f"group_{i + 1}_pct_std")]
    return rows.groupBy("method").agg(*cols)


def median_reach(methods: DataFrame, vectors: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Lexicographic median of the reach vectors of each method's rank-1 nodes; with ``sd`` in ``vectors`` also of these."""
    rows = methods.where("rank = 1").join(vectors, "node_id")
    return median_vectors(rows, by, "vec", "sd" if "sd" in vectors.columns else None).withColumnsRenamed({"median": "median_reach", "median_std": "median_reach_std"})


# Parts of composite names, methods that are always selected, and methods that need a ranking.
COMPOSITE_PARTS = (
    "lexipeeling_coreness", "lexipeeling_degree", "lexipeeling_degree_lexicographic", "degree_lexicographic_lexipeeling",
    "restricted_degree_lexicographic",
)
ALWAYS = ("lexipeeling", "lexipeeling_extended")
NEED_RANKING = (
    "lexipeeling", "lexipeeling_extended", "degree_lexicographic", "random", "pagerank_uniform_jump", "pagerank_exponential_jump",
    "fairgd", "adaptgd", "fspr", "lfpr_u", "lfpr_n",
)


def is_composite(method: Column) -> Column:
    """Names that hold a composite's pattern."""
    return reduce(lambda a, b: a | b, [method.contains(p) for p in COMPOSITE_PARTS])


def is_ranking_independent(method: Column) -> Column:
    """Names of methods that give one result for all rankings."""
    return ~method.isin(*NEED_RANKING) & ~method.startswith("betas_") & ~method.startswith("restricted_") & ~is_composite(method)


def select_methods(levels: DataFrame, metric: str, top_baselines: int = 3, top_composites: int = 3, always: Sequence[str] = (), groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``method``, ``in_full``, ``in_basic``: the methods of the full and of the basic set.

    Both hold the top baselines, the methods of ALWAYS and ``always``, and each named group's best
    baseline; the full set holds the top composites as well. A method that is always selected is
    neither baseline nor composite. Several rows of a method are averaged; ties go by name.
    """
    scores = levels.where(F.col(metric).isNotNull()).groupBy("method").agg(F.avg(metric).alias("v"))
    kind = F.when(is_composite(F.col("method")), "composite").when(F.col("method").isin(*ALWAYS), "always").otherwise("baseline")
    rows = cut(scores.withColumn("kind", kind))
    place = Window.partitionBy("kind").orderBy(F.desc("v"), "method")
    best = rows.withColumn("r", F.row_number().over(place))  # methods: some hundreds
    chosen = best.where(((F.col("kind") == "baseline") & (F.col("r") <= top_baselines)) | F.col("method").isin(*ALWAYS, *always)).select("method", F.lit(True).alias("basic"))
    composites = best.where((F.col("kind") == "composite") & (F.col("r") <= top_composites)).select("method", F.lit(False).alias("basic"))
    for names in (groups or {}).values():
        of = rows.where((F.col("kind") == "baseline") & F.col("method").isin(list(names)))
        chosen = chosen.unionAll(of.orderBy(F.desc("v"), "method").limit(1).select("method", F.lit(True).alias("basic")))
    return chosen.unionAll(composites).groupBy("method").agg(F.lit(True).alias("in_full"), F.max("basic").alias("in_basic"))


def reach_over_probabilities(best: DataFrame) -> DataFrame:
    """Means of the best spreaders' group percentages over infection probabilities, per method and ranking."""
    parts = [c for c in best.columns if c.startswith("group_") and "_pct_" in c]
    keys = [c for c in ("graph_name", "ranking", "method") if c in best.columns]
    return best.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in parts], F.avg("num_rank1_nodes").alias("num_rank1_nodes"), F.countDistinct("infection_prob").alias("num_probabilities"))


def top1_simple(methods: DataFrame, truth: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per method: how many nodes it puts first, their best, mean and worst truth rank, and whether one is the truth's first."""
    rows = methods.where("rank = 1").select(*by, "node_id").join(truth.select("node_id", F.col("rank").alias("truth")), "node_id")
    return rows.groupBy(*by).agg(F.count("*").alias("num_rank1_nodes"), F.min("truth").alias("best_truth_rank"), F.avg("truth").alias("mean_truth_rank"), F.max("truth").alias("worst_truth_rank"), (F.min("truth") == 1).alias("hits_top"))


def top1_detail(methods: DataFrame, truth: DataFrame, totals: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per method: its first nodes in id order with truth rank and total reach, and the reach's mean and deviation."""
    rows = methods.where("rank = 1").select(*by, "node_id").join(truth.select("node_id", F.col("rank").alias("truth")), "node_id").join(totals.select("node_id", "total_mean"), "node_id")
    listed = F.array_sort(F.collect_list(F.struct("node_id", "truth", "total_mean")))
    return rows.groupBy(*by).agg(listed.alias("nodes"), F.avg("total_mean").alias("mean_sir_total"), F.stddev_pop("total_mean").alias("std_sir_total"))
