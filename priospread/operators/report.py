"""Report transforms: selections, markers, pivots, cumulative scores, fronts, gaps, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_by
from ..plans.loops import cut
from .rollup import is_composite


def selection(levels: DataFrame, metrics: Sequence[str], k: int = 3, always: Sequence[str] = ("lexipeeling",)) -> DataFrame:
    """Methods that are named or among the top k, ties included, by any metric."""
    long = levels.select("method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("e")).select("method", "e.*").where("v is not null")
    top = rank_by(long, F.col("v"), ["metric"], "r", "competition").where(F.col("r") <= k).select("method")
    return top.unionAll(levels.where(F.col("method").isin(list(always))).select("method")).distinct()


def method_order(methods: DataFrame, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """``place``: peel variants first, then the named groups in turn, then the rest by name."""
    key = F.when(F.col("method").contains("lexipeeling"), 0)
    for i, names in enumerate(groups):
        key = key.when(F.col("method").isin(list(names)), i + 1)
    return methods.withColumn("place", key.otherwise(len(groups) + 1)).orderBy("place", "method")


def markers(table: DataFrame, column: str, value: str = "value", digits: int = 3, descending: bool = True) -> DataFrame:
    """1 for the best and 2 for the second value of each column, on rounded values."""
    rounded = table.withColumn("_v", F.round(value, digits))
    out = rank_by(rounded, F.col("_v"), [column], "marker", descending=descending)
    return out.withColumn("marker", F.when(F.col("marker") <= 2, F.col("marker"))).drop("_v")


def metric_table(long: DataFrame, column: str, value: str, columns: Sequence) -> DataFrame:
    """Methods by the given columns; the column list is part of the report, so no extra pass."""
    return long.groupBy("method").pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))


def wins(table: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """In how many columns each method holds the best rounded value."""
    long = table.select("method", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.round(c, digits).alias("v")) for c in columns])).alias("e")).select("method", "e.*")
    best = long.groupBy("c").agg(F.max("v").alias("best"))
    return long.join(F.broadcast(best), "c").groupBy("method").agg(F.count_if(F.col("v") == F.col("best")).alias("wins"))


def cumulative_scores(node_ranks: DataFrame, ks: Sequence[int], limits: Sequence[int], percent: bool = False, by: Sequence[str] = (), truth: str = "sir_rank_snr", rounded_up: bool = False) -> DataFrame:
    """``k``, ``t``, ``score``: of nodes with method rank <= k, the share of truth rank <= t in %.

    Averaged within (ranking, probability) first and over them next. ``percent`` reads t as
    percent: 100 * rank / n <= t, with n the method's median number of nodes; with ``rounded_up``
    rank <= max(1, ceil(n * t / 100)) instead. The bound on the rank reaches the scan.
    """
    rows = node_ranks.where(F.col("method_rank") <= max(ks)).select(*by, "method", "ranking", "infection_prob", "method_rank", F.col(truth).alias("truth"), "n_nodes")
    if percent:
        n = rows.groupBy(*by, "method").agg(F.median("n_nodes").alias("n"))
        rows = rows.join(n, [*by, "method"])  # a row a method
    at = rows.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("method_rank <= k")
    at = at.select("*", F.explode(F.array(*[F.lit(t) for t in limits])).alias("t"))
    if not percent:
        hit = F.col("truth") <= F.col("t")
    elif rounded_up:
        hit = F.col("truth") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("t") / 100))
    else:
        hit = F.col("truth") / F.col("n") * 100 <= F.col("t")
    one = at.groupBy(*by, "method", "k", "t", "ranking", "infection_prob").agg(F.avg(hit.cast("double")).alias("share"))
    return one.groupBy(*by, "method", "k", "t").agg((100 * F.avg("share")).alias("score"))


def cumulative_table(scores: DataFrame, k: int, limits: Sequence[int]) -> DataFrame:
    return scores.where(F.col("k") == k).groupBy("method").pivot("t", list(limits)).agg(F.first("score"))


def pareto_front(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows that no other beats in both values.

    By falling x, a row survives if its y is above all earlier ones. The distinct x are dealt into
    ranges with sampled bounds; a range starts with the best y of the ranges before it, so no
    window holds more than a range.
    """
    best = cut(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias(y)))
    found = sorted(r[0] for r in best.select(x).orderBy(F.xxhash64(x)).limit(1024).collect())
    bounds = found[32::32]
    ranged = best.withColumn("_r", sum((F.when(F.col(x) >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)))
    before = ranged.groupBy("_r").agg(F.max(y).alias("_m")).withColumn("_high", F.max("_m").over(Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)))  # at most 32 rows
    local = Window.partitionBy("_r").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    front = ranged.withColumn("_near", F.max(y).over(local)).join(F.broadcast(before.select("_r", "_high")), "_r")
    high = F.greatest("_near", "_high")  # skips nulls
    return points.join(front.where(high.isNull() | (F.col(y) > high)).select(x, y), [x, y], "left_semi")


def gap_to_best(scores: DataFrame, value: str = "score", dataset: str = "graph_name") -> DataFrame:
    """Largest drop below the best method over all datasets, of methods present on every one."""
    means = scores.groupBy(dataset, "method").agg(F.avg(value).alias("v"))
    best = means.groupBy(dataset).agg(F.max("v").alias("best"))
    gaps = means.join(F.broadcast(best), dataset).withColumn("gap", F.col("best") - F.col("v"))
    n = means.select(dataset).distinct().agg(F.count("*").alias("n"))
    out = gaps.groupBy("method").agg(F.max("gap").alias("worst_gap"), F.max_by(dataset, F.struct("gap", dataset)).alias("worst_dataset"), F.count("*").alias("k"))
    return out.crossJoin(F.broadcast(n)).where("k = n").drop("k", "n")


def strategy_comparison(levels: DataFrame, a: str, b: str, value: str, dataset: str = "graph_name", least_datasets: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """Per strategy: means of two methods and on how many datasets the first wins, ties, loses."""
    pick = lambda m, c: levels.where(F.col("method") == m).select(dataset, "ranking_strategy", F.col(value).alias(c))
    rows = pick(a, "va").join(pick(b, "vb"), [dataset, "ranking_strategy"])
    d = F.col("va") - F.col("vb")
    out = rows.groupBy("ranking_strategy").agg(F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"), F.countDistinct(dataset).alias("datasets"))
    return out.where(F.col("datasets") >= least_datasets)


def strategy_cumulative(node_ranks: DataFrame, strategies: DataFrame, percents: Sequence[int]) -> DataFrame:
    """Cumulative scores of rank-1 rows by strategy; the limit of a percent is rounded up to a rank."""
    first = strategies.select("ranking", "ranking_strategy").distinct()
    rows = node_ranks.where("method_rank = 1").join(first, "ranking")
    return cumulative_scores(rows, [1], percents, percent=True, by=["ranking_strategy"], rounded_up=True).drop("k")


def robustness(levels: DataFrame, value: str, k: int = 3) -> DataFrame:
    """``method``: the peel, and of the baselines all at the maximum if they are more than k, else k.

    Baselines are the methods without the peel's name in theirs; ties among the k go by name.
    """
    rows = cut(levels.where(~F.col("method").contains("lexipeeling") & F.col(value).isNotNull()).select("method", F.col(value).alias("v")))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("v"), "method")  # methods: some hundreds
    top = rows.agg(F.max("v").alias("top"))
    placed = rows.withColumn("r", F.row_number().over(down)).crossJoin(F.broadcast(top))
    placed = placed.withColumn("tied", F.count_if(F.col("v") == F.col("top")).over(Window.partitionBy(F.lit(0))))
    chosen = placed.where(F.when(F.col("tied") > k, F.col("v") == F.col("top")).otherwise(F.col("r") <= k)).select("method")
    return chosen.unionAll(levels.where("method = 'lexipeeling'").select("method")).distinct()


def beta_reach(reach: DataFrame, beta: str = "beta", value: str = "pct") -> DataFrame:
    """Reach by beta in % of the position's maximum."""
    top = F.max(value).over(Window.partitionBy("position"))
    return reach.withColumn("relative", F.when(top > 0, 100 * F.col(value) / top)).orderBy("position", beta)


def reach_by_beta(comparisons: DataFrame, value: str = "mrr") -> DataFrame:
    """Methods by beta group."""
    return comparisons.groupBy("method").pivot("betas_group").agg(F.avg(value))


def tie_curve(methods: DataFrame, points: int = 200, by: Sequence[str] = ("method", "ranking")) -> DataFrame:
    """``by``, ``pct``, ``size``: tie block size over the cumulative % of nodes in the order of rank.

    Blocks from rank 1 on give (cumulative %, size) knots, one curve per ranking; each of the grid
    points 0 to 100 lies between the last knot at or before it and the next one, or has the size
    of the first knot. The join is bounded: ``points`` a curve.
    """
    blocks = methods.groupBy(*by, "rank").agg(F.count("*").alias("c"))
    up, all_ = Window.partitionBy(*by).orderBy("rank"), Window.partitionBy(*by)
    knots = blocks.select(*by, "rank", F.col("c").cast("double").alias("size"), (F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(all_) * 100).alias("x"))
    spans = knots.select(*by, F.coalesce(F.lag("x").over(up), F.lit(-1.0)).alias("x0"), F.coalesce(F.lag("size").over(up), F.col("size")).alias("y0"), F.col("x").alias("x1"), F.col("size").alias("y1"))
    step = 100.0 / max(1, points - 1)
    pct = lambda i: F.when(i == points - 1, F.lit(100.0)).otherwise(i * F.lit(step))
    span = F.sequence(F.greatest(F.lit(0), F.floor(F.col("x0") / step).cast("int")), F.least(F.lit(points - 1), F.ceil(F.col("x1") / step).cast("int")))
    inside = F.filter(span, lambda i: (pct(i) > F.col("x0")) & ((pct(i) <= F.col("x1")) | ((F.col("x1") > 100 - 1e-9) & (i == points - 1))))
    at = spans.select("*", F.explode(inside).alias("i")).withColumn("pct", pct(F.col("i")))
    y = F.when(F.col("x0") < 0, F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("pct") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return at.select(*by, "pct", y.alias("size"))


def tie_bands(methods: DataFrame, points: int = 200) -> DataFrame:
    """Median and quartiles of the rankings' tie curves at each grid point, per method."""
    p = lambda q: F.percentile("size", F.lit(q))
    return tie_curve(methods, points).groupBy("method", "pct").agg(p(0.5).alias("median"), p(0.25).alias("q25"), p(0.75).alias("q75"))


def sem_ties(node_ranks: DataFrame, levels: Sequence[str], probability: float, method: str = "coreness") -> DataFrame:
    """``sem``: nodes, distinct truth ranks and mean tie size of one method's rows at one probability.

    ``levels`` names the truth-rank column of each noise level; averaged over rankings.
    """
    rows = node_ranks.where((F.col("method") == method) & (F.col("infection_prob") == probability))
    long = rows.select("ranking", F.explode(F.array(*[F.struct(F.lit(c).alias("sem"), F.col(c).alias("r")) for c in levels])).alias("e")).select("ranking", "e.*")
    one = long.groupBy("ranking", "sem").agg(F.count("*").alias("n"), F.countDistinct("r").alias("k"))
    return one.groupBy("sem").agg(F.avg("n").alias("n_nodes"), F.avg("k").alias("n_unique"), F.avg(F.col("n") / F.col("k")).alias("mean_tie"))


def quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*by).agg(F.min(value).alias("low"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.max(value).alias("high"))


def baselines(levels: DataFrame) -> DataFrame:
    return levels.where(~F.col("method").contains("lexipeeling"))


def best_baseline(levels: DataFrame, value: str) -> DataFrame:
    return baselines(levels).agg(F.max_by("method", F.struct(value, "method")).alias("method"), F.max(value).alias("v"))


def variants(levels: DataFrame) -> DataFrame:
    """The peel, its extension and its composites."""
    return levels.where(F.col("method").contains("lexipeeling")).withColumn("composite", is_composite(F.col("method")))


def mean_and_spread(levels: DataFrame, value: str, digits: int = 3) -> DataFrame:
    """Text cells ``mean ± std`` with a star on the best mean."""
    top = F.max(F.round(f"{value}_mean", digits)).over(Window.partitionBy(F.lit(0)))
    cell = F.concat(F.format_number(F.col(f"{value}_mean"), digits), F.lit(" ± "), F.coalesce(F.format_number(F.col(f"{value}_std"), digits), F.lit("-")))
    return levels.withColumn("cell", F.concat(cell, F.when(F.round(f"{value}_mean", digits) == top, "*").otherwise("")))
