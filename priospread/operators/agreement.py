"""How well a method's ranks agree with the simulated truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import fractional_rank
from ..plans.loops import cut
from .dominance import rank_agreement

# The default cut-offs.
TOP_K, TOP_PERCENT = (1, 5, 10, 20, 50), (1, 3, 5, 10)


def paired(methods: DataFrame, truth: DataFrame) -> DataFrame:
    """Method rows with the truth rank of the same node: ``m`` and ``s``."""
    return methods.select("method", "node_id", F.col("rank").alias("m")).join(truth.select("node_id", F.col("rank").alias("s")), "node_id")


def precision_at(k: Column) -> Column:
    """Common nodes of the top k by both ranks, at most k, over k."""
    return F.least(F.count_if((F.col("m") <= k) & (F.col("s") <= k)), k) / k


def metrics(pairs: DataFrame, by: Sequence[str] = ("method",), top: Sequence[int] = TOP_K, percents: Sequence[int] = TOP_PERCENT) -> DataFrame:
    """Precision, reciprocal ranks and counts in one aggregate per method.

    k is at most the number of nodes, percents give max(1, floor(n * pct / 100)). ``mrr`` is the
    mean of 1 / method rank over nodes of truth rank 1, ``arhr`` over truth rank <= k.
    """
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    rows = pairs.join(F.broadcast(n) if not by else n, list(by))
    cols: list[Column] = [F.max("n").alias("num_common_nodes"), F.count_if(F.col("s") == 1).alias("num_truth_top1"), F.avg(F.when(F.col("s") == 1, 1 / F.col("m"))).alias("mrr")]
    cut_offs = [(f"at_{k}", F.least(F.lit(k).cast("long"), F.col("n"))) for k in top]
    cut_offs += [(f"pct_{p}", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(p) / 100))) for p in percents]
    for name, k in cut_offs:
        both = F.sum(((F.col("m") <= k) & (F.col("s") <= k)).cast("long"))
        cols.append((F.least(both, F.max(k)) / F.max(k)).alias(f"precision_{name}"))
        cols.append(F.avg(F.when(F.col("s") <= k, 1 / F.col("m"))).alias(f"arhr_{name}"))
    return rows.groupBy(*by).agg(*cols)


def kendall(pairs: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """``kendall_tau`` and ``weighted_tau`` per group; undefined, the first is 0 and the second NaN."""
    out = rank_agreement(pairs, by)
    return out.select(*by, "kendall_tau", F.coalesce("weighted_tau", F.lit(float("nan"))).alias("weighted_tau"))


def kendall_sql(pairs: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Tau-b alone, per group."""
    return kendall(pairs, by).drop("weighted_tau")


def compare(methods: DataFrame, truth: DataFrame, vectors: DataFrame | None = None, group: str = "none") -> DataFrame:
    """All metrics of every method against one truth, with the reach vectors of both best nodes."""
    pairs = cut(paired(methods, truth))
    out = metrics(pairs).join(kendall(pairs), "method").withColumn("betas_group", F.lit(group))
    if vectors is None:
        return out
    best = lambda rank, name: pairs.join(vectors, "node_id").groupBy("method").agg(F.min_by(F.struct("node_id", "vec"), F.struct(rank, "node_id")).alias(name))
    tops = best("m", "m1").join(best("s", "s1"), "method")
    return out.join(tops.select("method", F.col("m1.node_id").alias("method_top_1"), F.col("m1.vec").alias("method_top_1_reach"), F.col("s1.node_id").alias("sir_top_1"), F.col("s1.vec").alias("sir_top_1_reach")), "method")


def compare_all(methods: DataFrame, plain: DataFrame, blended: dict[str, DataFrame]) -> DataFrame:
    """Methods without betas against the plain truth, and all of them against each blended one."""
    is_beta = F.col("method").contains("betas_")
    out = compare(methods.where(~is_beta), plain)
    for label, truth in blended.items():
        out = out.unionByName(compare(methods, truth, group=label))
    return out


def top_k_detail(methods: DataFrame, truth: DataFrame, k: int, reach: DataFrame) -> DataFrame:
    """Nodes of method rank <= k with their truth rank, if any, and reach vector."""
    rows = methods.where(F.col("rank") <= k).select("method", "node_id", F.col("rank").alias("method_rank"))
    return rows.join(truth.select("node_id", F.col("rank").alias("ground_truth_rank")), "node_id", "left").join(reach, "node_id", "left")


def tie_statistics(vectors: DataFrame, length: int, variant: str = "raw_mean") -> DataFrame:
    """Per prefix length: nodes in blocks of two or more equal prefixes, distinct prefixes, share."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: F.struct(j.alias("component_index"), F.slice(F.col("vec"), 1, j).alias("prefix")))).alias("e")
    blocks = vectors.select(prefix).select("e.*").groupBy("component_index", "prefix").agg(F.count("*").alias("c"))
    out = blocks.groupBy("component_index").agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(F.lit(0))).alias("num_nodes_tied"), F.count("*").alias("num_unique_vectors"), F.sum("c").alias("num_nodes"))
    return out.select(F.lit(variant).alias("variant"), "*", (F.col("num_nodes_tied") / F.col("num_nodes")).alias("fraction_tied"))


def tie_profile(methods: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Nodes, distinct ranks, largest and mean tie block, percent of nodes in a tie."""
    blocks = methods.groupBy(*by, "rank").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return blocks.groupBy(*by).agg(n.alias("n_nodes"), F.count("*").alias("n_unique_ranks"), F.max("c").alias("max_tie_size"), F.avg("c").alias("mean_tie_size"), (100 * F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(F.lit(0))) / n).alias("pct_tied"))


def fractional(methods: DataFrame) -> DataFrame:
    return fractional_rank(methods, "rank", ["method"])


def tie_summary(statistics: DataFrame, by: Sequence[str] = ("variant", "component_index")) -> DataFrame:
    """Tie statistics over rankings and probabilities: mean, least and largest share, mean counts."""
    return statistics.groupBy(*by).agg(
        F.avg("fraction_tied").alias("fraction_tied_mean"), F.min("fraction_tied").alias("fraction_tied_min"), F.max("fraction_tied").alias("fraction_tied_max"),
        F.avg("num_nodes_tied").alias("num_nodes_tied_mean"), F.avg("num_unique_vectors").alias("num_unique_vectors_mean"), F.count("*").alias("count"),
    )
