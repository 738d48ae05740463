"""Batch comparison: every method against every truth of a graph, ranking, probability and noise level.

All keys run in one job: ranks, pairs and measures are grouped by the key and never looped over. The
planner takes the keys that the tables offer, leaves those whose spreading is too weak or too strong,
and those whose results are there already (an anti-join on the partitions of the result). Results are
partitioned by key and written by dynamic overwrite, so a run replaces whole keys or none, a second run
writes nothing, and a lost run is done again for the keys that it has not committed.

Tables: ``methods(graph_name, ranking, method, node_id, rank)``; ``sir(graph_name, infection_prob,
node_id, group_id, mean, std, num_simulations)``; ``betas(graph_name, ranking, betas_group, betas)``,
where a vector blends each component with the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import rank_by
from ..plans.loops import cut
from .agreement import metrics
from .dominance import rank_agreement

#: What a result belongs to. ``prob`` is the probability with four digits, as result files name it.
KEYS = ("graph_name", "ranking", "prob", "sem")
KEY_TYPES = "graph_name string, ranking string, prob string, sem int"
# The default cut-offs and the bounds of the spreading filter.
TOP_RAW, TOP, PERCENTS, DETAIL = (1, 5, 10, 20), (1, 3, 5, 10), (1, 3, 5, 10), 3
LOWER, UPPER, LEAST_SHARE, DEGREE_FACTOR = 0.01, 0.20, 0.01, 1.5


def label(probability: str | Column) -> Column:
    return F.format_string("%.4f", probability)


def usable(sir: DataFrame, graphs: DataFrame, lower: float = LOWER, upper: float = UPPER, least: float = LEAST_SHARE, factor: float = DEGREE_FACTOR) -> DataFrame:
    """``graph_name``, ``infection_prob`` whose share of significant seeds lies between the bounds.

    ``graphs`` holds ``graph_name``, ``n`` and ``avg_degree``. A seed is significant when its reach, as a share
    of the graph, is at least ``max(least, factor * avg_degree / n)``; the share divides by the graph's nodes.
    """
    totals = sir.groupBy("graph_name", "infection_prob", "node_id").agg(F.sum("mean").alias("total"))
    level = F.greatest(F.lit(least), F.coalesce(F.lit(factor) * F.col("avg_degree") / F.col("n"), F.lit(0.0)))
    hits = totals.join(graphs, "graph_name").groupBy("graph_name", "infection_prob").agg((F.count_if(F.col("total") / F.col("n") >= level) / F.max("n")).alias("significant_ratio"))
    return hits.where(F.col("significant_ratio").between(lower, upper)).select("graph_name", "infection_prob")


def plan(methods: DataFrame, probabilities: DataFrame, sems: Sequence[int], done: DataFrame | None = None) -> DataFrame:
    """The keys, with ``infection_prob``, that have methods and spreading results and no comparison yet."""
    rankings = methods.select("graph_name", "ranking").distinct()
    levels = F.explode(F.array(*[F.lit(int(x)) for x in sems]))
    jobs = rankings.join(probabilities.select("graph_name", "infection_prob").distinct(), "graph_name").withColumn("prob", label(F.col("infection_prob"))).withColumn("sem", levels)
    return jobs if done is None else jobs.join(done.select(*KEYS).distinct(), list(KEYS), "left_anti")


def levelled(sir: DataFrame, sems: Sequence[int]) -> DataFrame:
    """``sir`` a noise level: ``value`` is the mean at level 0, else the mean in whole units of the level.

    The unit of a group is the exact percentile of its positive standard errors, 1 / sqrt(runs) without any.
    """
    sem, group = F.col("std") / F.sqrt("num_simulations"), ["graph_name", "infection_prob", "group_id"]
    out = sir.select(*group, "node_id", "mean", F.lit(0).alias("sem"), F.col("mean").alias("value")) if 0 in sems else None
    if above := [int(x) for x in sems if x]:
        units = F.array(*[F.struct(F.lit(x).alias("sem"), F.percentile(F.when(sem > 0, sem), F.lit(x / 100)).alias("unit")) for x in above])
        units = sir.groupBy(*group).agg(units.alias("u"), F.max(1 / F.sqrt("num_simulations")).alias("floor")).select(*group, "floor", F.explode("u").alias("u"))
        rows = sir.join(units, group).select(*group, "node_id", "mean", F.col("u.sem").alias("sem"), F.floor(F.col("mean") / F.coalesce("u.unit", "floor")).cast("double").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def reach_vectors(rows: DataFrame, jobs: DataFrame, value: str = "value") -> DataFrame:
    """``vec`` of every key and seed: the values of the ranked groups in order, 0 where one is missing."""
    places = jobs.select(*KEYS, "infection_prob", F.size(F.split("ranking", "_")).alias("length"), F.posexplode(F.split("ranking", "_"))).withColumn("group_id", F.col("col").cast("int"))
    # Seeds that no ranked group is known of stay in, with zeros.
    seeds = rows.select("graph_name", "infection_prob", "sem", "node_id", "group_id", value).join(places.select(*KEYS, "infection_prob", "length").distinct(), ["graph_name", "infection_prob", "sem"])
    held = seeds.join(places.select(*KEYS, "group_id", "pos"), [*KEYS, "group_id"], "left")
    found = F.map_from_entries(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", value))))  # a ranking's length at most
    out = held.groupBy(*KEYS, "node_id", "length").agg(found.alias("of"))
    vec = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0.0)))
    return out.select(*KEYS, "node_id", vec.alias("vec"))


def _ranked(vectors: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    vectors = cut(vectors)
    return rank_by(vectors, F.col("vec"), by, name, "competition", rows=vectors.count())


def truths(sir: DataFrame, jobs: DataFrame, sems: Sequence[int], betas: DataFrame | None = None) -> DataFrame:
    """``s_raw`` and ``s`` of every key, ``betas_group`` and seed: ranks by means, and by the key's truth.

    The group ``none`` ranks the levelled vectors; a beta group ranks them blended, and both ranks are that.
    """
    vectors = reach_vectors(levelled(sir, sems), jobs)
    means = reach_vectors(sir.withColumn("sem", F.explode(F.array(*[F.lit(int(x)) for x in sems]))), jobs, "mean")
    raw = _ranked(means, KEYS, "s_raw").select(*KEYS, "node_id", "s_raw")
    plain = _ranked(vectors, KEYS, "s").select(*KEYS, "node_id", "s").join(raw, [*KEYS, "node_id"])
    out = plain.select(*KEYS, F.lit("none").alias("betas_group"), "node_id", "s_raw", "s")
    if betas is not None:
        named = vectors.join(betas.select("graph_name", "ranking", "betas_group", "betas"), ["graph_name", "ranking"])
        mixed = F.transform("vec", lambda x, i: x + F.coalesce(F.try_element_at("vec", i + 2), F.lit(0.0)) * F.coalesce(F.try_element_at("betas", i + 1), F.lit(0.0)))
        blended = _ranked(named.select(*KEYS, "betas_group", "node_id", mixed.alias("vec")), [*KEYS, "betas_group"], "s")
        out = out.unionAll(blended.select(*KEYS, "betas_group", "node_id", F.col("s").alias("s_raw"), "s"))
    return out


def compare_keys(methods: DataFrame, sir: DataFrame, jobs: DataFrame, sems: Sequence[int], betas: DataFrame | None = None, detail: int = DETAIL) -> dict[str, DataFrame]:
    """The tables ``comparison``, ``top_k`` and ``ties`` of the keys in ``jobs``.

    Methods named ``betas_`` are compared with blended truths only, all others with every truth.
    """
    truth = cut(truths(sir, jobs, sems, betas))
    named = methods.select("graph_name", "ranking", "method", "node_id", F.col("rank").alias("m"))
    pairs = cut(named.join(truth, ["graph_name", "ranking", "node_id"]).where((F.col("betas_group") != "none") | ~F.col("method").contains("betas_")))
    by = [*KEYS, "betas_group", "method"]
    raw = metrics(pairs.withColumn("s", F.col("s_raw")), by, TOP_RAW, ())
    raw = raw.select(*by, *[c for c in raw.columns if c.startswith("precision")])
    snr = metrics(pairs, by, TOP, PERCENTS)
    snr = snr.select(*by, "num_common_nodes", F.col("num_truth_top1").alias("num_snr_top1"), "mrr", *[F.col(c).alias(c.replace("precision", "precision_snr")) for c in snr.columns if c.startswith(("arhr", "precision"))])
    first = pairs.groupBy(*by).agg(F.count_if(F.col("m") == 1).alias("num_method_top1"), F.min_by("node_id", F.struct("m", "node_id")).alias("method_top_1_node"), F.min_by("node_id", F.struct("s_raw", "node_id")).alias("sir_top_1_node"))
    agreed = rank_agreement(pairs, by).drop("n")
    comparison = agreed.join(raw, by).join(snr, by).join(first, by)
    reach = sir.groupBy("graph_name", label(F.col("infection_prob")).alias("prob"), "node_id").agg(F.sum("mean").alias("total_reach_mean"))
    top = pairs.where(F.col("m") <= detail).select(*by, "node_id", F.col("m").alias("method_rank"), F.col("s_raw").alias("ground_truth_rank")).join(reach, ["graph_name", "prob", "node_id"])
    return {"comparison": comparison, "top_k": top.select(*by, "node_id", "method_rank", "ground_truth_rank", "total_reach_mean"), "ties": tie_tables(sir, jobs, sems)}


def tie_tables(sir: DataFrame, jobs: DataFrame, sems: Sequence[int]) -> DataFrame:
    """Nodes in ties of each prefix of the vectors of means (``raw_mean``) and of levelled ones (``snr``)."""
    means = reach_vectors(sir.withColumn("sem", F.explode(F.array(*[F.lit(int(x)) for x in sems]))), jobs, "mean")
    both = means.withColumn("variant", F.lit("raw_mean")).unionAll(reach_vectors(levelled(sir, sems), jobs).withColumn("variant", F.lit("snr")))
    by = [*KEYS, "variant"]
    prefixes = both.select(*by, "vec", F.explode(F.sequence(F.lit(1), F.size("vec"))).alias("component_index"))
    blocks = prefixes.groupBy(*by, "component_index", F.slice("vec", F.lit(1), F.col("component_index")).alias("prefix")).agg(F.count("*").alias("c"))
    out = blocks.groupBy(*by, "component_index").agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("num_nodes_tied"), F.count("*").alias("num_unique_vectors"), F.sum("c").alias("num_nodes"))
    return out.withColumn("fraction_tied", F.col("num_nodes_tied") / F.col("num_nodes"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def done_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys that ``path`` holds comparisons of, by its partitions; None before the first run."""
    folder = f"{path}/comparison"
    return spark.read.schema(KEY_TYPES).parquet(folder).distinct() if _exists(spark, folder) else None


def run_batch(methods: DataFrame, sir: DataFrame, graphs: DataFrame, path: str, sems: Sequence[int] = (50,), betas: DataFrame | None = None, spread_filter: bool = True) -> int:
    """Compare the keys that ``path`` lacks, write them below it, and return their number.

    ``comparison`` is written last: a key that has it has its ``top_k`` and ``ties`` too.
    """
    spark = methods.sparkSession
    allowed = usable(sir, graphs) if spread_filter else sir
    jobs = cut(plan(methods, allowed, sems, done_keys(spark, path)))
    n = jobs.count()
    if n:
        wanted = sir.join(jobs.select("graph_name", "infection_prob").distinct(), ["graph_name", "infection_prob"], "left_semi")
        tables = compare_keys(methods.join(jobs.select("graph_name", "ranking").distinct(), ["graph_name", "ranking"], "left_semi"), cut(wanted), jobs, sems, betas)
        for name in ("ties", "top_k", "comparison"):
            tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/{name}")
    return n


def read_batch(spark: SparkSession, path: str, name: str = "comparison") -> DataFrame:
    """A table that ``run_batch`` wrote; filters on its keys read only their partitions."""
    found = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in KEYS], KEY_TYPES])
    return spark.read.schema(fields).parquet(f"{path}/{name}")
