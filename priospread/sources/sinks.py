"""Writers and readers of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexi import render


def write_methods(results: DataFrame, path: str, timed_out: Sequence[tuple[str, str]] = (), mode: str = "append") -> None:
    """Method rows partitioned by ranking; methods that timed out on a graph leave no row."""
    out = results
    for graph, method in timed_out:
        out = out.where(~((F.col("graph_name") == graph) & (F.col("method") == method)))
    if "vec" in out.columns:
        out = out.withColumn("value", F.coalesce(render(F.col("vec")), F.col("score").cast("string"))).drop("vec", "score")
    out.write.mode(mode).partitionBy("ranking").parquet(path)


def write_betas(betas: DataFrame, path: str) -> None:
    betas.write.mode("overwrite").json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or JSON by the suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.json(path) if kind == "json" else spark.read.parquet(path)


def write_any(df: DataFrame, path: str) -> None:
    """CSV tables are reports of bounded size and come as one file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_node_ranks(spark: SparkSession, path: str, most_rank: int | None = None) -> DataFrame:
    """Node ranks; the bound on the method rank reaches the scan."""
    out = spark.read.parquet(path)
    return out if most_rank is None else out.where(F.col("method_rank") <= most_rank)


def without_done(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs whose output does not exist yet."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sir_wide(long: DataFrame, groups: Sequence[int]) -> DataFrame:
    """One row per seed with a mean and a deviation column per group."""
    cols = [F.max(F.when(F.col("group_id") == g, F.col(c))).alias(f"group_{g}_{c}") for g in groups for c in ("mean", "std")]
    return long.groupBy("node_id").agg(*cols, F.max("num_simulations").alias("num_simulations"))
