"""Graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import rank_by
from .text import Graph, canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cosource_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers who bought the same part from the same supplier; groups are market segments."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c"))
    bought = lines.join(orders, "l_orderkey").select("c", "l_partkey", "l_suppkey").distinct()
    other = bought.withColumnRenamed("c", "d")
    edges = bought.join(other, ["l_partkey", "l_suppkey"]).where("c < d").select(F.col("c").alias("src"), F.col("d").alias("dst")).distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), "c_mktsegment")
    segments = rank_by(customers.select("c_mktsegment").distinct(), F.col("c_mktsegment"), name="r", descending=False, rows=0)
    nodes = customers.join(F.broadcast(segments), "c_mktsegment").select("node_id", (F.col("r") - 1).cast("int").alias("group_id"))
    return Graph(nodes, edges)


def comoment_graph(spark: SparkSession, sf_dir: str, groups: int = 5) -> Graph:
    """Users who were active in the same minute; ``members`` are the users of each minute."""
    active = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("long").alias("u"), F.date_trunc("minute", "ts").alias("m"))
    seen = active.distinct()
    edges = seen.join(seen.withColumnRenamed("u", "v"), "m").where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    nodes = active.select(F.col("u").alias("node_id")).distinct().withColumn("group_id", F.pmod("node_id", F.lit(groups)).cast("int"))
    return Graph(nodes, edges, active.where("m is not null").select(F.col("u").alias("node_id"), (F.unix_micros("m") / 60_000_000).cast("long").alias("place")))


def nation_trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations with more line items between them than the average pair; groups are regions."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    pairs = lines.join(orders, "l_orderkey").join(buyers, "c_custkey").join(sellers, "l_suppkey").where("a <> b")
    weights = pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("w"))
    average = weights.agg(F.avg("w").alias("mean"))  # one row
    edges = weights.join(F.broadcast(average), F.col("w") > F.col("mean")).select("src", "dst")
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("int").alias("group_id"))
    return Graph(nodes, canonical(edges))


def flag_trade_graphs(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The trade graphs of nations, one a return flag, as one graph, and the ``graph_name`` of its nodes.

    A node is the flag's code point times 100 plus the nation; an edge has more line items than the flag's mean.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.ascii("l_returnflag") * 100).cast("long").alias("f"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    pairs = lines.join(orders, "l_orderkey").join(buyers, "c_custkey").join(sellers, "l_suppkey").where("a <> b")
    weights = pairs.groupBy("f", (F.col("f") + F.least("a", "b")).alias("src"), (F.col("f") + F.greatest("a", "b")).alias("dst")).agg(F.count("*").alias("w"))
    edges = weights.join(weights.groupBy("f").agg(F.avg("w").alias("mean")), "f").where("w > mean").select("src", "dst")
    ends = weights.select(F.col("src").alias("node_id")).unionAll(weights.select("dst")).distinct()
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("int").alias("group_id"))
    nodes = ends.join(regions, F.col("node_id") % 100 == F.col("k")).select("node_id", "group_id")
    return Graph(nodes, edges), nodes.select("node_id", F.concat(F.lit("trade_"), F.char(F.floor(F.col("node_id") / 100))).alias("graph_name"))
