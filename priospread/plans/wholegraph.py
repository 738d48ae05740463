"""Registered queries of the customer and moment graphs as a whole, and of order statistics, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexi
from ..functions.ranks import median_vectors
from ..operators import epidemic, fairrank, local, paths, peel, rollup
from ..sources.tables import comoment_graph, cosource_graph, nation_trade_graph
from . import oracles as o
from . import queries as base
from .loops import cut


def closeness_rank_cosource(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return base._scored(g, paths.closeness(g))


def local_global_rank_cosource(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return base._scored(g, local.local_global(g))


def entropy_rank_cosource(spark: SparkSession, sf: str) -> DataFrame:
    g = cosource_graph(spark, sf)
    return base._scored(g, local.entropy_degree_distance(g))


def distance_counts_cosource(spark: SparkSession, sf: str) -> DataFrame:
    return paths.distance_counts(cosource_graph(spark, sf))


def priority_cores_cosource(spark: SparkSession, sf: str) -> DataFrame:
    """The peel vectors of several rankings of unlike lengths, in one loop."""
    cores = peel.frontier_cores(cosource_graph(spark, sf), [base.RANKING, (2, 3, 0)])
    return cores.select("ranking", "node_id", lexi.render(F.col("vec")).alias("value"))


def source_masses_20(spark: SparkSession, sf: str) -> DataFrame:
    g = comoment_graph(spark, sf).cut()
    out = fairrank.source_masses(g.links, g.nodes, rounds=20, epsilon=None)
    return out.select("source", "group_id", F.round("mass", base.DIGITS).alias("mass"))


def median_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicographic medians of two measures with two deviations, per flag and status."""
    pair = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", pair("l_quantity", "l_discount").alias("vec"), pair("l_tax", "l_extendedprice").alias("sd"))
    out = median_vectors(rows, ["l_returnflag", "l_linestatus"], "vec", "sd")
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(F.col(c)[i], base.DIGITS).alias(f"{c}_{i}") for c in ("median", "median_std") for i in (0, 1)])


def median_first_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The median reach of the nations that degree puts first in each region's list."""
    g = nation_trade_graph(spark, sf).cut()
    sir = cut(base._reach(g))
    vectors = epidemic.reach_vectors(sir, base.RANKING).join(epidemic.reach_vectors(sir, base.RANKING, "std").withColumnRenamed("vec", "sd"), "node_id")
    methods = g.nodes.select("node_id", F.concat(F.lit("region_"), F.col("group_id")).alias("method"), F.lit(1).alias("rank"))
    out = rollup.median_reach(methods, vectors)
    return out.select("method", "n", *[F.round(F.col(c)[i], base.DIGITS).alias(f"{c}_{i}") for c in ("median_reach", "median_reach_std") for i in (0, 1)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        closeness_rank_cosource, local_global_rank_cosource, entropy_rank_cosource, distance_counts_cosource, priority_cores_cosource,
        source_masses_20, median_lines, median_first_reach,
    )}


#: Steps that reach all of a customer's component on the test tables.
STEPS = 10


def _levels(steps: int = STEPS) -> list[str]:
    """Pairs by distance, level by level."""
    out = ["l0 AS MATERIALIZED (SELECT node_id AS src, node_id AS dst, 0 AS d FROM nodes)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
    for k in range(1, steps + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT x.src, x.dst, {k} AS d FROM (SELECT DISTINCT a.src, b.dst FROM l{k - 1} a JOIN adj b ON a.dst = b.src) x ANTI JOIN s{k - 1} s ON s.src = x.src AND s.dst = x.dst)")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})")
    return [*out, f"far AS MATERIALIZED (SELECT * FROM s{steps} WHERE d > 0)"]


def _masses(rounds: int) -> list[str]:
    out = ["deg AS MATERIALIZED (SELECT src, count(*) AS k FROM adj GROUP BY src)", "y0 AS MATERIALIZED (SELECT node_id, group_id, 1.0::DOUBLE AS value FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(f"""y{k} AS MATERIALIZED (SELECT node_id, group_id, sum(value) AS value FROM (
  SELECT src AS node_id, group_id, sum(0.85::DOUBLE * y.value / deg.k) AS value FROM adj JOIN deg USING (src) JOIN y{k - 1} y ON y.node_id = dst GROUP BY ALL
  UNION ALL SELECT node_id, group_id, 1.0::DOUBLE FROM nodes) GROUP BY ALL)""")
    return out


def oracle_sql() -> dict[str, str]:
    q, digits = o.q, base.DIGITS
    close = "cl AS (SELECT n.node_id, coalesce(r / total * (r / (SELECT count(*) - 1 FROM nodes)::DOUBLE), 0) AS value FROM nodes n LEFT JOIN (SELECT src, count(*)::DOUBLE AS r, sum(d)::DOUBLE AS total FROM far GROUP BY src) x ON x.src = n.node_id)"
    entropy = "en AS MATERIALIZED (SELECT n.node_id, coalesce(log2(t) - l / t, 0) AS e FROM nodes n LEFT JOIN (SELECT src, sum(value)::DOUBLE AS t, sum(value * log2(value)) AS l FROM adj JOIN deg ON node_id = dst GROUP BY src) x ON x.src = n.node_id)"
    spread = lambda term, other: f"sp AS (SELECT n.node_id, coalesce(max(n.value) / (SELECT count(*) FROM nodes)::DOUBLE * sum({term}), 0) AS value FROM deg n LEFT JOIN far ON far.src = n.node_id LEFT JOIN {other} j ON j.node_id = far.dst LEFT JOIN {other} i ON i.node_id = n.node_id GROUP BY n.node_id)"
    middle = lambda table, by, cols: f"SELECT {by}, n, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY k) - 1 AS pl, count(*) OVER (PARTITION BY {by}) AS n FROM {table}) WHERE pl = (n - 1) // 2 OR pl = n // 2 GROUP BY {by}, n"
    mean = lambda c, name: f"round(avg({c}), {digits}) AS {name}"
    peeled = lambda r: q(o.COSOURCE, *o.peel(40, r), f"SELECT '{lexi.ranking_key(r)}' AS ranking, node_id, array_to_string(v, '_') AS value FROM peeled")
    vec = lambda c: [f"coalesce(max({c}) FILTER (group_id = {g}), 0.0)" for g in base.RANKING]
    m, s = vec("mean"), vec("std")
    return {
        "closeness_rank_cosource": q(o.COSOURCE, *_levels(), close, o.scored("cl")),
        "local_global_rank_cosource": q(o.COSOURCE, o.DEGREE, *_levels(), spread("sqrt(j.value) / d", "deg"), o.scored("sp")),
        "entropy_rank_cosource": q(o.COSOURCE, o.DEGREE, *_levels(), entropy, spread("sqrt(greatest(i.e + j.e, 0)) / d", "en"), o.scored("sp")),
        "distance_counts_cosource": q(o.COSOURCE, *_levels(), "SELECT src AS node_id, d, count(*) AS r FROM far GROUP BY ALL"),
        "priority_cores_cosource": f"SELECT * FROM ({peeled(base.RANKING)}) UNION ALL SELECT * FROM ({peeled((2, 3, 0))})",
        "source_masses_20": q(o.COMOMENT, *_masses(20), f"SELECT node_id AS source, group_id, round(value / sum(value) OVER (PARTITION BY node_id), {digits}) AS mass FROM y20"),
        "median_lines": q(
            "x AS (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_extendedprice::DOUBLE AS e, [-l_quantity::DOUBLE, l_tax::DOUBLE, -l_discount::DOUBLE, l_extendedprice::DOUBLE] AS k FROM lineitem)",
            middle("x", "l_returnflag, l_linestatus", ", ".join(mean(c, n) for c, n in (("a", "median_0"), ("b", "median_1"), ("c", "median_std_0"), ("e", "median_std_1"))))),
        "median_first_reach": q(
            o.NATIONS, *o.spread(), f"rv AS (SELECT 'region_' || n.group_id AS method, m0, m1, s0, s1, [-m0, s0, -m1, s1] AS k FROM (SELECT node_id, {m[0]} AS m0, {m[1]} AS m1, {s[0]} AS s0, {s[1]} AS s1 FROM sir GROUP BY node_id) JOIN nodes n USING (node_id))",
            middle("rv", "method", ", ".join(mean(c, n) for c, n in (("m0", "median_reach_0"), ("m1", "median_reach_1"), ("s0", "median_reach_std_0"), ("s1", "median_reach_std_1"))))),
    }
