"""Rank operators: dense, competition, fractional, tie-break, restriction, selection.

A rank over all nodes must not put them into one task. ``rank_by`` counts the rows of each order
key, deals the distinct keys into ranges with bounds from a fixed sample, ranks within a range,
and adds the counts of the ranges before: any orderable key works, arrays included, and the plan
stays parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.loops import cut

#: Ranges of a two-phase rank; distinct keys that the range bounds are drawn from.
RANGES, BOUND_SAMPLE = 32, 1024
#: Rows below which one range is enough.
ONE_RANGE = 100_000


def _bounds(keys: DataFrame) -> list:
    """At most RANGES - 1 order keys that split a sample of the distinct keys evenly."""
    found = [r["_k"] for r in keys.select("_k").where("_k is not null").distinct().orderBy(F.xxhash64("_k")).limit(BOUND_SAMPLE).orderBy("_k").collect()]
    step = max(1, len(found) // RANGES)
    return found[step::step][: RANGES - 1]


def _literal(value, of: T.DataType) -> Column:
    """A collected order key as a column: ``F.lit`` takes no rows."""
    if value is None:
        return F.lit(None).cast(of)
    if isinstance(of, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in of])
    if isinstance(of, T.ArrayType):
        return F.array(*[_literal(x, of.elementType) for x in value]).cast(of)
    return F.lit(value).cast(of)


def rank_by(df: DataFrame, order: Column, by: Sequence[str] = (), name: str = "rank", kind: str = "dense", descending: bool = True, rows: int | None = None) -> DataFrame:
    """``df`` with the column ``name``: dense or competition rank of ``order`` within ``by``.

    Null keys come last. ``rows`` is the row count if it is known, else the rows are counted. Up
    to ONE_RANGE rows one window ranks them. Beyond, the distinct keys are ranked with their
    counts, range by range, and joined back, so a key that most rows hold is one row in the window.
    """
    turn = F.desc_nulls_last if descending else F.asc_nulls_last
    keyed = df.withColumn("_k", order)
    if (df.count() if rows is None else rows) <= ONE_RANGE:
        over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(turn("_k"))
        return keyed.withColumn(name, (F.dense_rank() if kind == "dense" else F.rank()).over(over)).drop("_k")
    keyed = cut(keyed)
    keys = cut(keyed.groupBy(*by, "_k").agg(F.count("*").alias("_n")))
    bounds = _bounds(keys)
    kind_of = keys.schema["_k"].dataType
    inside = sum((F.when(F.col("_k") >= _literal(b, kind_of), 1).otherwise(0) for b in bounds), F.lit(0))
    keys = keys.withColumn("_r", F.when(F.col("_k").isNull(), F.lit(-1) if descending else F.lit(len(bounds) + 1)).otherwise(inside))
    step = F.lit(1).cast("long") if kind == "dense" else F.col("_n")
    local = Window.partitionBy(*by, "_r").orderBy(turn("_k")).rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("_at", F.coalesce(F.sum(step).over(local), F.lit(0)))
    sizes = keys.groupBy(*by, "_r").agg(F.sum(step).alias("_m"))  # RANGES rows a group
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_r") if descending else F.asc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_r", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    ranks = placed.alias("x").join(offsets.alias("o"), same("x", "o", [*by, "_r"])).select(*[F.col(f"x.{c}") for c in (*by, "_k")], (F.col("x._at") + F.col("o._before") + 1).cast("int").alias("_rank"))
    out = keyed.alias("x").join(ranks.alias("k"), same("x", "k", [*by, "_k"]))  # few keys are broadcast, many are spread; AQE splits a hot one
    return out.select(*[F.col(f"x.{c}") for c in df.columns if c != name], F.col("k._rank").alias(name))


def dense_rank_desc(df: DataFrame, value: str = "value", by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Dense rank of higher-is-better values: what every base method reports."""
    return rank_by(df, F.col(value), by, name)


def fractional_rank(df: DataFrame, rank: str, by: Sequence[str] = (), name: str = "fractional_rank") -> DataFrame:
    """Mean position of a tie block; ``rank`` is a competition rank."""
    sizes = df.groupBy(*by, rank).agg(F.count("*").alias("_n"))
    return df.join(sizes, [*by, rank]).withColumn(name, F.col(rank) + (F.col("_n") - 1) / 2).drop("_n")


def tie_break(primary: DataFrame, secondary: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Competition rank on (primary rank, secondary rank); a missing secondary comes last.

    Keeps the primary's value. ``rows`` is the primary's row count if it is known: without it the plan runs
    once more to count it.
    """
    second = secondary.select(*by, "node_id", F.col("rank").alias("_second"))
    both = primary.join(second, [*by, "node_id"], "left")
    key = F.struct("rank", F.coalesce("_second", F.lit(2**62)))
    return rank_by(both.withColumn("_both", key).drop("rank"), F.col("_both"), by, "rank", "competition", False, rows).drop("_both", "_second")


def restrict(ranked: DataFrame, nodes: DataFrame, groups: Sequence[int], first: bool = False, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Nodes of the ranked groups (or of the first one) before the others, each side by its rank."""
    chosen = [int(g) for g in (groups[:1] if first else groups)]
    sided = ranked.join(nodes.select("node_id", (~F.col("group_id").isin(chosen)).cast("int").alias("_out")), "node_id")
    key = F.struct("_out", "rank")
    return rank_by(sided.withColumn("_both", key).drop("rank", "_out"), F.col("_both"), by, "rank", "competition", False, rows).drop("_both")


def top_spreader(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rank-1 node, the smallest id on ties."""
    return ranked.where("rank = 1").groupBy(*by).agg(F.min("node_id").alias("node_id"))


def select_nodes(results: DataFrame, most_rank: int | None = None, top: int | None = None, methods: Sequence[str] | None = None) -> DataFrame:
    """Nodes at rank 1, up to ``most_rank``, or the ``top`` by best rank over methods (ties: id)."""
    rows = results.where(F.col("method").isin(list(methods))) if methods else results
    if top is not None:
        return rows.groupBy("node_id").agg(F.min("rank").alias("rank")).orderBy("rank", "node_id").limit(top).select("node_id")
    return rows.where(F.col("rank") <= (most_rank or 1)).select("node_id").distinct()


def with_ties(df: DataFrame, value: str, k: int, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Rows at or above the k-th value."""
    return rank_by(df, F.col(value), by, "_rank", "competition", rows=rows).where(F.col("_rank") <= k).drop("_rank")


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "at") -> DataFrame:
    """``df`` and each row's 0-based place ``name`` in its group by ``order`` (columns, rising; equal rows in any order).

    Rows are dealt into ranges of (group, order), numbered inside a range, and moved by the rows of the
    group in ranges before: no group is in one task. Group columns must hold no nulls.
    """
    rows = cut(df)
    ranges = max(1, -(-rows.count() // ONE_RANGE))
    rows = cut(rows.repartitionByRange(ranges, *by, *order).withColumn("_strip", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*by, "_strip").orderBy(*order)) - 1
    sizes = rows.groupBy(*by, "_strip").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "_strip", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn("_inside", inside).join(offsets, [*by, "_strip"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_strip", "_inside", "_before")


def median_vectors(df: DataFrame, by: Sequence[str], vec: str = "vec", std: str | None = None) -> DataFrame:
    """``n`` and the lexicographic median of each group's vectors, as ``median`` (and ``median_std`` beside it).

    Vectors are sorted falling; of equal means the smaller deviation comes first, component by component. The
    median is the middle one, or the mean of the two middle ones. Found by place, without a list of the group.
    """
    key = F.transform(vec, lambda x: -x) if std is None else F.flatten(F.zip_with(vec, std, lambda m, s: F.array(-m, s)))
    cols = [vec] if std is None else [vec, std]
    placed = positions(df.where(F.col(vec).isNotNull()).select(*by, *cols, key.alias("_key")), by, ["_key"])
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    middle = placed.join(sizes, list(by)).where((F.col("at") == F.floor((F.col("n") - 1) / 2)) | (F.col("at") == F.floor(F.col("n") / 2)))  # one or two rows
    mean = lambda c: F.zip_with(F.min_by(c, "at"), F.max_by(c, "at"), lambda a, b: (a + b) / 2)
    out = [mean(vec).alias("median")] + ([] if std is None else [mean(std).alias("median_std")])
    return middle.groupBy(*by).agg(F.max("n").alias("n"), *out)
