"""Pair counts between two ranks of any number of nodes, without a group in one task.

Kendall's tau and its weighted form need, for each node, how many others both ranks order alike.
Nodes of equal ranks (m, s) are one *cell*; for a cell let

* ``p1`` and ``p2`` be the nodes ahead of it in the order (m, s) and in the order (s, m),
* ``dom`` the nodes ahead of it in both.

Then nodes ordered alike less nodes ordered unlike are ``4 dom - 2 p1 - 2 p2 + n - em - es + c``, where
``em`` and ``es`` count the nodes of its m and of its s, and ``c`` those of the cell. All but ``dom`` are
prefix sums and group sums.

``dom`` is counted in two levels. Cells are dealt into ranges of the first order (strips k) and of the
second (strips l), both by Spark's range partitioning, so a strip holds about ``STRIP`` cells whatever the
ties. What is ahead in both is in an earlier k and an earlier l (a table of strip sums), or in the same k
(counted inside that strip by merging), or in an earlier k of the same l (counted inside that strip).
Weights are sums of the harmonic series over the places of a cell, and every measure is a weighted sum
of these counts, so strips return three sums a group and no count travels back to its cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut

#: Cells of a strip, at least; strips of either order, at most, so the table of strip sums stays below 2^20 rows a group.
STRIP, STRIPS = 1 << 17, 1 << 10
#: Places from which the harmonic series is taken from its expansion (error below 1e-15 there).
EXACT = 64


def _harmonic(start: Column, count: Column) -> Column:
    """Sum of 1 / (1 + r) for r from ``start`` to ``start + count - 1``."""
    end = start + count
    low = F.least(end, F.lit(EXACT))
    few = F.when(start < EXACT, F.aggregate(F.sequence(start, F.greatest(low - 1, start)), F.lit(0.0), lambda a, r: a + 1 / (r + 1))).otherwise(F.lit(0.0))
    a = F.greatest(start, F.lit(EXACT)).cast("double")
    tail = lambda x: 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    b = F.greatest(end, F.lit(EXACT)).cast("double")
    return few + F.log1p((b - a) / a) + tail(b) - tail(a)


def ahead(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place the summed weight of earlier places of smaller value, by merging runs."""
    n = len(values)
    _, y = np.unique(values, return_inverse=True)
    order, out, width, top = np.arange(n), np.zeros(n, np.int64), 1, int(y.max(initial=0)) + 1
    while width < n:
        run, left = order // (2 * width), (order // width) % 2 == 0
        # Runs are merged two by two; of equal values the right one goes first, so it counts smaller ones only.
        merged = np.argsort(((run * top + y[order]) << 1) | left, kind="stable")
        order, run, left = order[merged], run[merged], left[merged]
        sums = np.cumsum(np.where(left, weights[order], 0))
        before = np.r_[0, sums][np.searchsorted(run, run)]
        out[order[~left]] += (sums - before)[~left]
        width *= 2
    return out


def _place(*columns: np.ndarray) -> np.ndarray:
    """The place of each row in the order of ``columns``."""
    out = np.empty(len(columns[0]), np.int64)
    out[np.lexsort(columns[::-1])] = np.arange(len(out))
    return out


def _sums(keys: pa.Table, by: Sequence[str], counts: np.ndarray, t: pa.Table) -> pa.Table:
    c, w1, w2 = (t.column(x).to_numpy() for x in ("c", "w1", "w2"))
    # A strip's sum may leave 64 bits: it travels as text and is added up as a decimal.
    total = sum(int(x) for x in (c * counts).tolist()) if float(counts.max(initial=0)) * float(c.sum()) >= 2**62 else int((c * counts).sum())
    return pa.table([*[keys.column(k).slice(0, 1) for k in by], pa.array([str(total)]), pa.array([float((w1 * counts).sum())]), pa.array([float((w2 * counts).sum())])], [*by, "t", "d1", "d2"])


def _strips(cells: DataFrame, by: Sequence[str], strip: str) -> DataFrame:
    """Sums over the cells of what is ahead of them inside their strip."""
    if strip == "k":
        count = lambda t: (_place(t["m"], t["s"]), _place(t["s"], t["m"]))
    else:  # earlier strips of the first order only
        count = lambda t: (_place(t["s"], t["m"]), t["k"])

    def run(table: pa.Table) -> pa.Table:
        t = {x: table.column(x).to_numpy() for x in ("m", "s", "k", "c")}
        along, values = count(t)
        order = np.argsort(along)
        found = np.empty(len(order), np.int64)
        found[order] = ahead(values[order], t["c"][order])
        return _sums(table, by, found, table)

    kinds = [f"{k} {cells.schema[k].dataType.simpleString()}" for k in by]
    return cells.select(*by, strip, *[x for x in ("m", "s", "k", "c", "w1", "w2") if x != strip]).groupBy(*by, strip).applyInArrow(run, ", ".join([*kinds, "t string, d1 double, d2 double"]))


def _grid(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over the cells of what is in earlier strips of both orders: at most STRIPS^2 rows a group."""
    sums = cells.groupBy(*by, "k", "l").agg(F.sum("c").alias("c"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))

    def run(table: pa.Table) -> pa.Table:
        k, l, c = (table.column(x).to_numpy() for x in ("k", "l", "c"))  # noqa: E741
        k, l = (np.unique(x, return_inverse=True)[1] for x in (k, l))  # noqa: E741
        grid = np.zeros((k.max() + 2, l.max() + 2), np.int64)
        grid[k + 1, l + 1] = c
        before = grid.cumsum(0).cumsum(1)[k, l]
        return _sums(table, by, before, table)

    kinds = [f"{x} {cells.schema[x].dataType.simpleString()}" for x in by]
    return sums.groupBy(*by).applyInArrow(run, ", ".join([*kinds, "t string, d1 double, d2 double"]))


def _prefix(cells: DataFrame, by: Sequence[str], strip: str, order: Sequence[str], name: str) -> DataFrame:
    """``cells`` and the nodes ``name`` ahead of each in its group: inside its strip, and in strips before."""
    inside = F.sum("c").over(Window.partitionBy(*by, strip).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = cells.groupBy(*by, strip).agg(F.sum("c").alias("_n"))  # STRIPS rows a group
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(strip).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*by, strip, F.coalesce(before, F.lit(0)).alias("_before"))
    return cells.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sizes, [*by, strip]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def rank_agreement(pairs: DataFrame, by: Sequence[str], m: str = "m", s: str = "s", invert: bool = False) -> DataFrame:
    """Per group: the nodes ``n``, ``kendall_tau`` (tau-b) and ``weighted_tau`` of the ranks ``m`` and ``s``.

    Pairs weigh 1 / (1 + r_i) + 1 / (1 + r_j), r counted from the largest (m, s), or (s, m) for the other half
    of the mean; ``invert`` turns the ranks around. Groups in which a rank is constant have tau 0 and no
    weighted tau. ``by`` must hold no nulls; rows with a null rank take no part; an empty table has no rows.
    """
    by = list(by)
    turn = -1 if invert else 1
    rows = pairs.select(*by, (F.col(m) * turn).cast("long").alias("m"), (F.col(s) * turn).cast("long").alias("s")).where("m is not null and s is not null")
    cells = cut(rows.groupBy(*by, "m", "s").agg(F.count("*").alias("c")))
    strips = max(1, min(STRIPS, math.ceil(cells.count() / STRIP)))
    cells = cut(cells.repartitionByRange(strips, *by, "m", "s").withColumn("k", F.spark_partition_id()))
    cells = cut(cells.repartitionByRange(strips, *by, "s", "m").withColumn("l", F.spark_partition_id()))
    cells = _prefix(_prefix(cells, by, "k", ["m", "s"], "p1"), by, "l", ["s", "m"], "p2")
    whole = cells.groupBy(*by).agg(F.sum("c").alias("n"))
    cells = cells.join(whole, by)
    weight = lambda p: _harmonic(F.col("n") - F.col(p) - F.col("c"), F.col("c"))
    cells = cut(cells.withColumns({"w1": weight("p1"), "w2": weight("p2")}))

    exact = lambda c: F.col(c).cast("decimal(38,0)")
    parts = _strips(cells, by, "k").unionAll(_strips(cells, by, "l")).unionAll(_grid(cells, by))
    dom = parts.groupBy(*by).agg(F.sum(exact("t")).alias("t"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    rest = F.col("n") + F.col("c") - 2 * F.col("p1") - 2 * F.col("p2")
    c, n = exact("c"), F.first("n")
    plain = cells.groupBy(*by).agg(
        n.alias("n"), F.sum(c * rest.cast("decimal(20,0)")).alias("r"), F.sum(F.col("w1") * rest).alias("r1"), F.sum(F.col("w2") * rest).alias("r2"),
        F.sum("w1").alias("w1"), F.sum("w2").alias("w2"),
    )

    def blocks(side: str) -> DataFrame:
        """Nodes of equal rank: sums of size^2, and of size times their weights."""
        one = cells.groupBy(*by, side).agg(F.sum("c").alias("e"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
        e = exact("e")
        return one.groupBy(*by).agg(F.sum(e * e).alias(f"{side}_t"), F.sum(F.col("e") * F.col("w1")).alias(f"{side}_1"), F.sum(F.col("e") * F.col("w2")).alias(f"{side}_2"))

    all_ = plain.join(dom, by).join(blocks("m"), by).join(blocks("s"), by)
    net = (4 * F.col("t") + F.col("r") - F.col("m_t") - F.col("s_t")).cast("double")
    size = F.col("n").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    of = lambda side: (size - F.col(f"{side}_t")).cast("double")  # noqa: E731  ordered pairs that the rank tells apart
    tau = F.when((of("m") > 0) & (of("s") > 0), net / F.sqrt(of("m")) / F.sqrt(of("s"))).otherwise(F.lit(0.0))

    def half(k: str) -> Column:
        top = 4 * F.col(f"d{k}") + F.col(f"r{k}") - F.col(f"m_{k}") - F.col(f"s_{k}")
        under = [F.col("n") * F.col(f"w{k}") - F.col(f"{side}_{k}") for side in ("m", "s")]
        told = (of("m") > 0) & (of("s") > 0)
        return F.when(told, top / F.sqrt(F.when(told, under[0])) / F.sqrt(F.when(told, under[1])))

    return all_.select(*by, "n", tau.alias("kendall_tau"), ((half("1") + half("2")) / 2).alias("weighted_tau"))
