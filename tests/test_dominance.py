"""Distributed tau and weighted tau against sums over all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priospread.operators import agreement, dominance


def plain_tau(m, s):
    a, b = np.sign(m[:, None] - m), np.sign(s[:, None] - s)
    under = float((a * a).sum()) * float((b * b).sum())
    return (a * b).sum() / math.sqrt(under) if under else 0.0


def plain_weighted(x, y):
    def one(a, b):
        r = np.empty(len(a))
        r[np.lexsort((b, a))[::-1]] = np.arange(len(a))
        w = 1 / (1 + r)
        ww, da, db = w[:, None] + w, np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        return (ww * da * db).sum() / math.sqrt((ww * da**2).sum() * (ww * db**2).sum())

    return (one(x, y) + one(y, x)) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 9), st.integers(1, 5)), min_size=1, max_size=80))
def test_merging_counts_what_is_ahead(rows):
    v, w = (np.array(x, np.int64) for x in zip(*rows))
    assert dominance.ahead(v, w).tolist() == [int(w[:i][v[:i] < v[i]].sum()) for i in range(len(v))]


def frame(spark, groups):
    rows = [(name, i, int(a), int(b)) for name, (m, s) in groups.items() for i, (a, b) in enumerate(zip(m, s))]
    return spark.createDataFrame(rows, "method string, node_id long, m int, s int")


@pytest.mark.parametrize("strip", [dominance.STRIP, 9])
def test_groups_of_all_kinds(spark, monkeypatch, strip):
    monkeypatch.setattr(dominance, "STRIP", strip)
    rng = np.random.default_rng(strip)
    hot = np.where(rng.random(200) < 0.5, 3, rng.integers(1, 40, 200))
    groups = {
        "ties": (rng.integers(1, 8, 90), rng.integers(1, 9, 90)), "distinct": (rng.permutation(120), rng.permutation(120)), "same": (np.arange(60), np.arange(60)),
        "opposite": (np.arange(50), np.arange(50)[::-1]), "hot": (hot, rng.integers(1, 5, 200)), "one": (np.array([1]), np.array([1])), "flat": (np.ones(9, int), np.arange(9)),
    }
    got = {r.method: r for r in dominance.rank_agreement(frame(spark, groups), ["method"]).collect()}
    assert set(got) == set(groups)
    for name, (m, s) in groups.items():
        assert got[name].n == len(m) and got[name].kendall_tau == pytest.approx(plain_tau(m, s), abs=1e-12), name
        if len(set(m.tolist())) > 1 and len(set(s.tolist())) > 1:
            assert got[name].weighted_tau == pytest.approx(plain_weighted(m, s), abs=1e-10), name
        else:
            assert got[name].weighted_tau is None
    flipped = {r.method: r.weighted_tau for r in dominance.rank_agreement(frame(spark, groups), ["method"], invert=True).collect()}
    assert flipped["ties"] == pytest.approx(plain_weighted(*[-x for x in groups["ties"]]), abs=1e-10)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("a", None, 3), ("a", 3, None)], "method string, m int, s int").withColumn("k", F.lit("clash")).withColumn("w1", F.lit(1))
    [row] = dominance.rank_agreement(df, ["method"]).collect()
    assert (row.n, row.kendall_tau) == (3, pytest.approx(1.0))
    assert dominance.rank_agreement(df.limit(0), ["method"]).count() == 0
    assert agreement.kendall(df.where("m = 1")).first().kendall_tau == 0.0 and math.isnan(agreement.kendall(df.where("m = 1")).first().weighted_tau)


def test_sums_of_the_harmonic_series(spark):
    cases = [(0, 1), (0, 64), (3, 200), (63, 1), (64, 1), (64, 500), (10**6, 12), (10**9, 10**9), (40, 10**6)]
    df = spark.createDataFrame(cases, "a long, c long").select("a", "c", dominance._harmonic(F.col("a"), F.col("c")).alias("h"))
    for r in df.collect():
        want = math.fsum(1 / (1 + x) for x in range(r.a, r.a + r.c)) if r.c <= 10**6 else math.log1p(r.c / (r.a + 0.5))
        assert r.h == pytest.approx(want, rel=1e-12 if r.c <= 10**6 else 1e-9)


def test_work_is_spread_over_strips(spark, monkeypatch):
    """No strip of a hundred thousand nodes, a third of them tied, holds much more than its share."""
    monkeypatch.setattr(dominance, "STRIP", 4000)
    n = 100_000
    df = spark.range(n).select(F.lit("x").alias("method"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("m"), F.pmod(F.hash("id"), F.lit(60_000)).alias("s"))
    held, plain = [], dominance._prefix

    def prefix(cells, by, strip, order, name):
        held.extend(r[0] for r in cells.groupBy(strip).count().select("count").collect())
        return plain(cells, by, strip, order, name)

    monkeypatch.setattr(dominance, "_prefix", prefix)
    row = dominance.rank_agreement(df, ["method"]).first()
    assert row.n == n and abs(row.kendall_tau) < 0.02 and max(held) < 8000
