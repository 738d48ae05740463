"""Batch comparison: plain ranks and measures per key, planning, resumption, blended truths; the loader of files."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from priospread.operators import batch
from priospread.sources.files import read_comparisons

GRAPHS, RANKINGS, PROBS, SEMS, RUNS = ("ga", "gb"), ("0_1", "2_0_1"), (0.05, 0.1), (0, 50), 20


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    methods, sir = [], []
    for g, n in zip(GRAPHS, (18, 25)):
        for r in RANKINGS:
            for m in ("degree", "h1_index", "betas_degree_0.5"):
                methods += [(g, r, m, i, int(x)) for i, x in enumerate(rng.integers(1, 8, n))]
        for p in PROBS:
            sir += [(g, p, i, k, float(rng.integers(0, 60)) / RUNS, float(rng.integers(0, 9)) / 4, RUNS) for i in range(n - 2) for k in range(3)]
    return (
        spark.createDataFrame(methods, "graph_name string, ranking string, method string, node_id long, rank int"),
        spark.createDataFrame(sir, "graph_name string, infection_prob double, node_id long, group_id int, mean double, std double, num_simulations long"),
        spark.createDataFrame([("ga", 18, 2.0), ("gb", 25, 3.0)], "graph_name string, n long, avg_degree double"),
        spark.createDataFrame([(g, r, "half", [0.5] * r.count("_")) for g in GRAPHS for r in RANKINGS], "graph_name string, ranking string, betas_group string, betas array<double>"),
    )


def competition(vectors):
    return {i: 1 + sum(w > v for w in vectors.values()) for i, v in vectors.items()}


def plain_truths(sir, key):
    """raw, levelled and blended ranks of a key."""
    g, r, p, sem = key
    groups = [int(x) for x in r.split("_")]
    rows = [x for x in sir if x.graph_name == g and x.infection_prob == p]
    value = {}
    for k in {x.group_id for x in rows}:
        errs = [x["std"] / RUNS**0.5 for x in rows if x.group_id == k and x["std"] > 0]
        unit = np.percentile(errs, sem) if sem and errs else RUNS**-0.5
        value |= {(x.node_id, k): (float(np.floor(x["mean"] / unit)) if sem else x["mean"]) for x in rows if x.group_id == k}
    mean = {(x.node_id, x.group_id): x["mean"] for x in rows}
    nodes = {x.node_id for x in rows}
    vec = {i: tuple(value.get((i, k), 0.0) for k in groups) for i in nodes}
    mixed = {i: tuple(a + 0.5 * b for a, b in itertools.zip_longest(v, v[1:], fillvalue=0.0)) for i, v in vec.items()}
    return competition({i: tuple(mean.get((i, k), 0.0) for k in groups) for i in nodes}), competition(vec), competition(mixed)


def plain_measures(m, raw, s):
    nodes = sorted(set(m) & set(s))
    n, a, b = len(nodes), np.array([m[i] for i in nodes]), np.array([s[i] for i in nodes])
    da, db = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    under = ((da**2).sum() * (db**2).sum()) ** 0.5
    first = [1 / m[i] for i in nodes if s[i] == 1]
    share = lambda t, k: min(sum(m[i] <= k and t[i] <= k for i in nodes), k) / k
    hits = [1 / m[i] for i in nodes if s[i] <= 3]
    return n, (da * db).sum() / under if under else 0.0, np.mean(first) if first else None, share(raw, min(5, n)), share(s, max(1, n // 10)), np.mean(hits) if hits else None


def test_every_key_against_plain_python(spark, tables, tmp_path):
    methods, sir, graphs, betas = tables
    path = str(tmp_path / "out")
    assert batch.run_batch(methods, sir, graphs, path, SEMS, betas, spread_filter=False) == 16
    got = {(r.graph_name, r.ranking, float(r.prob), r.sem, r.betas_group, r.method): r for r in batch.read_batch(spark, path).collect()}
    rows, ranks = sir.collect(), {}
    for r in methods.collect():
        ranks.setdefault((r.graph_name, r.ranking, r.method), {})[r.node_id] = r["rank"]
    assert len(got) == 16 * 5  # two plain methods with two truths, a blended one with one
    for key in itertools.product(GRAPHS, RANKINGS, PROBS, SEMS):
        raw, snr, mixed = plain_truths(rows, key)
        for method in ("degree", "h1_index", "betas_degree_0.5"):
            m = ranks[key[0], key[1], method]
            for group, (a, b) in {"none": (raw, snr), "half": (mixed, mixed)}.items():
                r = got.get((*key, group, method))
                if group == "none" and method.startswith("betas_"):
                    assert r is None
                    continue
                n, tau, mrr, p5, pct, arhr = plain_measures(m, a, b)
                assert (r.num_common_nodes, r.kendall_tau, r.mrr, r.precision_at_5, r.precision_snr_pct_10, r.arhr_at_3) == (n, *[x if x is None else pytest.approx(x) for x in (tau, mrr, p5, pct, arhr)])
                assert r.num_method_top1 == sum(m[i] == 1 for i in b) and r.sir_top_1_node == min(b, key=lambda i: (a[i], i))
    ties = batch.read_batch(spark, path, "ties")
    assert ties.where("sem = 0").groupBy(*batch.KEYS, "component_index").agg(F.countDistinct("num_nodes_tied").alias("c")).where("c > 1").count() == 0  # level 0 is the means
    assert batch.read_batch(spark, path, "top_k").where("method_rank > 3").count() == 0


def test_a_second_run_writes_nothing_and_a_lost_key_comes_back(spark, tables, tmp_path):
    import os
    import shutil

    methods, sir, graphs, betas = tables
    path = str(tmp_path / "out")
    files = lambda: {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for f in (f"{d}/{x}" for x in names) if f.endswith(".parquet")}
    assert batch.run_batch(methods.where("graph_name = 'ga'"), sir, graphs, path, (50,), betas, spread_filter=False) == 4
    before = files()
    assert batch.run_batch(methods.where("graph_name = 'ga'"), sir, graphs, path, (50,), betas, spread_filter=False) == 0 and files() == before
    whole = {tuple(r) for r in batch.read_batch(spark, path).select(*batch.KEYS, "betas_group", "method", "mrr").collect()}
    lost = [d for d, _, _ in os.walk(f"{path}/comparison") if d.endswith("ranking=0_1/prob=0.0500/sem=50")]
    assert len(lost) == 1
    shutil.rmtree(lost[0])
    assert batch.run_batch(methods.where("graph_name = 'ga'"), sir, graphs, path, (50,), betas, spread_filter=False) == 1
    assert {tuple(r) for r in batch.read_batch(spark, path).select(*batch.KEYS, "betas_group", "method", "mrr").collect()} == whole
    kept = {f: t for f, t in before.items() if "ranking=0_1/prob=0.0500" not in f}
    assert {f: t for f, t in files().items() if f in kept} == kept  # other keys were not written again
    assert batch.run_batch(methods, sir, graphs, path, (50,), betas, spread_filter=False) == 4  # the other graph


def test_spreads_that_are_too_weak_or_too_strong_are_left_out(spark, tables):
    _, sir, graphs, _ = tables
    rows, sizes = sir.collect(), {r.graph_name: r for r in graphs.collect()}
    for low, high in ((0.0, 1.0), (0.3, 0.8), (2.0, 3.0)):
        want = set()
        for g, p in itertools.product(GRAPHS, PROBS):
            n, level = sizes[g].n, max(0.01, 1.5 * sizes[g].avg_degree / sizes[g].n)
            totals = {}
            for r in rows:
                if (r.graph_name, r.infection_prob) == (g, p):
                    totals[r.node_id] = totals.get(r.node_id, 0.0) + r["mean"]
            if low <= sum(t / n >= level for t in totals.values()) / n <= high:
                want.add((g, p))
        assert {tuple(r) for r in batch.usable(sir, graphs, low, high).collect()} == want


def test_empty_tables_and_missing_groups(spark, tables, tmp_path):
    methods, sir, graphs, _ = tables
    assert batch.run_batch(methods.limit(0), sir, graphs, str(tmp_path / "a"), SEMS, spread_filter=False) == 0
    assert batch.run_batch(methods, sir.limit(0), graphs, str(tmp_path / "b"), SEMS) == 0
    odd = methods.where("ranking = '0_1' and graph_name = 'ga'").withColumn("ranking", F.lit("9_0"))  # no such group 9
    assert batch.run_batch(odd, sir, graphs, str(tmp_path / "c"), (0,), spread_filter=False) == 2
    assert batch.read_batch(spark, str(tmp_path / "c")).count() == 4


def test_comparison_files_of_unlike_columns(spark, tmp_path):
    at = lambda name, cols: spark.createDataFrame([("degree", 1.0)], f"method string, {cols} double").write.parquet(f"{tmp_path}/{name}.parquet")
    at("sem_0/g_rx_r0_1_p0.0500_comparison", "mrr")
    at("sem_50/g_rx_r0_1_p0.1000_betas_equal_0.5_comparison", "arhr")
    at("other_r2_p0.1000_comparison", "mrr")
    at("old_p0.1000_comparison", "mrr")
    got = {(r.graph_name, r.ranking, r.infection_prob, r.betas_group, r.sem): (r.mrr, r.arhr) for r in read_comparisons(spark, str(tmp_path)).collect()}
    assert got == {("g_rx", "0_1", 0.05, "none", 0): (1.0, None), ("g_rx", "0_1", 0.1, "equal_0.5", 50): (None, 1.0), ("other", "2", 0.1, "none", None): (1.0, None)}
    some = read_comparisons(spark, str(tmp_path), graph="g_rx", probability=0.1)
    assert [r.betas_group for r in some.collect()] == ["equal_0.5"] and all("g_rx" in f for f in some.inputFiles())
    with pytest.raises(FileNotFoundError):
        read_comparisons(spark, str(tmp_path), graph="absent")
