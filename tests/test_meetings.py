"""Sums over the neighbours of a graph of meetings, against the same graph's edges."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priospread.operators import fairrank, meetings, pagerank
from priospread.plans import loops
from priospread.sources.text import Graph


@pytest.fixture(scope="module")
def met(spark):
    random.seed(3)
    rows = {(u, random.randint(0, 40)) for u in range(30) for _ in range(4)} | {(99, 1000)} | {(u, 500) for u in range(8)} | {(u, 501) for u in range(8)}
    pairs = Counter((u, v) for u, m in rows for v, n in rows if m == n and u < v)
    members = spark.createDataFrame(sorted(rows), "node_id long, place long")
    nodes = members.select("node_id").distinct().withColumn("group_id", (F.col("node_id") % 3).cast("int"))
    return members, nodes, pairs, spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_repeated_pairs_in_runs_of_any_size(met):
    rows = np.array([tuple(r) for r in met[0].collect()])
    for most in (1, 7, 10**6):
        got = [(int(a), int(b), int(w)) for x in meetings.repeated_pairs(rows[:, 0], rows[:, 1], rows[:, 0], rows[:, 1], most) for a, b, w in zip(*x) if a < b]
        assert sorted(got) == sorted((*p, w) for p, w in met[2].items() if w > 1)
    none = np.zeros(0, np.int64)
    assert not list(meetings.repeated_pairs(none, none, none, none)) and not list(meetings.repeated_pairs(rows[:, 0], rows[:, 1], none, none))


@pytest.mark.parametrize("rows", [20, 10**6])
def test_surplus_pairs_of_many_blocks(met, monkeypatch, rows):
    monkeypatch.setattr(meetings, "BLOCK_ROWS", rows)
    got = sorted(tuple(r) for r in meetings.surplus_pairs(met[0], met[0].count()).collect())
    assert got == sorted((*p, w - 1) for p, w in met[2].items() if w > 1)


@pytest.mark.parametrize("most", [0, 10**6])
def test_operators_need_no_edges(met, monkeypatch, most):
    monkeypatch.setattr(meetings, "BROADCAST", most)
    members, nodes, pairs, edges = met
    plain, lean = Graph(nodes, edges).cut(), Graph(nodes, None, members).cut()
    got = lambda df: sorted((*r[:-1], pytest.approx(r[-1], abs=1e-12)) for r in df.collect())
    same = lambda make: make(lean).columns == make(plain).columns and got(make(lean)) == sorted(map(tuple, make(plain).collect()))
    two = nodes.select("node_id", (F.col("group_id") % 2).alias("group_id"))
    half = two.select("group_id").distinct().withColumn("share", F.lit(0.5))
    phi = fairrank.default_phi(nodes)
    assert same(lambda g: pagerank.pagerank(g, rounds=3, tolerance=None))
    assert same(lambda g: fairrank.out_counts(g.links, nodes))
    if most:
        assert same(lambda g: fairrank.neighbourhood_fair(g.links, nodes, phi, rounds=3, epsilon=None))
        assert same(lambda g: fairrank.step_fair(g.links, nodes, phi, rounds=3, epsilon=None))
        assert same(lambda g: fairrank.source_masses(g.links, nodes, rounds=3, epsilon=None).select("source", "group_id", "mass"))
        assert same(lambda g: fairrank.target_fair(g.links, two, half, nodes.where("node_id < 12").select("node_id"), "neighbourhood", rounds=3, epsilon=None))
    assert lean.links.degrees().where("node_id = 99").isEmpty()


def test_disk_of_meetings(met, spark):
    members, _, pairs, _ = met
    links = meetings.Meetings(members.unionAll(members))  # rows that repeat count once
    got = sorted(tuple(r) for r in links.surplus.collect())
    assert got == sorted((*p, w - 1) for p, w in pairs.items() if w > 1)  # each pair is kept once, not in both directions
    degrees = Counter(x for p in pairs for x in p)
    assert dict(map(tuple, links.degrees().collect())) == degrees
    none = meetings.Meetings(members.limit(0))
    assert none.surplus.isEmpty() and none.degrees().isEmpty()


def test_packed_places():
    lists = [[5], [-60, 0, 2**40], [], list(range(1000))]
    batch = pa.record_batch({"node_id": pa.array(range(4), pa.int64()), "places": pa.array(lists, pa.list_(pa.int64()))})
    packed = next(iter(meetings._packed(iter([batch.slice(1)])))).column("packed")
    assert [x.tolist() for x in meetings._unpacked(packed)] == lists[1:] and len(packed[2].as_py()) < 100


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("write", [loops.cut, loops.mark])
def test_written_frames_leave_no_shuffle_files(spark, write):
    before, setting = _shuffle_files(spark), spark.conf.get(loops.CLEANUP)
    done = write(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().join(spark.range(700).withColumnRenamed("id", "k").repartition(3, "k"), "k"))
    end = time.time() + 10  # files go by messages
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(loops.CLEANUP) == setting
    assert done.count() == 700 and done.agg(F.sum("count")).first()[0] == 5000
