"""Loops over whole graphs: frontier peels, 64-source searches, group masses of all sources, medians by place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priospread.functions import ranks
from priospread.operators import fairrank, hindex, local, paths, peel

from .test_graph import framed, near, random_graph, values


def plain_peel(groups, edges, ranking, beta=0, scale=1):
    add = peel._weights(ranking, beta, scale)
    ids = sorted(groups)
    pos = np.array([ranking.index(groups[i]) if groups[i] in ranking else -1 for i in ids])
    src, dst = (np.array([ids.index(e[k]) for e in edges], int) for k in (0, 1))
    return dict(zip(ids, peel.peel_arrays(len(ids), src, dst, pos, add)))


@pytest.mark.parametrize("seed", [1])
def test_frontier_peel_of_several_rankings(spark, seed):
    groups, edges = random_graph(seed, 22, 0.25)
    rankings = [[1, 0], [2], [0, 2, 1]]
    rows = peel.frontier_cores(framed(spark, groups, edges), rankings).collect()
    for r in rankings:
        name = "_".join(map(str, r))
        assert {x.node_id: tuple(x.vec) for x in rows if x.ranking == name} == plain_peel(groups, edges, r)
    rows = peel.frontier_cores(framed(spark, groups, edges), [[1, 2]], 30, 100).collect()
    assert {x.node_id: tuple(x.vec) for x in rows} == plain_peel(groups, edges, [1, 2], 30, 100)


def test_frontier_peel_of_a_chain_and_of_nodes_without_edges(spark):
    groups = {i: i % 2 for i in range(14)}
    g = framed(spark, groups, [(i, i + 1) for i in range(9)])
    assert {x.node_id: tuple(x.vec) for x in peel.frontier_cores(g, [[0, 1]]).collect()} == plain_peel(groups, [(i, i + 1) for i in range(9)], [0, 1])


def test_forms_for_one_task_are_bounded(spark, monkeypatch):
    groups, edges = random_graph(7, 30, 0.2)
    g = framed(spark, groups, edges)
    assert values(hindex.coreness(g)) == values(hindex.coreness(g, one_task=True))
    assert values(paths.betweenness(g)) == pytest.approx(values(paths.betweenness(g, one_task=True)))
    monkeypatch.setattr(hindex, "TASK_EDGES", 5)
    monkeypatch.setattr(peel, "TASK_EDGES", 5)
    monkeypatch.setattr(paths, "WORKER_EDGES", 5)
    for work in (lambda: hindex.coreness(g, one_task=True), lambda: peel.grouped_cores(g, [[0]]), lambda: paths.betweenness(g, one_task=True)):
        with pytest.raises(ValueError):
            work()


def bfs(groups, edges):
    out = {}
    links = near(groups, edges)
    for s in groups:
        seen, front, d = {s}, {s}, 0
        while front:
            d += 1
            front = {v for u in front for v in links[u]} - seen
            seen |= front
            out |= {(s, v): d for v in front}
    return out, links


def test_searches_from_all_nodes(spark):
    """150 nodes: three blocks of sources and several components."""
    rng = random.Random(2)
    groups = {i: i % 3 for i in range(150)}
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(140), rng.randrange(140)) for _ in range(190)) if a != b})
    far, links = bfs(groups, edges)
    g = framed(spark, groups, edges)
    counts = {}
    for (s, _), d in far.items():
        counts[s, d] = counts.get((s, d), 0) + 1
    assert {(r.node_id, r.d): r.r for r in paths.distance_counts(g).collect()} == counts
    n = len(groups)
    reach = {s: [d for (a, _), d in far.items() if a == s] for s in groups}
    assert values(paths.closeness(g)) == pytest.approx({s: (len(x) / sum(x) * len(x) / (n - 1) if x else 0.0) for s, x in reach.items()})
    deg = {u: len(links[u]) for u in groups}
    root = {s: deg[s] / n * sum(deg[v] ** 0.5 / d for (a, v), d in far.items() if a == s) for s in groups}
    assert values(local.local_global(g)) == pytest.approx(root)
    ent = {}
    for u in groups:
        t = sum(deg[v] for v in links[u])
        ent[u] = -sum(deg[v] / t * np.log2(deg[v] / t) for v in links[u]) if t else 0.0
    want = {s: deg[s] / n * sum(max(0.0, ent[s] + ent[v]) ** 0.5 / d for (a, v), d in far.items() if a == s) for s in groups}
    assert values(local.entropy_degree_distance(g)) == pytest.approx(want, abs=1e-9)


def test_searches_without_edges(spark):
    g = framed(spark, {0: 0, 1: 1, 2: 0}, [(0, 1)])
    alone = type(g)(g.nodes, g.edges.limit(0))
    assert paths.distance_counts(alone).count() == 0 and set(values(paths.closeness(alone)).values()) == {0.0}


def test_group_masses_of_all_sources(spark):
    """One vector a group gives the sums of one PageRank a source, sinks included."""
    rng = random.Random(9)
    groups = {i: i % 3 for i in range(12)}
    edges = sorted({(rng.randrange(9), rng.randrange(12)) for _ in range(40)})  # 9, 10 and 11 have no way out
    nodes, e = spark.createDataFrame(list(groups.items()), "node_id long, group_id int"), spark.createDataFrame(edges, "src long, dst long")
    got = {(r.source, r.group_id): r.mass for r in fairrank.source_masses(e, nodes, rounds=45, epsilon=None).collect()}
    out = {u: [b for a, b in edges if a == u] for u in groups}
    for s in groups:
        x = np.zeros(12)
        x[s] = 1.0
        for _ in range(300):
            new = np.zeros(12)
            for u in groups:
                for v in out[u]:
                    new[v] += fairrank.FOLLOW * x[u] / len(out[u])
            new[s] += 1.0 - new.sum()
            x = new
        for c in range(3):
            assert got.get((s, c), 0.0) == pytest.approx(sum(x[u] for u in groups if groups[u] == c), abs=2e-3)  # 0.85^45
    early = fairrank.source_masses(e, nodes, epsilon=1.0)  # the first round moves less than a whole
    assert early.groupBy("source").agg(F.sum("mass").alias("m")).where("abs(m - 1) > 1e-9").count() == 0


@pytest.mark.parametrize("most", [ranks.ONE_RANGE, 30])
def test_places_and_medians(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "ONE_RANGE", most)
    rng = random.Random(most)
    data = [(g, [float(rng.randrange(4)), float(rng.randrange(3))], [float(rng.randrange(3)), float(rng.randrange(5))]) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 160)) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, vec array<double>, sd array<double>").withColumn("_n", F.lit(1)).drop("_n")
    at = ranks.positions(df.select("g", F.col("vec")[0].alias("x")), ["g"], ["x"]).collect()
    for g in "abcd":
        mine = sorted((r["at"], r.x) for r in at if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)
    got = {r.g: r for r in ranks.median_vectors(df, ["g"], "vec", "sd").collect()}
    plain = {r.g: r for r in ranks.median_vectors(df, ["g"]).collect()}
    for g in "abcd":
        rows = sorted(([(-m, s) for m, s in zip(v, d)], v, d) for x, v, d in data if x == g)
        lo, hi = rows[(len(rows) - 1) // 2], rows[len(rows) // 2]
        half = lambda a, b: [(x + y) / 2 for x, y in zip(a, b)]
        assert got[g].n == len(rows) and got[g]["median"] == half(lo[1], hi[1]) and got[g].median_std == half(lo[2], hi[2])
        rows = sorted((v for x, v, _ in data if x == g), reverse=True)
        assert plain[g]["median"] == half(rows[(len(rows) - 1) // 2], rows[len(rows) // 2])
    assert ranks.median_vectors(df.limit(0), ["g"]).count() == 0


def test_many_bucket_vectors_in_one_loop(spark):
    rng = random.Random(4)
    groups, edges = random_graph(6, 12, 0.3)
    groups = {u: g % 2 for u, g in groups.items()}
    g = framed(spark, groups, edges)
    phi = spark.createDataFrame([(0, 0.4), (1, 0.6)], "group_id int, share double")
    excess = {d: {u: rng.random() * (rng.random() < 0.8) for u in groups} for d in range(3)}
    df = spark.createDataFrame([(d, u, w) for d, e in excess.items() for u, w in e.items()], "direction int, node_id long, weight double").cache()
    got = {(r.direction, r.node_id): r.value for r in fairrank.step_fair_directions(g.adjacency, g.nodes, phi, df, rounds=6, epsilon=None).collect()}
    for d in excess:
        one = fairrank.step_fair(g.adjacency, g.nodes, phi, None, df.where(F.col("direction") == d).select("node_id", "weight"), rounds=6, epsilon=None)
        assert values(one) == pytest.approx({u: got[d, u] for u in groups}, abs=1e-12)


def test_search_of_bucket_vectors_comes_nearer(spark):
    groups, edges = random_graph(8, 10, 0.35)
    g = framed(spark, {u: x % 2 for u, x in groups.items()}, edges)
    phi = spark.createDataFrame([(0, 0.7), (1, 0.3)], "group_id int, share double")
    plain = fairrank.directed_pagerank(g.adjacency, g.nodes)
    weight, ranks, losses = fairrank.search_excess(g.adjacency, g.nodes, phi, plain, directions=5, iterations=2, rounds=6, epsilon=None)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    sums = weight.join(g.nodes, "node_id").groupBy("group_id").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in sums) and weight.where("weight < 0").count() == 0
    again = fairrank.step_fair(g.adjacency, g.nodes, phi, None, weight, rounds=6, epsilon=None)
    assert values(again) == pytest.approx(values(ranks), abs=1e-12)
    aim = values(plain)
    assert sum((v - aim[u]) ** 2 for u, v in values(ranks).items()) == pytest.approx(losses[-1])
