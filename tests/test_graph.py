import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from priospread.functions import lexi, ranks
from priospread.operators import degrees, epidemic, fairrank, hindex, local, paths, peel, registry, report, targets
from priospread.operators.generate import assign_groups, block_probabilities, grown_graph, uniform_graph
from priospread.sources.text import Graph, canonical, compact_ids, load_graph, read_edges

GROUPS = 3


def random_graph(seed, n=14, p=0.3):
    rng = random.Random(seed)
    return {i: rng.randrange(GROUPS) for i in range(n)}, [(a, b) for b in range(n) for a in range(b) if rng.random() < p]


def framed(spark, groups, edges):
    nodes = spark.createDataFrame(list(groups.items()), "node_id long, group_id int")
    return Graph(nodes, spark.createDataFrame(edges, "src long, dst long"))


def near(groups, edges):
    out = {i: set() for i in groups}
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def values(df, column="value"):
    return {r["node_id"]: (tuple(r[column]) if isinstance(r[column], list) else r[column]) for r in df.collect()}


def greedy_peel(groups, edges, ranking):
    """Plain peel: always remove a node of least vector."""
    adj = near(groups, edges)
    vec = {u: [sum(groups[v] == g for v in adj[u]) + (groups[u] == g) for g in ranking] for u in groups}
    left, out, level = set(groups), {}, None
    while left:
        u = min(left, key=lambda x: (vec[x], x))
        level = vec[u][:] if level is None else max(level, vec[u][:])
        out[u] = tuple(level)
        left.remove(u)
        if groups[u] in ranking:
            for v in adj[u] & left:
                vec[v][ranking.index(groups[u])] -= 1
    return out


def test_peel_forms_agree_with_the_plain_one(spark):
    for seed in range(150):
        groups, edges = random_graph(seed, n=random.Random(seed).randint(3, 24))
        ranking = random.Random(seed).sample(range(GROUPS), random.Random(seed + 1).randint(1, 3))
        pos = np.array([ranking.index(g) if g in ranking else -1 for g in groups.values()])
        src, dst = (np.array([e[i] for e in edges], int) for i in (0, 1))
        got = peel.peel_arrays(len(groups), src, dst, pos, peel._weights(ranking, 0, 1))
        assert dict(enumerate(got)) == greedy_peel(groups, edges, ranking)


def test_fixpoint_equals_grouped(spark):
    groups, edges = random_graph(7)
    g = framed(spark, groups, edges)
    want = greedy_peel(groups, edges, [1, 0])
    assert values(peel.fixpoint_cores(g, [1, 0]), "vec") == want
    both = peel.grouped_cores(g, [[1, 0], [2]])
    assert values(both.where("ranking = '1_0'"), "vec") == want
    assert values(both.where("ranking = '2'"), "vec") == greedy_peel(groups, edges, [2])


def test_one_group_peel_is_coreness_plus_one(spark):
    groups, edges = random_graph(3)
    g = framed(spark, dict.fromkeys(groups, 0), edges)
    core = values(hindex.coreness(g))
    assert values(peel.grouped_cores(g, [[0]]), "vec") == {u: (c + 1,) for u, c in core.items()}


def test_degree_vectors_count_the_node_itself(spark):
    g = framed(spark, {0: 0, 1: 1, 2: 0, 3: 2}, [(0, 1), (1, 2)])
    assert values(degrees.degree_vector(g, [0, 1]), "vec") == {0: (1, 1), 1: (2, 1), 2: (1, 1), 3: (0, 0)}
    assert values(degrees.degree(g)) == {0: 1, 1: 2, 2: 1, 3: 0}
    assert values(degrees.blended_degree_vector(g, [0, 1], 30), "vec")[1] == (230, 100)


def test_distances_and_components(spark):
    groups, edges = random_graph(11, n=12, p=0.15)
    adj = near(groups, edges)
    want = {}
    for s in groups:
        d, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in adj[u] - set(d):
                d[v] = d[u] + 1
                queue.append(v)
        want |= {(s, t): x for t, x in d.items() if t != s}
    g = framed(spark, groups, edges)
    assert {(r.src, r.dst): r.d for r in paths.distances(g).collect()} == want
    assert values(paths.components(g), "component") == {s: min([s, *(t for a, t in want if a == s)]) for s in groups}


def test_betweenness_of_a_path_and_a_star(spark):
    path = framed(spark, dict.fromkeys(range(4), 0), [(0, 1), (1, 2), (2, 3)])
    assert values(paths.betweenness(path)) == pytest.approx({0: 0, 1: 2 / 3, 2: 2 / 3, 3: 0})


def test_clustering_counts_spokes(spark):
    g = framed(spark, dict.fromkeys(range(4), 0), [(0, 1), (0, 2), (1, 2), (0, 3)])
    assert values(local.clustering_coefficient(g)) == pytest.approx({0: 2 * 4 / 6, 1: 3.0, 2: 3.0, 3: 0.0})


def test_rank_kinds_and_ranges(spark, monkeypatch):
    rows = [(i, v) for i, v in enumerate([5, 3, 3, 9, 1, 9, 9, None, 2, 2])]
    df = spark.createDataFrame(rows, "node_id long, value int")
    dense = values(ranks.dense_rank_desc(df), "rank")
    competition = values(ranks.rank_by(df, F.col("value"), kind="competition"), "rank")
    assert [dense[i] for i in range(10)] == [2, 3, 3, 1, 5, 1, 1, 6, 4, 4]
    assert [competition[i] for i in range(10)] == [4, 5, 5, 1, 9, 1, 1, 10, 7, 7]
    monkeypatch.setattr(ranks, "ONE_RANGE", 0)
    assert values(ranks.dense_rank_desc(df), "rank") == dense
    assert values(ranks.rank_by(df, F.col("value"), kind="competition"), "rank") == competition
    up = values(ranks.rank_by(df, F.col("value"), kind="competition", descending=False), "rank")
    assert [up[i] for i in range(10)] == [6, 4, 4, 7, 1, 7, 7, 10, 2, 2]


def test_restrict_and_tie_break(spark):
    nodes = spark.createDataFrame([(i, i % 2) for i in range(4)], "node_id long, group_id int")
    base = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 3)], "node_id long, rank int")
    assert values(ranks.restrict(base, nodes, [0]), "rank") == {0: 1, 2: 1, 1: 3, 3: 4}
    second = spark.createDataFrame([(0, 1), (2, 2)], "node_id long, rank int")
    assert values(ranks.tie_break(base, second), "rank") == {1: 1, 0: 2, 2: 3, 3: 4}


def test_ranks_by_pairs_in_ranges(spark, monkeypatch):
    """Restricted and tie-broken ranks order by pairs; beyond one range their bounds are pairs too."""
    nodes = spark.createDataFrame([(i, i % 3) for i in range(200)], "node_id long, group_id int")
    base = spark.createDataFrame([(i, i * 7 % 11) for i in range(200)], "node_id long, rank int")
    second = spark.createDataFrame([(i, i * 5 % 13) for i in range(0, 200, 3)], "node_id long, rank int")
    made = lambda: [values(ranks.restrict(base, nodes, [2, 0], first), "rank") for first in (False, True)] + [values(ranks.tie_break(base, second), "rank")]
    one = made()
    lists = base.select("node_id", F.when(F.col("node_id") % 5 > 0, F.struct(F.array("rank", F.lit(1)).alias("a"), F.lit(None).cast("int").alias("b"))).alias("k"))
    listed = values(ranks.rank_by(lists, F.col("k")), "rank")
    monkeypatch.setattr(ranks, "ONE_RANGE", 0)
    assert made() == one and values(ranks.rank_by(lists, F.col("k")), "rank") == listed


def test_lexicographic_helpers(spark):
    row = spark.range(1).select(
        lexi.lexi_compare(F.array(F.lit(1), F.lit(5)), F.array(F.lit(2), F.lit(3))).alias("less"),
        lexi.lexi_compare(F.array(F.lit(3), F.lit(1)), F.array(F.lit(3), F.lit(1), F.lit(7))).alias("same"),
        lexi.median_vector(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.array(F.lit(2.0)), F.array(F.lit(9.0)))).alias("median"),
    ).first()
    assert (row.less, row.same, list(row.median)) == (-1, 0, [2.5])


def test_strategies(spark):
    m = spark.createDataFrame([(0, 5.0, 1.0, 1.0), (1, 3.0, 1.0, 9.0), (2, 4.0, 2.0, 2.0), (3, 3.0, 0.0, 0.0)], "group_id int, size double, coreness double, degree double")
    got = {(r.strategy, r.length): r.groups for r in targets.strategy_rankings(m, [2, 3], random_count=1).collect()}
    assert got["top_size", 3] == [0, 2, 1] and got["bottom_size", 2] == [1, 3] and got["alt_size", 3] == [0, 3, 2]
    assert got["mixed_top_size_top_degree", 3] == [0, 1] and len(got["random_1", 3]) == 3
    with pytest.raises(ValueError):
        targets.strategy_rankings(m, [5])


def test_spreading_at_the_ends(spark):
    g = framed(spark, {0: 0, 1: 1, 2: 1, 3: 0}, [(0, 1), (1, 2)])
    sure = {(r.node_id, r.group_id): (r["mean"], r["std"]) for r in epidemic.reach(g, g.nodes, 1.0, 3).collect()}
    assert sure[0, 0] == (1.0, 0.0) and sure[0, 1] == (2.0, 0.0) and sure[3, 1] == (0.0, 0.0)
    never = epidemic.reach(g, g.nodes, 0.0, 3).groupBy("node_id").agg(F.sum("mean").alias("s")).collect()
    assert all(r.s == 1.0 for r in never)


def test_fair_ranks_keep_mass(spark):
    groups, edges = random_graph(5)
    g = framed(spark, {i: x % 2 for i, x in groups.items()}, edges)
    phi = spark.createDataFrame([(0, 0.3), (1, 0.7)], "group_id int, share double")
    mass = {r.group_id: r.mass for r in fairrank.group_mass(fairrank.neighbourhood_fair(g.adjacency, g.nodes, phi, rounds=3, epsilon=None), g.nodes).collect()}
    assert mass == pytest.approx({0: 0.3, 1: 0.7})
    mass = {r.group_id: r.mass for r in fairrank.group_mass(fairrank.step_fair(g.adjacency, g.nodes, phi, rounds=3, epsilon=None), g.nodes).collect()}
    assert mass == pytest.approx({0: 0.3, 1: 0.7})


def test_sensitive_programme_meets_its_share():
    import pandas as pd

    groups, edges = random_graph(9)
    both = pd.DataFrame(edges + [(b, a) for a, b in edges], columns=["src", "dst"])
    nodes = pd.DataFrame({"node_id": list(groups), "group_id": [g % 2 for g in groups.values()]})
    got = fairrank.sensitive_jump(both, nodes, 0.5)
    assert got.jump.sum() == pytest.approx(1, abs=1e-6) and (got.jump >= 0).all()
    assert got.value[(nodes.group_id == 1).to_numpy()].sum() == pytest.approx(0.5, abs=1e-6)
    assert fairrank.sensitive_jump(both, nodes, 0.999) is None


def test_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2 1\n3 3\n2 4\n")
    (tmp_path / "g.txt").write_text("1 0\n2 1\n3 0\n4 1\n9 2\n")
    g = load_graph(spark, str(tmp_path / "e.txt"), str(tmp_path / "g.txt"))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 2), (2, 4)} and g.nodes.count() == 5
    (tmp_path / "t.txt").write_text("# note\n\na b\n")
    assert [tuple(r) for r in read_edges(spark, str(tmp_path / "t.txt"), strict=False).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        Graph(g.nodes.where("node_id <> 4"), g.edges).checked()
    edges, nodes, _ = compact_ids(canonical(g.edges), g.nodes)
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (1, 3)} and nodes.count() == 5


def test_generators(spark):
    n = uniform_graph(spark, 400, 6.0)
    assert 900 < n.count() < 1500 and n.where("src >= dst").count() == 0 and n.distinct().count() == n.count()
    assert block_probabilities([50, 50], 6.0, 0.2)[1][0] == pytest.approx((6 - 0.2 * 6 / 99 * 50) / 49)
    groups = assign_groups(spark.range(10).select(F.col("id").alias("node_id")), [0.6, 0.4])
    assert sorted(r["count"] for r in groups.groupBy("group_id").count().collect()) == [4, 6]
    g = grown_graph(spark, 40, 4, 2, 0.3, 0.2)
    assert g.edges.count() == 6 + 36 * 2


def test_front_and_registry(spark):
    pts = spark.createDataFrame([(1.0, 5.0), (2.0, 4.0), (2.0, 3.0), (1.0, 4.0), (3.0, 1.0), (3.0, 1.0)], "x double, y double")
    assert sorted(map(tuple, report.pareto_front(pts).collect())) == [(1.0, 5.0), (2.0, 4.0), (3.0, 1.0), (3.0, 1.0)]
    names = registry.all_names([0.3])
    assert len(names) == len(set(names)) and len(registry.all_names()) == 78
    groups, edges = random_graph(2)
    rows, late = registry.run_methods(framed(spark, groups, edges), [[0, 1]], ["degree", "lexipeeling", "degree_lexipeeling", "restricted_degree"])
    assert not late and rows.groupBy("method").count().where("count <> 14").count() == 0


def test_registry_query_runs_every_name(monkeypatch):
    """The registered query hands all names and all betas on; nothing is filtered out."""
    from priospread.plans import queries

    asked = []
    monkeypatch.setattr(queries, "nation_trade_graph", lambda *a: Graph(None, None))
    monkeypatch.setattr(queries, "cut", lambda df: df)
    monkeypatch.setattr(registry, "run_methods", lambda g, rankings, names, betas=(), **how: asked.append((names, betas)) or [type("Out", (), {"drop": lambda self, c: self})()])
    queries.queries()["method_registry"](None, "")
    [(names, betas)] = asked
    assert sorted(betas) == [0.01, 0.1, 0.5, 0.99] and set(names) == set(registry.all_names(betas)) and len(names) == 166


def test_customer_sir_takes_the_reference_runs(spark, monkeypatch):
    """SIR on the customer graph: 1000 runs for every node, equal to a plain search over the open edges."""
    from priospread.plans import queries

    groups, edges = random_graph(6, n=10)
    groups[99] = 4  # a node without edges, alone in its group
    monkeypatch.setattr(queries, "cosource_graph", lambda *a: framed(spark, groups, edges))
    got = {(r.node_id, r.group_id): r for r in queries.queries()["sir_reach_cosource"](spark, "").collect()}
    assert len(got) == len(groups) * len(set(groups.values())) and {r.num_simulations for r in got.values()} == {1000}
    f, counts = epidemic.FACTORS, {}
    for sim in range(1000):
        adj = {u: set() for u in groups}
        for u, v in edges:
            h = (u * f["u"] + v * f["v"] + sim * f["sim"] + 17) % epidemic.PRIME
            for c in epidemic.OFFSETS:
                h = (h * h + c * (h % 65536) + c) % epidemic.PRIME
            if h < int(queries.PROBABILITY * epidemic.PRIME):
                adj[u].add(v)
                adj[v].add(u)
        for seed in groups:
            seen, front = {seed}, {seed}
            while front:
                front = {v for u in front for v in adj[u]} - seen
                seen |= front
            for g in set(groups.values()):
                counts.setdefault((seed, g), []).append(sum(groups[u] == g for u in seen))
    for key, c in counts.items():
        assert got[key]["mean"] == pytest.approx(np.mean(c)) and got[key]["std"] == pytest.approx(np.std(c), abs=1e-6)


def test_percolated_reach_has_the_law_of_single_runs(spark):
    """Open components give the means and deviations of seed-by-seed runs; joins and tasks give equal labels."""
    groups, edges = random_graph(8, n=16, p=0.3)
    g = framed(spark, groups, edges).cut()
    single = {(r.node_id, r.group_id): r for r in epidemic.reach(g, g.nodes, 0.3, 1500).collect()}
    shared = {(r.node_id, r.group_id): r for r in epidemic.percolated_reach(g, 0.3, 1500).collect()}
    assert single.keys() == shared.keys()
    for key, a in single.items():
        b = shared[key]
        assert abs(a["mean"] - b["mean"]) < 5 * ((a["std"] ** 2 + b["std"] ** 2) / 1500) ** 0.5 + 1e-9
        assert a["std"] == pytest.approx(b["std"], rel=0.15, abs=0.02)
    rows = lambda **how: sorted(map(tuple, epidemic.open_components(g, 0.3, 40, **how).select("sim", "node_id", "component").collect()))
    assert rows() == rows(run_edges=0)


def test_sensitive_ranks_report_a_graph_beyond_their_bound(spark, monkeypatch):
    """fspr on a larger graph is listed, not left out in silence; so is what is built on it when asked alone."""
    groups, edges = random_graph(2)
    g = framed(spark, groups, edges)
    monkeypatch.setattr(fairrank, "PROGRAMME_EDGES", 13)
    assert registry.run_methods(g, [[0, 1]], ["degree", "fspr"])[1] == [("graph", "fspr")]
    assert registry.run_methods(g, [[0, 1]], ["restricted_fspr"]) == (None, [("graph", "restricted_fspr")])


def test_core_numbers_at_any_size(spark, monkeypatch):
    """The frontier form equals the one-task form; a path of 1,000 nodes comes to rest."""
    groups, edges = random_graph(3, n=30, p=0.2)
    g = framed(spark, groups, edges)
    assert values(hindex.coreness(g)) == values(hindex.coreness(g, one_task=True))
    monkeypatch.undo()
    path = framed(spark, dict.fromkeys(range(1000), 0), [(i, i + 1) for i in range(999)])
    assert set(values(hindex.coreness(path)).values()) == {1}


def test_programme_without_its_matrix(monkeypatch):
    """Products with the rank operator give what the matrix gives; 2,500 nodes meet their share."""
    import pandas as pd

    groups, edges = random_graph(9)
    both = pd.DataFrame(edges + [(b, a) for a, b in edges], columns=["src", "dst"])
    nodes = pd.DataFrame({"node_id": list(groups), "group_id": [g % 2 for g in groups.values()]})
    dense = fairrank.sensitive_jump(both, nodes, 0.5)
    monkeypatch.setattr(fairrank, "DENSE_NODES", 0)
    free = fairrank.sensitive_jump(both, nodes, 0.5)
    assert free.value.to_numpy() == pytest.approx(dense.value.to_numpy(), abs=1e-7)
    rng = np.random.default_rng(1)
    e = np.unique(np.sort(rng.integers(0, 2500, (6000, 2)), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    large = fairrank.sensitive_jump(pd.DataFrame(np.concatenate([e, e[:, ::-1]]), columns=["src", "dst"]), pd.DataFrame({"node_id": np.arange(2500), "group_id": np.arange(2500) % 2}), 0.6, steps=60)
    assert large.value[1::2].sum() == pytest.approx(0.6, abs=1e-6)
