"""Names and lookup of result files; graphs from a configuration, written and read again."""


import pytest

from priospread.operators import generate
from priospread.sources import files
from priospread.sources.text import load_graph


def test_suffixes_there_and_back():
    assert files.ranking_suffix([3, 2], ["top_size", "random"], 10) == "L2-3_Srandom-top_size_R10"
    assert files.ranking_suffix([5, 2, 3], ["all"]) == "L2-3-5_Sall"
    for lengths, strategies, count in (([2, 3], ["all"], 5), ([2], ["top_size"], None), ([2, 3, 5], ["random", "top_size"], 0)):
        assert files.parse_ranking_suffix(files.ranking_suffix(lengths, strategies, count)) == {"lengths": lengths, "strategies": strategies, "random_count": count}


def test_odd_suffixes():
    nothing = {"lengths": [], "strategies": [], "random_count": None}
    assert all(files.parse_ranking_suffix(x) == nothing for x in ("", "2_Sall", "L2-3", "L2_Sa_Sb"))
    assert files.parse_ranking_suffix("Lx-2_Sall_R4") == {"lengths": [], "strategies": ["all"], "random_count": 4}
    assert files.parse_ranking_suffix("L2_Sa_Rest") == {"lengths": [2], "strategies": ["a_Rest"], "random_count": None}


def test_lookup(spark, tmp_path):
    at = str(tmp_path)
    assert files.find_rankings(spark, at, "g") == (None, None) and files.find_spreading(spark, at, "g") == []
    for name in ("g_rankings_L2_Sall_R5.json", "g_rankings_L2-3_Sall.json", "g_ranking_strategies_L2_Sall_R5.json", "g2_rankings_L2_Sall.json"):
        (tmp_path / name).write_text("[]")
    ends = lambda pair: tuple(x and x.rsplit("/", 1)[-1] for x in pair)
    assert ends(files.find_rankings(spark, at, "g", [2], ["all"], 5)) == ("g_rankings_L2_Sall_R5.json", "g_ranking_strategies_L2_Sall_R5.json")
    assert ends(files.find_rankings(spark, at, "g")) == ("g_rankings_L2-3_Sall.json", None)
    assert files.find_rankings(spark, at, "g", [4], ["all"]) == (None, None)
    for p in ("0.1000", "0.0500", "bad"):
        (tmp_path / f"g_sir_p{p}.csv").write_text("")
    assert [p for _, p in files.find_spreading(spark, at, "g")] == [0.05, 0.1]
    (tmp_path / "g_sir_p0.2000.parquet").mkdir()
    assert [p for _, p in files.find_spreading(spark, at, "g")] == [0.2]


def test_rankings_of_results(spark):
    rows = spark.createDataFrame([("1_0",), ("0_1",), ("1_0",), (None,)], "ranking string")
    assert files.rankings_of(rows) == [[0, 1], [1, 0]]


def test_graphs_from_a_configuration(spark, tmp_path):
    er = {"name": "e", "type": "ER", "n": 60, "avg_degree": 4, "num_groups": 2, "group_sizes": [0.25, 0.75]}
    sbm = {"name": "s", "type": "SBM", "n": 50, "avg_degree": 5, "num_groups": 2, "group_sizes": [0.5, 0.5], "community_sizes": [20, 30], "group_assignment": "aligned"}
    config = {"global": {"random_seed": 7, "replicates_per_config": 2}, "graphs": {"sir_optimal": [er], "fast_only": [sbm]}}
    assert generate.generate_all(spark, config, str(tmp_path)) == ["e_rep0", "e_rep1", "s_rep0", "s_rep1"]
    sizes, edges = {}, {}
    for name in ("e_rep0", "e_rep1", "s_rep0"):
        g = load_graph(spark, f"{tmp_path}/{name}_edges.txt", f"{tmp_path}/{name}_groups.txt")
        sizes[name] = {r["group_id"]: r["count"] for r in g.nodes.groupBy("group_id").count().collect()}
        edges[name] = {(r["src"], r["dst"]) for r in g.edges.collect()}
        said = spark.read.json(f"{tmp_path}/{name}_metadata.json").first()
        assert said["num_edges"] == len(edges[name]) and said["num_nodes"] == sum(sizes[name].values()) and said["num_groups"] == 2
        assert said["actual_avg_degree"] == pytest.approx(2 * len(edges[name]) / said["num_nodes"]) and said["edge_file"] == f"{name}_edges.txt"
    assert sizes == {"e_rep0": {0: 15, 1: 45}, "e_rep1": {0: 15, 1: 45}, "s_rep0": {0: 20, 1: 30}}
    assert edges["e_rep0"] != edges["e_rep1"]
    assert generate.from_config(spark, er | {"random_seed": 7})[1].edges.exceptAll(spark.createDataFrame(sorted(edges["e_rep0"]), "src long, dst long")).isEmpty()


def test_wrong_configurations(spark):
    er = {"name": "e", "type": "ER", "n": 10, "avg_degree": 2, "group_sizes": [0.5, 0.5]}
    for wrong in ({"type": "tree"}, {"group_sizes": [0.5, 0.4]}, {"num_groups": 3}, {"group_assignment": "aligned"}, {"type": "SBM", "community_sizes": [4, 5]}):
        with pytest.raises(ValueError):
            generate.from_config(spark, er | wrong)
