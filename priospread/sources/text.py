"""Readers of edge lists, group files, ranking files, configurations and two-group graphs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.meetings import Meetings
from ..plans.loops import cut


@dataclass
class Graph:
    """An undirected simple graph: ``nodes(node_id, group_id)``, ``edges(src, dst)`` with src < dst."""

    nodes: DataFrame
    edges: DataFrame
    #: Of a graph of meetings, who was where (node_id, place): sums over neighbours then need no edges.
    members: DataFrame | None = None
    _links: Meetings | None = None

    @property
    def links(self) -> DataFrame | Meetings:
        """What sums over neighbours go along: the members' meetings, prepared once, or both directions of every edge."""
        if self.members is None:
            return self.adjacency
        if self._links is None:
            self._links = Meetings(self.members)
        return self._links

    @property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge."""
        return self.edges.select("src", "dst").unionAll(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def cut(self) -> Graph:
        """The same graph written once to the shared folder; a graph that is there already stays."""
        if all(hasattr(x, "_cut_path") for x in (self.nodes, self.edges)):
            return self
        if self.members is not None:  # the edges are many, and not needed
            return self if hasattr(self.nodes, "_cut_path") else Graph(cut(self.nodes), self.edges, self.members, self._links)
        return Graph(cut(self.nodes), cut(self.edges))

    def checked(self) -> Graph:
        """Fails if an edge's node has no group."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        lost = ends.join(self.nodes.where("group_id is not null"), "node_id", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"nodes without a group: {[r['node_id'] for r in lost]}")
        return self

    def group_ids(self) -> list[int]:
        return [r["group_id"] for r in self.nodes.select("group_id").distinct().orderBy("group_id").collect()]


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct undirected edges with src < dst, without loops."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.trim("value").alias("line"))


def read_edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Raw (src, dst) rows. Strict lines hold two integers; else blanks and ``#`` lines are skipped."""
    rows = _fields(spark, path).where("line <> ''")
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an edge line: "), F.col("line")))
        return rows.select(F.when(F.size("f") == 2, F.col("f")[0]).otherwise(bad).cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"))
    return rows.where(~F.col("line").startswith("#") & (F.size("f") >= 2)).select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path).where("line <> ''")
    return rows.select(F.col("f")[0].cast("long").alias("node_id"), F.col("f")[1].cast("int").alias("group_id"))


def load_graph(spark: SparkSession, edge_path: str, group_path: str) -> Graph:
    """Edges without loops and repeats; nodes of the group file stay even when isolated."""
    edges = canonical(read_edges(spark, edge_path))
    groups = read_groups(spark, group_path).groupBy("node_id").agg(F.max("group_id").alias("group_id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return Graph(ends.join(groups, "node_id", "full"), edges).checked()


def read_two_group_graph(spark: SparkSession, graph_path: str, community_path: str) -> tuple[DataFrame, DataFrame]:
    """Directed edges and nodes of files whose first line is a count."""
    edges = _fields(spark, graph_path).where(F.size("f") == 2).select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst")).distinct()
    return edges, _fields(spark, community_path).where(F.size("f") == 2).select(F.col("f")[0].cast("long").alias("node_id"), F.col("f")[1].cast("int").alias("group_id"))


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, attribute) rows of ``node attr attr ...`` lines; a lone count line has none."""
    rows = _fields(spark, path).where(F.size("f") > 1)
    return rows.select(F.col("f")[0].cast("long").alias("node_id"), F.explode(F.slice("f", 2, 10_000)).cast("int").alias("attribute"))


def read_phi(spark: SparkSession, path: str) -> DataFrame:
    """Target share of each group; they have to add up to one."""
    phi = _fields(spark, path).where(F.size("f") == 2).select(F.col("f")[0].cast("int").alias("group_id"), F.col("f")[1].cast("double").alias("share"))
    total = phi.agg(F.sum("share")).first()[0]
    if total is None or abs(total - 1) > 1e-5:
        raise ValueError(f"shares add up to {total}")
    return phi


def compact_ids(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids from 0 in the order of the old ones; nodes without a group and their edges go.

    Returns edges, nodes and the map (old_id, node_id).
    """
    from ..functions.ranks import rank_by

    known = nodes.where("group_id is not null").select("node_id", "group_id").distinct()
    ids = rank_by(known.select("node_id").distinct(), F.col("node_id"), name="_new", descending=False).select(F.col("node_id").alias("old_id"), (F.col("_new") - 1).cast("long").alias("node_id"))
    s, d = ids.select(F.col("old_id").alias("src"), F.col("node_id").alias("s")), ids.select(F.col("old_id").alias("dst"), F.col("node_id").alias("d"))
    out = edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return out, known.withColumnRenamed("node_id", "old_id").join(ids, "old_id").select("node_id", "group_id"), ids


def repeated_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def flip_groups(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("group_id", 1 - F.col("group_id"))


def read_method_names(path: str) -> list[str]:
    """One name per line; blanks and ``#`` lines are skipped."""
    lines = (x.strip() for x in Path(path).read_text().splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def read_rankings(path: str) -> list[list[int]]:
    return [list(map(int, r)) for r in json.loads(Path(path).read_text())]


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """(ranking, groups, strategies) of a file that maps rankings to strategy names."""
    found = json.loads(Path(path).read_text())
    rows = [(k, [int(g) for g in k.split("_")], list(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "ranking string, groups array<int>, strategies array<string>")


@dataclass
class Experiment:
    """What a configuration file says: one dataclass instead of nested dictionaries."""

    graphs: dict[str, list[dict]] = field(default_factory=dict)
    probabilities: list[float] = field(default_factory=list)
    simulations: int = 1000
    betas: list[float] = field(default_factory=list)
    sem_percentiles: list[float] = field(default_factory=lambda: [0.0])
    lengths: list[int] = field(default_factory=lambda: [2])
    strategies: list[str] = field(default_factory=lambda: ["all"])
    random_count: int = 0

    @classmethod
    def from_yaml(cls, path: str) -> Experiment:
        import yaml  # only where configuration files are used

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})

    @classmethod
    def from_dict(cls, d: dict) -> Experiment:
        sir, ranks = d.get("sir", {}), d.get("rankings", {})
        listed = lambda x, kind: [kind(v) for v in (x if isinstance(x, list) else [x])]
        out = cls(graphs=d.get("graphs", {}))
        out.probabilities = listed(sir.get("infection_probabilities", []), float)
        out.simulations = int(sir.get("num_simulations", out.simulations))
        out.betas = listed(d.get("betas", []), float)
        out.sem_percentiles = listed(d.get("sem_percentile", 0.0), float)
        out.lengths = listed(ranks.get("lengths", out.lengths), int)
        out.strategies = listed(ranks.get("strategies", "all"), str)
        out.random_count = int(ranks.get("random_count", 0))
        return out
