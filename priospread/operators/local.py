"""Scores from a node's neighbourhood: clustering, gravity family, local-global, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from ..sources.text import Graph
from .degrees import degree
from .hindex import coreness, h_chain
from .paths import distances, per_source, waves

#: Steps that gravity sums reach.
REACH = 3


def _all(graph: Graph, values: DataFrame, value=None) -> DataFrame:
    """``values`` for every node, 0 where there is none."""
    value = F.col("value") if value is None else value
    return graph.nodes.select("node_id").join(values, "node_id", "left").select("node_id", F.coalesce(value, F.lit(0.0)).cast("double").alias("value"))


def forward_edges(graph: Graph) -> DataFrame:
    """Every edge once, from its end of smaller (degree, id): no node has many of them."""
    deg = degree(graph)
    a, b = deg.select(F.col("node_id").alias("src"), F.col("value").alias("ds")), deg.select(F.col("node_id").alias("dst"), F.col("value").alias("dd"))
    rows = graph.edges.join(a, "src").join(b, "dst")
    lo, hi = F.struct(F.col("ds").alias("d"), F.col("src").alias("v")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("v"))
    return rows.select(F.least(lo, hi)["v"].alias("u"), F.greatest(lo, hi)["v"].alias("v"))


def triangles(graph: Graph) -> DataFrame:
    """Each triangle once, as (u, v, w) in the order of degree; wedges start at small degrees."""
    fwd = cut(forward_edges(graph))
    wedge = fwd.join(fwd.select("u", F.col("v").alias("w")), "u").where("v <> w")
    return wedge.join(fwd.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]).select("u", "v", "w")


def triangle_counts(graph: Graph) -> DataFrame:
    ends = triangles(graph).select(F.explode(F.array("u", "v", "w")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("triangles"))


def clustering_coefficient(graph: Graph) -> DataFrame:
    """2 * edges among the node and its neighbours / (degree * (degree - 1)): spokes count."""
    rows = degree(graph).join(triangle_counts(graph), "node_id", "left")
    d, t = F.col("value"), F.coalesce("triangles", F.lit(0))
    return rows.select("node_id", F.when(d > 1, 2.0 * (d + t) / (d * (d - 1))).otherwise(F.lit(0.0)).alias("value"))


#: Common multiple of the squared distances 1, 4 and 9: gravity sums are whole in 36ths.
SQUARES = 36


def pulls(graph: Graph, mass: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``node_id``, ``value``: mass(i) * sum over nodes within three steps of 36 mass(j) / d^2.

    Masses are whole numbers, so this is one too: equal scores are equal in any order of adding.
    """
    pairs = distances(graph, REACH) if pairs is None else pairs
    near = pairs.join(mass.select(F.col("node_id").alias("dst"), F.col("value").cast("long").alias("mj")), "dst")
    share = F.expr(f"mj * CAST({SQUARES} DIV (d * d) AS BIGINT)")
    sums = near.groupBy(F.col("src").alias("node_id")).agg(F.sum(share).alias("pull"))
    return mass.join(sums, "node_id", "left").select("node_id", (F.col("value").cast("long") * F.coalesce("pull", F.lit(0))).alias("value"))


def in_units(whole: DataFrame) -> DataFrame:
    """Scores from whole 36ths: one division at the end."""
    return whole.select("node_id", (F.col("value").cast("double") / SQUARES).alias("value"))


def gravity(graph: Graph, mass: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """mass(i) * sum over nodes within three steps of mass(j) / d^2; masses are whole numbers."""
    return in_units(pulls(graph, mass, pairs))


def gravity_centrality(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    return gravity(graph, coreness(graph), pairs)


def local_gravity(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    return gravity(graph, degree(graph), pairs)


def neighbour_sum(graph: Graph, values: DataFrame) -> DataFrame:
    near = graph.adjacency.join(values.select(F.col("node_id").alias("dst"), "value"), "dst")
    sums = near.groupBy(F.col("src").alias("node_id")).agg(F.sum("value").alias("value"))
    return graph.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("value", F.lit(0)).alias("value"))


def extended_gravity(graph: Graph, pairs: DataFrame | None = None, mass: DataFrame | None = None) -> DataFrame:
    """Sum of the neighbours' gravity, added up in whole 36ths."""
    return in_units(neighbour_sum(graph, pulls(graph, coreness(graph) if mass is None else mass, pairs)))


def gravity_h_index(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """exp(-constraint) * hv(i) * sum of hv(j) / d^2 within three steps.

    hv(i): neighbours whose degree is at least i's h-index. constraint(i): sum over neighbours j
    of (1 / deg i * (1 + sum over common neighbours w of 1 / deg w))^2.
    """
    graph = graph.cut()
    deg = cut(degree(graph))
    h = h_chain(graph, 1).withColumnRenamed("value", "h")
    near = graph.adjacency.join(deg.select(F.col("node_id").alias("dst"), F.col("value").alias("dj")), "dst")
    hv = near.join(h.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("src").alias("node_id")).agg(F.count_if(F.col("dj") >= F.col("h")).cast("double").alias("value"))
    hv = cut(_all(graph, hv))
    t = triangles(graph)
    corner = lambda a, b, w: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(w).alias("w"))
    sides = F.array(*[corner(a, b, c) for a, b, c in (("u", "v", "w"), ("v", "u", "w"), ("u", "w", "v"), ("w", "u", "v"), ("v", "w", "u"), ("w", "v", "u"))])
    common = t.select(F.explode(sides).alias("e")).select("e.*").join(deg.select(F.col("node_id").alias("w"), F.col("value").alias("dw")), "w")
    common = common.groupBy("src", "dst").agg(F.sum(1.0 / F.col("dw")).alias("shared"))
    own = deg.select(F.col("node_id").alias("src"), F.col("value").alias("di"))
    tie = graph.adjacency.join(own, "src").join(common, ["src", "dst"], "left").select("src", F.pow((1.0 + F.coalesce("shared", F.lit(0.0))) / F.col("di"), F.lit(2.0)).alias("c"))
    constraint = tie.groupBy(F.col("src").alias("node_id")).agg(F.sum("c").alias("c"))
    pull = gravity(graph, hv, pairs)
    rows = pull.join(constraint, "node_id", "left")
    return rows.select("node_id", (F.exp(-F.coalesce("c", F.lit(0.0))) * F.col("value")).alias("value"))


def local_global(graph: Graph) -> DataFrame:
    """deg(i) / n * sum over reachable j of sqrt(deg j) / d."""
    graph = graph.cut()
    e = cut(degree(graph).select("node_id", F.sqrt("value").alias("e")))
    far = waves(graph, lambda new, sources, d: per_source(new.join(e, "node_id"), sources, {"far": "e"}).select("node_id", (F.col("far") / d).alias("far")))
    return _degree_distance(graph, far)


def entropy_degree_distance(graph: Graph) -> DataFrame:
    """deg(i) / n * sum of sqrt(e_i + e_j) / d; e: entropy of the neighbours' degree shares.

    The root does not split into a part of i and one of j, so a step's words are unfolded to pairs, which are
    summed up per source before they leave their task.
    """
    graph = graph.cut()
    near = graph.adjacency.join(degree(graph).select(F.col("node_id").alias("dst"), F.col("value").alias("dj")), "dst")
    # With T the neighbours' degree sum, -sum p log p is log T - sum(d log d) / T.
    sums = near.groupBy(F.col("src").alias("node_id")).agg(F.sum("dj").alias("t"), F.sum(F.col("dj") * F.log2("dj")).alias("l"))
    e = cut(_all(graph, sums, F.log2("t") - F.col("l") / F.col("t")).withColumnRenamed("value", "e"))

    def work(new: DataFrame, sources: DataFrame, d: int) -> DataFrame:
        own = sources.join(e, "node_id").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "e"))).alias("own"))  # 64 entries
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("new"), i) == 1)
        pairs = new.join(e.withColumnRenamed("e", "ej"), "node_id").join(own, "block").select("block", "own", "ej", F.explode(bits).alias("bit"))
        # The entropy of one neighbour is 0 up to rounding; keep roots real.
        term = F.sqrt(F.greatest(F.col("ej") + F.col("own")[F.col("bit")], F.lit(0.0)))
        return pairs.groupBy("block", "bit").agg(F.sum(term).alias("far")).join(sources, ["block", "bit"]).select("node_id", (F.col("far") / d).alias("far"))

    return _degree_distance(graph, waves(graph, work))


def _degree_distance(graph: Graph, far: DataFrame) -> DataFrame:
    sums = far.groupBy("node_id").agg(F.sum("far").alias("far"))
    n = graph.nodes.agg(F.count("*").alias("n"))
    out = degree(graph).join(sums, "node_id").crossJoin(F.broadcast(n))
    return _all(graph, out.select("node_id", (F.col("value") / F.col("n") * F.col("far")).alias("value")))
