"""Method names and what computes them, with shared bases and real cancellation.

A method is a function of a :class:`Run` (graph, ranking, options). Bases are computed once per
run and shared by composites and restrictions; each result is ``node_id``, ``value`` or ``vec``
and ``rank``.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexi
from ..functions.ranks import rank_by, restrict, tie_break
from ..plans.loops import cut
from ..sources.text import Graph
from . import degrees, fairrank, hindex, local, pagerank, paths, peel

# Names of the methods that do not depend on the ranking.
INDEPENDENT = (
    "coreness", "degree", "betweenness", "pagerank", "h1_index", "h2_index", "h3_index", "h4_index", "h5_index",
    "closeness_centrality", "gravity_centrality", "extended_gravity_centrality", "local_gravity", "gravity_h_index",
    "clustering_coefficient_centrality", "local_global_centrality", "entropy_degree_distance_combination",
)
# Names of the methods that depend on it.
DEPENDENT = (
    "lexipeeling", "lexipeeling_extended", "degree_lexicographic", "pagerank_uniform_jump", "pagerank_exponential_jump",
    "random", "fspr", "lfpr_u", "lfpr_n",
)
# Composites (primary, secondary).
COMPOSITES = {f"lexipeeling_{b}": ("lexipeeling", b) for b in ("coreness", "degree", "degree_lexicographic")} | {
    f"{b}_lexipeeling": (b, "lexipeeling") for b in ("coreness", "degree", "degree_lexicographic")
}
#: Bases that can be restricted to the ranked groups, or to the first one.
RESTRICTABLE = tuple(m for m in (*INDEPENDENT, "degree_lexicographic", "pagerank_uniform_jump", "pagerank_exponential_jump", "fspr", "lfpr_u", "lfpr_n"))
#: Methods that the reach of public material does not define; they give no result.
UNDEFINED = ("fairgd", "adaptgd")


#: Digits of a score that its rank looks at: sums in another order differ in the last ones only.
DIGITS = 12


def significant(x: Column, digits: int = DIGITS) -> Column:
    """``x`` rounded to significant digits; whole numbers below 10^digits stay themselves."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | (x == F.rint(x)) & (F.abs(x) < 10.0**digits), x).otherwise(F.rint(x * scale) / scale)


class TooLarge(Exception):
    """A graph beyond the bound of a method."""


class NotSettled(Exception):
    """A programme that ran out of steps before it came to rest."""


@dataclass
class Run:
    """One graph and ranking; ``made`` holds each base once."""

    graph: Graph
    ranking: Sequence[int] = ()
    seed: int = 42
    made: dict[str, DataFrame | None] = field(default_factory=dict)
    shared: dict[str, DataFrame] = field(default_factory=dict)  # bases of the graph, over rankings
    locks: dict[str, threading.RLock] = field(default_factory=dict)
    one_task: bool = False  # whether a task may hold the whole graph

    def lock(self, key: str) -> threading.RLock:
        """Held while a base is made, so that methods that run side by side make it once.

        What a method is built on never leads back to it, so no two wait for each other.
        """
        return self.locks.setdefault(key, threading.RLock())

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self.lock(f"shared:{name}"):
            if name not in self.shared:
                self.shared[name] = cut(make())
            return self.shared[name]

    def near(self) -> DataFrame:
        return self.once("_near", lambda: paths.distances(self.graph, local.REACH))

    def coreness(self) -> DataFrame:
        return self.once("coreness", lambda: hindex.coreness(self.graph, self.one_task))

    def cores(self, graph: Graph, ranking: Sequence[int], beta: int = 0, scale: int = 1) -> DataFrame:
        form = peel.grouped_cores if self.one_task else peel.frontier_cores
        return form(graph, [ranking], beta, scale).select("node_id", "vec")

    def directed(self) -> DataFrame:
        return self.graph.adjacency

    def phi(self) -> DataFrame:
        return pagerank.target_distribution(self.graph.nodes, self.ranking)


def _h(k: int) -> Callable[[Run], DataFrame]:
    """The k-th index from the (k - 1)-th, which is shared."""

    def make(run: Run) -> DataFrame:
        before = run.once("degree", lambda: degrees.degree(run.graph)) if k == 1 else run.once(f"h{k - 1}_index", lambda: _h(k - 1)(run))
        return hindex.h_step(run.graph.adjacency, before)

    return make


def _lexi(run: Run) -> DataFrame:
    return run.cores(run.graph, run.ranking)


def _extended(run: Run) -> DataFrame | None:
    more = peel.extended(run.graph, run.ranking)
    return None if more is None else run.cores(*more)


def _random(run: Run) -> DataFrame:
    """Uniform scores by a hash of seed, ranking and node."""
    h = F.pmod(F.xxhash64(F.lit(run.seed), F.lit(lexi.ranking_key(run.ranking)), "node_id"), F.lit(1 << 53))
    return run.graph.nodes.select("node_id", (h / F.lit(float(1 << 53))).alias("value"))


def _phi(run: Run, base: float) -> DataFrame | None:
    """Target shares of all groups, for rankings of exactly two groups."""
    return pagerank.target_distribution(run.graph.nodes, run.ranking, base) if len(run.ranking) == 2 else None


def _step_fair(run: Run, base: float = 0.5) -> DataFrame | None:
    phi = _phi(run, base)
    return None if phi is None else fairrank.step_fair(run.directed(), run.graph.nodes, phi)


def _near_fair(run: Run, base: float = 0.5) -> DataFrame | None:
    phi = _phi(run, base)
    return None if phi is None else fairrank.neighbourhood_fair(run.directed(), run.graph.nodes, phi)


def _sensitive(run: Run, base: float = 0.5) -> DataFrame | None:
    phi, most = _phi(run, base), fairrank.PROGRAMME_EDGES
    if phi is None:
        return None
    if any(x.limit(most + 1).count() > most for x in (run.graph.nodes, run.graph.edges)):
        raise TooLarge(f"fspr solves a programme of at most {most} nodes and edges")
    share = {r["group_id"]: r["share"] for r in phi.collect()}.get(1, 0.5)  # one row a group
    nodes, links = run.graph.nodes.select("node_id", "group_id"), run.directed()
    # Nodes ride along as loops; one task solves the programme of a graph whose size was checked.
    rows = links.select("src", "dst", F.lit(None).cast("int").alias("g")).unionAll(nodes.select("node_id", "node_id", "group_id"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        loops = pdf.src == pdf.dst
        named = pdf[loops].rename(columns={"src": "node_id", "g": "group_id"})[["node_id", "group_id"]]
        got = fairrank.sensitive_jump(pdf[~loops].sort_values(["src", "dst"]), named, share)
        return pd.DataFrame({"node_id": [], "value": [], "settled": []}) if got is None else got[["node_id", "value", "settled"]]

    out = cut(rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(solve, "node_id long, value double, settled boolean"))
    if not out.where("not settled").isEmpty():
        raise NotSettled("the programme ran out of steps")
    return None if out.isEmpty() else out.drop("settled")


METHODS: dict[str, Callable[[Run], DataFrame | None]] = {
    "coreness": lambda r: hindex.coreness(r.graph, r.one_task),
    "degree": lambda r: degrees.degree(r.graph),
    "betweenness": lambda r: paths.betweenness(r.graph, one_task=r.one_task),
    "pagerank": lambda r: pagerank.pagerank(r.graph),
    **{f"h{k}_index": _h(k) for k in range(1, 6)},
    "closeness_centrality": lambda r: paths.closeness(r.graph),
    "gravity_centrality": lambda r: local.gravity(r.graph, r.coreness(), r.near()),
    "extended_gravity_centrality": lambda r: local.extended_gravity(r.graph, r.near(), r.coreness()),
    "local_gravity": lambda r: local.local_gravity(r.graph, r.near()),
    "gravity_h_index": lambda r: local.gravity_h_index(r.graph, r.near()),
    "clustering_coefficient_centrality": lambda r: local.clustering_coefficient(r.graph),
    "local_global_centrality": lambda r: local.local_global(r.graph),
    "entropy_degree_distance_combination": lambda r: local.entropy_degree_distance(r.graph),
    "lexipeeling": _lexi,
    "lexipeeling_extended": _extended,
    "degree_lexicographic": lambda r: degrees.degree_vector(r.graph, r.ranking),
    "pagerank_uniform_jump": lambda r: pagerank.pagerank(r.graph, pagerank.ranked_jump(r.graph, r.ranking)),
    "pagerank_exponential_jump": lambda r: pagerank.pagerank(r.graph, pagerank.exponential_jump(r.graph, r.ranking)),
    "random": _random,
    "fspr": _sensitive,
    "lfpr_u": _step_fair,
    "lfpr_n": _near_fair,
}


def beta_methods(beta: float) -> dict[str, Callable[[Run], DataFrame | None]]:
    """The blended methods of one beta, named with its label; two groups or more are ranked."""
    scaled, label = round(beta * 100), f"{beta:g}"
    base = {
        f"betas_degree_lexicographic_{label}": lambda r: degrees.blended_degree_vector(r.graph, r.ranking, scaled),
        f"betas_lexipeeling_{label}": lambda r: r.cores(r.graph, r.ranking, scaled, 100),
        f"betas_pagerank_exponential_jump_{label}": lambda r: pagerank.pagerank(r.graph, pagerank.exponential_jump(r.graph, r.ranking, 0.5 + beta)),
        f"betas_fspr_{label}": lambda r: _sensitive(r, 0.5 + beta),
        f"betas_lfpr_u_{label}": lambda r: _step_fair(r, 0.5 + beta),
        f"betas_lfpr_n_{label}": lambda r: _near_fair(r, 0.5 + beta),
    }
    return {k: (lambda r, f=f: f(r) if len(r.ranking) >= 2 else None) for k, f in base.items()}


def beta_composites(beta: float) -> dict[str, tuple[str, str]]:
    b = f"{beta:g}"
    lexi_, deg = f"betas_lexipeeling_{b}", f"betas_degree_lexicographic_{b}"
    return {
        f"betas_lexipeeling_coreness_{b}": (lexi_, "coreness"), f"betas_lexipeeling_degree_{b}": (lexi_, "degree"),
        f"betas_lexipeeling_betas_degree_lexicographic_{b}": (lexi_, deg), f"coreness_betas_lexipeeling_{b}": ("coreness", lexi_),
        f"degree_betas_lexipeeling_{b}": ("degree", lexi_), f"betas_degree_lexicographic_betas_lexipeeling_{b}": (deg, lexi_),
    }


def all_names(betas: Sequence[float] = ()) -> list[str]:
    out = [*INDEPENDENT, *DEPENDENT, *COMPOSITES, *(f"{p}_{m}" for m in RESTRICTABLE for p in ("restricted", "restricted_first"))]
    for b in betas:
        blended = list(beta_methods(b))
        out += [*blended, *beta_composites(b), *(f"{p}_{m}" for m in blended if "lexipeeling" not in m for p in ("restricted", "restricted_first"))]
    return out


def ranked(run: Run, name: str, betas: Sequence[float] = ()) -> DataFrame | None:
    """``node_id``, ``value``, ``vec``, ``rank`` of a method by name; None where it has no result."""
    with run.lock(name):
        if name not in run.made:
            out = _make_ranked(run, name, betas)
            run.made[name] = None if out is None else cut(out.select("node_id", "value", "vec", "rank"))
        return run.made[name]


def _make_ranked(run: Run, name: str, betas: Sequence[float]) -> DataFrame | None:
    table = METHODS | {k: f for b in betas for k, f in beta_methods(b).items()}
    pairs = COMPOSITES | {k: v for b in betas for k, v in beta_composites(b).items()}
    out: DataFrame | None
    if name in table:
        got = run.once(name, lambda: table[name](run)) if name in INDEPENDENT else table[name](run)
        if got is None:
            out = None
        elif "vec" in got.columns:
            out = rank_by(got.select("node_id", F.lit(None).cast("double").alias("value"), F.col("vec").cast("array<double>").alias("vec")), F.col("vec"))
        else:
            rows = got.select("node_id", F.col("value").cast("double").alias("value"), F.lit(None).cast("array<double>").alias("vec"))
            out = rank_by(rows, significant(F.col("value")))
    elif name in pairs:
        a, b = (ranked(run, x, betas) for x in pairs[name])
        out = None if a is None or b is None else tie_break(a, b)
    elif name.startswith("restricted_"):
        first = name.startswith("restricted_first_")
        base = ranked(run, name.removeprefix("restricted_first_" if first else "restricted_"), betas)
        out = None if base is None else restrict(base, run.graph.nodes, run.ranking, first)
    elif any(u in name for u in UNDEFINED):
        out = None
    else:
        raise KeyError(name)
    return out


class TimedOut(Exception):
    """A method ran beyond its limit; its Spark jobs were cancelled."""


def with_limit(spark, name: str, seconds: float, work: Callable[[], DataFrame | None]) -> DataFrame | None:
    """``work()`` in a job group of its own that is cancelled when the time is over."""
    result: dict = {}

    def go() -> None:
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        try:
            result["df"] = work()
        except BaseException as e:  # handed to the caller
            result["error"] = e

    t = InheritableThread(target=go, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        spark.sparkContext.cancelJobGroup(name)
        raise TimedOut(name)
    if "error" in result:
        raise result["error"]
    return result["df"]


def _wave(name: str, betas: Sequence[float]) -> int:
    """0 for methods, 1 for pairs of methods, 2 for restrictions of either."""
    if name.startswith("restricted_"):
        return 2
    return int(name in COMPOSITES or any(name in beta_composites(b) for b in betas))


def run_methods(graph: Graph, rankings: Sequence[Sequence[int]], names: Sequence[str], betas: Sequence[float] = (), graph_name: str = "graph", replicate: int = 0, limit: float = 3600.0, workers: int = 1, one_task: bool = False) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """One long frame of all methods over all rankings, and the (graph, method) pairs that timed out, were too large or did not settle.

    Such a method is skipped for later rankings, with everything built on it. Methods come before
    pairs, pairs before restrictions; ``workers`` of them run side by side (1 for runtimes that do
    not disturb each other), which helps where a round's set-up outweighs its work. ``one_task`` lets
    tasks hold the whole graph for core numbers, peels and path counts, within these methods' bounds.
    """
    shared: dict[str, DataFrame] = {}
    graph = graph.cut()
    spark, parts, late = graph.nodes.sparkSession, [], []
    for ranking in rankings:
        run, got, took = Run(graph, ranking, shared=shared, one_task=one_task), {}, {}

        def one(name: str) -> None:
            if any(x == name or name.endswith(f"_{x}") for _, x in list(late)):
                return
            began = time.time()
            try:
                got[name] = with_limit(spark, f"{graph_name}:{name}", limit, lambda: ranked(run, name, betas))
            except (TimedOut, TooLarge, NotSettled):
                late.append((graph_name, name))
            took[name] = time.time() - began

        for wave in range(3):
            with ThreadPoolExecutor(max(1, workers)) as pool:
                list(pool.map(one, [n for n in names if _wave(n, betas) == wave]))
        for name in names:
            if got.get(name) is not None:
                parts.append(got[name].select(F.lit(graph_name).alias("graph_name"), F.lit(replicate).alias("replicate_id"), F.lit(lexi.ranking_key(ranking)).alias("ranking"), F.lit(name).alias("method"), "node_id", F.col("rank").cast("long").alias("rank"), F.lit(took[name]).alias("runtime"), F.coalesce(lexi.render(F.col("vec")), F.col("value").cast("string")).alias("value")))
    while len(parts) > 1:  # unions of halves: their plans are analysed log n times, not n
        parts = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else None, late
