"""Sums over the neighbours in a graph of meetings, without a list of its edges.

Nodes that were at the same place are neighbours, once however many places they share. A place of n members
has n (n - 1) / 2 pairs, so edges grow with the square of the table and a loop that shuffles them needs
many times its size on disk. Sums need only the members: what a node receives is, over its places, the sum of
the place less its own part, and less (w - 1) times the part of each node it shares w > 1 places with. Only these
surplus pairs are found and kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut

#: Rows of members in a block of nodes, pairs that a task holds at once.
BLOCK_ROWS, PAIRS = 1_000_000, 2_000_000
#: Nodes or places up to which a round's state is broadcast (counted first).
BROADCAST = 1_000_000


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Places of two sides as numbers from 0."""
    found = np.unique(np.concatenate([a, b]))
    return len(found), np.searchsorted(found, a), np.searchsorted(found, b)


def repeated_pairs(u: np.ndarray, mu: np.ndarray, v: np.ndarray, mv: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(u, v, w)`` of pairs, u itself with u too, that share w > 1 places, of members (u, mu) against (v, mv).

    The nodes u are taken in runs of about ``most`` pairs; one node's pairs are at most the rows of v.
    """
    n, mu, mv = _codes(mu, mv)
    order = np.argsort(mv, kind="stable")
    v, sizes = v[order], np.bincount(mv, minlength=n)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
    names, v = np.unique(v, return_inverse=True)
    order = np.argsort(u, kind="stable")
    u, mu = u[order], mu[order]
    firsts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    ends = np.concatenate([firsts[1:], [len(u)]]) if len(u) else firsts
    upto = np.concatenate([[0], np.cumsum(sizes[mu])])
    at = 0
    while at < len(firsts):
        low = firsts[at]
        stop = max(at + 1, int(np.searchsorted(upto[ends], upto[low] + most, side="right")))
        high = ends[stop - 1]
        many = sizes[mu[low:high]]
        owner = np.repeat(np.searchsorted(firsts[at:stop], np.arange(low, high), side="right") - 1, many)
        place = np.repeat(starts[mu[low:high]] - (upto[low:high] - upto[low]), many) + np.arange(many.sum())
        pairs = np.sort(owner * np.int64(len(names)) + v[place])
        head = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        w = np.diff(np.concatenate([head, [len(pairs)]]))
        head, w = head[w > 1], w[w > 1]
        if len(head):
            yield u[firsts[at:stop]][pairs[head] // len(names)], names[pairs[head] % len(names)], w
        at = stop


def _packed(lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's places in order as differences, deflated: some two bytes a place where the cells need a node many times."""
    for batch in lists:
        places = batch.column("places")
        parts = np.split(places.flatten().to_numpy(), np.cumsum(np.diff(places.offsets.to_numpy()))[:-1]) if batch.num_rows else []
        yield pa.record_batch({"node_id": batch.column("node_id"), "packed": pa.array([zlib.compress(np.diff(np.sort(x), prepend=0).tobytes(), 1) for x in parts], pa.binary())})


def _unpacked(packed: pa.Array) -> list[np.ndarray]:
    return [np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in packed.to_pylist()]


def _surplus(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated pairs of one cell, which holds the members of two blocks (or of one)."""
    sides: dict[bool, list] = {False: [], True: []}
    one = None
    for batch in cell:
        one = batch.column("one")[0].as_py() if one is None and batch.num_rows else one
        for right in (False, True):
            part = batch.filter(pa.compute.equal(batch.column("right"), right))
            lists = _unpacked(part.column("packed"))
            if lists:
                sides[right].append((np.repeat(part.column("node_id").to_numpy(), [len(x) for x in lists]), np.concatenate(lists)))
    left, other = ([np.concatenate(x) for x in zip(*sides[k])] if sides[k] else [np.zeros(0, np.int64)] * 2 for k in (False, True))
    for a, b, w in repeated_pairs(*left, *(left if one else other)):
        keep = a < b if one else np.ones(len(a), bool)  # blocks of unlike nodes give each pair once
        yield pa.record_batch({"src": np.minimum(a, b)[keep], "dst": np.maximum(a, b)[keep], "more": w[keep].astype(np.int64) - 1})


def by_node(members: DataFrame) -> DataFrame:
    """``node_id``, ``places``: each place once."""
    return members.groupBy("node_id").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _met_twice(lists: DataFrame, rows: int) -> DataFrame:
    blocks = max(1, -(-rows // BLOCK_ROWS))
    packed = lists.select("node_id", "places").mapInArrow(_packed, "node_id long, packed binary").withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("o")
    cells = packed.select("node_id", "b", "packed", other).select((F.least("b", "o") * blocks + F.greatest("b", "o")).alias("cell"), (F.col("b") > F.col("o")).alias("right"), (F.col("b") == F.col("o")).alias("one"), "node_id", "packed")
    # Packed cells are small for the work in them: with a number of their own, partitions are not merged.
    return cells.repartition(blocks * (blocks + 1), "cell").groupBy("cell").applyInArrow(_surplus, "src long, dst long, more long")


def surplus_pairs(members: DataFrame, rows: int) -> DataFrame:
    """``src`` < ``dst`` that share more than one place, and ``more``: how many beyond the first.

    Nodes are dealt into blocks by a hash and each pair of blocks is one group, so pairs are found where
    the members of two blocks meet and are never shuffled; a block of members goes to as many groups as there are blocks.
    """
    return _met_twice(by_node(members), rows)


class Meetings:
    """The neighbours of ``members`` (node_id, place: long), both directions of every edge."""

    def __init__(self, members: DataFrame) -> None:
        self.lists = cut(by_node(members))  # a row a node, which rounds unfold
        self.members = self.lists.select("node_id", F.explode("places").alias("place"))
        rows, self.nodes = self.lists.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)), F.count("*")).first()
        self.places = self.members.agg(F.count_distinct("place")).first()[0]
        # As they come out of their cells, each pair once: a shuffle by node and both directions would be most of the disk.
        self.surplus = cut(_met_twice(self.lists, rows))

    def sums(self, values: DataFrame, cols: Sequence[str]) -> DataFrame:
        """``node_id`` and each of ``cols`` summed over the node's neighbours; values must not be negative.

        Whole numbers stay exact. A place's sum less the node's own part may miss zero by its last digits: it is cut at 0.
        """
        few = lambda df, n: F.broadcast(df) if n <= BROADCAST else df
        zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0))
        values = values.select("node_id", *cols)
        place = F.explode("places").alias("place")
        here = self.lists.join(few(values, self.nodes), "node_id").select(place, *cols).groupBy("place").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
        # Each place less the own part: where the others' parts are 0, so is the difference.
        met = self.lists.join(few(values, self.nodes), "node_id", "left").select("node_id", place, *cols).join(few(here, self.places), "place").groupBy("node_id").agg(*[F.sum(F.col(f"_{c}") - zero(c)).alias(f"_{c}") for c in cols])
        pairs = self.surplus.unionAll(self.surplus.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "more"))
        less = pairs.join(few(values.withColumnRenamed("node_id", "src"), self.nodes), "src").groupBy(F.col("dst").alias("node_id")).agg(*[F.sum(F.col("more") * F.col(c)).alias(f"-{c}") for c in cols])
        return met.join(less, "node_id", "left").select("node_id", *[F.greatest(zero(f"_{c}") - zero(f"-{c}"), F.lit(0)).alias(c) for c in cols])

    def degrees(self) -> DataFrame:
        """``node_id``, ``deg`` of the nodes that have neighbours."""
        return self.sums(self.members.select("node_id").distinct().withColumn("deg", F.lit(1).cast("long")), ["deg"]).where("deg > 0")

    def group_counts(self, nodes: DataFrame) -> DataFrame:
        """``src``, ``group_id``, ``k``: neighbours of a node in each group."""
        groups = [r[0] for r in nodes.select("group_id").where("group_id is not null").distinct().orderBy("group_id").collect()]  # a row a group
        cols = [f"k{i}" for i in range(len(groups))]
        if not groups:
            return nodes.select(F.col("node_id").alias("src"), "group_id", F.lit(0).cast("long").alias("k")).limit(0)
        flags = nodes.select("node_id", *[(F.col("group_id").eqNullSafe(F.lit(g))).cast("long").alias(c) for g, c in zip(groups, cols)])
        each = F.explode(F.array(*[F.struct(F.lit(g).cast(nodes.schema["group_id"].dataType).alias("group_id"), F.col(c).alias("k")) for g, c in zip(groups, cols)]))
        return self.sums(flags, cols).select(F.col("node_id").alias("src"), each.alias("e")).select("src", "e.*").where("k > 0")

    def by_class(self, classes: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
        """Two steps to ``node_id``, ``direct``: what a node's neighbours have for its class (node_id, class).

        The first makes parts (src, class, part) a row a node, with a column a class, the second sums such rows up.
        """
        names = [r[0] for r in classes.select("class").distinct().orderBy("class").collect()]  # a row a class
        cols = [f"c{i}" for i in range(len(names))]
        mine = F.coalesce(*[F.when(F.col("class") == F.lit(x), F.col(c)) for x, c in zip(names, cols)])

        def widen(parts: DataFrame) -> DataFrame:
            return parts.groupBy(F.col("src").alias("node_id")).agg(*[F.sum(F.when(F.col("class") == F.lit(x), F.col("part")).otherwise(F.lit(0.0))).alias(c) for x, c in zip(names, cols)])

        def direct(wide: DataFrame) -> DataFrame:
            return self.sums(wide, cols).join(classes, "node_id").select("node_id", mine.alias("direct"))

        return widen, direct
