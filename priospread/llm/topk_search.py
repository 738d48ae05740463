"""Exact top-k search with Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt once, to groups of bounded size; the queries travel to every group and stream
through it in batches. A task builds, for each block of its rows, one list per dimension sorted by
component, once for all queries. For a batch of queries the lists are read from both ends, in
steps that double; new rows are scored for the queries that still read, and a query stops when the
bound, the sum over dimensions of its component times the last value read at the end that it
favours, is below its k-th best score. That score is carried from block to block of a group, so
later blocks are often left before a row is scored. Group winners are merged per query, best first,
ties to the smaller id.

Nothing is broadcast. Rows are shuffled once and queries once a group; groups grow with the table
up to ``MOST_ROWS`` rows and ``COMPONENTS`` components (64 MB as doubles, about four times that
with the lists). In many dimensions without structure the bound bites only after nearly every row
was seen in some list: the share of rows that :func:`search_queries` reports is then 1.

Edge cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as ended by zeros; rows that repeat an id are candidates each, as a query the least
vector of an id counts; a query's own id is never its candidate; with fewer rows than k all are
returned; zero vectors score 0; an empty table has no result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Results per query, scale of a component, rows of a block, queries of a batch, list entries of the
#: first step; each step reads twice as many, so reading ends at most at twice the depth that is needed.
TOP, SCALE, ROW_BLOCK, QUERY_BLOCK, STEP = 10, 1024, 4096, 1024, 16
#: Groups that a table is dealt to if they stay within the bounds, most rows and components of one.
GROUPS, MOST_ROWS, COMPONENTS = 64, 65_536, 8_000_000


class Block:
    """Rows with one sorted list per dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids = x, ids
        self.order, self.value = sorted_lists(x)
        # Products of doubles are exact as long as no sum leaves 2^53.
        self.large = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.real = x.astype(float)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.large * float(np.abs(q).max(initial=0)) < 2**53:
            return (self.real[rows] @ q.T.astype(float)).astype(np.int64)
        return self.x[rows] @ q.T


class Best:
    """The best rows so far of each query of a batch, best first."""

    def __init__(self, n: int, top: int) -> None:
        self.n, self.top = n, top
        self.query, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th score of queries that have k rows

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        query, score, row = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.top
        self.query, self.score, self.row = query[keep], score[keep], row[keep]
        last = place == self.top - 1
        self.least[query[last]] = score[last]

    @property
    def full(self) -> np.ndarray:
        return self.least > np.iinfo(np.int64).min


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of each dimension's list, falling."""
    order = np.argsort(-x, axis=0, kind="stable").astype(np.int32)
    return order, np.take_along_axis(x, order, 0)


def search_queries(q: np.ndarray, own: np.ndarray, block: Block, best: Best) -> tuple[int, int]:
    """Read the block's lists for a batch of queries; the depth reached and the scores computed."""
    n, above, below = len(block.x), np.maximum(q, 0), np.minimum(q, 0)
    seen, depth, step, scored = np.zeros(n, bool), 0, STEP, 0

    def reading(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~(best.full & (above @ top + below @ bottom < best.least)))

    active = reading(block.value[0], block.value[-1])
    while len(active) and depth < n:
        to, step = min(n, depth + step), 2 * step
        ends = np.concatenate([block.order[depth:to].ravel(), block.order[n - to : n - depth].ravel()])
        new = np.unique(ends[~seen[ends]])
        seen[new], depth = True, to
        if len(new):
            s = block.scores(new, q[active])
            scored += s.size
            valid = block.ids[new][:, None] != own[active][None, :]
            level = best.least[active]
            if len(new) > best.top:  # the k-th of the new ones, of which one may be the query itself
                cut = np.partition(s, len(new) - best.top - 1, axis=0)[len(new) - best.top - 1]
                same = np.bincount(np.nonzero(~valid)[1], minlength=len(active)) > 1
                level = np.where(same, level, np.maximum(level, cut))
            r, c = np.nonzero(valid & (s >= level[None, :]))
            best.add(active[c], s[r, c], block.ids[new[r]])
        if seen.all():
            break
        active = active[np.isin(active, reading(block.value[depth - 1], block.value[n - depth]))]
    return depth, scored


def threshold_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, lists=None, top: int = TOP, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the best rows for one query, best first, and the depth at which reading stopped."""
    best = Best(1, top)
    if own is not None:
        x, ids = x[ids != own], ids[ids != own]
    depth = search_queries(q[None, :], np.array([np.iinfo(np.int64).min]), Block(x, ids), best)[0] if len(x) else 0
    return best.row, best.score, depth


def _padded(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def top_inner_products(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of every query row's best ``top`` rows."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = checkpoint(rows.withColumn("at", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    size = max(1, min(max(ROW_BLOCK, math.ceil(n / GROUPS)), MOST_ROWS, max(ROW_BLOCK, COMPONENTS // width)))
    groups = max(1, math.ceil(n / size))
    # Rows are dealt by their place, so rows that repeat an id are spread as well.
    found = rows.select(F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), "id", "v")
    asks = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "id", "v")
    block_rows, batch = ROW_BLOCK, QUERY_BLOCK

    def run(batches):
        group, ids, vectors, blocks = None, [], [], []

        def search(b: pa.RecordBatch):
            """The batch's queries against all blocks of the group."""
            q, own = _padded(b.column("v"), width), b.column("id").to_numpy()
            best = Best(len(q), top)
            for block in blocks:
                search_queries(q, own, block, best)
            return pa.RecordBatch.from_arrays([pa.array(own[best.query]), pa.array(best.row), pa.array(best.score)], ["query_id", "vec_id", "score"])

        for whole in batches:
            g, is_ask = whole.column("g").to_numpy(), whole.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((g[1:] != g[:-1]) | (is_ask[1:] != is_ask[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(g)]):
                if lo == hi:
                    continue
                if g[lo] != group:
                    group, ids, vectors, blocks = g[lo], [], [], []
                b = whole.slice(lo, hi - lo)
                if not is_ask[lo]:
                    ids.append(b.column("id").to_numpy())
                    vectors.append(_padded(b.column("v"), width))
                    continue
                if ids:
                    x, i = np.concatenate(vectors), np.concatenate(ids)
                    blocks = [Block(x[k : k + block_rows], i[k : k + block_rows]) for k in range(0, len(x), block_rows)]
                    ids, vectors = [], []
                for k in range(0, b.num_rows, batch):
                    yield search(b.slice(k, batch))

    dealt = found.unionByName(asks).repartition(groups, "g").sortWithinPartitions("g", "asks")
    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
