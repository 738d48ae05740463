"""Exact ranked lexical search over inverted treaps.

1. The items' terms (a block of items at a time, bounded by bytes) form a vocabulary. One reading of
   the texts gives each document its count of terms and its occurrences of the vocabulary's terms;
   these narrow rows are written to the checkpoint folder. Counts of documents, of terms and of
   documents a term are exact sums over them.
2. A task streams its rows in segments bounded by documents and postings. In a segment each term has
   a treap: in-order by document id, heap-ordered by the term's impact in the document (equal impacts
   by a hash, so that copies do not make chains).
3. All items traverse a segment's treaps simultaneously. A step holds intervals of documents with, per
   term, the top node inside. The sum of the weighted impacts of these nodes bounds every score in the
   interval: if it cannot enter the item's best ``top``, the subtrees are left. Else the document of the
   largest summand is scored and divides the interval. The k-th score travels from segment to segment,
   and one that a few segments of the whole table reach is given to all tasks before they start.
4. A task's winners, at most ``top`` an item, meet in a window that is limited before its shuffle.

No posting is shuffled. Broadcast are an item block's vocabulary and weights, bounded by ``ITEM_BYTES``.

Edge cases: null and empty texts and texts without terms are no documents; an item without terms, or
whose terms occur nowhere, has no rows; rows that repeat a document id are documents each; a null document
id comes last among equal scores; items that repeat an id, or have none, are ranked each on their own;
very long texts are taken whole (slices of 16 MB a batch); bytes that are not UTF-8 count as U+FFFD;
empty tables have no result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, mix64, sound

#: Results per item; bytes of a block of items; documents and postings of a segment; nodes of a step.
TOP, ITEM_BYTES, SEGMENT_DOCS, SEGMENT_POSTINGS, STEP_NODES = 20, 8 << 20, 16_384, 4_000_000, 1 << 17
#: Documents, about, of the first wave, whose k-th scores all tasks start from. It only raises bounds.
FIRST_WAVE = 20_000
# A-Z lower-cased, every other ASCII byte but letters and digits ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bits of the hash that orders equal impacts (these are below 2^20), and of a document's place in a segment.
TIE_BITS, DOC_BITS = 16, 15
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII of a UTF-8 text."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """The impact of a term that occurs ``tf`` times in a document of ``n_terms`` terms."""
    if 25 * int(n_terms.max(initial=0)) * n_docs >= 2**63:
        m = np.array([75 + 25 * int(n) * n_docs // length for n in n_terms], np.int64)
    else:
        m = 75 + 25 * n_terms * n_docs // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def treaps(start: np.ndarray, heap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left child, right child (-1: none) and whether it is a root, of each posting.

    ``heap`` holds unequal keys list after list, ``start`` where lists begin. The parent of a posting is
    the smaller of the nearest greater keys on either side, which pointer jumping finds for all at once.
    """
    n = len(heap)

    def nearest(step: int) -> np.ndarray:
        to = np.arange(n) + step
        to[start if step < 0 else np.append(start[1:], n) - 1] = -1
        active = np.flatnonzero(to >= 0)
        while len(active := active[heap[to[active]] < heap[active]]):
            to[active] = to[to[active]]
            active = active[to[active] >= 0]
        return to

    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    before, after = nearest(-1), nearest(1)
    key = lambda to: np.where(to >= 0, heap[to], LAST)
    from_left = key(before) < key(after)
    root = (before < 0) & (after < 0)
    left, right = np.full(n, -1), np.full(n, -1)
    at = np.flatnonzero(from_left)
    right[before[at]] = at
    at = np.flatnonzero(~from_left & ~root)
    left[after[at]] = at
    return left, right, root


class Best:
    """The best documents so far of each item, best first, ties to the smaller id, nulls last."""

    def __init__(self, n: int, top: int, floor: np.ndarray | None = None) -> None:
        self.top = top
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        #: No document below this score, and none of this score after this id, can enter.
        self.least = np.zeros(n, np.int64) if floor is None else floor.copy()
        self.last = np.where(self.least > 0, LAST, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = (score > self.least[item]) | ((score == self.least[item]) & (doc <= self.last[item]))
        if not keep.any():
            return
        new = (item[keep], score[keep], doc[keep], null[keep])
        item, score, doc, null = (np.concatenate(x) for x in zip((self.item, self.score, self.doc, self.null), new))
        order = np.lexsort((null, doc, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]
        kth = place == self.top - 1
        self.least[item[kth]], self.last[item[kth]] = score[kth], doc[kth]


@dataclass
class Items:
    """A block of items: the places, terms and weights of each one's distinct terms, item after item."""

    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1


class Segment:
    """The treaps of some documents, and the search in them."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n_terms: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], n_docs: int, length: int, vocabulary: int) -> None:
        order = np.lexsort((ids, null))
        self.ids, self.null, self.size = np.where(null, LAST, ids)[order], null[order], len(ids)
        held = [len(terms[i]) for i in order]
        doc = np.repeat(np.arange(len(ids)), held)
        term = np.concatenate([terms[i] for i in order]).astype(np.int64)
        tf = np.concatenate([counts[i] for i in order]).astype(np.int64)
        by_term = np.argsort(term, kind="stable")
        self.term, self.doc = term[by_term], doc[by_term]
        self.impact = impacts(tf[by_term], n_terms[order][self.doc], n_docs, length)
        start = np.flatnonzero(np.r_[True, self.term[1:] != self.term[:-1]]) if len(term) else np.zeros(0, int)
        tie = (mix64(self.doc.astype(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        self.left, self.right, root = treaps(start, (((self.impact << TIE_BITS) | tie) << DOC_BITS) | self.doc)
        self.root = np.full(vocabulary, -1)
        self.root[self.term[root]] = np.flatnonzero(root)
        self.code = self.term * self.size + self.doc
        self.scored = 0

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The top node of each subtree between two documents, -1 if there is none."""
        node, at = node.copy(), np.arange(len(node))
        while len(at):
            doc = self.doc[node[at]]
            after, before = doc <= low[at], doc >= high[at]
            out = after | before
            at, after = at[out], after[out]
            node[at] = np.where(after, self.right[node[at]], self.left[node[at]])
            at = at[node[at] >= 0]
        return node

    def search(self, items: Items, best: Best) -> None:
        """Offer to ``best`` every document that may enter it."""
        node = self.root[items.term]
        item = np.repeat(np.arange(len(items)), np.diff(items.start))
        some = node >= 0
        present, at = np.unique(item[some], return_inverse=True)
        if not len(present):
            return
        todo = [(present, np.full(len(present), -1), np.full(len(present), self.size), at, node[some], items.weight[some])]
        while todo:
            # item, low and high of each interval; interval, node and weight of each subtree
            item, low, high, at, node, w = todo.pop()
            if len(node) > STEP_NODES and len(item) > 1:
                cut = len(item) // 2
                k = np.searchsorted(at, cut)
                todo.append((item[cut:], low[cut:], high[cut:], at[k:] - cut, node[k:], w[k:]))
                todo.append((item[:cut], low[:cut], high[:cut], at[:k], node[:k], w[:k]))
                continue
            part = w * self.impact[node]
            start = np.searchsorted(at, np.arange(len(item)))
            bound = np.add.reduceat(part, start)
            open_ = (bound > best.least[item]) | ((bound == best.least[item]) & (self.ids[low + 1] <= best.last[item]))
            if not open_.any():
                continue
            if not open_.all():
                item, low, high = item[open_], low[open_], high[open_]
                of = open_[at]
                at, node, w, part = (np.cumsum(open_) - 1)[at[of]], node[of], w[of], part[of]
                start = np.searchsorted(at, np.arange(len(item)))
            largest = np.flatnonzero(part == np.maximum.reduceat(part, start)[at])
            largest = largest[np.searchsorted(at[largest], np.arange(len(item)))]
            pivot = self.doc[node[largest]]
            code = self.term[node] * self.size + pivot[at]
            place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            score = np.add.reduceat(np.where(self.code[place] == code, w * self.impact[place], 0), start)
            self.scored += len(item)
            best.add(item, score, self.ids[pivot], self.null[pivot])
            item, low, high, at, w = np.r_[item, item], np.r_[low, pivot], np.r_[pivot, high], np.r_[at, at + len(item)], np.r_[w, w]
            node = self._within(np.r_[node, node], low[at], high[at])
            some = node >= 0
            if some.any():
                held = np.zeros(len(item), bool)
                held[at[some]] = True
                todo.append((item[held], low[held], high[held], (np.cumsum(held) - 1)[at[some]], node[some], w[some]))


def _index(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """``id``, ``n``, ``terms`` and ``counts`` (little-endian uint32) of the documents that have terms."""

    def worker():
        number = vocabulary.value.get

        def work(texts):
            sizes, terms, counts = [], [], []
            for t in texts:
                found = terms_of(t)
                known = [v for x in found if (v := number(x)) is not None]
                v, c = np.unique(np.array(known, "<u4"), return_counts=True)
                sizes.append(len(found))
                terms.append(v.tobytes())
                counts.append(c.astype("<u4").tobytes())
            return sizes, terms, counts

        return work

    fields = pa.schema([("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_texts(rows, ["id"], "text", worker, fields).where("n > 0")


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents of each term; tasks send one sum a term that they hold."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u4"), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    sums = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return out


def _winners(index: DataFrame, shared, n_docs: int, length: int, vocabulary: int, top: int) -> DataFrame:
    """Each task's best documents of each item."""

    def run(batches):
        items, floor = shared.value
        best, rows, postings = Best(len(items), top, floor), [], 0

        def search():
            ids, null, n, terms, counts = (np.concatenate(x) if isinstance(x[0], np.ndarray) else [y for z in x for y in z] for x in zip(*rows))
            Segment(ids, null, n, terms, counts, n_docs, length, vocabulary).search(items, best)

        for b in batches:
            size = np.array([len(x) // 4 for x in b.column("terms").to_pylist()])
            lo = 0
            while lo < b.num_rows:
                held = sum(len(r[0]) for r in rows)
                hi = lo + int(np.searchsorted(np.cumsum(size[lo:]), SEGMENT_POSTINGS - postings, "right"))
                hi = min(max(hi, lo if rows else lo + 1), lo + SEGMENT_DOCS - held, b.num_rows)
                if hi > lo:
                    part = b.slice(lo, hi - lo)
                    ids = part.column("id")
                    arrays = [[np.frombuffer(x, "<u4") for x in part.column(c).to_pylist()] for c in ("terms", "counts")]
                    rows.append((ids.fill_null(0).to_numpy(), np.array(ids.is_null()), part.column("n").to_numpy(), *arrays))
                    postings += int(size[lo:hi].sum())
                lo = hi
                if lo < b.num_rows:
                    search()
                    rows, postings = [], 0
        if rows:
            search()
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def _ranked(winners: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return winners.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", top: int = TOP) -> DataFrame:
    """``item``, ``rank``, ``key`` and ``score`` of the ``top`` documents of every item."""
    spark = docs.sparkSession
    asked = checkpoint(items.select(F.col(item).alias("item"), F.coalesce(F.col(query).cast("binary"), F.lit(b"")).alias("text")).withColumn("at", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == block).select("at", "text").toArrow()
        found = [Counter(terms_of(sound(t))) for t in rows.column("text").to_pylist()]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        index = checkpoint(_index(docs, key, text, spark.sparkContext.broadcast(vocabulary)))
        n_docs, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([weight(n_docs, int(df)) for df in _frequencies(index, len(vocabulary))], np.int64)
        numbers = [np.array([vocabulary[t] for t in c], np.int64) for c in found]
        times = [np.array(list(c.values()), np.int64) for c in found]
        flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        asks = Items(np.cumsum([0, *map(len, found)]), flat, weights[flat] * np.concatenate([*times, np.zeros(0, np.int64)]))
        search = lambda part, floor: _winners(part, spark.sparkContext.broadcast((asks, floor)), n_docs, length, len(vocabulary), top)  # noqa: B023, E731
        floor = np.zeros(len(asks), np.int64)
        if n_docs > 4 * FIRST_WAVE:
            wave = index.where(F.pmod(F.xxhash64(F.lit(7), "id", "n"), F.lit(n_docs // FIRST_WAVE)) == 0)
            kth = _ranked(search(wave.coalesce(64), floor), top).where(F.col("rank") == top).select("item", "score").toArrow()
            floor[kth.column("item").to_numpy()] = kth.column("score").to_numpy()
        best = _ranked(search(index, floor), top)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(asks)), pa.int64()), "at": rows.column("at")}))
        best = best.join(names, "item").select("at", "rank", "doc", "score")
        out = best if out is None else out.unionAll(best)
    return out.join(asked.select("at", "item"), "at").select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
