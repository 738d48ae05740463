"""Ranked lexical search: treaps hold their two orders, and results equal a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from priospread.llm import treap_search as T

SMALL = "/root/testdata/sf0.001"
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, top=20):
    """{place of the item: [(doc_id, score)]} by scoring every document."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for k, (_, text) in enumerate(items):
        scores = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, i))
        out[k] = [(x[3], -x[0]) for x in sorted(scores, key=lambda x: x[:3])[:top]]
    return out


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=40), min_size=1, max_size=5))
def test_treaps_are_ordered_by_document_and_by_impact(lists):
    start = np.cumsum([0, *map(len, lists)])[:-1]
    heap = np.array([v * 1000 + (i * 37) % 1000 for x in lists for i, v in enumerate(x)])
    left, right, root = T.treaps(start, heap)

    def walk(i):
        if i < 0:
            return []
        assert all(heap[c] < heap[i] for c in (left[i], right[i]) if c >= 0)
        return [*walk(left[i]), i, *walk(right[i])]

    assert [i for r in np.flatnonzero(root) for i in walk(r)] == list(range(len(heap)))


@pytest.mark.parametrize("copies", [0, 60])
@pytest.mark.parametrize("step", [1 << 17, 40])
def test_segments_equal_a_plain_scan(copies, step, monkeypatch):
    monkeypatch.setattr(T, "STEP_NODES", step)
    rng = random.Random(copies)
    docs = [(i * 3, words(rng, rng.randint(0, 40))) for i in range(150)]
    docs += [(1 + i * 3, docs[7][1]) for i in range(copies)] + [(None, docs[7][1])] * (copies // 30)
    rng.shuffle(docs)
    items = [(k, docs[rng.randrange(150)][1] if k % 3 else words(rng, 12)) for k in range(12)]
    found = [Counter(T.terms_of(t.encode())) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    held = [(i, T.terms_of(t.encode())) for i, t in docs if t]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    flat = np.array([vocabulary[t] for c in found for t in c], np.int64)
    weights = np.array([c[t] * T.weight(n_docs, df[t]) for c in found for t in c], np.int64)
    asks = T.Items(np.cumsum([0, *map(len, found)]), flat, weights)
    best = T.Best(len(items), 5)
    for k in range(0, len(held), 37):
        part = held[k : k + 37]
        counts = [Counter(vocabulary[t] for t in w if t in vocabulary) for _, w in part]
        terms = [np.array(sorted(c), "<u4") for c in counts]
        tf = [np.array([c[t] for t in x], "<u4") for c, x in zip(counts, terms)]
        ids = np.array([i if i is not None else 0 for i, _ in part])
        T.Segment(ids, np.array([i is None for i, _ in part]), np.array([len(w) for _, w in part]), terms, tf, n_docs, length, len(vocabulary)).search(asks, best)
    want = plain_ranks(docs, items, 5)
    for k in want:
        at = best.item == k
        assert [(None if null else int(d), int(s)) for d, s, null in zip(best.doc[at], best.score[at], best.null[at])] == want[k]


def test_subtrees_are_left_unread():
    rng = np.random.default_rng(1)
    n, terms = 4000, 30
    rows = [np.unique(rng.integers(0, terms, 6)).astype("<u4") for _ in range(n)]
    tf = [rng.geometric(0.4, len(r)).astype("<u4") for r in rows]
    segment = T.Segment(np.arange(n), np.zeros(n, bool), np.full(n, 50), rows, tf, n, 50 * n, terms)
    asks = T.Items(np.array([0, 3]), np.array([0, 5, 9]), np.array([900, 500, 700]))
    best = T.Best(1, 10)
    segment.search(asks, best)
    assert len(best.doc) == 10 and segment.scored < n / 4


def ranks(df, key="item_id"):
    return [(r[key], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def test_whole_tables_against_a_plain_scan(spark):
    from priospread.llm.queries import op11_treap_search

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = [(items[k][0], place, i, s) for k, rows in plain_ranks(docs, items).items() for place, (i, s) in enumerate(rows, 1)]
    assert sorted(ranks(op11_treap_search(spark, SMALL))) == sorted(want)


def test_odd_rows_blocks_and_first_wave(spark, monkeypatch):
    monkeypatch.setattr(T, "ITEM_BYTES", 60)
    monkeypatch.setattr(T, "FIRST_WAVE", 4)
    rng = random.Random(5)
    docs = [(i, words(rng, 15)) for i in range(80)] + [(3, "W1 w2, w2"), (3, "W1 w2, w2"), (None, "w1 w2 w2"), (900, None), (901, ""), (902, " .,-"), (903, "é中文 w1"), (904, "w1 " * 400_000)]
    items = [(1, "w1 w2 W2"), (1, "w3 é中文"), (None, "w1"), (2, None), (3, ""), (4, "nowhere at all"), (5, words(rng, 30))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "'y' as term", "0 as score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as at")
    got = T.rank_documents(d, q, top=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = [(items[k][0], place, i, s) for k, rows in plain_ranks(docs, items, 7).items() for place, (i, s) in enumerate(rows, 1)]
    assert sorted(map(str, ranks(got))) == sorted(map(str, want))
    assert T.rank_documents(d.limit(0), q).count() == 0 and T.rank_documents(d, q.limit(0)).count() == 0
