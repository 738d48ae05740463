import random
import re

import numpy as np
import pytest

from priospread.llm import minhash_near_dup as M
from priospread.llm import pivot_near_dup as P
from priospread.llm.components import connected_components


def union(n, links):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_texts(texts):
    s = sets(texts)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    return [len(x) for x in s], union(len(s), links)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three four five", "É x", "é x", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 150))]
        texts += [" ".join(base)] * 3
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(1, 6)):
                t[rng.randrange(len(t))] = word()
            texts.append("\n".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    shared = " ".join(word() for _ in range(40))
    texts += [shared + " " + " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts.append(" ".join(word() for _ in range(30_000)))
    return texts


@pytest.mark.parametrize("block", [1024, 3])
def test_texts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, id string, n int")
    sizes, component = brute_texts(texts)
    got = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], component[i], component[i] == i)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(60)] = f"x{i}_{rng.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in M.near_duplicates(docs).orderBy("doc_id").collect()] == brute_texts(texts)[1]


def test_pruning_bound():
    levels = M.least_matches()
    assert levels[-1][0] == M.BANDS * M.ROWS and all(0 < m < 0.75 * n for n, m in levels)
    rng = np.random.default_rng(1)
    same = rng.random((4000, M.BANDS * M.ROWS)) < 0.8
    a = np.zeros(same.shape, "<u4")
    assert M.survivors(a, np.where(same, 0, 1).astype("<u4")).mean() > 0.999
    low = rng.random((2000, M.BANDS * M.ROWS)) < 0.4
    assert M.survivors(a[:2000], np.where(low, 0, 1).astype("<u4")).mean() < 0.01


def test_text_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(empty).count() == 0 and M.keep_one_of_each(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, 1, True)], key=str)
    assert M.keep_one_of_each(docs).columns == docs.columns


def vectors(seed=1, n=400, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, n)] + rng.normal(size=(n, 16)) * rng.choice([0.02, 0.2, 0.3, 1.0], n)[:, None]
    x[n // 2 : n // 2 + 60] = x[0]
    return [(i, [float(np.float32(v)) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, rng.integers(0, labels, n)))]


def brute_vectors(rows):
    links, counts = [], [0] * len(rows)
    ok = [v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and rows[j][2] == label and len(rows[j][1]) == len(v) and P.exact_cosine(v, rows[j][1]) >= P.COSINE:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    return counts, union(len(rows), links), links


def check_vectors(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, pivot int")
    got = {r.vec_id: r for r in P.embedding_near_duplicates(df).collect()}
    counts, component, links = brute_vectors(rows)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= counts[i] for i in range(len(rows)))
    assert found >= 0.9 * 2 * len(links)
    return got, counts, component


def test_vectors_recall_against_brute_force(spark):
    check_vectors(spark, vectors())


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 20)
    got, counts, component = check_vectors(spark, vectors(seed=2))
    exact = [i for i in range(len(counts)) if got[i].n_links == counts[i]]
    assert len(exact) >= 0.9 * len(counts)


def test_hot_group_of_near_vectors_keeps_every_link(spark):
    """A third of 10,000 vectors are near copies of one another; every row counts all its links."""
    rng, n = np.random.default_rng(4), 10_000
    x = rng.normal(size=(n, 64))
    centre = rng.normal(size=64)
    x[::3] = centre + 0.2 * rng.normal(size=(len(x[::3]), 64))
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= P.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = np.array([r.n_links for r in P.embedding_near_duplicates(df).orderBy("vec_id").collect()])
    assert want.sum() > 2_000_000 and got.sum() / want.sum() == 1 and (got == want).all()


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [1e30, 0.0], 1), (12, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.embedding_near_duplicates(df).collect()}
    for i in (0, 1, 10, 11):
        assert got[i] == (3, 0, i == 0)
    for i in (2, 3, 4, 5, 6, 7, 8, 9, 12):
        assert got[i] == (0, i, True)
    assert P.embedding_near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    ids = list(range(60))
    rng.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(39)] + [(ids[i], ids[i + 1]) for i in range(45, 59)] + [(3, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(60, links)
    assert all(got[i] == want[i] for i in got) and len(got) == 55
