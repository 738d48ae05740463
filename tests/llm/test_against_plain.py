"""Operators whose result SQL cannot express, against plain Python over whole tables; planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from priospread.llm import pivot_near_dup as P
from priospread.llm import quality_gam as Q
from priospread.llm import secret_scan as S
from priospread.llm import topk_search as T
from priospread.llm import url_filter as U

from .test_near_dup import brute_texts

SMALL = "/root/testdata/sf0.001"


def plain_score(model, row):
    """A score by one table lookup after the other."""
    z = model.intercept
    place = lambda cuts, v: sum(1 for c in cuts if c <= v)
    for f, v in enumerate(row):
        z += model.tables[f][place(model.cuts[f], v)]
    for (f, g), table in zip(model.pairs, model.pair_tables):
        z += table[place(model.pair_cuts[f], row[f])][place(model.pair_cuts[g], row[g])]
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def tables(spark):
    return [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]


def plain_quality(spark):
    docs, labels = tables(spark)
    model = Q.train_quality(docs, labels.where(~Q.held_out()))
    return {r.doc_id: plain_score(model, Q.features((r.text or "").encode())) for r in docs.collect()}


def test_scores_equal_plain_lookups(spark):
    docs, labels = tables(spark)
    want = plain_quality(spark)
    got = Q.score_quality(docs, Q.train_quality(docs, labels.where(~Q.held_out()))).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-12) and r.predicted == (want[r.doc_id] >= 0.7)


def test_features_of_a_known_text():
    got = dict(zip(Q.FEATURES, Q.features(b"Aa bb, bb!\nAa bb, bb!")))
    assert got["log_bytes"] == pytest.approx(np.log(22)) and got["distinct_words"] == 0.5 and got["repeated_lines"] == 0.5
    assert got["upper_share"] == 2 / 12 and got["bang_share"] == 2 / 21 and got["top_word_share"] == 2 / 6


def test_model_does_not_learn_held_out_rows(spark):
    docs, labels = tables(spark)
    ids = [r.doc_id for r in labels.collect()]
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    assert out and {r.doc_id for r in labels.where(~Q.held_out()).collect()} == set(ids) - set(out)


def test_pipeline_against_plain_stages(spark):
    """Each stage's rows by plain Python: table lookups, shingle sets, patterns, the tokenizer."""
    docs, _ = tables(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    score = plain_quality(spark)
    kept = sorted(i for i in texts if score[i] >= 0.7)
    _, component = brute_texts([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if component[k] == k]
    good = corpus_pipeline.quality(spark, docs, SMALL)
    once = corpus_pipeline.near_dedup(spark, good, SMALL).cache()
    assert sorted(r.doc_id for r in once.collect()) == kept
    ratios, clean = S.train_from(once), {}
    for i in kept:
        t = (texts[i] or "").encode()
        base = S.base_spans(t)
        out, at = b"", 0
        for s, e in sorted((s, e) for _, s, e in base + S.markov_spans(t, ratios, base)):
            if s >= at:
                out += t[at:s] + b"[secret]"
            at = max(at, e)
        clean[i] = (out + t[at:]).decode()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seen: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        seen.setdefault(r.doc_id, []).append(r)
    assert sorted(seen) == kept
    for i, parts in seen.items():
        ids = np.array([*whole.encode(clean[i], add_special_tokens=False).ids, 1], "<u4")
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()] and sum(r.length for r in parts) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in parts)


def test_markov_models_find_planted_keys_in_the_table(spark):
    """Keys that no pattern covers, planted in a third of the documents: recall 0.95, precision 0.95 at least."""
    rng, docs = random.Random(8), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, planted = [], {}
    for r in docs.collect():
        text = r.text or ""
        if r.doc_id % 3 == 0:
            key = "".join(rng.choices(pool, k=rng.randint(28, 44)))
            planted[r.doc_id] = (len(text) + 7, len(text) + 7 + len(key))
            text += f" value {key} end"
        rows.append((r.doc_id, text))
    found = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("n_markov > 0").collect()
    spans = {(r.doc_id, int(s), int(e)) for r in found for k, s, e in (x.split(":") for x in r.spans.split(",")) if k == "markov"}
    hits = sum((i, *span) in spans for i, span in planted.items())
    assert hits / len(planted) >= 0.95 and hits / len(spans) >= 0.95


def test_pair_counts_equal_plain_counts():
    samples = [b"abc", b"", b"a", b"zzz9"] * 3000
    got, n = S.pair_counts(samples), len(S.ALPHABET) + 1
    want = np.zeros((n + 1, n), int)
    at = {c: i for i, c in enumerate(S.ALPHABET)}
    for s in filter(None, samples):
        want[n, at[s[0]]] += 1
        for x, y in zip(s, s[1:]):
            want[at[x], at[y]] += 1
    assert (got == want).all()


@pytest.mark.parametrize("n", [1500, 6000])
def test_pivot_index_recall(spark, n):
    """Planted pairs at cosine 0.93 to 0.98 in 64 dimensions, several sizes: recall 0.99 at least."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x[1::4] = x[::4][: len(x[1::4])] + 0.28 * rng.normal(size=x[1::4].shape)
    x[2 :: 8] = rng.normal(size=64) + 0.35 * rng.normal(size=x[2::8].shape)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= P.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = np.array([r.n_links for r in P.embedding_near_duplicates(df).orderBy("vec_id").collect()])
    assert want.sum() > n / 10 and (got <= want).all() and got.sum() / want.sum() >= 0.99


def test_pairs_meet_in_one_list():
    rng = np.random.default_rng(2)
    a, b = (np.array([rng.permutation(20)[:8] for _ in range(300)]) for _ in range(2))
    met = np.array([P.meets(a, b, p) for p in range(20)])
    shared = np.array([len(set(x) & set(y)) for x, y in zip(a, b)])
    assert (met.sum(0) == ((shared >= P.SHARED) | (a[:, 0] == b[:, 0]))).all()


@pytest.mark.parametrize("mean", [0.0, 0.6, 0.7])
def test_index_of_vectors_that_share_a_direction(mean):
    """50,000 vectors of a mean cosine: few pairs are candidates, planted near pairs are among them."""
    rng, n, dim, planted = np.random.default_rng(3), 50_000, 64, 500
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(n, dim))) * (1 - mean) ** 0.5 + unit(rng.normal(size=dim)) * mean**0.5
    src, dst = rng.integers(0, n // 2, planted), n // 2 + np.arange(planted)
    c, u = rng.uniform(P.COSINE, 0.99, (planted, 1)), unit(x[src])
    off = rng.normal(size=(planted, dim))
    off = unit(off - (off * u).sum(1, keepdims=True) * u)
    x[dst] = c * u + (1 - c * c) ** 0.5 * off
    u, some = P._unit(x), 224
    pivots, middle = P.centred(u[rng.permutation(n)[: P.DRAWN * some]], some)
    named = np.argsort(-((u - middle) @ pivots.T), axis=1, kind="stable")[:, : P.NEAREST]
    meet = lambda a, b: (a[:, 0] == b[:, 0]) | ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= P.SHARED)
    i, j = rng.integers(0, n, (2, 60_000))
    assert meet(named[i], named[j]).mean() < 0.06 and meet(named[src], named[dst]).mean() > 0.99


def test_share_of_rows_that_the_threshold_algorithm_scores():
    """Lists of falling spread stop early; lists without structure are read to the end (see the README)."""
    rng = np.random.default_rng(1)
    for scale, most in ((np.exp(-2 * np.arange(16)), 0.4), (np.ones(16), 1.0)):
        x = (rng.normal(size=(4000, 16)) * scale * 1024).astype(np.int64)
        block, best = T.Block(x, np.arange(4000)), T.Best(20, 10)
        _, scored = T.search_queries(x[:20], np.arange(20), block, best)
        assert scored / (20 * 4000) <= most
        for q in range(20):
            order = np.lexsort((np.arange(4000), -(x @ x[q])))
            assert best.row[best.query == q].tolist() == order[order != q][:10].tolist()


def test_masses_against_plain_python(spark):
    """Trust and distrust over thousands of hosts: the same integers as a plain loop; all mass is kept."""
    rng, n = random.Random(5), 3000
    edges = {}
    for _ in range(9000):
        a, b = rng.randrange(n), min(n - 1, int(rng.expovariate(1) * 300))
        if a != b:
            edges[f"h{a}.test", f"h{b}.test"] = rng.randint(1, 5)
    seeds = {("trust", f"h{i}.test"): i % 7 + 1 for i in range(0, n, 50)} | {("distrust", f"h{i}.test"): 1 for i in range(7, n, 90)}
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, w long"), spark.createDataFrame([(*k, w) for k, w in seeds.items()], "kind string, host string, weight long")).collect()}
    want: dict = {}
    for at, kind in enumerate(("trust", "distrust")):
        way = [((a, b) if kind == "trust" else (b, a), w) for (a, b), w in edges.items()]
        out: dict = {}
        for (a, _), w in way:
            out[a] = out.get(a, 0) + w
        total = sum(w for (k, _), w in seeds.items() if k == kind)
        fine = U.UNIT * (sum(edges.values()) + sum(seeds.values()))
        home = {h: (fine * w // total) * (100 - U.FOLLOW) // 100 for (k, h), w in seeds.items() if k == kind}
        state, was = dict(home), None
        while state != was:
            was, state = state, dict(home)
            for (a, b), w in way:
                if a in was:
                    state[b] = state.get(b, 0) + (was[a] * U.FOLLOW // 100) * w // out[a]
        left = sum(state.values())
        for h, m in state.items():
            want.setdefault(h, [0, 0])[at] = m * U.FINE // left
    assert got == {h: tuple(m) for h, m in want.items()}
    assert all(abs(sum(m[at] for m in got.values()) - U.FINE) < 10 * n for at in (0, 1))


def test_labels_of_expressions_over_a_table(spark):
    from priospread.llm.license_scan import scan_licenses

    rows = {
        "spdx license identifier is described here": "", "// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode": "gpl-2.0-only,mit",
        "SPDX-License-Identifier:\n# Apache-2.0\n": "apache-2.0", "SPDX-License-Identifier: MIT/Apache-2.0": "apache-2.0,mit",
        "SPDX-License-Identifier: MIT WITH (A OR B)": "", "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC */": "bsd-3-clause,isc,mit",
        "under the MIT License; SPDX-License-Identifier: A WITH B WITH C": "mit",
    }
    got = {r.text: r.labels for r in scan_licenses(spark.createDataFrame([(t, t) for t in rows], "text string, t string"), "text", "t").withColumnRenamed("doc_id", "text").collect()}
    assert got == rows


def test_plain_digest_is_the_one_of_the_pattern():
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(S.joined([]).encode()).hexdigest())
