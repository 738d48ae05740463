import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priospread.llm import packing as K
from priospread.llm import piece_sampling as S
from priospread.llm import topk_search as T
from priospread.llm.word_bpe import WordBpe

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_top(rows, top=10):
    ok = [(i, [int(np.floor(c * 1024)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for i, q in ok:
        if i % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i))[:top]
            out |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize(("rows_block", "query_block"), [(4096, 1024), (37, 2)])
def test_search_matches_brute_force(spark, monkeypatch, rows_block, query_block):
    monkeypatch.setattr(T, "ROW_BLOCK", rows_block)
    monkeypatch.setattr(T, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1 if i % 3 else 6)]) for i in range(500)]
    rows += [(500, None), (501, [float("nan")] * 6), (502, [None] * 6), (600, [0.0] * 6), (700, [float("inf")] + [0.0] * 5), (800, [-1.0] * 6), (801, [-1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, rank string, score int")
    got = {tuple(r) for r in T.top_inner_products(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_top(rows)


def test_search_edges(spark):
    df = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    ask = F.col("vec_id") % 100 == 0
    assert [tuple(r) for r in T.top_inner_products(df, ask).orderBy("rank").collect()] == [(100, 1, 1, 2048 * 1024), (100, 2, 2, 2048 * 1024)]
    assert T.top_inner_products(df.limit(0), ask).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(4000, 3)) * 1024).astype(np.int64)
    q, ids = np.array([900, 5, -3]), np.arange(4000)
    best, score, depth = T.threshold_search(q, x, ids, T.sorted_lists(x), 10)
    want = np.lexsort((ids, -(x @ q)))[:10]
    assert best.tolist() == ids[want].tolist() and score.tolist() == (x @ q)[want].tolist() and depth < 1000


ODD = ["", "don't stop 'sun it's≠ <|endoftext|>x É.É—. ß?!", "中文字 テスト.", "İstanbul ΟΔΟΣ. 3.14 A'S!", "x×. \x1c\x00a.", "a" * 5000, "\u2581x  y", " lead", "e\u0301. e\u0338=\u0338"]


def test_word_encoder_equals_the_tokenizer(spark):
    whole, bpe = Tokenizer.from_file(BPE), WordBpe(BPE)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    for t in texts + ODD:
        assert bpe.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_word_encoder_survives_a_full_table(monkeypatch):
    from priospread.llm import word_bpe

    monkeypatch.setattr(word_bpe, "CACHE_CHUNKS", 4)
    whole, bpe = Tokenizer.from_file(BPE), WordBpe(BPE)
    for t in ("one two three", "four one five.", "six, seven eight nine ten one"):
        assert bpe.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def check_pieces(rows, texts):
    whole = Tokenizer.from_file(BPE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = np.array(whole.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    tokens = padded = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        tokens += at
        padded += at if at & (at - 1) == 0 else 2048
    return tokens, padded, by_seq


def test_packing_is_whole_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens, padded, seqs = check_pieces(K.pack_documents(docs, BPE).collect(), texts)
    assert padded <= 1.02 * tokens
    groups = defaultdict(int)
    for parts in seqs.values():
        groups[parts[0].step_group] += parts[0].window
    assert max(groups.values()) <= 2 * K.STEP_TOKENS


def test_packing_edges(spark):
    texts = dict(enumerate([None, "", "a", *ODD, "x " * 2047, "x " * 2048, "word " * 9000]))
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, length string")
    check_pieces(K.pack_documents(docs, BPE).collect(), texts)
    assert K.pack_documents(docs.limit(0), BPE).count() == 0


def test_balanced_groups():
    of = K.balanced([2048] * 8 + [256] * 16, 4)
    loads = [sum(w for w, g in zip([2048] * 8 + [256] * 16, of) if g == k) for k in range(4)]
    assert max(loads) == min(loads)


def test_round_trip_is_lossless(spark):
    rows = [(i, t, 1) for i, t in enumerate([None, *ODD, "line\n\nnext  gap ", "\t tab", "😀 emoji", "é" * 200])]
    got = S.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_pieces int"), PIECES).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[0] == 0
    table = S.round_trip(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PIECES)
    assert table.where("not lossless").count() == 0


def test_sampling_is_reproducible_whatever_the_batch():
    model = S.PieceModel.shared(PIECES)
    texts = ["the internationalisation of words", "another text entirely", "x" * 60 + " tail"]
    seeds = [S.seed_of(i) for i in range(3)]
    together = [x.tolist() for x in S.sample_slice(model, texts, seeds)]
    alone = [S.sample_slice(model, [t], [s])[0].tolist() for t, s in zip(texts, seeds)]
    assert together == alone
    assert len({tuple(S.sample_slice(model, [texts[0]], [S.seed_of(i)])[0].tolist()) for i in range(50)}) > 10


def paths_of(model, s):
    """All segmentations of a segment with their weights."""
    out = [((), 1.0)] if not s else []
    ids = {model.bytes[i].decode(): i for i in range(len(model.bytes)) if model.weight[i] > 0}
    for n in range(1, min(len(s), model.longest) + 1):
        if (i := ids.get(s[:n])) is not None:
            out += [((i, *rest), model.weight[i] * w) for rest, w in paths_of(model, s[n:])]
    return out


def test_samples_follow_the_lattice():
    model = S.PieceModel.shared(PIECES)
    every = paths_of(model, " there")
    total = sum(w for _, w in every)
    n = 6000
    drawn = defaultdict(int)
    for ids in S.sample_slice(model, ["there"] * n, [S.seed_of(i) for i in range(n)]):
        drawn[tuple(ids.tolist())] += 1
    assert set(drawn) <= {p for p, _ in every}
    for p, w in every:
        expected = n * w / total
        if expected > 20:
            assert abs(drawn[p] - expected) < 5 * expected**0.5
