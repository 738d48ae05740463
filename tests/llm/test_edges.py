"""Nulls, empty and very long texts, bytes that are not UTF-8, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from priospread.llm import license_scan, minhash_near_dup, packing, piece_sampling, quality_gam, secret_scan

LONG = ("some plain words, the " * 8 + "password=hunter22 ").encode() * 27_000  # over 5 MB
BAD = b"broken \xff\xfe bytes here password=abcdefgh and more words"
CLASH = ("_text", "_null_text", "_good", "_kept", "_redacted", "_t", "_k0", "_f0", "row", "key", "t", "id", "component", "digest", "sig", "n")
OPERATORS = {
    "license": license_scan.scan_licenses,
    "secret": lambda d: secret_scan.scan_secrets(d, secret_scan.train([], [])),
    "redact": lambda d: secret_scan.redact_secrets(d, secret_scan.train([], [])),
    "pieces": lambda d: piece_sampling.round_trip(d, public_tokenizers.path("piece_bpe_32k.model")),
    "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality": lambda d: quality_gam.score_quality(d, quality_gam.fit(*quality_sample())),
    "keep": lambda d: quality_gam.keep_quality(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"), threshold=0.0),
    "near": minhash_near_dup.near_duplicates,
    "once": minhash_near_dup.keep_one_of_each,
}


def quality_sample():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((200, len(quality_gam.FEATURES)))
    return x, (x[:, 0] > 0.5).astype(float)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, b""), (3, b" \n"), (4, BAD), (5, LONG), (6, b"one two three four five six"), (6, b"one two three four five six"), (6, b"other words in a row of the same id"), (None, b"no id here"), (7, "é中文😀".encode())]
    out = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in rows], "doc_id long, b binary")
    out = out.withColumn("text", F.expr("cast(b as string)")).drop("b")
    return out.withColumns({c: F.lit(c) for c in CLASH}).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).select("doc_id").collect()
    ids = [r.doc_id for r in rows]
    if name == "packing":  # pieces
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, None}
    elif name == "once":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, 6, 6, None, 7], key=str)
    else:
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, 6, 6, None, 7], key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_texts_come_back_as_they_were(odd):
    whole = lambda df: sorted(((r.doc_id, r.h) for r in df.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()), key=str)
    kept = OPERATORS["keep"](odd)
    assert kept.columns == odd.columns and whole(kept) == whole(odd)
    cut = OPERATORS["redact"](odd)
    assert cut.columns == odd.columns
    got = {r.doc_id: bytes(r.b) if r.b is not None else None for r in cut.where("doc_id in (1, 2, 4, 7)").select("doc_id", F.col("text").cast("binary").alias("b")).collect()}
    assert got == {1: None, 2: b"", 4: "broken �� bytes here [secret] and more words".encode(), 7: "é中文😀".encode()}
    assert cut.where("doc_id = 5 and text like '%hunter22%'").count() == 0


def test_secret_offsets_count_broken_bytes_as_one(odd):
    [row] = OPERATORS["secret"](odd.where("doc_id = 4")).collect()
    assert row.spans.startswith("assign:21:")


def test_repeated_ids_with_other_texts_have_the_class_of_their_text(odd):
    rows = OPERATORS["near"](odd.where("doc_id = 6").unionByName(odd.where("doc_id = 6").withColumn("doc_id", F.lit(9).cast("long")))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted([(6, 2, 6), (6, 2, 6), (6, 5, 6), (9, 2, 6), (9, 2, 6), (9, 5, 6)])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, stage, tmp_path):
    work = dict(corpus_pipeline.STAGES)[stage]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.withColumn("n_chars", F.length("text"))
    out = work(spark, docs, str(tmp_path))
    if stage != "packing":
        assert out.columns == docs.columns
    assert out.count() >= 0 and work(spark, docs.limit(0), str(tmp_path)).count() == 0
