"""Threshold-scaled fingerprints against a plain version; successors; merging; containment."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from priospread.llm import scaled_sketch as S

SMALL = "/root/testdata/sf0.001"


def plain_sketch(text, scale=S.SCALE):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = {hashlib.md5(s.encode()).hexdigest()[:15] for s in shingles}
    kept = {h for h in hashes if int(h, 16) * scale < 1 << 60}
    return sorted(kept or ({min(hashes)} if hashes else ()))


def alike(a, b):
    n = min(len(a), len(b))
    return len(set(a) & set(b)) / n if n else float(len(a) == len(b))


def plain_rows(docs):
    """Distinct (id, text) in order, null ids last; ``docs`` have unique ids or equal repeats."""
    order = sorted({(i is None, i or 0, t or "") for i, t in docs})
    out = []
    for k, (null, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(plain_sketch, (text, edited, after))
        row = (None if null else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), alike(a, b), alike(a, c))
        out += [row] * sum(1 for j, t in docs if (j is None, j or 0, t or "") == order[k])
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_against_a_plain_version(spark):
    from priospread.llm.queries import op12_scaled_fingerprint

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(op12_scaled_fingerprint(spark, SMALL)) == sorted(plain_rows(docs), key=str)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    docs = [(5, "Some words of the fifth one, and more of them"), (5, "Some words of the fifth one, and more of them"), (None, "no id, but a text"), (1, None), (2, ""), (3, " \n"), (9, long), (7, "é中文😀 ab"), (8, "one two"), (10, "ONE  two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"1 as {c}" for c in ("z", "k", "h", "n", "cut", "sent", "sketch", "edited", "next", "_words", "_hashes")])
    got = S.fingerprint_documents(df)
    assert rows(got) == sorted(plain_rows(docs), key=str)
    by = {r.doc_id: r for r in got.collect()}
    assert by[8].fingerprint == by[10].fingerprint != "" and by[2].fingerprint == by[3].fingerprint == ""
    assert S.fingerprint_documents(df.limit(0)).count() == 0
    [one] = S.fingerprint_documents(df.where("doc_id = 7")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256("é中文😀 aé".encode()).hexdigest()


def test_rows_that_repeat_an_id_with_other_texts_follow_each_other(spark):
    docs = [(1, "a b c d e f g h"), (2, "x" * 8), (2, "y" * 8), (3, "z" * 8)]
    got = S.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 2").select("edited_sha256").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r[0] for r in got} in ({sha("xxxxxxyy"), sha("yyyyyyzz")}, {sha("yyyyyyxx"), sha("xxxxxxzz")})


@pytest.mark.parametrize("parts", [1, 7])
def test_successors_over_ranges(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ids = random.Random(parts).sample(range(10**6), 500)
        got = S.successors(spark.createDataFrame([(i,) for i in ids], "id long"), ["id"]).selectExpr("id", "next.id as after").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(ids)
    assert {r.id: r.after for r in got} == dict(zip(order, order[1:] + order[:1]))


def test_containment_of_unequal_texts_and_merging(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    big = [word() for _ in range(40_000)]
    texts = [("big", " ".join(big)), ("part", " ".join(big[1000:3000])), ("half", " ".join(big[5000:6000] + [word() for _ in range(1000)])), ("none", " ".join(word() for _ in range(2000)))]
    sketched = S.with_sketch(spark.createDataFrame(texts, "id string, text string"), "text", "sketch").cache()
    one = sketched.where("id = 'big'").select(F.col("sketch").alias("all"))
    got = {r.id: r.c for r in sketched.crossJoin(one).select("id", S.containment("sketch", "all").alias("c")).collect()}
    assert got["big"] == got["part"] == 1.0 and 0.4 < got["half"] < 0.6 and got["none"] < 0.02
    merged = S.merged(sketched.where("id in ('big', 'none')").withColumn("set", F.lit(1)), "sketch", ["set"])
    got = {r.id: r.contained for r in S.contained_in(sketched, "id", "sketch", merged).collect()}
    assert got["big"] == got["part"] == got["none"] == 1.0 and 0.4 < got["half"] < 0.6
    # a union of sketches is the sketch of the texts together (but for the shingles across the seam)
    whole = {int(h, 16) for t in (texts[0][1], texts[3][1]) for h in plain_sketch(t)}
    assert {r.hash for r in merged.collect()} == whole


def test_no_python_worker(spark):
    plan = S.with_sketch(spark.createDataFrame([("a",)], "text string"), "text", "s").select(S.fingerprint("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
