"""Odd rows of the tables of vectors, pages and conversations: nulls, repeats, ties, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

from priospread.llm import chat_format, pivot_near_dup, topk_search, url_filter

NAMES = ("id", "g", "at", "v", "asks", "class", "pair", "side", "own", "to", "host", "path", "by", "conv", "h1", "h2", "block", "n", "mass", "kind", "src", "dst", "w", "rank", "score")


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in NAMES if c not in df.columns})


@pytest.fixture(scope="module")
def vectors(spark):
    near, far, big = [1.0, 0.0, 0.0, 0.01], [0.0, 1.0, 0.0, 0.0], [3.0, 0.0, 0.0, 0.0]
    rows = [
        (1, "a", near), (2, "a", big), (3, "a", far), (4, "b", near), (5, None, near), (6, "a", None), (7, "a", [0.0] * 4), (8, "a", [1.0, None, 0.0, 0.0]),
        (9, "a", [float("nan"), 0.0, 0.0, 0.0]), (10, "a", [float("inf"), 0.0, 0.0, 0.0]), (11, "a", [1.0, 0.0]), (12, "a", []), (13, "a", far), (13, "a", far), (None, "a", near), (100, "a", near),
    ]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")


def test_vectors_of_all_kinds(vectors):
    rows = pivot_near_dup.embedding_near_duplicates(with_clashes(vectors)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert len(rows) == 16 and sorted(got[1] + got[2] + got[100]) == [(2, 1)] * 3  # copies and near ones of a label
    assert got[3] == [(2, 3)] and got[13] == [(2, 3), (2, 3)]  # a repeated id counts as vectors each
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[i] == [(0, i)], i
    assert got[None] == [(0, None)] and pivot_near_dup.embedding_near_duplicates(vectors.limit(0)).count() == 0


def test_searches_of_all_kinds(vectors):
    got = topk_search.top_inner_products(with_clashes(vectors), F.col("vec_id") % 100 == 0, top=4).collect()
    assert {r.query_id for r in got} == {100}
    best = [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])]
    one = 1024 * 1024
    # 2 is longest; 1 and 4 and 5 tie, to the smaller id; the query's own id, nulls and what is not finite take no part
    assert best == [(1, 2, 3 * one), (2, 1, one + 100), (3, 4, one + 100), (4, 5, one + 100)]
    assert topk_search.top_inner_products(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pages_of_all_kinds(spark):
    rules = (("block", "bad.test", "/x"), ("allow", "good.test", "/y"))
    long = "http://" + "a" * 70_000 + ".test/" + "p" * 200_000
    rows = [
        (1, "http://BAD.test/x1?q#f", '<a href="http://good.test/y">'), (1, "http://BAD.test/x1?q#f", '<a href="http://good.test/y">'), (None, "https://sub.good.test/y", None), (2, None, "<a>"),
        (3, "no scheme", ""), (4, "http://", ""), (5, "ftp://é.test/ü?x", '<a href="http://[bad">'), (6, long, '<a href="' + long + '">'), (7, "a://b://c", ""),
    ]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {}
    for r in url_filter.filter_urls(df, rules).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("bad.test", "/x1", "bad.test/x", "block")] * 2 and got[None] == [("sub.good.test", "/y", "good.test/y", "allow")]
    assert got[2] == got[3] == [("", "", None, "allow")] and got[4] == [("", "", None, "allow")] and got[5][0][:2] == ("é.test", "/ü")
    assert len(got[6][0][1]) == 200_001 and got[7] == [("b:", "//c", None, "allow")]
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, ()).collect()} == {"allow"}  # no rules, no seeds


def test_conversations_of_all_kinds(spark):
    turns = [("user", "hi"), ("bot", "hello"), (None, None), ("user", "é" * 300_000)]
    rows = [(c, k, *t) for c, n in (("whole", 4), ("copy", 4), ("part", 2), ("less", 1)) for k, t in enumerate(turns[:n])]
    rows += [(None, 0, "user", "hi"), ("odd", None, "user", "x"), ("odd", None, "user", "x"), ("tied", 0, "b", "2"), ("tied", 0, "a", "1")]
    df = with_clashes(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert set(got) == {"copy", "odd", "tied"} and got["copy"].n_copies == 2 and got["copy"].n_turns == 4
    o, m, c = chat_format.OPEN, chat_format.MIDDLE, chat_format.CLOSE
    assert got["copy"].rendered == "".join(f"{o}{r or ''}{m}{t or ''}{c}" for r, t in turns)
    assert got["tied"].rendered == f"{o}a{m}1{c}{o}b{m}2{c}" and got["odd"].n_turns == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0
