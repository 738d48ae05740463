import zlib

import numpy as np

from priospread.llm import chat_format as C
from priospread.llm import quality_gam as Q
from priospread.llm import url_filter as U


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    base = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(7)]
    rows = [(1, *x) for x in base[:3]] + [(2, *x) for x in base[:5]] + [(3, *x) for x in base] + [(4, *x) for x in base]
    rows += [(5, 0, "user", "turn 0"), (6, 0, "user", "other"), (7, 0, None, None), (8, None, "user", "x"), (None, 0, "user", "lost"), (9, 0, "user", "turn 0"), (9, 1, "assistant", "else")]
    rows += [(10, 0, "user", "b"), (10, 0, "user", "a"), (11, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, n int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in C.format_chats(df).collect()}
    assert set(got) == {3, 6, 7, 8, 9, 10, 11}
    assert got[3][:2] == (7, 2) and got[3][2] == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in base)
    assert got[7][2] == "<||>\n<|end|>\n"
    assert C.format_chats(df.limit(0)).count() == 0


def test_long_conversation_spans_blocks(spark):
    turns = [(t, "user", f"t{t}") for t in range(500)]
    rows = [(1, *x) for x in turns] + [(2, *x) for x in turns[:301]] + [(3, *x) for x in turns[:64]] + [(4, *x) for x in turns[1:]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {r.conv for r in C.maximal_conversations(df).collect()} == {1, 4}


def judge(spark, urls, html=None, **how):
    df = spark.createDataFrame([(i, u, html, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    return {urls[r.page_id]: r for r in U.filter_urls(df, **how).collect()}


def test_rules(spark):
    got = judge(spark, [
        None, "", "no scheme", "http://", "HTTP://A.Com/en/x", "http://a.com/en", "http://notcom/en/", "http://x.example.com/en/7?q", "http://x.example.com/en/6#a",
        "http://example.net/de/8", "http://example.net/de/9", "http://É.org/es/?x", "http://a.com/EN/", "ftp://u@a.com:80/en/", "http://a.com/x\n/en/", "a://b.com?x/en/",
    ])
    rule = {u: (r.host, r.path, r.rule) for u, r in got.items()}
    assert rule[None] == rule[""] == rule["no scheme"] == rule["http://"] == ("", "", None)
    assert rule["HTTP://A.Com/en/x"] == ("a.com", "/en/x", "com/en/")
    assert rule["http://a.com/en"] == ("a.com", "/en", None)
    assert rule["http://notcom/en/"] == ("notcom", "/en/", None)
    assert rule["http://x.example.com/en/7?q"] == ("x.example.com", "/en/7", "example.com/en/7")
    assert rule["http://x.example.com/en/6#a"] == ("x.example.com", "/en/6", "com/en/")
    assert rule["http://example.net/de/8"][2] == "example.net/de/8" and rule["http://example.net/de/9"][2] == "net/de/"
    assert rule["http://É.org/es/?x"] == ("É.org", "/es/", "org/es/")
    assert rule["ftp://u@a.com:80/en/"][:2] == ("u@a.com:80", "/en/")
    assert rule["a://b.com?x/en/"] == ("b.com", "", None)
    assert got["http://x.example.com/en/7?q"].verdict == "allow" and got["HTTP://A.Com/en/x"].verdict == "block"


def test_distrust_spreads_against_links(spark):
    rules = (("block", "bad.test", "/x"), ("allow", "good.test", "/y"))
    df = spark.createDataFrame([
        (1, "http://bad.test/x", None), (2, "http://good.test/y", '<a href="http://friend.test/">'),
        (3, "http://farm.test/", '<a href="http://bad.test/">' * 3), (4, "http://friend.test/", ""), (5, "http://alone.test/", ""),
    ], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in U.filter_urls(df, rules).collect()}
    assert got == {"bad.test": "block", "good.test": "allow", "farm.test": "block", "friend.test": "allow", "alone.test": "allow"}
    assert U.filter_urls(df.limit(0), rules).count() == 0


def test_chains_of_any_length_are_followed(spark):
    """Distrust against a chain of 40 links, and trust along one, reach its end; longer runs change nothing."""
    link = lambda a, b: f'<a href="http://{a}{b}.test/">'
    rows = [(0, "http://f0.test/x", ""), (1, "http://g0.test/y", link("g", 1))]
    rows += [(10 + i, f"http://f{i}.test/", link("f", i - 1)) for i in range(1, 41)] + [(100 + i, f"http://g{i}.test/", link("g", i + 1)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.verdict, r.distrust_share) for r in U.filter_urls(df, (("block", "f0.test", "/x"), ("allow", "g0.test", "/y"))).collect()}
    assert all(got[f"f{i}.test"] == ("block", 100) for i in range(1, 41)) and all(got[f"g{i}.test"] == ("allow", 0) for i in range(1, 40))


def test_no_verdict_changes_with_twice_the_rounds():
    import duckdb

    from priospread.llm.oracles import RESTED, url_sql

    con = duckdb.connect()
    con.execute("create view pages as from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    assert sorted(con.execute(url_sql()).fetchall()) == sorted(con.execute(url_sql(turns=2 * RESTED)).fetchall())


def test_hub_passes_on_to_single_links(spark):
    """A blocked host with over a million links to it still spreads distrust to a host that links once."""
    edges = spark.createDataFrame([("farm.test", "bad.test", 3_000_000), ("once.test", "bad.test", 1), ("once.test", "good.test", 1)], "src string, dst string, w long")
    seeds = spark.createDataFrame([("distrust", "bad.test", 1), ("trust", "far.test", 1)], "kind string, host string, weight long")
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(edges, seeds).collect()}
    assert got["once.test"][0] == 0 and got["once.test"][1] > 0
    assert abs(got["farm.test"][1] / got["once.test"][1] / 3_000_000 - 1) < 1e-4


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train_quality(docs, labels.where(~Q.held_out()))
    scored = Q.score_quality(docs, model)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    rows = scored.join(labels, "doc_id").where(Q.held_out()).collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_held_out_rule(spark):
    got = spark.range(40).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert set(model.pairs[0]) == {0, 1}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 100_000, 3), (4, " \n", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    model = Q.train_quality(docs, labels)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    kept = Q.keep_quality(docs, labels.limit(0))
    assert kept.columns == docs.columns and Q.score_quality(docs.limit(0), model).count() == 0
    assert Q.keep_quality(docs, labels.limit(0), threshold=0.0).where("text is null").count() == 1


def test_pipeline_matches_its_stages(spark):
    import corpus_pipeline as pipeline

    from priospread.llm.minhash_near_dup import near_duplicates
    from priospread.llm.secret_scan import scan_secrets

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = pipeline.quality(spark, docs, sf).cache()
    model = Q.train_quality(docs, labels.where(~Q.held_out()))
    want = {r.doc_id for r in Q.score_quality(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    once = pipeline.near_dedup(spark, good, sf).cache()
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in near_duplicates(good).where("kept").collect()}
    clean = pipeline.secrets(spark, once, sf).cache()
    assert clean.schema.names == docs.schema.names and clean.count() == once.count()
    assert scan_secrets(clean).where("n_access + n_hex > 0").count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    pieces = pipeline.packing(spark, clean, sf)
    assert pieces.select("doc_id").distinct().count() == clean.count()
    assert pipeline.run(spark, sf).select("doc_id").distinct().count() == clean.count()


def test_links_of_odd_pages_are_those_of_the_sql(spark):
    """A vertical tab is no white space there, and a long s is a letter of a scheme."""
    import duckdb

    from priospread.llm.oracles import url_sql

    html = ['<a href=\v"http://v.org/es/">', '<a href=\t"http://t.org/es/">', '<a href="http\u017f://s.org/es/">', '<a href="http://w.org\v/es/">']
    rows = [(i, f"http://h{i}.test/", h) for i, h in enumerate(html)] + [(9 + i, f"http://{c}.org/es/", None) for i, c in enumerate("vtsw")]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    got = sorted(tuple(r) for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted(con.execute(url_sql()).fetchall()) and [r[4] for r in got[:4]] == ["allow", "block", "block", "allow"]
