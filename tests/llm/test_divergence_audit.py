"""The divergence audit against a dense plain version; shards; shares beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from priospread.llm import divergence_audit as A

SMALL = "/root/testdata/sf0.001"
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(docs, least=10):
    count, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang].add(source)
        count[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c, total: {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: share(count[lang, s], total[s]) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        q = share(whole, sum(total.values()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            rows = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode())), 1)]
            rows = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:10], 1)]
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_a_dense_version(spark):
    from priospread.llm.queries import op13_divergence_audit

    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(op13_divergence_audit(spark, SMALL)) == sorted(plain_audit(docs))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    docs = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "é"]), " ".join(f"W{chr(97 + min(25, int(rng.paretovariate(0.6))))}" for _ in range(rng.randrange(30)))) for _ in range(200)]
    docs += [("en", "empty", None), ("en", "empty", ""), ("en", "empty", "1234 ,;"), ("xx", "alone", "wa wb"), ("yy", "one", "wa"), ("yy", "two", "wb wb")]
    return docs + [("en", "a", "wa-wb " * 300_000), ("de", "b", "Éé中文 wa1wb\x00wc")]


@pytest.mark.parametrize("shard", [A.SHARD_BYTES, 12])
def test_odd_rows_and_shards(spark, odd, shard, monkeypatch):
    monkeypatch.setattr(A, "SHARD_BYTES", shard)
    df = spark.createDataFrame(odd, "lang string, source string, text string").selectExpr("*", *[f"1 as {c}" for c in ("term", "id", "g", "p", "part", "item", "value", "rank", "n", "df")])
    got = A.audit_sources(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and rows(got) == sorted(plain_audit(odd))


def test_empty_tables_and_vocabularies(spark, odd):
    df = spark.createDataFrame(odd, "lang string, source string, text string")
    assert A.audit_sources(df.limit(0)).count() == 0
    got = rows(A.audit_sources(df, least=10_000))
    assert got == sorted(plain_audit(odd, 10_000)) and {r[4] for r in got} == {0}


def test_automata_find_whole_terms_side_by_side():
    built = A.automata(["en", "en", "de"], ["a", "ab", "a"])
    assert [i for _, i in built["en"].iter(A.padded(b"A,ab a  abc ba\na"))] == [0, 1, 0, 0]
    assert [i for _, i in built["de"].iter(A.padded(b"ab a"))] == [2]


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (9_000_000_000, 9_000_000_001, 7), (4 * 10**18, 4 * 10**18 + 5, 10**9), (123_456_789_012_345, 3 * 10**17, 999)]
    df = spark.createDataFrame([(n, t, v) for n, t, v in cases], "n long, t long, v long")
    assert [r.p for r in df.select(A.share("n", "t", "v").alias("p")).collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    none = df.withColumns({"t": F.lit(0), "v": F.lit(0)})
    assert none.select(A.share("n", "t", "v").alias("p")).first().p is None
