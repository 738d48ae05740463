"""Source divergence audit with a two-pass vocabulary automaton.

1. First pass: exact document frequencies of every (lang, term). A task adds up in a bounded table and
   sends partial sums; the terms of at least ``LEAST_DOCS`` documents of their lang are kept.
2. Second pass: kept terms, padded by delimiters, form one Aho-Corasick automaton a lang, which recounts
   their occurrences in the padded texts. Only sparse sums (lang, source, term, count) are shuffled. A
   vocabulary beyond ``SHARD_BYTES`` is dealt by hash to several shards of that size, each with a pass of
   its own, so what is broadcast and what a worker builds stays bounded.
3. A term's smoothed share p of a group depends on the group where its count is 0. Divergences of pairs
   are sums over all kept terms, but terms that neither group has add one value times their number, and
   terms of one group add by how often a count occurs in it. Postings meet only on terms of both.

Everything is in whole numbers; products beyond 64 bits are decimals.

Edge cases: null lang, source and text count as ''; groups without terms take part in pairs with the
shares of absent terms; a lang without kept terms has pairs of value 0; a group that is the only one of its
lang has none; rows that repeat an id are documents each (ids are not read); empty and very long texts
are taken whole; bytes that are not UTF-8 count as U+FFFD; an empty table has no result; equal values rank
by the item's UTF-8 bytes; further columns, of any name, are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, slices, sound

#: Documents of its lang that a kept term is in; ranks of terms; what a share is counted in.
LEAST_DOCS, TOP_TERMS, FINE = 10, 10, 1_000_000_000
#: Bytes of kept terms of one automaton pass; entries that a task holds before it sends sums.
SHARD_BYTES, HELD = 4 << 20, 500_000
# A-Z lower-cased, every other ASCII byte but letters ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: The automata of the last shard that this worker process has built, by the shard's name.
_BUILT: dict[str, dict[str, ahocorasick.Automaton]] = {}


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters and characters beyond ASCII of a UTF-8 text."""
    return text.translate(_TERMS).split()


def padded(text: bytes) -> str:
    """The text with a delimiter on either side of each term."""
    return f" {text.translate(_TERMS).decode()} "


def automata(langs: list[str], terms: list[str]) -> dict[str, ahocorasick.Automaton]:
    """An automaton of delimiter-padded terms for each lang; a term's value is its place in the lists."""
    out: dict[str, ahocorasick.Automaton] = {}
    for i, (lang, term) in enumerate(zip(langs, terms)):
        if lang not in out:
            out[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        out[lang].add_word(f" {term} ", i)
    for a in out.values():
        a.make_automaton()
    return out


def _texts(batches):
    """lang, source, and the whole texts of slices of bounded size."""
    for whole in batches:
        for lo, hi in slices(pa.compute.binary_length(whole.column("text")).to_pylist()):
            b = whole.slice(lo, hi - lo)
            yield b.column("lang").to_pylist(), b.column("source").to_pylist(), [sound(t) for t in b.column("text").to_pylist()]


def _document_frequencies(batches):
    held: dict[str, Counter] = {}

    def sums():
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([t.decode() for t in c], pa.string()), pa.array(c.values(), pa.int64())], ["lang", "term", "df"])
        held.clear()

    for langs, _, texts in _texts(batches):
        for lang, text in zip(langs, texts):
            held.setdefault(lang, Counter()).update(set(terms_of(text)))
        if sum(map(len, held.values())) > HELD:
            yield from sums()
    yield from sums()


def kept_terms(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``term`` and a number ``id`` of the kept vocabulary."""
    found = rows.mapInArrow(_document_frequencies, "lang string, term string, df long")
    return checkpoint(found.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term", F.monotonically_increasing_id().alias("id")))


def _occurrences(shared):
    def run(batches):
        name, langs, terms, ids = shared.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = automata(langs, terms)
        built, held, n = _BUILT[name], {}, 0

        def sums():
            for (lang, source), found in held.items():
                i, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array([source] * len(i), pa.string()), pa.array(ids[i]), pa.array(c)], ["lang", "source", "id", "n"])
            held.clear()

        for slice_ in _texts(batches):
            for lang, source, text in zip(*slice_):
                if lang in built:
                    found = np.fromiter((i for _, i in built[lang].iter(padded(text))), np.int64)
                    held.setdefault((lang, source), []).append(found)
                    n += len(found)
                    if n > 8 * HELD:
                        yield from sums()
                        n = 0
        yield from sums()

    return run


def sparse_postings(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``id`` and the count ``n`` > 0 of each kept term in each group."""
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 2), F.lit(0))).first()[0]
    shards, out = max(1, math.ceil(size / SHARD_BYTES)), None
    for shard in range(shards):
        part = kept.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part.column("lang").to_pylist(), part.column("term").to_pylist(), part.column("id").to_numpy()))
        found = rows.mapInArrow(_occurrences(shared), "lang string, source string, id long, n long")
        out = found if out is None else out.unionAll(found)
    return checkpoint(out.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")))


def share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(FINE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    whole = (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)") + 2
    parts = F.col(total) + 2 * F.col(terms)
    # Both are below 2^63, so the product is below 10^38 and the quotient, at most FINE, a long.
    return F.when(parts > 0, F.call_function("div", whole * FINE, parts.cast("decimal(20,0)")) + 1)


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)), in whole numbers."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """``a`` < ``b`` and the ``value`` of every pair of groups of a lang."""
    side = lambda df, x, cols: df.select(*[F.col(c).alias(f"{x}{c}") for c in cols])
    a, b = (side(posted, x, ["g", "id", "p", "p0"]) for x in "ab")
    both = a.join(b, (F.col("aid") == F.col("bid")) & (F.col("ag") < F.col("bg")))
    more = divergence("ap", "bp") - divergence("ap", "bp0") - divergence("ap0", "bp") + divergence("ap0", "bp0")
    both = both.select(F.col("ag").alias("a"), F.col("bg").alias("b"), more.alias("value"))
    counts = side(posted.groupBy("lang", "g", "p").agg(F.count("*").alias("m")), "a", ["lang", "g", "p", "m"])
    one = counts.join(side(groups, "b", ["lang", "g", "p0"]), (F.col("alang") == F.col("blang")) & (F.col("ag") != F.col("bg")))
    one = one.select(F.least("ag", "bg").alias("a"), F.greatest("ag", "bg").alias("b"), (F.col("am") * divergence("ap", "bp0")).alias("value"))
    a, b = (side(groups, x, ["lang", "g", "terms", "held", "p0"]) for x in "ab")
    none = a.join(b, (F.col("alang") == F.col("blang")) & (F.col("ag") < F.col("bg")))
    none = none.select(F.col("ag").alias("a"), F.col("bg").alias("b"), F.coalesce((F.col("aterms") - F.col("aheld") - F.col("bheld")) * divergence("ap0", "bp0"), F.lit(0)).alias("value"))
    return both.unionAll(one).unionAll(none).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: divergences between the sources
    of a lang (part ``pair``), and each source's most over-used terms (part ``term``)."""
    named = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    rows = docs.select(named(lang, "lang"), named(source, "source"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kept = kept_terms(rows, least)
    postings = sparse_postings(rows, kept)
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "terms")])
    groups = checkpoint(groups.select("*", share(F.lit(0), "total", "terms").alias("p0"), F.monotonically_increasing_id().alias("g")))
    posted = checkpoint(postings.join(groups, ["lang", "source"]).select("lang", "g", "id", "n", share("n", "total", "terms").alias("p"), "p0"))

    pairs = _pairs(groups, posted)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("other")), F.struct(F.col("b").alias("g"), F.col("a").alias("other")))).alias("w"), "value").select("w.*", "value")
    other = groups.select(F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = ways.join(other, "other").select("g", "item", "value")

    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    used = posted.groupBy("lang", "id").agg(F.sum("n").alias("n")).join(langs, "lang").select("id", share("n", "total", "terms").alias("q"))
    over = posted.join(used, "id").where("p > q").select("g", "id", divergence("p", "q").alias("value"))
    over = over.join(kept.select("id", F.col("term").alias("item")), "id").select("g", "item", "value")

    order = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("g", F.lit("pair").alias("part"), "item", "value", order.alias("rank"))
    over = over.withColumn("rank", order).where(F.col("rank") <= top).select("g", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionAll(over).join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")
