"""Threshold-scaled document fingerprints, in DataFrame operations only.

A sketch holds every hash of a text's distinct shingles that lies below a fixed fraction, 1 / ``SCALE``,
of the range of hashes. Whatever two texts share, their sketches share in the same fraction, so sketches
merge by union and estimate how much of one text is contained in a text (or a collection) of quite
another size. A text none of whose hashes lies below keeps its least one, so only blank texts have an
empty sketch. A hash is the number in the first 15 hex digits of the shingle's MD5.

A document's successor in id order is found without a window over the table: narrow rows (id, text hash,
length) are dealt into ranges, each takes the next row of its range, and the last of a range the first of
the range after it. Texts are shuffled once, by id, with their sketches; successors send the prefix that
their predecessor needs, and their sketch. A sketch knows where its hashes stand, so an edited text takes
over those of the words that stay and hashes only the words from the seam on.

Edge cases: null texts count as empty; empty and blank texts have the empty sketch, alike to another
empty one (1.0) and to nothing else (0.0); with fewer than five words the whole sequence is the one
shingle; rows that repeat an id and a text are one place in the order and have equal results; rows that
repeat an id with other texts follow each other by text hash; null ids come last; a single document is its own successor;
very long texts are taken whole, a row each; an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Words of a shingle; a sketch holds one in SCALE hashes; an edit replaces the last 1 / EDIT of a text.
WORDS, SCALE, EDIT = 5, 8, 4
# What is lower-cased, what parts words.
UPPER, LOWER, SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\\x20\\x09-\\x0D"
DIGITS = 15
#: The place of a hash that no edit keeps.
NOWHERE = 2**31 - 1


def below(scale: int = SCALE) -> str:
    """The least hash that is not retained, as hex digits."""
    return f"{-(-(1 << 4 * DIGITS) // scale):0{DIGITS}x}" if scale > 1 else "g"


def _words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), f"[{SPACE}]+"), lambda w: w != "")


def _hashes(found: str, words: int) -> Column:
    """The MD5 of each shingle of the array ``found``, as hex digits."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - words + 1, F.lit(1)))
    digits = F.transform(starts, lambda i: F.md5(F.array_join(F.slice(F.col(found), i, words), " ").cast("binary")))
    return F.when(F.size(found) > 0, digits).otherwise(F.array().cast("array<string>"))


def _number(digits: Column) -> Column:
    return F.conv(F.substring(digits, 1, DIGITS), 16, 10).cast("long")


def with_sketch(df: DataFrame, text: str, name: str, at: str | None = None, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``df`` and the sorted array ``name`` of the hashes that the sketch of ``text`` retains.

    ``at`` adds the number of the shingle where each first stands.
    """
    found, hashes, held = (fresh(df, f"_{x}") for x in ("words", "hashes", "held"))
    out = df.withColumn(found, _words(F.coalesce(F.col(text), F.lit("")))).withColumn(hashes, _hashes(found, words))
    low = F.transform(hashes, lambda h, i: F.when(h < below(scale), F.struct(_number(h).alias("h"), (i + 1).alias("at"))))
    out = out.withColumn(held, F.array_sort(F.filter(low, lambda x: x.isNotNull())))
    out = out.withColumn(held, F.filter(held, lambda x, i: (i == 0) | (x["h"] != F.get(held, i - 1)["h"])))
    some = (F.size(held) > 0) | (F.size(hashes) == 0)
    out = out.withColumn(name, F.when(some, F.transform(held, lambda x: x["h"])).otherwise(F.array(_number(F.array_min(hashes)))))
    if at:
        out = out.withColumn(at, F.when(some, F.transform(held, lambda x: x["at"])).otherwise(F.array(F.lit(NOWHERE))))
    return out.drop(found, hashes, held)


def _with_edited_sketch(df: DataFrame, words: int, scale: int) -> DataFrame:
    """``edited_sketch`` of ``edited`` from ``sketch`` and ``at`` of the text, whose first ``stay`` words stay
    as they are but for the last one, which may have grown."""
    from_ = F.greatest(F.col("stay") - words + 1, F.lit(1))
    out = df.withColumn("_all", _words(F.col("edited"))).withColumn("_tail", F.slice("_all", from_, F.greatest(F.size("_all"), F.lit(1))))
    fresh_ = F.transform(F.filter(_hashes("_tail", words), lambda h: h < below(scale)), _number)
    kept = F.filter("sketch", lambda h, i: F.get("at", i) <= F.col("stay") - words)
    out = out.withColumn("_kept", F.array_sort(F.array_distinct(F.concat(kept, fresh_))))
    some = (F.size("_kept") > 0) | (F.size("_all") == 0)
    return out.withColumn("edited_sketch", F.when(some, F.col("_kept")).otherwise(F.array(_number(F.array_min(_hashes("_all", words)))))).drop("_all", "_tail", "_kept")


def fingerprint(sketch: str) -> Column:
    """The retained hashes as hex digits, rising."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), ",")


def containment(a: str, b: str) -> Column:
    """The share of the smaller sketch that the other one holds."""
    size = F.least(F.size(a), F.size(b))
    return F.when(size > 0, F.size(F.array_intersect(F.col(a), F.col(b))) / size).otherwise((F.size(a) == F.size(b)).cast("double"))


def merged(sketches: DataFrame, sketch: str, by: Sequence[str]) -> DataFrame:
    """One row (``by``, ``hash``) for each hash of a group's union; unions of unions are unions."""
    return sketches.select(*by, F.explode(sketch).alias("hash")).distinct()


def contained_in(sketches: DataFrame, key: str, sketch: str, union: DataFrame) -> DataFrame:
    """``key`` and ``contained``, the share of each document's sketch in the union ``union(hash)``."""
    rows = sketches.select(key, F.size(sketch).alias("_n"), F.explode(sketch).alias("hash"))
    held = rows.join(union.select("hash").distinct(), "hash", "left_semi").groupBy(key).agg(F.count("*").alias("_held"))
    out = sketches.select(key, F.size(sketch).alias("_n")).join(held, key, "left")
    return out.select(key, F.when(F.col("_n") > 0, F.coalesce("_held", F.lit(0)) / F.col("_n")).alias("contained"))


def successors(ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """``ids`` and the struct ``next`` of the key after each one's, the first one's after the last."""
    one = F.struct(*key)
    dealt = checkpoint(ids.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()))
    inside = dealt.withColumn("_next", F.lead(one).over(Window.partitionBy("_range").orderBy(*key)))
    firsts = dealt.groupBy("_range").agg(F.min(one).alias("_first"))  # a row a range
    after = Window.orderBy("_range")
    whole = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_range", F.coalesce(F.lead("_first").over(after), F.first("_first").over(whole)).alias("_after"))
    return inside.join(firsts, "_range").select(*ids.columns, F.coalesce("_next", "_after").alias("next"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to its successor's."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).isNull().alias("z"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    place = ["z", "k", "h"]
    ids = rows.select(*place, F.length("text").alias("n")).groupBy(*place).agg(F.max("n").alias("n"))
    order = checkpoint(successors(checkpoint(ids), place))
    texts = with_sketch(rows, "text", "sketch", "at", words, scale).repartition(*place)
    wants = order.select(*[F.col(f"next.{c}").alias(c) for c in place], *[F.col(c).alias(f"to_{c}") for c in place], F.floor(F.col("n") / EDIT).cast("int").alias("cut"))
    # Both joins read the same columns of the texts, so one shuffle of them serves both.
    cut = F.when(F.size("at") >= 0, F.col("cut")).alias("cut")
    sent = texts.join(wants, place).select(*[F.col(f"to_{c}").alias(c) for c in place], F.struct(cut, F.expr("substring(text, 1, cut)").alias("prefix"), F.col("sketch").alias("next_sketch")).alias("sent"))
    sent = sent.groupBy(*place).agg(F.first("sent").alias("sent"))  # successors that repeat send the same
    own = F.expr("substring(text, 1, length(text) - sent.cut)")
    out = texts.join(sent, place).select(
        "z", "k", F.length("text").cast("long").alias("n_chars"), "sketch", "at", F.col("sent.next_sketch").alias("next_sketch"),
        F.concat(own, F.col("sent.prefix")).alias("edited"), F.size(_words(own)).alias("stay"),
    )
    out = _with_edited_sketch(out, words, scale)
    return out.select(
        F.when(~F.col("z"), F.col("k")).alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        containment("sketch", "edited_sketch").alias("near_edited"), containment("sketch", "next_sketch").alias("near_next"),
    )
