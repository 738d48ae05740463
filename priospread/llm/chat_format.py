"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logged conversation is often a snapshot that a later log carries on. Each turn gets a hash of
(turn number, role, text); the rolling prefix hash at a turn is the sum of the hashes up to it,
in two 40-bit halves beside the count of turns. A conversation whose total equals a proper
prefix of another is dropped by an anti-join; equal conversations collapse to the smallest id;
maximal conversations are rendered.

Sums need no order, so totals are pre-aggregated before the shuffle, and prefix sums run in
two levels (blocks of ``BLOCK`` turns, then turns in a block): a conversation that holds a third
of all rows is spread over its blocks. Only its rendered text has to meet in one row.

Edge cases: null roles and texts count as empty; a null turn number sorts first (as -1); rows
that repeat a turn number are one step of the conversation, ordered by role and text; rows with
a null conversation id belong to none and are left out; one-turn conversations stay if maximal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a block of the two-level prefix sums.
BLOCK = 64
# What surrounds a turn in the rendered text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    half = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "turn", "role", "text"), 24)
    return rows.select("conv", "turn", "role", "text", half(1).alias("h1"), half(2).alias("h2"), F.floor(F.col("turn") / BLOCK).alias("block"))


def maximal_conversations(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``n_turns`` and ``n_copies`` of the conversations that no longer one begins with."""
    turns = _turns(conversations, key, turn, role, text)
    sums = [F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")]
    blocks = turns.groupBy("conv", "block").agg(*sums)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    based = blocks.select("conv", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("n", "h1", "h2")], F.sum("n").over(whole).alias("n_all"))
    totals = blocks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    alone = totals.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    upto = Window.partitionBy("conv", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = turns.select("conv", "block", "turn", *[x.over(upto).alias(c) for x, c in ((F.count("*"), "n"), (F.sum("h1"), "h1"), (F.sum("h2"), "h2"))])
    prefixes = running.join(based, ["conv", "block"]).select("n_all", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in ("n", "h1", "h2")])
    begun = prefixes.where("n < n_all").groupBy("n", "h1", "h2").agg(F.lit(1).alias("begun"))
    return alone.join(begun, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, ``n_turns``, ``n_copies`` and the ``rendered`` text of every maximal conversation."""
    kept = maximal_conversations(conversations, key, turn, role, text)
    turns = _turns(conversations, key, turn, role, text).select("conv", "turn", "role", "text").join(kept, "conv")
    one = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE))
    spoken = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = turns.groupBy("conv", "n_turns", "n_copies").agg(F.array_join(F.transform(spoken, one), "").alias("rendered"))
    return out.select(F.col("conv").alias(key), "n_turns", "n_copies", "rendered")
