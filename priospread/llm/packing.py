"""Hierarchical multi-length packing of token streams.

Documents are routed by length to tiers of context size. Every tier packs whole documents into
windows of its own size; a gap of a long window is filled from shorter tiers, largest fitting
piece first, and then by cutting one more piece to fit. Windows therefore close exactly full at
a power of two. What is left when a task ends is packed into windows of falling powers of two
and at most one padded window. Step groups of equal token budget are balanced longest first.

A task packs its own rows as they stream by and holds at most one open window per tier, the
tier queues (each below ``QUEUE`` windows) and one batch; no row leaves its task, so a hot
source or a very long document moves nothing. A document longer than the largest window fills
whole windows by itself. ``sequence_id`` holds the task number above bit 40, so ids are unique
without an exchange.

Edge cases: null and empty texts have the end token only; bytes that are not UTF-8 count as
U+FFFD; repeated rows and keys are packed each; a text of any length is held whole by its task; a
piece never crosses documents, every id lies in exactly one piece, offsets have no gaps; an empty
table has no pieces; extra columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sound
from .word_bpe import WordBpe

#: Context sizes, the window that padded sequences have, the id that ends a document, the
#: smallest window made of leftovers, tokens of a step group, groups that are balanced together.
TIERS, PADDED, END_ID, LEAST_WINDOW, STEP_TOKENS, GROUPS = (256, 512, 1024, 2048), 2048, 1, 32, 65_536, 4
#: Windows' worth of tokens that a tier's queue may hold before it is drained.
QUEUE = 64

SCHEMA = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("window", T.IntegerType()), T.StructField("step_group", T.LongType()),
])


class Packer:
    """Packs pieces (length, document number, start) into windows; ``closed`` gathers them."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, padded: int = PADDED) -> None:
        self.tiers, self.padded = tiers, padded
        self.queues: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # each sorted by length
        self.held = [0] * len(tiers)
        self.closed: list[tuple[int, list[tuple[int, int, int]]]] = []

    def push(self, length: int, doc: int, start: int) -> None:
        tier = next((i for i, t in enumerate(self.tiers) if length <= t), len(self.tiers) - 1)
        insort(self.queues[tier], (length, doc, start))
        self.held[tier] += length

    def take(self, tier: int, most: int) -> tuple[int, int, int] | None:
        """The longest piece of a tier that is no longer than ``most``."""
        q = self.queues[tier]
        if not (k := bisect_right(q, (most, float("inf"), 0))):
            return None
        piece = q.pop(k - 1)
        self.held[tier] -= piece[0]
        return piece

    def cut(self, tier: int, size: int) -> tuple[int, int, int] | None:
        """``size`` tokens off the shortest longer piece of a tier; its rest is routed anew."""
        q = self.queues[tier]
        k = bisect_right(q, (size, float("inf"), 0))
        if k >= len(q):
            return None
        length, doc, start = q.pop(k)
        self.held[tier] -= length
        self.push(length - size, doc, start + size)
        return size, doc, start

    def add(self, doc: int, length: int) -> None:
        """Route a document; what exceeds the largest window fills whole windows at once."""
        start, top = 0, self.tiers[-1]
        while length - start >= top:
            self.closed.append((top, [(top, doc, start)]))
            start += top
        if length > start:
            self.push(length - start, doc, start)
        for i, t in enumerate(self.tiers):
            if self.held[i] >= QUEUE * t:
                self.drain(i, QUEUE * t // 2)

    def fill(self, tier: int, window: int) -> None:
        """Close one exactly full window, first from its tier, then from shorter and longer ones."""
        room, pieces = window, []
        order = [*range(tier, -1, -1), *range(tier + 1, len(self.tiers))]
        while room:
            piece = next((p for i in order if (p := self.take(i, room))), None) or next((p for i in order if (p := self.cut(i, room))), None)
            pieces.append(piece)
            room -= piece[0]
        self.closed.append((window, pieces))

    def drain(self, tier: int, least: int) -> None:
        while self.held[tier] > least and self.held[tier] >= self.tiers[tier]:
            self.fill(tier, self.tiers[tier])

    def finish(self) -> None:
        window = self.tiers[-1]
        while (left := sum(self.held)) >= LEAST_WINDOW:
            while window > left:
                window //= 2
            self.fill(next(i for i, t in enumerate(self.tiers) if window <= t), window)
        pieces = [p for q in self.queues for p in q]
        self.queues, self.held = [[] for _ in self.tiers], [0] * len(self.tiers)
        if pieces:
            self.closed.append((self.padded, pieces))


def balanced(windows: list[int], groups: int) -> list[int]:
    """A group for each window, longest first to the least loaded group."""
    load, of = [0] * groups, [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-windows[i], i)):
        g = min(range(groups), key=lambda g: (load[g], g))
        of[i], load[g] = g, load[g] + windows[i]
    return of


def pack_documents(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and SCHEMA: one row per piece of every document of ``docs``; no shuffle."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *SCHEMA.fields])
    names = [f.name for f in SCHEMA.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        bpe, packer = WordBpe.shared(tokenizer_file), Packer()
        streams: dict[int, tuple[object, np.ndarray]] = {}  # documents with pieces that wait
        left: dict[int, int] = {}
        n_doc = n_seq = n_group = 0
        key_type = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_seq, n_group
            while packer.closed:
                part, size = [], 0
                while size < GROUPS * STEP_TOKENS and len(part) < len(packer.closed):
                    size += packer.closed[len(part)][0]
                    part.append(packer.closed[len(part)])
                if size < GROUPS * STEP_TOKENS and not last:
                    return
                del packer.closed[: len(part)]
                n = min(GROUPS, max(1, size // STEP_TOKENS))
                out: list[tuple] = []
                for (window, pieces), g in zip(part, balanced([w for w, _ in part], n)):
                    offset = 0
                    for length, doc, start in pieces:
                        k, ids = streams[doc]
                        out.append((k, start, length, zlib.crc32(ids[start : start + length]), len(ids), task + n_seq, offset, window, task + n_group + g))
                        offset += length
                        left[doc] -= length
                        if not left[doc]:
                            del streams[doc], left[doc]
                    n_seq += 1
                n_group += n
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, t) for c, t in zip(cols[1:], [pa.int64()] * 6 + [pa.int32(), pa.int64()])]], [key, *names])

        for b in batches:
            key_type = b.schema.field("key").type
            for k, t in zip(b.column("key").to_pylist(), (x.as_py() for x in b.column("text"))):
                ids = bpe.encode(sound(t), END_ID)
                streams[n_doc], left[n_doc] = (k, ids), len(ids)
                packer.add(n_doc, len(ids))
                n_doc += 1
                if len(packer.closed) > 1024:
                    yield from flush(False)
        packer.finish()
        yield from flush(True)

    return rows.mapInArrow(run, schema)
