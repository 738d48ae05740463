"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct shingles (64-bit hashes of five words); texts with equal
   sets are one class, whose smallest key represents it.
2. Representatives get a MinHash signature and ``BANDS`` band keys of ``ROWS`` values each.
3. Rows that share a band key are candidates. A bucket is not expanded into all pairs. First its
   members are compared with one of them, the hub, and links merge components. Buckets of three
   and more that still hold several components are compared in blocks of ``BLOCK`` members: a
   task holds two blocks of signatures and prunes their pairs in memory. It returns the members
   that have an unpruned partner in another component, each with its best one; the best pairs are
   verified and merge components. Where waiting members of a bucket are then still in several
   components, they meet once more, with their full shingle sets, and a task returns the links
   that join components. A pair counts in the first bucket it shares; pairs inside a component
   need no comparison, and no list of all pairs is ever written.
4. A candidate's signatures are compared in batches of ``BATCH`` values. With a uniform prior the
   posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1); a pair is pruned
   once the posterior probability of reaching the threshold is below ``MISS``. Survivors are
   verified on the full shingle sets, which are built again for these documents only.

At the threshold 0.75 a pair shares no band with probability (1 - 0.75^4)^32 = 5e-6. Two distinct
shingles share a 64-bit hash with probability 5e-20.

Edge cases: null, empty and blank texts have an empty set and link with nothing; with fewer than
five words the whole sequence is the one shingle; bytes that are not UTF-8 count as U+FFFD; rows
that repeat a key count as one document, linked with what any of their texts is near to; a null
key counts as no row of its class, whose component it gets, and is null without one; very long
texts are taken whole; an empty table has no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, mix64, restrict
from .components import connected_components

WORDS, THRESHOLD_PERCENT = 5, 75
BANDS, ROWS, BATCH, MISS, SEED = 32, 4, 16, 1e-4, 20_011
#: Members of a block of a bucket.
BLOCK = 1024
#: Word hashes that a task keeps.
CACHE_WORDS = 250_000
#: Pairs of a block pair that are compared at once.
PAIRS = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, words: int = WORDS, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole UTF-8 text."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.array([hashes[w] for w in found], np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` 32-bit MinHash values of a non-empty set of hashes."""
    with np.errstate(over="ignore"):
        factors = mix64(np.arange(SEED, SEED + size, dtype=np.uint64)) | np.uint64(1)
        low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 2048):
            np.minimum(low, (factors[:, None] * s[None, i : i + 2048]).min(1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def band_keys(sig: np.ndarray, bands: int = BANDS) -> list[int]:
    """A signed 64-bit key per band; the band's number is part of it."""
    keys = np.arange(bands, dtype=np.uint64)
    for column in sig.reshape(bands, -1).T:
        keys = mix64(keys ^ column.astype(np.uint64))
    return keys.view(np.int64).tolist()


def _band_rows(batches):
    for x in batches:
        if x.num_rows:
            keys = [band_keys(s) for s in _blocks(x.column("sig"))]
            ids = pa.array(np.repeat(np.arange(x.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array([k for row in keys for k in row], pa.int64()), x.column("id").take(ids)], ["key", "id"])


def least_matches(threshold: float = THRESHOLD_PERCENT / 100, batch: int = BATCH, size: int = BANDS * ROWS, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches is pruned.

    P(S >= t) for S ~ Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature blocks pass every batch; pruned rows are not compared on."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, m in least_matches():
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(1)
        alive, matches, at = alive[matches >= m], matches[matches >= m], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _blocks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _ids(pairs: DataFrame) -> DataFrame:
    return checkpoint(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())


def _prune(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that sequential verification leaves."""
    signatures = restrict(signatures, _ids(pairs), "id")
    with_a = pairs.join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    rows = with_a.join(signatures.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for x in batches:
            if x.num_rows:
                good = pa.array(survivors(_blocks(x.column("sig_a")), _blocks(x.column("sig_b"))))
                yield x.select(["a", "b"]).filter(good)

    return rows.mapInArrow(run, rows.select("a", "b").schema)


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
        return False
    both = np.sort(np.concatenate([u, v]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(u) + len(v) - same)


def _unpruned(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of a bucket's block pair whose components differ and that survive, and matches."""
    component, block, sig = t.column("component").to_numpy(), t.column("block").to_numpy(), _blocks(t.column("sig"))
    within, n_rows, out = t.column("lo")[0] == t.column("hi")[0], len(component), []
    for top in range(0, n_rows, step := max(1, PAIRS // max(1, n_rows))):
        rows = slice(top, top + step)
        differs = component[rows, None] != component[None, :]
        if not within:
            differs &= block[rows, None] != block[None, :]
        i, j = np.nonzero(np.triu(differs, top + 1))
        i, matches, at = i + top, np.zeros(len(i), np.int16), 0
        for n, m in least_matches():
            matches = matches + (sig[i, at:n] == sig[j, at:n]).sum(1, dtype=np.int16)
            good = matches >= m
            i, j, matches, at = i[good], j[good], matches[good], n
        out.append((i, j, matches))
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_shared(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unpruned pairs that share no earlier band than this bucket's: each pair has one bucket."""
    i, j, matches = _unpruned(t)
    if not len(i):
        return i, j, matches
    sig = _blocks(t.column("sig"))
    key = t.column("key")[0].as_py()  # a repeated id brings the signatures of its other texts too
    band = next(k.index(key) for k in map(band_keys, sig) if key in k)
    part = slice(0, band * ROWS)
    alone = ~(sig[i, part] == sig[j, part]).reshape(len(i), band, ROWS).all(2).any(1)
    return i[alone], j[alone], matches[alone]


def _waiting(t: pa.Table) -> pa.RecordBatch:
    """(key, id, mate): members that have an unpruned partner, and the one of most matches."""
    ids = t.column("id").to_numpy()
    i, j, matches = _first_shared(t)
    ends, mates, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([matches, matches])
    order = np.lexsort((ids[mates], -score, ends))
    first = order[np.flatnonzero(np.diff(ends[order], prepend=-1))]
    return pa.RecordBatch.from_arrays([t.column("key").take(pa.array(ends[first])).combine_chunks(), pa.array(ids[ends[first]]), pa.array(ids[mates[first]])], ["key", "id", "mate"])


def _joining(t: pa.Table, percent: int) -> pa.RecordBatch:
    """(a, b): links on the full sets that join components, likeliest pairs first."""
    ids, component = t.column("id").to_numpy(), t.column("component").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("s").to_pylist()]
    i, j, matches = _first_shared(t)
    of: dict = {}

    def root(x):
        while (y := of.get(x, x)) != x:
            x = y
        return x

    out = []
    for k in np.argsort(-matches, kind="stable"):
        x, y = int(i[k]), int(j[k])
        rx, ry = root(component[x]), root(component[y])
        if rx != ry and _linked(sets[x], sets[y], percent):
            of[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    x, y = np.array(out, int).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])


def _blocked(at: DataFrame, wide: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over the block pairs of the mixed buckets of ``at(key, id, component)``.

    Each row goes to the tasks of its block with every block of its bucket; a task streams sorted
    buckets and holds one block pair at a time. Rows are dealt while they are narrow; the columns
    of ``wide`` (a row per id) join last, so signatures and sets are shuffled once.
    """
    sizes = at.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    dealt = at.join(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "id", "component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    dealt = dealt.join(wide, "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def run(batches):
        held = None  # the last, perhaps unfinished, block pair
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x])
            t = t if held is None else pa.concat_tables([held, t])
            name = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            at = 0
            for end in (np.flatnonzero(np.any([c[1:] != c[:-1] for c in name], axis=0)) + 1).tolist():
                yield work(t.slice(at, end - at).combine_chunks())
                at = end
            held = t.slice(at)
        if held is not None:
            yield work(held.combine_chunks())

    return dealt.mapInArrow(run, schema).distinct()


def _mixed(members: DataFrame, state: DataFrame | None, least: int) -> DataFrame:
    """key, id, component of the buckets of ``least`` and more that hold several components."""
    at = members.withColumn("component", F.col("id"))
    if state is not None:
        at = members.join(state, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = at.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where(f"n >= {least} and lo <> hi")
    return checkpoint(at.join(mixed.select("key"), "key"))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id`` and the sorted shingle hashes ``s`` of the wanted documents."""

    def worker():
        hashes = _WordHashes()
        return lambda texts: [[shingles(t, words, hashes).tobytes() for t in texts]]

    made = map_texts(restrict(docs, ids, "id"), ["id"], "text", worker, pa.schema([("s", pa.binary())]))
    return made.groupBy("id").agg(F.first("s").alias("s"))


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    sets = _sets(docs, _ids(pairs), words)
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").select("a", "b", "s_a", "s_b")

    def run(batches):
        for x in batches:
            if x.num_rows:
                good = [_linked(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), percent) for u, v in zip(x.column("s_a").to_pylist(), x.column("s_b").to_pylist())]
                yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, rows.select("a", "b").schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def signer():
        hashes = _WordHashes()

        def signed(texts):
            found = [shingles(t, words, hashes) for t in texts]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            return [len(s) for s in found], digest, [signature(s).tobytes() if len(s) else None for s in found]

        return signed

    fields = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
    rows = checkpoint(map_texts(docs, ["id"], "text", signer, fields))
    classes = checkpoint(rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    # One row per id: a repeated id with unequal texts is in several classes; all of them count.
    signatures = classes.select("id", "sig")
    banded = signatures.mapInArrow(_band_rows, "key long, id " + rows.schema["id"].dataType.simpleString())
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = checkpoint(banded.join(shared, "key"))
    kind = rows.schema["id"].dataType.simpleString()
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"))
    near = checkpoint(members.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    near = checkpoint(_prune(near, signatures))
    links = checkpoint(_verify(near, docs, words, percent))
    state = None if links.isEmpty() else connected_components(links)
    at = _mixed(members, state, 3)  # buckets of two were decided by their hub
    wanted = lambda rows: checkpoint(rows.select("id").distinct())
    waiting = checkpoint(_blocked(at, restrict(signatures, wanted(at), "id"), _waiting, f"key long, id {kind}, mate {kind}"))
    if not waiting.isEmpty():
        best = waiting.select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")).distinct()
        links = links.unionAll(checkpoint(_verify(checkpoint(best.join(near, ["a", "b"], "left_anti")), docs, words, percent)))
        state = None if links.isEmpty() else connected_components(links)
        at = _mixed(waiting.select("key", "id").distinct(), state, 2)
        if not at.isEmpty():
            ids = wanted(at)
            wide = restrict(signatures, ids, "id").join(_sets(docs, ids, words), "id")
            links = links.unionAll(checkpoint(_blocked(at, wide, lambda t: _joining(t, percent), f"a {kind}, b {kind}")))
            state = None if links.isEmpty() else connected_components(links)

    classes = classes.select("digest", "id")
    if state is not None:
        classes = classes.join(state, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    else:
        classes = classes.withColumnRenamed("id", "component")
    out = rows.join(classes, "digest", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but those near a row with a smaller key.

    Rows that repeat a key are one document: they stay or go together. Null keys stay.
    """
    gone = checkpoint(near_duplicates(docs, key, text).where("not kept").select(key).distinct())
    return restrict(docs, gone, key, "left_anti")
