"""Embedding near-duplicates: a pivot-permutation index with inverted lists and exact verification.

Reference points (pivots) are drawn from the vectors; one too near an earlier one is left out, so
a dense group holds a pivot or two and not one for each share of the rows; how near depends on how
many are left, so vectors that share a common direction have pivots as well. A vector is described
by its NEAREST pivots in order of nearness, both seen from the mean of the drawn vectors. Inverted lists hold, for each pivot, the vectors that
name it. Two vectors are candidates when they share the nearest pivot, or SHARED pivots at all;
the cosine of every candidate pair is then computed in double precision.

A pair meets in one list only: that of the pivot whose two places in the descriptions add up to
least. Vectors of one nearest pivot therefore meet in its list, however many other pivots they
share, and all of them are compared: a hot group of near copies loses no link. A long list is cut
into blocks of ``BLOCK`` vectors in the order of their nearest pivots; a task compares two blocks
by matrix products, and block pairs that can only hold pairs of another list are left out.

Tasks return link counts per vector and a spanning forest of the links instead of all pairs.
Vectors that are equal bit for bit are one class with a count, so groups of exact copies, however
large, are one row of the index. With a number of pivots that grows with the root of the rows the
work grows with rows^1.5, and with the square of a group only where it is one of near copies.

Edge cases: vectors that are null, zero, or hold null or non-finite components and rows with a
null label link with nothing and are their own component; vectors of unequal length never link;
rows that repeat an id count as vectors each, with one component; a null id is left out of links;
ties in nearness go to the smaller pivot number; extra columns of any name are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, hash_order
from .components import connected_components

#: Least cosine of a link.
COSINE = 0.93
#: Pivots (least, most, per square root of the classes), drawn vectors for each, pivots that describe
#: a vector, pivots that make a candidate, vectors of a block.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_RATE, DRAWN, NEAREST, SHARED, BLOCK = 64, 16_384, 1.0, 4, 8, 2, 1024
#: Cosines to an earlier pivot from which one is left out: the first that leaves three quarters of the pivots asked for.
APART = (0.5, 0.6, 0.7, 0.8, 0.9)
#: Bytes of pivots that travel to every task, and of drawn vectors that come to the driver.
PIVOT_BYTES, DRAWN_BYTES = 32 << 20, 64 << 20


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in rows], float)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled by their largest component first so that none overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` pivots among unit rows, as far apart as leaves three quarters of them.

    Vectors that share a direction are all near each other by a narrow angle and would leave a handful of
    pivots; ranks of cosines to pivots that share it as well still tell such vectors apart. A group of near
    copies holds a pivot or two at any of these angles.
    """
    for apart in APART:
        if 4 * len(found := separated(x, most, apart)) >= 3 * most:
            break
    return found


def centred(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots as unit directions from the mean of the unit rows, and that mean.

    Nearness is the cosine's part that differs between pivots: without the mean taken off, the pivots that lie
    along it are everyone's nearest. Cosines of links are those of the vectors as they are.
    """
    mean = x.mean(0)
    p = pivots_of(x, most) - mean
    return p / np.maximum(np.sqrt((p * p).sum(1, keepdims=True)), 1e-12), mean


def separated(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first ``most`` unit rows that are not near an earlier one that was taken."""
    kept, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for row in x:
        if n == len(kept):
            break
        if not n or (kept[:n] @ row).max() < apart:
            kept[n], n = row, n + 1
    return kept[:n]


def meets(a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """Which pairs of descriptions are candidates whose list is that of ``pivot``.

    Candidates share the nearest pivot, or SHARED pivots; their list is that of the shared pivot
    with the least sum of places, the smaller number on ties.
    """
    same = a[:, :, None] == b[:, None, :]
    place = np.arange(a.shape[1])[:, None] + np.arange(b.shape[1])[None, :]
    wide = int(max(a.max(initial=0), b.max(initial=0))) + 1
    cost = np.where(same, place * wide + a[:, :, None], np.iinfo(np.int64).max).reshape(len(a), -1)
    least = cost.min(1)
    enough = (a[:, 0] == b[:, 0]) | (same.sum((1, 2)) >= min(SHARED, a.shape[1]))
    return enough & (least % wide == pivot) & (least < np.iinfo(np.int64).max)


def forest(mask: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the symmetric link matrix ``mask``."""
    out, waits = [], np.ones(len(mask), bool)
    for root in range(len(mask)):
        if not waits[root]:
            continue
        waits[root], stack = False, [root]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(mask[u] & waits)
            waits[new] = False
            out += [(u, v) for v in new.tolist()]
            stack += new.tolist()
    return out


def embedding_near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.select("id", F.when(F.col("sound") & F.col("label").isNotNull() & F.col("id").isNotNull(), F.struct("label", "v")).alias("class"))
    classes = checkpoint(rows.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "class.label", "class.v", "copies"))
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    some = math.ceil(min(MOST_PIVOTS, max(1, PIVOT_BYTES // (8 * width)), max(LEAST_PIVOTS, PIVOT_RATE * math.sqrt(n))))
    drawn = max(some, min(DRAWN * some, DRAWN_BYTES // (8 * width)))
    sizes: dict[int, list] = {}
    for v in classes.orderBy(hash_order("id"), "id").limit(drawn).select("v").toArrow().column("v"):
        sizes.setdefault(len(v), []).append(v.values.to_numpy())
    pivots = {k: centred(_unit(_matrix(x)), some) for k, x in sizes.items()}

    def describe(batches):
        for pdf in batches:
            for size, part in pdf.groupby(pdf.v.map(len)):
                # A length without a pivot has one list for all its vectors.
                named = np.zeros((len(part), 1), np.int32)
                if (p := pivots.get(size)) is not None:
                    near = -((_unit(_matrix(part.v)) - p[1]) @ p[0].T)
                    named = np.argsort(near, axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                yield part.assign(size=size, named=list(named))

    described = classes.mapInPandas(describe, T.StructType([*classes.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("named", T.ArrayType(T.IntegerType()))]))
    described = checkpoint(described)
    lists = described.select("label", "size", F.explode("named").alias("pivot"), F.col("named")[0].alias("first"), "id")
    # A list's blocks hold vectors in the order of their nearest pivots; a nearest pivot of many
    # vectors has blocks of its own, dealt by a hash.
    parts = lists.groupBy("label", "size", "pivot", "first").agg(F.count("*").alias("n"))
    before = F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).over(Window.partitionBy("label", "size", "pivot").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("block", F.when(F.col("n") > BLOCK, -2 - F.col("first")).otherwise(F.floor(F.coalesce(before, F.lit(0)) / BLOCK)).cast("long"))
    parts = checkpoint(parts.withColumn("cuts", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / F.lit(BLOCK))).otherwise(1).cast("int")))
    blocks = parts.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).groupBy("label", "size", "pivot", F.struct("block", "cut").alias("at")).agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.sum("n").alias("n"))
    one, two = (blocks.select("label", "size", "pivot", *[F.col(c).alias(f"{side}_{c}") for c in ("at", "lo", "hi", "n")]) for side in ("a", "b"))
    # Block numbers only; pairs of one nearest pivot other than the list's meet in that pivot's list.
    alone = (F.col("a_lo") == F.col("a_hi")) & (F.col("a_lo") == F.col("b_lo")) & (F.col("a_lo") == F.col("b_hi")) & (F.col("a_lo") != F.col("pivot"))
    pairs = one.join(two, ["label", "size", "pivot"]).where("a_at < b_at or a_at = b_at and a_n > 1").where(~alone)
    pairs = checkpoint(pairs.select(F.monotonically_increasing_id().alias("pair"), "label", "size", "pivot", "a_at", "b_at"))
    sides = pairs.select("pair", "label", "size", "pivot", F.col("a_at").alias("at"), F.lit(0).alias("side"), (F.col("a_at") == F.col("b_at")).alias("own")).unionAll(pairs.where("a_at <> b_at").select("pair", "label", "size", "pivot", "b_at", F.lit(1), F.lit(False)))
    # Narrow rows are dealt first; each vector joins once it is known which tasks it goes to.
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    placed = lists.join(parts.select("label", "size", "pivot", "first", "block", "cuts"), ["label", "size", "pivot", "first"]).select("label", "size", "pivot", "id", F.struct("block", cut.alias("cut")).alias("at"))
    dealt = placed.join(sides, ["label", "size", "pivot", "at"]).groupBy("label", "id").agg(F.collect_list(F.struct("pair", "pivot", "side", "own")).alias("to"))
    dealt = described.join(dealt, ["label", "id"]).select("id", "copies", "v", "named", F.explode("to").alias("e")).select("e.*", "id", "copies", "v", "named")
    id_type = to_arrow_type(classes.schema["id"].dataType)

    def compare(table: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], id_type), "n": pa.array([], pa.int64()), "other": pa.array([], id_type)})
        sides, here = [], table["pivot"][0].as_py()
        for side in (0, 1):
            part = table.filter(pa.compute.equal(table["side"], side)).combine_chunks()
            if part.num_rows:
                v = _matrix(part["v"].to_pylist())
                sides.append((part["id"].combine_chunks(), part["copies"].to_numpy(), v, _unit(v), np.array(part["named"].to_pylist())))
        if not sides or (len(sides) == 1 and not table["own"][0].as_py()):  # the hash left a block empty
            return none
        a, b = sides[0], sides[-1]
        cosines = a[3] @ b[3].T
        near = cosines >= cosine - 1e-9
        if a is b:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            good[part] = meets(a[4][i[part]], b[4][j[part]], here)
        i, j = i[good], j[good]
        for k in np.flatnonzero(cosines[i, j] < cosine + 1e-9):  # at the bound: decided in plain order
            good_pair = exact_cosine(a[2][i[k]], b[2][j[k]]) >= cosine
            if not good_pair:
                i[k] = -1
        i, j = i[i >= 0], j[i >= 0]
        if not len(i):
            return none
        mask = np.zeros(near.shape, bool)
        mask[i, j] = True
        parts = [(a[0], mask @ b[1])] if a is b else [(a[0], mask @ b[1]), (b[0], a[1] @ mask)]
        found, other, n = [], [], []
        for ids, links in parts:
            some = ids.take(pa.array(np.flatnonzero(links)))
            found, other, n = [*found, some], [*other, some], [*n, links[links > 0]]
        rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        mask = mask[np.ix_(rows, cols)]
        names = a[0].take(pa.array(rows))
        if a is not b:
            names = pa.concat_arrays([names, b[0].take(pa.array(cols))])
            mask = np.block([[np.zeros((len(rows),) * 2, bool), mask], [mask.T, np.zeros((len(cols),) * 2, bool)]])
        if edges := forest(mask):
            x, y = np.array(edges).T
            found, other, n = [*found, names.take(pa.array(x))], [*other, names.take(pa.array(y))], [*n, np.zeros(len(x), int)]
        return pa.table({"id": pa.concat_arrays(found).cast(id_type), "n": pa.array(np.concatenate(n), pa.int64()), "other": pa.concat_arrays(other).cast(id_type)})

    kind = classes.schema["id"].dataType.simpleString()
    found = checkpoint(dealt.groupBy("pair").applyInArrow(compare, f"id {kind}, n long, other {kind}"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of = classes.join(counts, "id", "left").join(components, "id", "left")
    of = of.select(F.struct("label", "v").alias("class"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(of, "class", "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def exact_cosine(a, b) -> float:
    """Plain double precision: sums in order, one square root of each side."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    dot = float(sum(x * y for x, y in zip(a, b)))
    return dot / (math.sqrt(float(sum(x * x for x in a))) * math.sqrt(float(sum(y * y for y in b))))
