"""Quality classifier: generalised additive model with pairwise interactions.

Text features are cut at training quantiles into bins. Cyclic boosting visits the features in
turn; each visit fits a shallow tree (at most ``LEAVES`` leaves over the feature's bins) to the
log-loss gradient and adds its damped leaf values to the feature's lookup table. Then the pairs
of features with the largest remaining gain are boosted on coarse two-dimensional tables. A
score is the logistic of the intercept plus one table lookup per feature and pair.

Training takes at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of the key),
which is the documented bound; scoring reads every row in one narrow pass.

Edge cases: null and empty texts have all features 0 and a score; bytes that are not UTF-8 count
as U+FFFD; null labels are left out, repeated keys train once; repeated rows are scored each;
very long texts are scored whole, one at a time; without any label, or with a single class, the
score is the base rate smoothed by one row of each class.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_order, map_texts, one_row_per_key

#: Most labelled rows that are trained on, and the score from which a document counts as good.
SAMPLE_ROWS, THRESHOLD = 12_000, 0.7
#: Bins of a feature and of each side of a pair; leaves of a tree; rounds over all features and
#: over all pairs; step; pairs kept; least rows in a leaf.
BINS, PAIR_BINS, LEAVES, ROUNDS, PAIR_ROUNDS, STEP, PAIRS, LEAST_LEAF = 48, 8, 4, 120, 30, 0.15, 6, 8

FEATURES = (
    "log_bytes", "mean_word", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "newline_share",
    "space_share", "high_share", "distinct_words", "adjacent_repeats", "top_word_share", "repeated_lines", "words_per_line",
    "sentence_ends", "entropy", "edge_symbols", "longest_word", "comma_share", "upper_words", "repeated_pairs",
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"()-?"]] = True
_EDGE = re.compile(rb"[!-/:-@\[-`{-~]{3,}(?=\s|$)")


def features(text: bytes) -> list[float]:
    """The FEATURES of a whole UTF-8 text; shares lie in 0 to 1."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda *chars: float(count[[ord(c) for c in chars]].sum()) / n
    words = text.split()
    m = max(1, len(words))
    sizes: dict[bytes, int] = {}
    for w in words:
        sizes[w] = sizes.get(w, 0) + 1
    lines = text.split(b"\n")
    p = count[count > 0] / n
    letters = max(1, int(count[_LETTER].sum()))
    return [
        float(np.log1p(n)), float(min(40.0, (n - m) / m)), float(count[65:91].sum()) / letters, share(*"0123456789"),
        float(count[_SYMBOLS].sum()) / n, share("!"), share("|"), share("\n"), share(" "), float(count[128:].sum()) / n,
        len(sizes) / m, sum(a == b for a, b in zip(words, words[1:])) / m, max(sizes.values(), default=0) / m,
        1 - len(set(lines)) / len(lines), min(400.0, m / len(lines)), share(*".?!") * n / m, float(-(p * np.log(p)).sum()),
        len(_EDGE.findall(text)) / m, float(np.log1p(max(map(len, words), default=0))), share(",") * n / m,
        sum(w.isupper() for w in words) / m, 1 - len(set(zip(words, words[1:]))) / max(1, m - 1) if m > 1 else 0.0,
    ]


@dataclass
class Gam:
    """Lookup tables: ``cuts[f]`` bin edges, ``tables[f]``; pairs (f, g) with coarse edges."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, f], "right")]
        coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.pair_cuts)]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            z += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton leaf values per bin of a tree that splits ordered bins where the gain is largest."""
    sums = [np.concatenate([[0.0], np.cumsum(a)]) for a in (gradient, weight, rows)]

    def best(lo: int, hi: int) -> tuple[float, int, int, int]:
        (g, h, n), part = sums, slice(lo + 1, hi)
        left = [s[part] - s[lo] for s in (g, h, n)]
        right = [s[hi] - s[part] for s in (g, h, n)]
        if hi - lo < 2:
            return -1.0, lo, hi, lo
        gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1)
        gain = np.where((left[2] >= LEAST_LEAF) & (right[2] >= LEAST_LEAF), gain, -1.0)
        k = int(np.argmax(gain))
        return float(gain[k]), lo, hi, lo + 1 + k

    parts = [best(0, len(gradient))]
    while len(parts) < leaves and max(parts)[0] > 0:
        gain, lo, hi, at = max(parts)
        parts.remove((gain, lo, hi, at))
        parts += [best(lo, at), best(at, hi)]
    out = np.zeros(len(gradient))
    for _, lo, hi, _ in parts:
        out[lo:hi] = (sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on features ``x`` (rows by features) and labels ``y`` of 0 and 1."""
    n, rate = len(y), (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    cuts = [edges(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
    model = Gam(float(np.log(rate / (1 - rate))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    z = np.full(n, model.intercept)
    for _ in range(ROUNDS):
        for b, table, r in zip(bins, model.tables, rows):
            p = 1 / (1 + np.exp(-z))
            step = STEP * tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), r)
            table += step
            z += step[b]
    model.pair_cuts = [edges(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    p = 1 / (1 + np.exp(-z))

    def cells(f: int, g: int) -> tuple[np.ndarray, int]:
        k = len(model.pair_cuts[g]) + 1
        return coarse[f] * k + coarse[g], (len(model.pair_cuts[f]) + 1) * k

    def gain(f: int, g: int) -> float:
        c, k = cells(f, g)
        return float((np.bincount(c, y - p, k) ** 2 / (np.bincount(c, p * (1 - p), k) + 1)).sum())

    model.pairs = sorted(((f, g) for f in range(width) for g in range(f)), key=lambda q: (-gain(*q), q))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_cuts[f]) + 1, len(model.pair_cuts[g]) + 1)) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in zip(model.pairs, model.pair_tables):
            c, k = cells(f, g)
            p = 1 / (1 + np.exp(-z))
            step = STEP * np.bincount(c, y - p, k) / (np.bincount(c, p * (1 - p), k) + LEAST_LEAF)
            table += step.reshape(table.shape)
            z += step[c]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> Gam:
    """Fit on at most ``sample`` labelled documents, one row of each key; only their texts leave the scan.

    A key with several labels trains on the least one, a key with several texts on the least text
    by hash: the model does not depend on the order in which tasks end.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("double")).alias("y"))
    chosen = known.orderBy(hash_order("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # bounded by ``sample``
    rows = map_texts(rows, ["k", "y"], "t", lambda: lambda texts: [[zlib.crc32(t) for t in texts], [features(t) for t in texts]], pa.schema([("h", pa.int64()), ("x", pa.list_(pa.float64()))]))
    got: pd.DataFrame = one_row_per_key(rows, "k", ["h", "x"]).select("y", "x").toPandas()  # at most ``sample`` rows
    order = np.lexsort(np.array([*np.stack(got.x).T, got.y.to_numpy()])) if len(got) else []
    got = got.iloc[order]  # sums do not depend on the order in which tasks end
    return fit(np.stack(got.x) if len(got) else np.zeros((0, len(FEATURES))), got.y.to_numpy(float))


def score_quality(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``score`` and ``predicted`` for every row."""

    def work(texts):
        s = model.score(np.array([features(t) for t in texts]))
        return s, (s >= threshold).astype(np.int32)

    return map_texts(docs, [key], text, lambda: work, pa.schema([("score", pa.float64()), ("predicted", pa.int32())]))


def held_out(key: str = "doc_id") -> Column:
    """crc32(key as text) mod 4 is 2: rows that no model learns from (null keys: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``.

    Rows that repeat a key or a text are judged each; a null text is judged as empty and stays
    null, other texts come back as they are; very long texts are judged whole, one at a time;
    columns of any name pass through.
    """
    model = train_quality(docs, labels.where(~held_out(key)), key, text)
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))

    def work(texts):
        return [model.score(np.array([features(t) for t in texts])) >= threshold]

    good = map_texts(bare, ["row"], "t", lambda: work, pa.schema([("good", pa.bool_())])).where("good")
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])
