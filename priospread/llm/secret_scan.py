"""Secret scan: fixed patterns, then character Markov models compared by log-likelihood ratio.

Two first-order Markov models over the 68 symbols of ALPHABET, one of random strings and one of
ordinary identifiers, are trained from labelled samples: seeded random strings, and all words of
identifier characters in all documents that no fixed pattern touches. A run of identifier characters that
no fixed pattern covers is a secret when the summed log-likelihood ratio, and its mean per
character, pass the thresholds.

Edge cases: null and empty texts have no spans; offsets are code points of the whole text, in
which a byte that is not UTF-8 counts as one; repeated rows are scanned each; very long texts are
scanned whole, one at a time; extra columns are ignored; over an empty table the ordinary model is
uniform.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, sound

# The base patterns and the least lengths that a match needs.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = rb"AKIA[A-Z0-9]+", rb"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SYMBOL = np.full(256, len(ALPHABET), np.int64)
_SYMBOL[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
#: Runs that may be secrets, the least ratio in all and per character (natural logarithm).
LEAST_RUN, LEAST_RATIO, LEAST_MEAN = 20, 12.0, 0.45
#: Weight, in counts, of a symbol's own share against its pairs.
BACK_OFF = 20.0
#: Random strings made for the model of secrets.
SAMPLE_RANDOM, SAMPLE_SEED = 6000, 7

_assign = re.compile(ASSIGN, re.I)
_access, _hex = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)), re.compile(rb"[0-9a-f]{%d,}" % LEAST_HEX)
_run = re.compile(rb"(?<![A-Za-z0-9+/_=\x80-\xff-])[A-Za-z0-9+/_=-]{%d,}(?![\x80-\xff])" % LEAST_RUN)
_identifier = re.compile(rb"(?<![\x80-\xff])[A-Za-z0-9_+/=-]{6,}(?![\x80-\xff])")


def random_samples(n: int = SAMPLE_RANDOM, seed: int = SAMPLE_SEED) -> list[bytes]:
    """Samples labelled secret: seeded random strings of the usual key alphabets."""
    rng = random.Random(seed)
    pools = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    return [bytes(rng.choices(pools[i % len(pools)], k=rng.randint(20, 44))) for i in range(n)]


def pair_counts(samples: Iterable[bytes]) -> np.ndarray:
    """How often each symbol follows each; the last row counts first symbols."""
    n = len(ALPHABET) + 1
    counts = np.zeros((n + 1) * n, np.int64)
    held: list[bytes] = []

    def add() -> None:
        x = _SYMBOL[np.frombuffer(b"\0".join(held), np.uint8)]
        first = np.zeros(len(x), bool)
        first[np.cumsum([0, *[len(s) + 1 for s in held[:-1]]])] = True
        gap = np.zeros(len(x), bool)
        gap[np.flatnonzero(first)[1:] - 1] = True  # the separators
        nonlocal counts
        counts += np.bincount(n * n + x[first & ~gap], minlength=len(counts))
        inner = ~gap[1:] & ~gap[:-1]
        counts += np.bincount(n * x[:-1][inner] + x[1:][inner], minlength=len(counts))
        held.clear()

    for s in samples:
        if s:
            held.append(s)
        if len(held) >= 4096:
            add()
    if held:
        add()
    return counts.reshape(n + 1, n)


def log_ratios(secret: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each symbol pair from the pair counts of both classes.

    Pairs back off to the symbols' own shares (add-one), so a pair that no sample shows is as
    unlikely as its symbols and not as likely as any other.
    """

    def model(counts: np.ndarray) -> np.ndarray:
        alone = (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
        return np.log((counts + BACK_OFF * alone) / (counts.sum(1, keepdims=True) + BACK_OFF))

    return model(secret.astype(float)) - model(ordinary.astype(float))


def train(secret: Iterable[bytes], ordinary: Iterable[bytes]) -> np.ndarray:
    """Log-likelihood ratio of each symbol pair; the last row is the start."""
    return log_ratios(pair_counts(secret), pair_counts(ordinary))


def identifiers(text: bytes) -> Iterator[bytes]:
    """Samples labelled ordinary: runs of identifier characters that no fixed pattern touches."""
    covered = Covered(base_spans(text))
    return (m[0] for m in _identifier.finditer(text) if not covered.touches(*m.span()))


def train_from(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Train on labelled samples: seeded random strings (secret) against all identifiers of all documents.

    Each task counts symbol pairs in a table of fixed size; the tables are added up in Spark and
    one of them comes to the driver, so the model covers every text and no text leaves its task.
    """
    n = len(ALPHABET) + 1
    rows = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))

    def run(batches):
        counts = np.zeros((n + 1, n), np.int64)
        for b in batches:
            counts += pair_counts(x for t in b.column("t") for x in identifiers(sound(t.as_py())))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    counted = np.zeros((n + 1) * n, np.int64)
    for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 70 * 69 rows
        counted[r["at"]] = r["n"]
    return log_ratios(pair_counts(random_samples()), counted.reshape(n + 1, n))


class Covered:
    """Merged spans, for overlap tests by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, start: int, end: int) -> bool:
        """Whether a span overlaps [start, end)."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the fixed patterns, kinds in the listed order."""
    out = [(0, *m.span()) for m in _assign.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(1, *m.span()) for m in _access.finditer(text)]
    return out + [(2, *m.span()) for m in _hex.finditer(text)]


def markov_spans(text: bytes, ratios: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, covered = [], Covered(taken)
    for m in _run.finditer(text):
        if covered.touches(*m.span()):
            continue
        x = _SYMBOL[np.frombuffer(m[0], np.uint8)]
        ratio = ratios[-1, x[0]] + ratios[x[:-1], x[1:]].sum()
        if ratio >= LEAST_RATIO and ratio >= LEAST_MEAN * len(x):
            out.append((3, *m.span()))
    return out


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with byte offsets turned to code points."""
    if not spans or text.isascii():
        return spans
    at, n, of = 0, 0, {}
    for b in sorted({b for _, s, e in spans for b in (s, e)}):
        n += len(text[at:b].decode("utf-8", "replace"))
        at, of[b] = b, n
    return [(k, of[s], of[e]) for k, s, e in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


FIELDS = pa.schema([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_markov", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])


def scan_text(text: bytes, ratios: np.ndarray) -> tuple:
    base = base_spans(text)
    more = markov_spans(text, ratios, base)
    n = [sum(k == i for k, _, _ in base) for i in range(3)]
    whole = code_points(text, base + more)
    return *n, len(more), hashlib.sha256(joined(whole[: len(base)]).encode()).hexdigest(), joined(whole)


def scan_secrets(docs: DataFrame, ratios: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and FIELDS for every row of ``docs``; one narrow pass after training."""
    ratios = train_from(docs, key, text) if ratios is None else ratios
    return map_texts(docs, [key], text, lambda: lambda texts: zip(*[scan_text(t, ratios) for t in texts]), FIELDS)


def redact_text(text: bytes, ratios: np.ndarray, mark: bytes = b"[secret]") -> bytes:
    """``text`` with every found span, overlapping ones merged, replaced by ``mark``."""
    base = base_spans(text)
    out, at = [], 0
    for _, s, e in sorted(base + markov_spans(text, ratios, base), key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return b"".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, ratios: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with secrets cut out of ``text``.

    Null texts stay null, and a text without a secret comes back byte for byte; in one with a secret
    bytes that are not UTF-8 become U+FFFD. Repeated rows are treated each, very long texts whole,
    one at a time; columns of any name pass through.
    """
    ratios = train_from(docs, key, text) if ratios is None else ratios
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))

    def work(texts):
        made = [redact_text(t, ratios) for t in texts]
        return [[None if x is t else x.decode() for x, t in zip(made, texts)]]

    out = map_texts(bare, ["row"], "t", lambda: work, pa.schema([("redacted", pa.string())]))
    return out.select(*[F.coalesce("redacted", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
