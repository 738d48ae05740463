"""SentencePiece encoding sampled by forward filtering and backward sampling; lossless decoding.

A text, led by one space, is cut before spaces and around newlines into segments; the piece
lattice of a segment has an edge for every piece that spells a substring, and a byte-fallback
edge for a character that no piece spells. A path's weight is the product of its pieces'
weights. Forward filtering sums the weights of all paths to each position; backward sampling
then draws edges from the end in proportion to the sum before the edge times the edge's weight,
so a path is drawn exactly by its share. The draws come from a counter hash of the row key, so a
row's segmentation does not depend on its batch or task.

The model file ranks its pieces by merge order and holds no probabilities, so a piece of rank r
weighs (r + 1)^-THETA: Zipf's law, flattened by the temperature.

Distinct segments of a slice of texts are filtered together, position by position; occurrences
are sampled together, step by step. Long segments are filtered one at a time, each sum with its own unit.

Edge cases: null and empty texts have no pieces; bytes that are not UTF-8 count as U+FFFD; a
literal U+2581 is spelled by bytes and stays itself; repeated rows with equal keys get equal
segmentations; a null key seeds as the empty string; a run without spaces is cut after every LONG
characters; a very long text is sampled in parts of whole segments; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import map_texts, mix64

#: Temperature, seed, texts of a slice, characters of a slice (a longer text is taken in parts),
#: longest segment that is filtered with others, characters after which a run without spaces is cut.
THETA, SEED, SLICE, PART, SHORT, LONG = 0.6, 5, 256, 1 << 20, 40, 4096
_SEGMENT = re.compile(r"\n| {0,%d}[^ \n]{1,%d}| {1,%d}" % (LONG, LONG, LONG))
_RANGE = np.arange(1024)
_G, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


class PieceModel:
    """Pieces of a SentencePiece file, found by a hash of their characters."""

    _shared: dict[str, PieceModel] = {}

    @classmethod
    def shared(cls, file: str) -> PieceModel:
        if file not in cls._shared:
            cls._shared[file] = cls(file)
        return cls._shared[file]

    def __init__(self, file: str, theta: float = THETA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * n
        keys, ids = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                spelled = piece.replace("▁", " ")
                self.bytes[i] = spelled.encode()
                keys.append(spelled)
                ids.append(i)
        self.longest = max(map(len, keys))
        rank = np.empty(len(ids))
        rank[np.argsort([-sp.get_score(i) for i in ids], kind="stable")] = np.arange(len(ids))
        # Weights are scaled by character so that sums over short segments stay near one.
        logs = -theta * np.log(rank + 1)
        self.log_scale = float(np.median([x / len(k) for x, k in zip(logs, keys)]))
        self.weight = np.zeros(n + 1)
        self.weight[ids] = np.exp(logs - self.log_scale * np.array([len(k) for k in keys]))
        self.fallback = float(np.exp(-theta * np.log(n) * 2 - self.log_scale))
        hashed = self._roll(keys)
        self.order = np.argsort(hashed)
        self.hashed, self.ids = hashed[self.order], np.array(ids)[self.order]
        if (self.hashed[1:] == self.hashed[:-1]).any():
            raise ValueError("two pieces share a hash")
        size = 1 << 18
        self.shift = np.uint64(64 - 18)
        self.slot_key, self.slot_id, self.more = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.zeros(size, bool)
        for h, i in zip(self.hashed, self.ids):
            s = int(h >> self.shift)
            if self.slot_id[s] < 0:
                self.slot_key[s], self.slot_id[s] = h, i
            else:
                self.more[s] = True

    @staticmethod
    def _roll(keys: list[str]) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for k, s in enumerate(keys):
            h = np.zeros(1, np.uint64)
            for c in s:
                h = (h + np.uint64(ord(c) + 1)) * _G
                h = h ^ (h >> np.uint64(29))
            out[k] = h[0]
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 without one."""
        s = (h >> self.shift).astype(np.int64)
        got = np.where((self.slot_id[s] >= 0) & (self.slot_key[s] == h), self.slot_id[s], -1)
        rest = np.flatnonzero(self.more[s] & (got < 0))
        if len(rest):
            k = np.minimum(np.searchsorted(self.hashed, h[rest]), len(self.hashed) - 1)
            got[rest] = np.where(self.hashed[k] == h[rest], self.ids[k], -1)
        return got

    def lattice(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """[length - 1, start]: the piece of that length at each start, -1 without one.

        ``room``: characters from each start to its segment's end.
        """
        out = np.full((self.longest, len(codes)), -1, np.int64)
        h, at = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                at = at[room[at] >= size]
                if not len(at):
                    break
                x = (h[at] + codes[at + size - 1].astype(np.uint64) + np.uint64(1)) * _G
                h[at] = x = x ^ (x >> np.uint64(29))
                out[size - 1, at] = self.find(x)
        return out


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(seed + np.uint64(step + 1) * _B) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def segments_of(text: str) -> list[str]:
    return _SEGMENT.findall(" " + text) if text else []


def sample_slice(model: PieceModel, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
    """Sampled ids of each text; texts are worked on in parts of at most PART characters or a segment."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    jobs: list[tuple[int, int, list[str]]] = []  # text, number of its first segment, segments
    held = 0

    def flush() -> None:
        nonlocal held
        if jobs:
            for (i, _, _), ids in zip(jobs, _sample(model, [x for _, _, x in jobs], [seeds[i] for i, _, _ in jobs], [k for _, k, _ in jobs])):
                out[i].append(ids)
        jobs.clear()
        held = 0

    for i, t in enumerate(texts):
        found, first, size = segments_of(t), 0, 0
        for k, s in enumerate(found):
            size += len(s)
            if held + size > PART and (k > first or jobs):
                if k > first:
                    jobs.append((i, first, found[first:k]))
                flush()
                first, size = k, len(s)
        if first < len(found):
            jobs.append((i, first, found[first:]))
            held += size
    flush()
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _sample(model: PieceModel, texts: list[list[str]], seeds: list[int], firsts: list[int]) -> list[np.ndarray]:
    """Sampled ids of lists of segments, whose first one has the given number in its text."""
    seen: dict[str, int] = {}
    per_text = [[seen.setdefault(s, len(seen)) for s in found] for found in texts]
    segments = list(seen)
    if not segments:
        return [np.zeros(0, np.int64) for _ in texts]
    size = np.array([len(s) for s in segments])
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.concatenate([[0], np.cumsum(size)])
    room = np.repeat(first[1:], size) - np.arange(len(codes))
    pieces = model.lattice(codes, room)
    weight = model.weight[pieces]  # the last weight, of -1, is 0
    bare = pieces[0] < 0
    weight[0, bare] = model.fallback
    # Forward filtering; alpha has one more position per segment than characters.
    base = first[:-1] + np.arange(len(size))
    alpha = np.zeros(len(codes) + len(size))
    alpha[base] = 1.0
    short = np.flatnonzero(size <= SHORT)
    short = short[np.argsort(-size[short], kind="stable")]
    falling = -size[short]
    for end in range(1, int(size[short].max(initial=0)) + 1):
        live = short[: np.searchsorted(falling, -end, "right")]
        total = np.zeros(len(live))
        for n in range(1, min(end, model.longest) + 1):
            total += alpha[base[live] + end - n] * weight[n - 1, first[live] + end - n]
        alpha[base[live] + end] = total
    # Long sums leave the range of doubles: each position keeps its sum and the logarithm of its unit.
    unit = np.zeros(len(alpha)) if (size > SHORT).any() else None
    for s in np.flatnonzero(size > SHORT).tolist():
        a, u, w = alpha[base[s] : base[s] + size[s] + 1], unit[base[s] : base[s] + size[s] + 1], weight[:, first[s] : first[s + 1]]
        near, now = np.zeros(model.longest), 0.0  # sums of the last positions, newest first, in the unit of now
        near[0] = 1.0
        for end in range(1, size[s] + 1):
            k = min(end, model.longest)
            total = float(near[:k] @ w[_RANGE[:k], end - 1 - _RANGE[:k]])
            near[1:] = near[:-1].copy()
            near[0] = total
            if not 1e-30 < total < 1e30:
                near /= total
                now, total = now + math.log(total), 1.0
            a[end], u[end] = total, now
    # Backward sampling of all occurrences; long segments carry on alone at the end.
    occ = np.array([i for ids in per_text for i in ids], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in per_text])
    number = np.arange(len(occ)) - np.repeat(np.cumsum([0] + [len(x) for x in per_text])[:-1] - np.array(firsts, np.int64), [len(x) for x in per_text])
    with np.errstate(over="ignore"):
        seed = mix64(np.array(seeds, np.uint64)[row] + number.astype(np.uint64) * _G)
    at, live = size[occ].copy(), np.arange(len(occ))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []  # of each step: occurrence, piece or -1 - character
    step = 0
    while len(live):
        s = occ[live]
        left = _uniform(seed[live], step) * _mass(alpha, unit, weight, base, first, s, at[live], model.longest)
        took, found = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
        reach, last = at[live], np.ones(len(live), np.int64)
        for n in range(1, min(int(reach.max()), model.longest) + 1):
            open_ = np.flatnonzero(~found & (reach >= n))
            if not len(open_):
                break
            start = reach[open_] - n
            part = alpha[base[s[open_]] + start] * weight[n - 1, first[s[open_]] + start]
            if unit is not None:
                part *= np.exp(unit[base[s[open_]] + start] - unit[base[s[open_]] + reach[open_]])
            last[open_] = np.where(part > 0, n, last[open_])
            left[open_] -= part
            hit = open_[(left[open_] < 0) & (part > 0)]
            took[hit], found[hit] = n, True
        took = np.where(found, took, last)  # rounding may leave a remainder after the last edge
        start = first[s] + reach - took
        piece = pieces[took - 1, start]
        drawn.append((live, np.where(piece < 0, -1 - start, piece)))
        at[live] -= took
        live = live[at[live] > 0]
        step += 1
    who = np.concatenate([x for x, _ in drawn])
    what = np.concatenate([x for _, x in drawn])
    when = np.repeat(np.arange(len(drawn)), [len(x) for x, _ in drawn])
    order = np.lexsort((-when, who))
    who, what = who[order], what[order]
    if (bytes_ := np.flatnonzero(what < 0)).size:
        spelled = [model.byte_ids[np.frombuffer(chr(codes[-1 - w]).encode("utf-8", "surrogatepass"), np.uint8)] for w in what[bytes_].tolist()]
        times = np.ones(len(what), np.int64)
        times[bytes_] = [len(x) for x in spelled]
        holes = np.repeat(what < 0, times)
        what, who = np.repeat(what, times), np.repeat(who, times)
        what[holes] = np.concatenate(spelled)
    bounds = np.searchsorted(row[who], np.arange(len(texts) + 1)) if len(who) else np.zeros(len(texts) + 1, int)
    return [what[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _mass(alpha, unit, weight, base, first, s, reach, longest) -> np.ndarray:
    """Sum over the edges that end at ``reach``, in the unit of that position."""
    if unit is None:
        return alpha[base[s] + reach]
    total = np.zeros(len(s))
    for n in range(1, min(int(reach.max()), longest) + 1):
        ok = np.flatnonzero(reach >= n)
        start = base[s[ok]] + reach[ok] - n
        total[ok] += alpha[start] * np.exp(unit[start] - unit[base[s[ok]] + reach[ok]]) * weight[n - 1, first[s[ok]] + reach[ok] - n]
    return total


def decode(model: PieceModel, ids) -> bytes:
    """The UTF-8 text that ``ids`` spell: the leading space of the first piece is not text."""
    return b"".join(map(model.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:]


def seed_of(key: object, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest("" if key is None else str(key), seed)


def encode_sampled(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``key`` and the sampled ``ids`` of every row's whole text."""
    return _mapped(docs, model_file, key, text, seed, pa.schema([("ids", pa.list_(pa.int32()))]), lambda model, texts, ids: [[x.astype(np.int32) for x in ids]])


def round_trip(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``key``, ``n_pieces``, ``ids_crc32`` and whether decoding gives the text back."""

    def digest(model, texts, ids):
        return [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [decode(model, x) == t for x, t in zip(ids, texts)]

    return _mapped(docs, model_file, key, text, seed, pa.schema([("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]), digest)


def _mapped(docs: DataFrame, model_file: str, key: str, text: str, seed: int, fields: pa.Schema, finish) -> DataFrame:
    def worker():
        model = PieceModel.shared(model_file)

        def work(texts, keys):
            parts = []
            for i in range(0, len(texts), SLICE):
                part = texts[i : i + SLICE]
                ids = sample_slice(model, [t.decode("utf-8", "replace") for t in part], [seed_of(k, seed) for k in keys[i : i + SLICE]])
                parts.append(finish(model, part, ids))
            return [[x for p in parts for x in p[c]] for c in range(len(fields))]

        return work

    return map_texts(docs, [key], text, worker, fields, also=[key])
