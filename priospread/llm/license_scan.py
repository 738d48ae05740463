"""License scan: Aho-Corasick over normalised words, licence expressions by shunting-yard.

Words are maximal runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters.
One automaton holds every notice phrase and the identifier tag; a tag's expression is read
from the raw text and parsed with the precedence with > and > or.

Edge cases: null and empty texts have no words and score 0; a phrase at both ends of a text
counts; overlapping phrases all count; repeated rows are scanned each; bytes that are not UTF-8
count as U+FFFD; very long texts are scanned whole, one at a time; the tag's words without a colon
are prose; malformed expressions add no label and are counted in ``n_malformed``; extra columns
are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices that the method labels by itself.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How open a licence is, by its family; AND takes the least, OR the most.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0, "public-domain": 1.0,
}
UNKNOWN_OPENNESS = 0.2
#: Trust in one piece of evidence: a tag with a sound expression, a base phrase, another notice.
TRUST_TAG, TRUST_BASE, TRUST_MORE = 0.95, 0.8, 0.5

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
# The tag's words, a colon, and the expression on the same line or, behind comment marks, on the next.
_EXPRESSION = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[\"']?[ \t]*:[ \t\"']*(?:\r?\n[ \t#*/;\"'-]*)?([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[/,](?=[ ]*[A-Za-z0-9])|[A-Za-z0-9.+\-]+(?::[A-Za-z0-9.\-]+)?")
_LEVEL = {"or": 1, "and": 2, "with": 3}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def family(identifier: str) -> str:
    """The longest known family that an identifier starts with, else itself."""
    x = identifier.lower().rstrip("+")
    return max((k for k in OPENNESS if x == k or x.startswith(k + "-")), key=len, default=x)


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Identifiers and openness of a licence expression; None if it is malformed.

    Shunting-yard to postfix, which is evaluated as it is made. WITH joins one identifier and one
    exception, nothing else. ``/`` and ``,`` before a known licence mean OR, as in older tags.
    Comment ends and full stops after a complete expression are left out, and prose if all identifiers
    are of known families; an unknown one that prose follows is a word of that prose: malformed.
    """
    values: list[tuple[list[str], float]] = []
    ops: list[str] = []

    def reduce_top() -> None:
        op, right, left = ops.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(([left[0][0] + "-with-" + right[0][0]], min(1.0, left[1] + 0.1)))
        else:
            values.append((left[0] + right[0], (min if op == "and" else max)(left[1], right[1])))

    strange = prose = False
    operand, depth, last = True, 0, ""  # operand: the next token has to start an operand; last: the kind before
    tokens = _TOKEN.findall(expression)
    for k, token in enumerate(tokens):
        low = token.lower()
        if token in "/,":
            after = tokens[k + 1] if k + 1 < len(tokens) else ""
            if operand or family(after.rstrip(".-")) not in OPENNESS:
                break
            low = "or"
        if low in _LEVEL:
            if operand or (low == "with" and last != "identifier"):
                return None
            while ops and ops[-1] != "(" and _LEVEL[ops[-1]] >= _LEVEL[low]:
                reduce_top()
            ops.append(low)
            operand, last = True, low
        elif token == "(":
            if not operand:
                break
            if last == "with":
                return None
            ops.append(token)
            depth += 1
            last = token
        elif token == ")":
            if operand or not depth:
                if operand or not values:
                    return None
                break
            while ops[-1] != "(":
                reduce_top()
            ops.pop()
            depth -= 1
            last = token
        else:
            if not operand:
                if depth:
                    return None
                prose = bool(low.strip(".-+"))
                break
            if not (name := low.rstrip(".-")):
                return None
            values.append(([name], OPENNESS.get(family(name), UNKNOWN_OPENNESS)))
            strange |= last != "with" and family(name) not in OPENNESS
            operand, last = False, "exception" if last == "with" else "identifier"
    if operand or depth or (strange and prose):
        return None
    while ops:
        reduce_top()
    return (sorted(set(values[0][0])), values[0][1]) if len(values) == 1 else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *MORE_PHRASES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


FIELDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("openness", pa.float64()), ("n_malformed", pa.int64()), ("spans", pa.string()),
])


def scan_text(text: bytes, a: ahocorasick.Automaton) -> tuple:
    """One row of FIELDS for a whole text."""
    words = words_of(text)
    norm = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, base, more, spans, doubt = [], set(), set(), [], 1.0
    openness, bad, tags, at, word = 1.0, 0, False, 0, 0
    found = sorted((end - len(phrase) - 1, phrase) for end, phrase in a.iter(norm))
    for start, phrase in found:
        word += norm.count(" ", at, start)
        at = start
        if phrase == TAG:
            tags = True
            continue
        spans.append(f"{word}:{BASE_PHRASES.get(phrase) or MORE_PHRASES[phrase]}")
        if phrase in BASE_PHRASES:
            starts.append(word)
            base.add(BASE_PHRASES[phrase])
            doubt *= 1 - TRUST_BASE
        else:
            more.add(MORE_PHRASES[phrase])
            doubt *= 1 - TRUST_MORE
    openness = min([1.0, *(OPENNESS[x] for x in base | more)])
    if tags:
        for m in _EXPRESSION.finditer(text):
            if got := evaluate(m[1].decode("utf-8", "replace")):
                more.update(got[0])
                openness = min(openness, got[1])
                doubt *= 1 - TRUST_TAG
            else:
                bad += 1
    labels = base | more
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), 1 - doubt, openness if labels else None, bad, ",".join(spans),
    )


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and FIELDS for every row of ``docs``; one narrow pass, no shuffle."""

    def worker():
        a = automaton()
        return lambda texts: zip(*[scan_text(t, a) for t in texts])

    return map_texts(docs, [key], text, worker, FIELDS)
