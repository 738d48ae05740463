"""Whole-text encoding with a word-level BPE file, one lookup per white-space chunk.

The tokenizer drops white space, so a text's ids are those of its chunks in turn. Chunks are
cached in a bounded table per Python worker; new chunks of a text are encoded together. A chunk
of plain letters skips normalising and pattern splitting: its lower-cased bytes go straight to
the merges. Every other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks that a worker keeps; a text that finds more starts it anew.
CACHE_CHUNKS = 400_000
# ASCII and Latin-1 letters, which NFC leaves alone and whose lower case is one letter.
_LETTERS = re.compile("[a-zß-öø-ÿ]{1,64}")
_TAIL = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)\Z", re.S)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    _shared: dict[str, WordBpe] = {}

    @classmethod
    def shared(cls, file: str) -> WordBpe:
        """One encoder per worker process and file."""
        if file not in cls._shared:
            cls._shared[file] = cls(file)
        return cls._shared[file]

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.plain.normalizer = None  # letters are lower-cased and mapped to symbols beforehand
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        symbols = byte_symbols()
        self.symbols = {chr(b): s for b, s in symbols.items()}
        self.table = str.maketrans(self.symbols)
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def learn(self, chunks: list[bytes]) -> None:
        """Put the ids of new chunks into the table."""
        cores: dict[bytes, str] = {}
        split: dict[bytes, tuple[bytes, bytes]] = {}
        other: list[bytes] = []
        for c in chunks:
            m = _TAIL.match(c)
            core, tail = m.groups() if m else (c, b"")
            word = core.decode("utf-8", "replace").lower()
            if not _LETTERS.fullmatch(word):
                other.append(c)
                continue
            split[c] = (core, tail)
            if core not in self.cache:
                cores[core] = word.encode().decode("latin-1").translate(self.table)
            if tail and tail not in self.cache:
                other.append(tail)
        if cores:
            ids = np.array(self.plain.encode(" ".join(cores.values()), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            for core, a, b in zip(cores, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.cache[core] = ids[a:b].tobytes()
        if other := list(dict.fromkeys(other)):
            got = self.whole.encode_batch([x.decode("utf-8", "replace") for x in other], add_special_tokens=False)
            for c, e in zip(other, got):
                self.cache[c] = np.array(e.ids, "<u4").tobytes()
        for c, (core, tail) in split.items():
            if tail:
                self.cache[c] = self.cache[core] + self.cache[tail]

    def encode(self, text: bytes, end: int | None = None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of a whole UTF-8 text, ``end`` after them."""
        words = text.lower().split()
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        if new := set(words).difference(self.cache):
            self.learn(sorted(new))
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        return np.frombuffer(b"".join(map(self.cache.__getitem__, words)) + tail, "<u4")
