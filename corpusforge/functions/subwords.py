"""Subword tokens by longest match in a given vocabulary: for indexes, budgets and windows in the place of words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words and signs of a lowered text.
PARTS = re.compile(r"\w+|[^\w\s]")
#: Words whose pieces a worker remembers.
REMEMBERED = 200_000


def printable_bytes() -> dict[str, int]:
    """The sign that stands for each byte in a vocabulary of bytes: printable Latin-1 stands for itself, the others follow from 256."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Trie:
    """The pieces of a vocabulary, byte after byte; a node's piece stands under None."""

    def __init__(self, pieces: Iterable[tuple[bytes, str]]) -> None:
        self.root: dict = {}
        for raw, name in pieces:
            node = self.root
            for b in raw:
                node = node.setdefault(b, {})
            node[None] = name

    def longest(self, word: bytes, at: int) -> tuple[int, str] | None:
        """Where the longest piece that begins here ends, and its name."""
        node, found = self.root, None
        for k in range(at, len(word)):
            node = node.get(word[k])
            if node is None:
                break
            if None in node:
                found = (k + 1, node[None])
        return found


class Subwords:
    """A vocabulary (piece -> id) of pieces that stand inside a word and of pieces that end one (marked by `end`)."""

    def __init__(self, vocabulary: dict[str, int], end: str = "</w>", unknown: str = "<unk>", of_bytes: bool = True) -> None:
        self.vocabulary, self.end, self.unknown, self.of_bytes = vocabulary, end, unknown, of_bytes
        self.tries: tuple[Trie, Trie] | None = None
        self.known: dict[str, list[str]] = {}

    @classmethod
    def read(cls, path: str, **options) -> Subwords:
        """The vocabulary of a tokenizer's JSON file."""
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f)["model"]["vocab"], **options)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tries": None, "known": {}}

    def _build(self) -> tuple[Trie, Trie]:
        byte = printable_bytes()
        raw = lambda p: bytes(byte[c] for c in p) if self.of_bytes and all(c in byte for c in p) else p.encode()
        inner = ((raw(p), p) for p in self.vocabulary if not (self.end and p.endswith(self.end)))
        final = ((raw(p.removesuffix(self.end)), p) for p in self.vocabulary if not self.end or p.endswith(self.end))
        return Trie(inner), Trie(final)

    def split(self, word: str) -> list[str]:
        """The pieces of a word: from the left the longest that fits; a piece that ends a word fits at its end only, and of two of
        one length it is taken. A word with a place where none fits is unknown as a whole."""
        if word in self.known:
            return self.known[word]
        self.tries = self.tries or self._build()
        (inner, final), raw, at, out = self.tries, word.encode(), 0, []
        while at < len(raw):
            one, last = inner.longest(raw, at), final.longest(raw, at)
            if last and last[0] == len(raw):
                one = last
            if one is None:
                out = [self.unknown]
                break
            at = one[0]
            out.append(one[1])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = out
        return out

    def text(self, text: str | None) -> list[str]:
        return [p for w in PARTS.findall((text or "").lower()) for p in self.split(w)]

    def tokens(self, c: Column) -> Column:
        """array<string>: the pieces of a text, none for a null one. Takes the place of the words of an index."""
        held = _sent(self)

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([held.value.text(t) for t in texts], dtype=object)

        return run(c)

    def ids(self, c: Column) -> Column:
        """array<int>: the ids of the pieces, -1 for an unknown word."""
        held = _sent(self)

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            own = held.value
            return pd.Series([[own.vocabulary.get(p, -1) for p in own.text(t)] for t in texts], dtype=object)

        return run(c)

    def count(self, c: Column) -> Column:
        """The number of pieces, for budgets."""
        held = _sent(self)

        @F.pandas_udf("int")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([len(held.value.text(t)) for t in texts], dtype="int32")

        return run(c)

    def words(self, c: Column, size: int) -> Column:
        """array<string>: a text in pieces of at most `size` subwords, cut between words where it can be; joined by blanks within a
        piece. A word of more subwords than that is a piece of its own. At least one piece, which may be empty."""
        held = _sent(self)

        def cut(text: str | None) -> list[str]:
            out, run, n = [], [], 0
            for w in PARTS.findall((text or "").lower()):
                k = len(held.value.split(w))
                if run and n + k > size:
                    out.append(" ".join(run))
                    run, n = [], 0
                run.append(w)
                n += k
            return [*out, " ".join(run)]

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([cut(t) for t in texts], dtype=object)

        return run(c)


def _sent(vocabulary: Subwords):
    """The vocabulary on the executors: a file of some MB, however large the data."""
    return SparkSession.getActiveSession().sparkContext.broadcast(vocabulary)
