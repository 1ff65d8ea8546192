"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces (matches of the splitting pattern) of a slice of the corpus are laid end to end; an inverted index
leads from each token pair, by its rank, to the positions that hold it. Ranks are replayed in ascending order over all
pieces at once; a merge changes its neighbours' pairs only, and these enter the index anew. In each piece one merge a turn,
the leftmost, is done, and a pair of lower rank that a merge brings up comes next: so the order within a piece is the
sequential one, whatever the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ASCII_SPACE, gather_runs, small_batches, strings, text_slices, tidy

#: White space of the pattern's \s that isn't among the six ASCII ones at which slices of text are cut.
OTHER_SPACE = regex.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Distinct pieces a worker remembers between slices.
REMEMBERED = 300_000


class Ranks:
    """A rank file: bytes to id, and every pair of ids whose bytes together are a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.n = max(ranks.values()) + 1
        self.bytes = [b""] * self.n
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] * self.n + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.key = np.array([k for k, _ in pairs], np.int64)
        self.rank = np.array([r for _, r in pairs], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.byte[data]
        n = len(token)
        word = np.repeat(np.arange(len(pieces)), lengths)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        first = np.cumsum(lengths) - lengths
        before[first[lengths > 0]] = -1
        after[(first + lengths - 1)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        own = np.full(n, -1, np.int64)  # the rank of the pair that begins here
        has = np.flatnonzero(after >= 0)
        own[has] = self.of(token[has], token[after[has]])
        has = has[own[has] >= 0]
        order = has[np.argsort(own[has], kind="stable")]
        ranks, begin = np.unique(own[order], return_index=True)
        begin = np.append(begin, len(order))
        index: dict[int, list[np.ndarray]] = {int(r): [order[begin[i] : begin[i + 1]]] for i, r in enumerate(ranks)}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (own[at] == r)]
            if len(at) > 1:
                again = np.zeros(len(at), bool)
                again[1:] = word[at[1:]] == word[at[:-1]]
                if again.any():
                    index[r] = [at[again]]
                    heapq.heappush(heap, r)
                    at = at[~again]
            if not len(at):
                continue
            gone = after[at]
            token[at], alive[gone] = r, False
            after[at] = after[gone]
            next_ = after[at]
            before[next_[next_ >= 0]] = at[next_ >= 0]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            own[at] = -1
            new = np.full(len(touched), -1, np.int64)
            right = after[touched]
            some = right >= 0
            new[some] = self.of(token[touched[some]], token[right[some]])
            own[touched] = new
            touched, new = touched[new >= 0], new[new >= 0]
            if len(touched) == 1:
                parts = [(int(new[0]), touched)]
            elif len(touched):
                o = np.argsort(new, kind="stable")
                touched, new = touched[o], new[o]
                cut = np.flatnonzero(np.diff(new)) + 1
                parts = [(int(new[a]), touched[a:b]) for a, b in zip(np.append(0, cut), np.append(cut, len(new)), strict=True)]
            else:
                parts = []
            for rank, where in parts:
                if rank in index:
                    index[rank].append(where)
                else:
                    index[rank] = [where]
                    heapq.heappush(heap, rank)
        ids, of = token[alive], word[alive]
        return ids, np.bincount(of, minlength=len(pieces))


def _stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of stretches (white space, then the rest up to the next white space), and the document of each."""
    space = ASCII_SPACE[data]
    start = np.zeros(len(data), bool)
    start[1:] = space[1:] & ~space[:-1]
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(offsets, at, "right") - 1


class Encoder:
    """Encodes slices of a text column; used inside one worker."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        self.ranks, self.split = Ranks(rank_path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = (np.zeros(0, np.int64) for _ in range(3))

    def pieces(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, one after another, and how many each has; its pattern matches are encoded on their own."""
        lists = [self.split.findall(s.decode()) for s in found]
        new = {m for m in chain.from_iterable(lists) if m not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = set(chain.from_iterable(lists))
        ids, length = self.ranks.replay([m.encode() for m in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        of = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, len(of))
        return self.ids[gather_runs(self.start[at], self.length[at])], np.bincount(of, self.length[at], len(lists)).astype(np.int64)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text, in order."""
        for i, j, data, offsets in text_slices(column, 16 << 20):
            odd = {k - i for k in range(i, j) if OTHER_SPACE.search(column[k].as_py() or "")}
            at, doc = _stretches(data, offsets)
            if len(at):
                coded = pc.dictionary_encode(strings(data, at, np.append(at[1:], len(data))))
                flat, length = self.pieces(coded.dictionary.to_pylist())
                codes = coded.indices.to_numpy()
                n = length[codes]
                ids = flat[gather_runs((np.cumsum(length) - length)[codes], n)]
                ends = np.append(0, np.cumsum(n))[np.searchsorted(doc, np.arange(j - i), "right")]
            else:
                ids, ends = np.zeros(0, np.int64), np.zeros(j - i, np.int64)
            begin = 0
            for k, end in enumerate(ends.tolist()):
                yield self.pieces([bytes(data[offsets[k] : offsets[k + 1]])])[0] if k in odd else ids[begin:end]
                begin = end

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids.tolist()))


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", out: str = "digest") -> DataFrame:
    """Encodes every whole text, decodes the ids again.

    out="ids": id, ids array<int>, decoded string. out="digest": id, n_tokens, ids_sha256, decoded_sha256.
    A null or empty text has no ids. Rows, repeated ones included, give a row each; other columns are left out. Of equal pairs in
    a piece the leftmost merges first. A very long text is encoded whole in one worker, in slices of 16 MB as far as white space
    allows. An empty table gives no rows. rank_path is read by each worker, so it must exist on all machines.
    """
    small_batches(df.sparkSession)
    digest = out == "digest"
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(rank_path, pattern)
        text = np.array([str(i) for i in range(coder.ranks.n)], object)
        for batch in batches:
            rows: list[tuple] = []
            for ids in coder.encode(batch.column(1)):
                whole = coder.decode(ids)
                if digest:
                    rows.append((len(ids), hashlib.sha256(",".join(text[ids].tolist()).encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
                else:
                    rows.append((ids.astype(np.int32), whole.decode("utf-8", "replace")))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidy(run), schema)
