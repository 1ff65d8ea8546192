"""Alignment of two tokenizers' ids over byte ranges, by a cogroup of postings with the counts of id pairs.

One pass encodes the texts by both tokenizers, a distinct stretch (a space and what follows up to the next space after a
character that isn't one) once in a worker, and writes for each slice of documents: a row a document, and its pairs of ids
with multiplicities as postings, in a block for each bucket of side ids. Postings are shuffled by bucket of the side id into
sorted streams, after the bucket's counts (in how many documents a pair stands) and maxima; each posting gives its documents'
contributions, and a second shuffle sums them by document. No stream is held: of a bucket only its counts are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, gather_runs, held_by_worker, mix, small_batches, strings, text_slices, tidy

#: Bytes of text of a slice, stretches that a worker remembers, bytes of stretches that are encoded at once, buckets of side ids, bytes of postings of a task.
SLICE, REMEMBERED, AT_ONCE, BUCKETS, TASK = 4 << 20, 500_000, 1 << 16, 64, 16 << 20
#: White space beyond ASCII; a text with some isn't cut, for a pattern may look across it.
_WIDE_SPACE = regex.compile(r"[^\S\x00-\x7f]")


def _byte_of() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes = bytes_of
        self.length = np.array([len(b) for b in bytes_of], np.int64)


class ByteLevel(Side):
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        out = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        super().__init__(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, which begin with a space."""
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model with byte fallback; it adds the space that the texts begin with."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        pieces = [self.coder.id_to_piece(i) for i in range(n)]
        self.blank = self.coder.piece_to_id("▁")
        super().__init__([bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else b"" if self.coder.is_control(i) or self.coder.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: No piece goes on after a blank, so a text may be cut before one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, which begin with a space."""
        return [ids if len(t) > 1 else [self.blank] for t, ids in zip(texts, self.coder.encode([t[1:] for t in texts], num_threads=1), strict=True)]


class Known:
    """What a worker remembers of distinct stretches: ids' numbers, groups, and linked pairs (id of A * width + id of B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width = len(self.b.bytes)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.n = np.zeros((1024, 4), np.int64)  # ids of A, ids of B, groups, place after the last pair; n_groups -1: bytes differ
        self.pairs, self.used = np.zeros(1 << 16, np.int64), 0

    def learn(self, texts: list[str]) -> None:
        """Adds distinct stretches. Those that end in no white space are encoded as one text, cut back by bytes."""
        if len(self.groups) + len(texts) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros((max(len(self.n), len(texts)), 4), np.int64)])
        plain = [t for t in texts if self.b.cuts and not t[-1].isspace()]
        run, size = [], 0
        for t in plain:
            run.append(t)
            size += len(t)
            if size >= AT_ONCE:
                self._run(run)
                run, size = [], 0
        if run:
            self._run(run)
        chosen = set(plain)
        for t in texts:
            if t not in chosen:
                self._run([t])

    def _run(self, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        whole = "".join(texts)
        a, b = (np.array(side.encode([whole])[0], np.int64) for side in (self.a, self.b))
        data = b"".join(raw)
        right = all(b"".join(map(side.bytes.__getitem__, ids.tolist())) == data for side, ids in ((self.a, a), (self.b, b)))
        ends = np.cumsum([len(r) for r in raw])
        stop_a, stop_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        if not right or not (np.isin(ends, stop_a).all() and np.isin(ends, stop_b).all()):
            if len(texts) > 1:  # one of them isn't given back byte for byte: each for itself
                half = len(texts) // 2
                self._run(texts[:half])
                self._run(texts[half:])
            else:
                self._add(texts[0], (0, 0, -1), "", a[:0])
            return
        low = np.searchsorted(stop_b, stop_a - self.a.length[a], "right")
        count = np.searchsorted(stop_b - self.b.length[b], stop_a, "left") - low
        pairs = np.repeat(a, count) * self.width + b[gather_runs(low, count)]
        both = np.intersect1d(stop_a, stop_b, assume_unique=True)
        cut_a, cut_b, links = np.searchsorted(stop_a, both) + 1, np.searchsorted(stop_b, both) + 1, np.cumsum(count)
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, x, y = [], 0, 0
        for p, q in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            groups.append(f"{','.join(names_a[x:p])}|{','.join(names_b[y:q])}")
            x, y = p, q
        upto = np.searchsorted(both, ends) + 1
        ends_a, ends_b = np.searchsorted(stop_a, ends) + 1, np.searchsorted(stop_b, ends) + 1
        ends_pairs = links[ends_a - 1]
        before = (0, 0, 0, 0)
        for t, *now in zip(texts, ends_a.tolist(), ends_b.tolist(), upto.tolist(), ends_pairs.tolist(), strict=True):
            self._add(t, tuple(n - m for n, m in zip(now[:3], before[:3], strict=True)), ";".join(groups[before[2] : now[2]]), pairs[before[3] : now[3]])
            before = now

    def _add(self, text: str, n: tuple[int, int, int], groups: str, pairs: np.ndarray) -> None:
        k = self.place[text] = len(self.groups)
        self.groups.append(groups)
        if self.used + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros(max(len(self.pairs), len(pairs)), np.int64)])
        self.pairs[self.used : self.used + len(pairs)] = pairs
        self.used += len(pairs)
        self.n[k] = (*n, self.used)

    def of(self, texts: list[str]) -> np.ndarray:
        """The places of stretches."""
        new = [t for t in texts if t not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            self.forget()
            new = texts
        self.learn(new)
        return np.fromiter(map(self.place.__getitem__, texts), np.int64, len(texts))


def stretches(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Stretches of a slice's texts, each with a space before it, and how many each text has. A text with white space other than
    blanks that a pattern looks across is one stretch."""
    docs = len(offsets) - 1
    line = np.insert(data, offsets[:-1], 0x20)  # a space before each text
    begin = offsets[:-1] + np.arange(docs)
    cut = np.zeros(len(line), bool)
    space = (line == 0x20) | ((line >= 0x09) & (line <= 0x0D)) | ((line >= 0x1C) & (line <= 0x1F))
    cut[1:] = (line[1:] == 0x20) & ~space[:-1]
    cut[begin] = True
    at = np.flatnonzero(cut)
    of = np.searchsorted(begin, at, "right") - 1
    ends = np.append(at[1:], len(line))
    high = np.flatnonzero(np.add.reduceat((line >= 0x80).astype(np.int64), begin)) if docs else []
    odd = [d for d in high if _WIDE_SPACE.search(column[int(d)].as_py() or "")]
    if len(odd):
        keep = ~np.isin(of, odd) | np.isin(at, begin)
        at, of = at[keep], of[keep]
        ends = np.append(at[1:], len(line))
    return strings(line, at, ends), np.bincount(of, minlength=docs)


def _slices(batches: Iterable[pa.RecordBatch], known: Known, seed: int) -> Iterator[tuple]:
    """For each slice: its number, ids of documents, their numbers (n_a, n_b, n_groups, n_links), digests, distinct pairs and how often each."""
    at = 0
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(1), SLICE):
            docs = j - i
            found, per_doc = stretches(batch.column(1).slice(i, docs), data, offsets)
            coded = pc.dictionary_encode(found)
            texts = coded.dictionary.cast(pa.string()).to_pylist()
            codes = coded.indices.to_numpy()
            place = known.of(texts)[codes]
            of = np.repeat(np.arange(docs), per_doc)
            n = known.n[place, :3]
            stop = known.n[place, 3]
            count = stop - np.where(place > 0, known.n[place - 1, 3], 0)
            bad = np.zeros(docs, bool)
            bad[of[n[:, 2] < 0]] = True
            bad |= np.diff(offsets) == 0  # no text
            sums = np.stack([np.bincount(of, x, docs) for x in (*n.T, count)], 1).astype(np.int64)
            sums[bad] = 0
            parts = np.array(known.groups, object)[place]
            bounds = np.append(0, np.cumsum(per_doc))
            digests = ["" if bad[d] else hashlib.sha256(";".join(parts[bounds[d] : bounds[d + 1]]).encode()).hexdigest() for d in range(docs)]
            use = ~bad[of]
            pairs = known.pairs[gather_runs((stop - count)[use], count[use])]
            doc = np.repeat(of[use], count[use])
            key = np.sort(pairs * docs + doc)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            yield seed << 32 | at, batch.column(0).slice(i, docs), sums, digests, key[new] // docs, (key[new] % docs).astype(np.int32), times.astype(np.int32)
            at += 1


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(a.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """A posting: how many documents' entries, of how many pairs, then the arrays."""
    return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *[x.tobytes() for x in arrays]])


def _unpacked(blob: pa.Scalar, *kinds: type) -> list[np.ndarray]:
    raw = blob.as_buffer()
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def encoded(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> Stored:
    """Written once: a row for each document (kind 2) and each posting of a slice (kind 1: pairs, entries of each, documents, multiplicities)."""
    from pyspark import TaskContext

    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    buckets = BUCKETS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_by_worker("crosstok")
        if (a_path, b_path) not in held:
            held[a_path, b_path] = Known(a_path, b_path)
        known = held[a_path, b_path]
        names = ["slice", "kind", "bucket", "place", "blob", "entries", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for number, ids, sums, digests, pair, doc, times in _slices(batches, known, TaskContext.get().partitionId()):
            docs = len(ids)
            null = lambda kind, n=docs: pa.nulls(n, kind)
            same = lambda x, n=docs, kind=None: pa.array(np.full(n, x), kind)
            yield pa.RecordBatch.from_arrays([same(number), same(2, kind=pa.int32()), null(pa.int32()), pa.array(np.arange(docs, dtype=np.int32)), null(pa.binary()), null(pa.int64()), ids, *[pa.array(np.ascontiguousarray(x)) for x in sums.T], pa.array(digests, pa.string())], names)
            bucket = _bucket(pair // known.width, buckets)
            order = np.argsort(bucket, kind="stable")  # pairs stay in order within a bucket
            bucket, pair, doc, times = bucket[order], pair[order], doc[order], times[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            own, blobs, entries = [], [], []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[k], cut[k + 1])
                first = np.flatnonzero(np.append(True, np.diff(pair[s]) != 0))
                own.append(k)
                blobs.append(_packed(pair[s][first], np.diff(np.append(first, s.stop - s.start)).astype(np.int32), doc[s], times[s]))
                entries.append(s.stop - s.start)
            n = len(own)
            if n:
                yield pa.RecordBatch.from_arrays([same(number, n), same(1, n, pa.int32()), pa.array(own, pa.int32()), same(docs, n, pa.int32()), pa.array(blobs, pa.binary()), pa.array(entries, pa.int64()), null(ids.type, n), *[null(pa.int64(), n)] * 4, null(pa.string(), n)], names)

    kind = dict(rows.dtypes)["id"]
    return Stored(rows.mapInArrow(tidy(run), f"slice long, kind int, bucket int, place int, blob binary, entries long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"), "postings")


def pair_counts(postings: DataFrame) -> DataFrame:
    """bucket, pair, docs: in how many documents each pair of ids stands linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pair, entries, _, _ = _unpacked(blob, np.int64, np.int32, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), bucket, np.int32)), pa.array(pair), pa.array(entries.astype(np.int64))], ["bucket", "pair", "docs"])

    return postings.select("bucket", "blob").mapInArrow(run, "bucket int, pair long, docs long").groupBy("bucket", "pair").agg(F.sum("docs").alias("docs"))


def contributions(rows: DataFrame) -> DataFrame:
    """slice, blob (links on a best pair and sum of counts, for each document of the slice) of each posting.

    rows, of one (bucket, salt) after another: its counts (kind 0, pairs ascending), then its postings (kind 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, [[], [], []]
        for batch in batches:
            of = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            key = np.stack([of[c].to_numpy() for c in ("bucket", "salt", "kind")], 1)
            cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)).tolist()
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (at := tuple(key[a, :2])) != now:
                    now, counts = at, [[], [], []]
                if key[a, 2] == 0:
                    for held, c in zip(counts, ("pair", "docs", "most"), strict=True):
                        held.append(of[c].slice(a, b - a).to_numpy())
                    continue
                counts = [[np.concatenate(c)] for c in counts]
                (pair,), (docs,), (most,) = counts
                for k in range(a, b):
                    p, entries, doc, times = _unpacked(of["blob"][k], np.int64, np.int32, np.int32, np.int32)
                    where = np.repeat(np.searchsorted(pair, p), entries)
                    n = of["place"][k].as_py()
                    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    np.add.at(total, doc, times * docs[where])
                    np.add.at(best, doc, times * (docs[where] == most[where]))
                    out.append((of["slice"][k].as_py(), _packed(best, total)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["slice", "blob"])

    return rows.mapInArrow(tidy(run), "slice long, blob binary")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Both tokenizers encode a space and the text, without special tokens (a: a byte-level BPE file of tokenizers; b: a
    sentencepiece model that adds the space). Groups end where tokens of both do. Links are the pairs of occurrences whose byte
    ranges overlap; a pair of ids counts in how many rows it stands linked. n_best is the number of links whose count is the
    highest of their id of a, ties included; count_sum is the sum of the links' counts. groups_sha256 is of `a1,a2|b1;a3|b2,b3`.
    A row whose text is null, empty, or isn't given back byte for byte has zeros and '', and counts nowhere. Repeated rows count
    each and have a row each. A very long text is encoded whole in one worker. An empty table gives no rows; other columns are
    left out. The paths must exist on all machines.
    """
    held = encoded(df, a_path, b_path, id_col, text_col)
    postings = held.read().where("kind = 1")
    width = len(Pieces(b_path).bytes)
    counts = Stored(pair_counts(postings).withColumn("a", F.expr(f"pair div {width}")), "counts")
    most = counts.read().groupBy("bucket", "a").agg(F.max("docs").alias("most"))
    # a bucket has as many tasks as its postings fill, each with the bucket's counts; a row for each bucket, BUCKETS at most
    salts = Stored(postings.groupBy("bucket").agg((F.floor(F.sum(F.octet_length("blob")) / TASK) + 1).cast("int").alias("salts")), "salts")
    salts = F.broadcast(salts.read())
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    salted = counts.read().join(most, ["bucket", "a"]).join(salts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    first = salted.select(null("long", "slice"), F.lit(0).alias("kind"), "bucket", "salt", null("binary", "blob"), null("int", "place"), "pair", "docs", "most")
    salt = F.pmod(F.xxhash64("slice"), F.col("salts")).cast("int").alias("salt")
    then = postings.join(salts, "bucket").select("slice", F.lit(1).alias("kind"), "bucket", salt, "blob", "place", *[null("long", c) for c in ("pair", "docs", "most")])
    rows = first.union(then).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "pair")
    given = contributions(rows).select("slice", F.lit(0).alias("kind"), "blob", *[F.lit(None).cast(t).alias(c) for c, t in held.read().dtypes if c not in ("slice", "kind", "blob", "bucket", "entries")])
    own = held.read().where("kind = 2").select(*given.columns)
    streams = given.union(own).repartition("slice").sortWithinPartitions("slice", "kind", "place")
    kind = dict(own.dtypes)["id"]

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, total = None, None, None
        for batch in batches:
            slices, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.flatnonzero(kinds == 0).tolist():
                x, y = _unpacked(batch.column(2)[k], np.int64, np.int64)
                # documents of the slices before this row go out first
                yield from rest_of(batch, slices, kinds, k, at, best, total)
                if slices[k] != at:
                    at, best, total = slices[k], x.copy(), y.copy()
                else:
                    best += x
                    total += y
            yield from rest_of(batch, slices, kinds, len(slices), at, best, total)

    def rest_of(batch, slices, kinds, end, at, best, total):
        begin = end
        while begin and kinds[begin - 1] == 2:
            begin -= 1
        if begin < end:
            b = batch.slice(begin, end - begin)
            place, own = b.column(3).to_numpy(), slices[begin:end] == at
            sums = [np.zeros(len(place), np.int64) for _ in range(2)]
            if own.any():
                for out, x in zip(sums, (best, total), strict=True):
                    out[own] = x[place[own]]
            names = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield pa.RecordBatch.from_arrays([names["id"], *[names[c] for c in ("n_a", "n_b", "n_groups", "n_links")], *map(pa.array, sums), names["groups_sha256"]], [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return streams.mapInArrow(tidy(finish), f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
