"""Packing along a space-filling curve.

Each document's tokens become a hashed count vector, a fixed random projection brings it to a few dimensions, and the cell
it falls in has a Hilbert key. Documents are range-sorted by that key and laid end to end along the curve; the stream is cut
into sequences, so neighbours on the curve share sequences and only the last one is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import ASCII_SPACE, LOWER, Stored, gather_runs, held_by_worker, mix, release_others, small_batches, strings, text_slices, tidy

#: Dimensions of the curve, bits of each, and places of the hashed vector.
DIMS, BITS, PLACES = 4, 10, 256
#: Distinct pieces a worker remembers between slices, bytes of text of a slice, and bytes of ids that a task sorts along the curve.
REMEMBERED, SLICE, SORTED = 1_000_000, 3 << 20, 32 << 20


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of each row of cell numbers (n x dims), by transposing Gray codes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((PLACES, DIMS)) / np.sqrt(PLACES)


_ASCII = np.arange(256) < 128
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that a tokenizer encodes alike with and without their neighbours, if it drops white space and splits between
    letters and other characters: at white space, from a letter to another ASCII character, and back but after an apostrophe."""
    space = ASCII_SPACE[data]
    letter = _LETTER[data]
    other = _ASCII[data] & ~letter & ~space
    ends = letter.copy()  # a letter ends here: of ASCII, or of two bytes from C3 80 on but the signs of multiplication and division
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begin = np.zeros(len(data), bool)
    begin[1:] = space[:-1] | (ends[:-1] & other[1:]) | (other[:-1] & (data[:-1] != 39) & letter[1:])
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begin & ~space)


class Grown:
    """An array that grows by doubling, so that adding to it costs by what is added."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            wider = np.zeros(max(2 * len(self.held), self.size + len(more)), self.held.dtype)
            wider[: self.size] = self.held[: self.size]
            self.held = wider
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


class Tokens:
    """Encodes slices of a text column piece by piece, for a tokenizer that lowers case and drops white space; used in one task."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.start, self.length = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    @staticmethod
    def of_worker(path: str) -> Tokens:
        """The one of this Python worker, which all its tasks share; what other operators hold there goes, for the worker is the same."""
        held = held_by_worker("tokens")
        if path not in held:
            release_others("tokens")
            held[path] = Tokens(path)
        return held[path]

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each of these distinct pieces in self.start and self.length."""
        got = list(map(self.known.get, found))
        new = [w for w, k in zip(found, got, strict=True) if k is None]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            got, new = [None] * len(found), found
        for k in range(0, len(new), 20_000):
            part = [w.decode() for w in new[k : k + 20_000]]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            first = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded))
            lengths = np.bincount(np.searchsorted(begin, first, "right"), minlength=len(part))
            self.start.add(self.ids.size + np.cumsum(lengths) - lengths)
            self.length.add(lengths)
            self.ids.add(np.array(coded.ids, np.uint32))
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        number = np.array([-1 if k is None else k for k in got], np.int64)
        number[number < 0] = np.arange(at, at + len(new))
        return number

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For slices of the column: all ids, the number of ids of each text, texts."""
        for i, j, data, offsets in text_slices(column, SLICE):
            if b"<|" in data.tobytes():  # the strings of special tokens: such a slice is encoded text by text
                whole = [self.tokenizer.encode(bytes(data[offsets[k] : offsets[k + 1]]).decode(), add_special_tokens=False).ids for k in range(j - i)]
                yield np.array([x for w in whole for x in w], np.uint32), np.array([len(w) for w in whole], np.int64), j - i
                continue
            at = _pieces(data, offsets)
            if not len(at):
                yield np.zeros(0, np.uint32), np.zeros(j - i, np.int64), j - i
                continue
            # a piece's range runs to the next piece; the white space at its end goes
            ranges = strings(LOWER[data[at[0] :]], at - at[0], np.append(at[1:], len(data)) - at[0])
            coded = pc.dictionary_encode(pc.ascii_rtrim_whitespace(ranges.cast(pa.string())))
            del ranges
            known = self.numbers(coded.dictionary.cast(pa.binary()).to_pylist())
            index = coded.indices.to_numpy()
            start, length = self.start.held[known], self.length.held[known]
            n = length[index]
            before = np.append(0, np.cumsum(n))
            yield self.ids.held[gather_runs(start[index], n)], np.diff(before[np.searchsorted(at, offsets)]), j - i


def _unit(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, curve (the Hilbert key), n, ids (binary, little-endian, of 16 bits if all ids fit, else 32): every whole text's ids, then end_id."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, project = Tokens.of_worker(tokenizer_path), _projection()
        unit = np.dtype(_unit(coder.tokenizer.get_vocab_size(), end_id))
        places = (mix(np.arange(coder.tokenizer.get_vocab_size(), dtype=np.uint64)) % np.uint64(PLACES)).astype(np.int64)
        for batch in batches:
            done = 0
            for flat, n, rows in coder.encode(batch.column(1)):
                counts = np.bincount(np.repeat(np.arange(rows) * PLACES, n) + places[flat], minlength=rows * PLACES).reshape(rows, PLACES).astype(np.float64)
                counts = np.sqrt(counts)
                norm = np.linalg.norm(counts, axis=1, keepdims=True)
                point = counts / np.maximum(norm, 1e-12) @ project
                cells = np.clip(((point * 3 + 0.5) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                key = hilbert(cells)
                whole = np.empty(len(flat) + rows, unit)
                end = np.cumsum(n + 1) - 1
                keep = np.ones(len(whole), bool)
                keep[end] = False
                whole[keep], whole[end] = flat, end_id
                offsets = np.append(0, (end + 1) * unit.itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, rows), pa.array(key), pa.array(n + 1), ids], [id_col, "curve", "n", "ids"])
                done += rows

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(tidy(run), f"`{id_col}` {kind}, curve long, n long, ids binary")


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", out: str = "digest") -> DataFrame:
    """Packs all documents into sequences of `length` ids; a row for each piece, a run of one document's ids in one sequence.

    id, start, length, doc_tokens, sequence_id, offset, and ids_crc32 (out="digest") or ids array<long> (out="ids"). A null or
    empty text is end_id alone. Repeated rows are packed each; ties on the curve go by id, nulls first. Pieces cover every
    sequence without gaps, but for the end of the last. No rows: no pieces. A very long text is encoded whole in one worker and
    cut over as many sequences as it fills. Other columns are left out. Two tables are written to the shared folder: the token
    ids, and the same in curve order.
    """
    spark = df.sparkSession
    tokens = Stored(tokenize(df, tokenizer_path, end_id, id_col, text_col), "tokens")
    total = tokens.read().agg(F.sum("n")).first()[0] or 0
    parts = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * total // SORTED)
    ordered = tokens.read().repartitionByRange(parts, "curve", f"`{id_col}`").sortWithinPartitions("curve", f"`{id_col}`")
    ordered = Stored(ordered.mapInArrow(tidy(_placed), T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])), "curve")
    tokens.drop()
    # one number a partition goes to the driver, so its size doesn't grow with a partition's rows
    totals = {r["part"]: r["total"] for r in ordered.read().groupBy("part").agg(F.sum("n").alias("total")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    kind = dict(df.dtypes)[id_col]
    last = "ids_crc32 long" if out == "digest" else "ids array<long>"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            begin = batch.column(4).to_numpy() + np.array([base[p] for p in batch.column(3).to_pylist()], np.int64)
            ids = batch.column(2)
            pieces = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // length + k
            first = np.maximum(begin[row], sequence * length)
            end = np.minimum(begin[row] + n[row], (sequence + 1) * length)
            start = first - begin[row]
            whole = [np.frombuffer(ids[i].as_buffer(), f"<u{ids[i].as_buffer().size // n[i]}").astype("<u4") for i in range(len(n))]
            parts = (whole[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), (end - begin[row]).tolist(), strict=True))
            held = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if out == "digest" else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - first), held, pa.array(n[row]), pa.array(sequence), pa.array(first - sequence * length)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", last.split()[0], "doc_tokens", "sequence_id", "offset"])

    placed = ordered.read().select(F.col(f"`{id_col}`"), "n", "ids", "part", "before")
    return placed.mapInArrow(tidy(cut), f"`{id_col}` {kind}, start long, length long, {last}, doc_tokens long, sequence_id long, offset long")


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of this partition, and for each row the tokens of the partition's rows before it."""
    from pyspark import TaskContext

    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        before = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])
