"""Jaccard join on word shingles: a blocked sparse matrix product of documents by shingles.

Documents with one shingle set are one class. The product (overlap counts of classes) is taken in blocks: first in groups of
classes that share a minimum hash, which find most links; then, exactly, in groups that share a shingle of the prefix that
every linked pair must share, in an order of shingles from rare to frequent. A group whose classes are in one component
already is done; of the others, pairs of blocks are multiplied, pairs are discarded by a bound of their sizes and bit maps,
and what stays is counted exactly. Components come from the links by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ASCII_SPACE, LOWER, Stored, mix, powers, small_batches, text_slices, tidy, tidy_table

#: Words in a shingle; two documents link when HUNDREDTHS * union <= 100 * intersection.
WORDS, HUNDREDTHS = 5, 80
#: Least bits of a class's map, minimum hashes of a class, classes of a block, tables that one call adds, bytes of text of a slice.
MAP, MINIMA, BLOCK, FAN, SLICE = 128, 2, 256, 64, 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = mix(np.arange(11, 11 + 8, dtype=np.uint64)) | np.uint64(1)
_INVERSE = pow(_BASE, -1, 1 << 64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, ascending, one text after another, and where each text's begin (n + 1 places).

    Words are runs without ASCII white space, A-Z lowered; a text of fewer words has its whole sequence as one."""
    docs = len(offsets) - 1
    low, space = LOWER[data], ASCII_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | fresh[1:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    stop = np.flatnonzero(space | fresh[:-1])
    end = np.append(stop, len(data))[np.searchsorted(stop, at, "right")]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    word = mix((sums[end] - sums[at]) * powers(_INVERSE, len(data))[at] + (end - at).astype(np.uint64))
    doc = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    full = np.zeros(len(at), bool)
    if len(at) >= words:
        full[: len(at) - words + 1] = doc[: len(at) - words + 1] == doc[words - 1 :]
    starts = np.flatnonzero(full)
    h = np.zeros(len(starts), np.uint64)
    for k in range(words):
        h += word[starts + k] * _PLACE[k]
    h, of = mix(h), doc[starts]
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():
        whole = (word[first[d] : first[d] + count[d]] * _PLACE[: count[d]]).sum(dtype=np.uint64)
        short = mix(np.array([whole], np.uint64) ^ np.uint64(count[d] * 0x51ED270B))
        where = np.searchsorted(of, d)
        h, of = np.insert(h, where, short), np.insert(of, where, d)
    bounds = np.searchsorted(of, np.arange(docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], np.append(0, np.cumsum(keep))[bounds]


def _reduce(f: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, np.uint64)
    some = bounds[:-1] < bounds[1:]
    if some.any():
        out[some] = f.reduceat(values, bounds[:-1][some])
    return out


def classes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as 16 bytes."""
    with np.errstate(over="ignore"):
        a = _reduce(np.add, mix(h ^ np.uint64(0xA0761D6478BD642F)), bounds, 0)
        b = _reduce(np.add, mix(h ^ np.uint64(0xE7037ED1A0B428DB)), bounds, 0)
    n = np.diff(bounds).astype(np.uint64)
    return np.stack([mix(a + n), mix(b ^ n)], 1)


def _fixed(rows: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes of one width as Arrow binary."""
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(data)])


def bit_maps(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The parity map of each set: each element flips one bit. Sets that differ in k elements have maps that differ in k bits at most.

    A map has a power of two of bits, as many as the set has elements or more, and MAP at least; folded(), it compares with
    the smaller map of another set."""
    n = np.diff(bounds)
    bits = np.maximum(MAP, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    flips = np.zeros(int(bits.sum()), np.uint8)
    hashed = (mix(h ^ np.uint64(0x8BB84B93962EACC9)) >> np.uint64(16)).astype(np.int64)
    np.add.at(flips, np.repeat(begin, n) + (hashed & (np.repeat(bits, n) - 1)), np.uint8(1))
    packed = np.packbits(flips & 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(bits) // 8).astype(np.int32)), pa.py_buffer(packed)])


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (a row each, of 64-bit words) brought down to `words` by laying halves over each other."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


class Maps:
    """The maps of a table's rows, those of one size side by side."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        blobs = [x.as_buffer() for x in column]
        self.words = np.array([b.size // 8 for b in blobs], np.int64)
        self.at = np.zeros(len(blobs), np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.at[rows] = np.arange(len(rows))
            self.held[w, w] = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), np.uint64).reshape(-1, w)

    def of(self, words: int, to: int) -> np.ndarray:
        if (words, to) not in self.held:
            self.held[words, to] = folded(self.held[words, words], to)
        return self.held[words, to]

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """In how many bits, at least, row x differs from each of the others."""
        own, out = int(self.words[x]), np.zeros(len(others), np.int64)
        size = self.words[others]
        for w in np.unique(size).tolist():
            some, to = np.flatnonzero(size == w), min(own, w)
            out[some] = np.bitwise_count(self.of(w, to)[self.at[others[some]]] ^ self.of(own, to)[self.at[x]]).sum(1, dtype=np.int64)
        return out


def enough(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray, hundredths: int) -> np.ndarray:
    return 100 * overlap >= hundredths * (n_a + n_b - overlap)


def prefix_length(n: int, hundredths: int) -> int:
    """So many of a set's first elements, in any fixed order, meet those of every set that links with it."""
    return n - -(-hundredths * n // 100) + 1


def link_sets(sets: list[np.ndarray], hundredths: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the same sets as all links do (a forest), by a product of the incidence matrices in blocks; pairs whose
    sizes alone rule a link out are left, and so are pairs of one label."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    flat = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    value, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(m), n[order])
    use = count[column] > 1
    row, column, width = row[use], shared[column[use]], int((count > 1).sum())
    n = n[order]
    root = np.arange(m)
    if labels is not None:
        _, root = np.unique(labels[order], return_inverse=True)
        first = np.full(root.max(initial=-1) + 1, -1)
        first[root[::-1]] = np.arange(m)[::-1]
        root = first[root]
    parent = root.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[int, int]] = []
    bounds = np.searchsorted(row, np.arange(0, m + 128, 128))
    for i in range(0, m, 128):
        a_end = min(m, i + 128)
        for j in range(i, m, 128):
            if n[j] * hundredths > 100 * n[a_end - 1]:
                break  # sizes only grow: no later block can link
            b_end = min(m, j + 128)
            overlap = np.zeros((a_end - i, b_end - j), np.float32)
            for c in range(0, width, 8192):
                a = np.zeros((a_end - i, min(8192, width - c)), np.float32)
                b = np.zeros((b_end - j, a.shape[1]), np.float32)
                for block, k, e in ((a, i, bounds[i // 128 + 1]), (b, j, bounds[j // 128 + 1])):
                    s = slice(bounds[k // 128], e)
                    inside = (column[s] >= c) & (column[s] < c + a.shape[1])
                    block[row[s][inside] - k, column[s][inside] - c] = 1
                overlap += a @ b.T
            x, y = np.nonzero(enough(n[i:a_end, None], n[None, j:b_end], overlap.astype(np.int64), hundredths))
            for p, q in zip((x + i).tolist(), (y + j).tolist(), strict=True):
                if p < q and (rp := find(p)) != (rq := find(q)):
                    parent[rq] = rp
                    links.append((int(order[p]), int(order[q])))
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of links (a, b); by star contraction, each round written out."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    held = Stored(edges, "edges")
    spark = links.sparkSession
    while True:
        e = held.read()
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # every larger neighbour of a node is joined to the least one around the node
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        next_ = Stored(small, "edges")
        # done when every edge leads to a root: no node is both an upper and a lower end
        now = next_.read()
        split = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = split or now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        held.drop()
        held = next_
        if not chained:
            break
    e = held.read()
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _summed(counts: DataFrame, chunk: str, blob: str, kind: type, f: np.ufunc, tasks: int, wide: type | None = None) -> dict[int, np.ndarray]:
    """Fixed-size vectors of tasks (part, from 0 to tasks), cut to chunks, combined chunk by chunk on the executors as a tree of
    FAN to a call; neither what a call gathers nor what comes to the driver grows with the data."""
    wide = wide or kind

    def added(first: bool):
        def add(table: pa.Table) -> pa.Table:
            total = None
            for b in table[blob]:
                x = np.frombuffer(b.as_buffer(), kind if first else wide).astype(wide)
                total = x if total is None else f(total, x)
            return pa.table({chunk: table[chunk].slice(0, 1), "part": table["part"].slice(0, 1), blob: pa.array([total.tobytes()], pa.binary())})

        return add

    rows, first = counts.select(chunk, "part", blob), True
    while first or tasks > 1:
        tasks = -(-tasks // FAN)
        group = F.floor(F.col("part") / FAN).cast("int")
        rows = rows.withColumn("part", group).groupBy(chunk, "part").applyInArrow(tidy_table(added(first)), f"{chunk} int, part int, {blob} binary")
        first = False
    return {r[chunk]: np.frombuffer(r[blob], wide) for r in rows.collect()}


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(keys[:, 0] % np.uint64(bits)).astype(np.int64), (keys[:, 1] % np.uint64(bits)).astype(np.int64), ((keys[:, 0] ^ (keys[:, 1] >> np.uint64(7))) % np.uint64(bits)).astype(np.int64)])


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": _binary([x for x, _ in links]), "b": _binary([y for _, y in links])})


def _linked(table: pa.Table, hundredths: int) -> pa.Table:
    """Links among the sets of one block (cid, set, and label where known)."""
    cid = table["cid"].to_pylist()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
    labels = np.unique(np.array(table["label"].to_pylist(), "S16"), return_inverse=True)[1] if "label" in table.column_names else None
    return _pairs([(cid[i], cid[j]) for i, j in link_sets(sets, hundredths, labels)])


class Join:
    """One run of the join over a table of documents; what several steps read is written to the shared folder."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, hundredths: int) -> None:
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.words, self.hundredths, self.id_kind = words, hundredths, dict(df.dtypes)[id_col]
        self.docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        self.parts = max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def describe(self) -> Stored:
        """A row for each document (chunk null), and the counts of shingles of each task, hashed to places, in chunks."""
        words, places, chunk = self.words, self.places, 1 << 16

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(places, np.uint32)
            kind = None
            names = ["id", "n", "cid", "map", *[f"m{i}" for i in range(MINIMA)], "chunk", "part", "counts"]
            for batch in batches:
                kind = batch.schema.field(0).type
                for i, j, data, offsets in text_slices(batch.column(1), SLICE):
                    h, bounds = shingles(data, offsets, words)
                    np.add.at(counts, (h >> np.uint64(8)).astype(np.int64) % places, np.uint32(1))
                    minima = [_reduce(np.minimum, mix(h ^ mix(np.array([77 + k], np.uint64))), bounds, 0).view(np.int64) for k in range(MINIMA)]
                    rows = j - i
                    columns = [batch.column(0).slice(i, rows), pa.array(np.diff(bounds)), _fixed(classes(h, bounds), 16), bit_maps(h, bounds), *[pa.array(m) for m in minima], pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if kind is not None:
                c = np.minimum(counts, 65535).astype(np.uint16)
                blobs = [c[k : k + chunk].tobytes() for k in range(0, places, chunk)]
                empty = [pa.nulls(len(blobs), t) for t in (kind, pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * MINIMA)]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(range(len(blobs)), pa.int32()), pa.array([_task()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names)

        minima = ", ".join(f"m{i} long" for i in range(MINIMA))
        return Stored(self.docs.mapInArrow(tidy(run), f"id {self.id_kind}, n long, cid binary, map binary, {minima}, chunk int, part int, counts binary"), "classes")

    def sets(self, wanted: DataFrame, n: int) -> DataFrame:
        """cid, set (binary) of the classes in `wanted` (cid); a Bloom filter of bounded size keeps most others from being sent."""
        bits = 1 << min(26, max(16, (10 * max(1, n)).bit_length()))

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, bool)
            for batch in batches:
                own[_places(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2), bits).ravel()] = True
            packed = np.packbits(own)
            blobs = [packed[k : k + 65536].tobytes() for k in range(0, len(packed), 65536)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array([_task()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "bits"])

        chunks = _summed(wanted.select("cid").coalesce(self.parts).mapInArrow(tidy(fill), "chunk int, part int, bits binary"), "chunk", "bits", np.uint8, np.bitwise_or, self.parts)
        bloom = self.spark.sparkContext.broadcast(b"".join(chunks[i].tobytes() for i in sorted(chunks)))
        words = self.words

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool) if bloom.value else np.zeros(bits, bool)
            sent: set[bytes] = set()
            for batch in batches:
                for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                    h, bounds = shingles(data, offsets, words)
                    keys = classes(h, bounds)
                    hit = have[_places(keys, bits)].all(0) & (np.diff(bounds) > 0)
                    rows = []
                    for d in np.flatnonzero(hit).tolist():
                        k = keys[d].tobytes()
                        if k not in sent:
                            sent.add(k)
                            rows.append((k, h[bounds[d] : bounds[d + 1]].tobytes()))
                    if len(sent) > 200_000:
                        sent.clear()
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["cid", "set"])

        found = self.docs.select("text").mapInArrow(tidy(run), "cid binary, `set` binary")
        return found.join(wanted.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])

    def run(self) -> DataFrame:
        self.places = 1 << 21
        described = self.describe()
        rows = described.read()
        self.counts = self._counts(rows)
        docs = rows.where("chunk is null").select("id", "n", "cid")
        own = [F.first(c).alias(c) for c in ("n", "map", *[f"m{i}" for i in range(MINIMA)])]
        one = Stored(rows.where("chunk is null and n > 0").groupBy("cid").agg(*own, F.min("id").alias("least")), "reps")
        first = self.by_minima(one.read())
        labels = Stored(components(first.read()), "labels")
        more = self.by_prefix(one.read(), labels.read())
        labels.drop()
        links = first.read().union(more.read()) if more is not None else first.read()
        final = Stored(components(links), "labels")
        for table in (first, more):
            if table is not None:
                table.drop()
        held = Stored(one.read().select("cid", "least"), "least")
        one.drop()
        named = final.read().withColumnRenamed("node", "cid").join(held.read(), "cid")
        # a row for each component, however large: what a task reads of one is combined before it is sent
        least = Stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "components")
        of = final.read().withColumnRenamed("node", "cid").join(least.read(), "label").select("cid", "component_id")
        known = Stored(held.read().join(of, "cid", "left").select("cid", F.coalesce("component_id", "least").alias("component_id")), "known")
        for table in (final, held, least):
            table.drop()
        return docs.join(known.read(), "cid", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))

    def _counts(self, rows: DataFrame) -> np.ndarray:
        tables = rows.where("chunk is not null").select("chunk", "part", "counts")
        tasks = (tables.agg(F.max("part")).first()[0] or 0) + 1
        chunks = _summed(tables, "chunk", "counts", np.uint16, np.add, tasks, np.uint32)
        counts = np.concatenate([chunks[i] for i in sorted(chunks)]) if chunks else np.zeros(self.places, np.uint32)
        # levels of three hundredths of a doubling: the order has 10 bits for them
        return np.minimum(32 * np.log2(1.0 + counts), 1023).astype(np.uint16)

    def by_minima(self, one: DataFrame) -> Stored:
        """Links among classes with one minimum hash, in blocks of about BLOCK of them."""
        keyed = one.select("cid", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"m{i}").alias("m")) for i in range(MINIMA)])).alias("x")).select("cid", "x.k", "x.m")
        sizes = Stored(keyed.groupBy("k", "m").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        salt = F.pmod(F.xxhash64("cid", "k"), F.ceil(F.col("size") / BLOCK)).cast("int")
        blocks = Stored(keyed.join(sizes.read(), ["k", "m"]).select("cid", F.xxhash64("k", "m", salt).alias("block")), "blocks")
        sizes.drop()
        sets = self.sets(blocks.read(), blocks.read().count())
        hundredths = self.hundredths
        links = Stored(self._by_block(blocks.read().join(sets, "cid"), "block", lambda t: _linked(t, hundredths)), "links")
        blocks.drop()
        return links

    def _by_block(self, rows: DataFrame, key: str, work) -> DataFrame:
        """Applies work (table of one block -> links) to blocks, many to a call."""

        def run(table: pa.Table) -> pa.Table:
            keys = table[key].to_numpy()
            order = np.argsort(keys, kind="stable")
            cut = np.flatnonzero(np.diff(keys[order])) + 1
            out = [work(table.take(pa.array(x))) for x in np.split(order, cut) if len(x) > 1]
            return pa.concat_tables(out) if out else _pairs([])

        bucket = F.pmod(F.xxhash64(F.lit(5), key), F.lit(self.parts * 4)).cast("int")
        return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(tidy_table(run), "a binary, b binary")

    def by_prefix(self, one: DataFrame, labels: DataFrame) -> Stored | None:
        """Links that the minima left: among classes of different components that share a shingle of their prefixes."""
        total = one.agg(F.sum("n")).first()[0] or 0
        if not total:
            return None
        buckets = max(self.parts, int(total * (100 - self.hundredths) / 100 / 500_000))
        groups = Stored(self.prefix_groups(buckets).dropDuplicates(["gid", "cid"]), "groups")
        # sizes in bands, so that sets that can link are in one band or in neighbours
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(self.hundredths, 99)) - 1e-9).cast("int").alias("band")
        classes_ = one.select("cid", band).join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "band", F.coalesce("label", "cid").alias("label"))
        labelled = Stored(groups.read().join(classes_, "cid").select("gid", "cid", "band", "label"), "labelled")
        groups.drop()
        # each of these joins meets a written table, so that Spark can split the rows of one group among tasks
        open_ = Stored(labelled.read().groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gid"), "open")
        left = Stored(labelled.read().join(open_.read(), "gid"), "left")
        labelled.drop()
        open_.drop()
        if not left.read().limit(1).count():
            left.drop()
            return None
        jobs = self.block_pairs(left, one.select("cid", "n", "map"))
        found = Stored(self._candidates(jobs.read(), jobs.read().count()).dropDuplicates(["job", "a", "b"]), "candidates")
        jobs.drop()
        pairs = found.read().where("job is null").select("a", "b").distinct()
        dense = found.read().where("job is not null")
        wanted = Stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(dense.select(F.col("a").alias("cid"))).distinct(), "wanted")
        n = wanted.read().count()
        if not n:
            return None
        sets = Stored(self.sets(wanted.read(), n), "sets")
        wanted.drop()
        hundredths = self.hundredths

        def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    keep.append(bool(enough(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), hundredths)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        a = sets.read().select(F.col("cid").alias("a"), F.col("set").alias("x"))
        b = sets.read().select(F.col("cid").alias("b"), F.col("set").alias("y"))
        few = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a binary, b binary")
        many = self._by_block(dense.select("job", F.col("a").alias("cid"), F.col("b").alias("label")).join(sets.read(), "cid"), "job", lambda t: _linked(t, hundredths))
        links = Stored(few.union(many), "links")
        found.drop()
        sets.drop()
        return links

    def prefix_groups(self, buckets: int) -> DataFrame:
        """gid, cid: groups of classes that share a shingle of their prefixes; groups with one membership have one gid."""
        words, hundredths = self.words, self.hundredths
        counts = self.spark.sparkContext.broadcast(self.counts.tobytes())
        entry = np.dtype([("g", np.uint64), ("c", "S16")])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent = np.frombuffer(counts.value, np.uint16)
            for batch in batches:
                found = []
                for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                    h, bounds = shingles(data, offsets, words)
                    keys = classes(h, bounds)
                    rank = frequent[(h >> np.uint64(8)).astype(np.int64) % len(frequent)]
                    # an order of all shingles from rare to frequent, by hash where equal: 10 bits of the count, 54 of the hash
                    order = (rank.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10))
                    _, first = np.unique(keys, axis=0, return_index=True)
                    for d in first.tolist():
                        s = slice(bounds[d], bounds[d + 1])
                        n = s.stop - s.start
                        if n:
                            p = prefix_length(n, hundredths)
                            top = np.argpartition(order[s], p - 1)[:p] if p < n else np.arange(n)
                            own = np.empty(len(top), entry)
                            own["g"], own["c"] = h[s][top], keys[d].tobytes()
                            found.append(own)
                if found:
                    whole = np.concatenate(found)
                    bucket = (whole["g"] % np.uint64(buckets)).astype(np.int32)
                    by = np.argsort(bucket, kind="stable")
                    whole, bucket = whole[by], bucket[by]
                    cut = np.flatnonzero(np.diff(bucket)) + 1
                    parts = np.split(whole, cut)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[np.append(0, cut)]), _binary([p.tobytes() for p in parts])], ["bucket", "entries"])

        def gather(table: pa.Table) -> pa.Table:
            whole = np.concatenate([np.frombuffer(x.as_buffer(), entry) for x in table["entries"]])
            whole = whole[np.argsort(whole["g"], kind="stable")]
            g = whole["g"]
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[:-1] |= same[1:]
            whole = whole[same]
            if not len(whole):
                return pa.table({"gid": pa.array([], pa.int64()), "cid": _binary([])})
            g = whole["g"]
            key = whole["c"].copy().view(np.uint64).reshape(-1, 2)
            group = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
            by = np.lexsort((key[:, 1], key[:, 0], group))
            key, group = key[by], group[by]
            new = np.append(True, (key[1:] != key[:-1]).any(1) | (group[1:] != group[:-1]))
            key, group = key[new], group[new]
            start = np.flatnonzero(np.append(True, np.diff(group) > 0))
            size = np.diff(np.append(start, len(group)))
            with np.errstate(over="ignore"):
                sign = mix(np.add.reduceat(mix(key[:, 0] ^ mix(key[:, 1])), start) + size.astype(np.uint64))
            _, take = np.unique(sign, return_index=True)
            take = take[size[take] > 1]
            keep = np.zeros(len(start), bool)
            keep[take] = True
            keep = np.repeat(keep, size)
            gid = np.repeat(sign, size)[keep].view(np.int64)
            return pa.table({"gid": gid, "cid": _fixed(key[keep], 16)})

        blobs = self.docs.select("text").mapInArrow(tidy(run), "bucket int, entries binary")
        return blobs.groupBy("bucket").applyInArrow(tidy_table(gather), "gid long, cid binary")

    def block_pairs(self, left: Stored, maps: DataFrame) -> Stored:
        """job, side, cid, label, n, map: the pairs of blocks of each open group, as far as their bands can link. A large component
        of a group has blocks of its own, and pairs of blocks of one component are left out. Drops `left`."""
        sizes = Stored(left.read().groupBy("gid", "label", "band").agg(F.count("*").alias("own")), "sizes")
        small = sizes.read().where(F.col("own") <= BLOCK).groupBy("gid", "band").agg(F.sum("own").alias("small"))
        sized = sizes.read().join(small, ["gid", "band"], "left")
        salt = F.pmod(F.xxhash64("cid"), F.ceil(F.col("own") / BLOCK))
        block: Column = F.when(F.col("own") > BLOCK, F.xxhash64("band", "label", salt)).otherwise(F.xxhash64("band", F.pmod(F.xxhash64("label"), F.ceil(F.col("small") / BLOCK))))
        held = Stored(sized, "sized")
        rows = Stored(left.read().join(held.read(), ["gid", "label", "band"]).select("gid", "cid", "label", "band", block.alias("block")), "rows")
        for table in (left, sizes, held):
            table.drop()
        blocks = Stored(rows.read().groupBy("gid", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("band").alias("band")), "blocks")
        a = blocks.read().select("gid", F.col("block").alias("p"), F.col("low").alias("pl"), F.col("high").alias("ph"), F.col("band").alias("pb"))
        b = blocks.read().select("gid", F.col("block").alias("q"), F.col("low").alias("ql"), F.col("high").alias("qh"), F.col("band").alias("qb"))
        one_label = (F.col("pl") == F.col("ph")) & (F.col("ql") == F.col("qh")) & (F.col("pl") == F.col("ql"))
        near = F.abs(F.col("pb") - F.col("qb")) <= 1
        pairs = a.join(b, "gid").where((F.col("p") <= F.col("q")) & near & ~one_label).select("gid", F.xxhash64("gid", "p", "q").alias("job"), "p", "q")
        ends = pairs.select("gid", "job", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("block")), F.struct(F.when(F.col("p") == F.col("q"), 0).otherwise(1).alias("side"), F.col("q").alias("block"))))).alias("x"))
        ends = Stored(ends.select("gid", "job", "x.side", "x.block"), "ends")
        blocks.drop()
        jobs = Stored(ends.read().join(rows.read(), ["gid", "block"]).select("job", "side", "cid", "label").join(maps, "cid"), "pairs")
        ends.drop()
        rows.drop()
        return jobs

    def _candidates(self, jobs: DataFrame, rows: int) -> DataFrame:
        """Pairs of a job that sizes and bit maps don't rule out: (null, a, b) each; where they are many, the job's members (job, cid, label)."""
        hundredths = self.hundredths

        def run(table: pa.Table) -> pa.Table:
            job = table["job"].to_numpy()
            cid = table["cid"].to_pylist()
            label_of = table["label"].to_pylist()
            label = np.unique(np.array(label_of, "S16"), return_inverse=True)[1]
            side, n = table["side"].to_numpy(), table["n"].to_numpy()
            maps = Maps(table["map"])
            order = np.argsort(job, kind="stable")
            out: list[tuple[int | None, bytes, bytes]] = []
            for rows in np.split(order, np.flatnonzero(np.diff(job[order])) + 1):
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                alone = not len(right)
                right = left if alone else right
                hits: list[tuple[int, int]] = []
                for i, x in enumerate(left.tolist()):
                    other = right[i + 1 :] if alone else right
                    other = other[label[other] != label[x]]
                    other = other[(n[other] * hundredths <= 100 * n[x]) & (n[x] * hundredths <= 100 * n[other])]
                    most = (n[other] + n[x] - maps.apart(x, other)) // 2
                    hits += [(x, y) for y in other[enough(n[other], n[x], most, hundredths)].tolist()]
                if len(hits) > 8 * len(rows):
                    members = {x for h in hits for x in h}
                    out += [(int(job[rows[0]]), cid[x], label_of[x]) for x in members]
                else:
                    out += [(None, min(cid[x], cid[y]), max(cid[x], cid[y])) for x, y in hits]
            return pa.table({"job": pa.array([x[0] for x in out], pa.int64()), "a": _binary([x[1] for x in out]), "b": _binary([x[2] for x in out])})

        bucket = F.pmod(F.xxhash64(F.lit(9), "job"), F.lit(max(self.parts * 4, rows // 20_000))).cast("int")
        return jobs.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(tidy_table(run), "job long, a binary, b binary")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, hundredths: int = HUNDREDTHS) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links lead to, the row's own included) of every row.

    Two documents link when 100 * intersection >= hundredths * union of their sets of shingles, words lower-cased for A-Z. A
    text with fewer words than a shingle has its whole sequence as one; a null text or one without words has none and links
    with nothing. Equal texts are linked. Repeated rows have a row each; a row of null id takes its component's id. Of equal
    sizes and counts the order of shingles is that of their hashes. Shingles are compared by 64-bit hashes. A very long text is
    shingled whole in one worker, with some hundred bytes for each of its words. An empty table gives no rows. Other columns
    are left out.
    """
    found = Join(df, id_col, text_col, words, hundredths).run()
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")
