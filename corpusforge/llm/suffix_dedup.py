"""Removal of long repeated byte strings by a hash-compared suffix sort.

Strings of `length` bytes are found by anchors: the least hash of a gram in each of them, which equal strings share. The
strings of one anchor start side by side and make a block. Blocks of anchors that stand in two places or more are compared:
equal blocks byte by byte; where blocks differ, their suffixes are sorted: mergesort, each comparison by binary search over
prefix polynomial hashes for the common extension, so in logarithmic time; neighbours in the order then give the strings that
two blocks share, and their bytes are compared, against collisions. An anchor of many blocks is sorted in groups of bounded
size, whose orders are merged: what no other string of its group equals meets the groups' other strings by hash, and the
bytes are compared again. What repeats is worked out once for each distinct block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import Stored, gather_runs, held_by_worker, mix, powers, small_batches, text_slices, tidy, tidy_table
from corpusforge.llm.ngram_join import _summed, _task

#: Bytes of a string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 400, 200
#: Bytes of a repeated passage: any fifty words of prose are longer.
PASSAGE = 200
#: Distinct blocks of an anchor up to which suffixes at the anchor are sorted, and those at every start beyond; both find the same.
FEW = 32
#: Distinct blocks that one sort holds.
GROUP = 512
#: Most bits of the filter of anchors; entries and bytes of contexts that a task holds at once.
BITS, ENTRIES, HELD = 1 << 28, 1 << 19, 32 << 20
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
#: Bytes of text that are hashed at once, so that the arrays stay in the cache; a longer text is taken in stretches.
_SLICE, _STRETCH = 1 << 16, 1 << 20


def _powers(base: int, bits: int) -> np.ndarray:
    """At least 2^bits powers of the base; a worker keeps as many as it has needed."""
    held = held_by_worker("powers")
    if len(held.get(base, ())) < 1 << bits:
        held[base] = powers(base, 1 << bits)
    return held[base]


def _sums(data: np.ndarray) -> np.ndarray:
    """H with H[i] the sum of byte values times powers of the base before i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data).bit_length())[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def _hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (h[end] - h[start]) * _powers(_INVERSE, (len(h) - 1).bit_length())[start]


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The blocks of each text: doc, first start s (in data), count w of starts, place of the anchor from s, hash of the
    anchor's gram, and hash of the block's bytes [s, s + w - 1 + length)."""
    n = len(data)
    if n < length or not (np.diff(offsets) >= length).any():
        e = np.zeros(0, np.int64)
        return {"doc": e, "s": e, "w": e, "off": e, "gram": e.astype(np.uint64), "block": e.astype(np.uint64)}
    h = _sums(data)
    width = length - gram + 1
    q = np.arange(n - gram + 1)
    g = mix((h[gram:] - h[: n - gram + 1]) * _powers(_INVERSE, n.bit_length())[: n - gram + 1])
    key = (g & np.uint64(0xFFFFFFFF00000000)) | q.astype(np.uint64)
    # the least key of each window of `width` places, from the least before and after in stretches of that width
    padded = np.full(-(-len(key) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    doc = np.searchsorted(offsets, np.arange(starts), "right") - 1 if len(offsets) > 4096 else np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    p = np.flatnonzero(np.arange(starts) + length <= offsets[doc + 1])
    anchor = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    w = np.diff(np.append(first, len(p)))
    s = p[first]
    return {"doc": doc[s], "s": s, "w": w, "off": anchor[first] - s, "gram": g[anchor[first]], "block": mix(_hash(h, s, s + w - 1 + length) + (w * 2 + 1).astype(np.uint64))}


def stretches(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Slices of a text column: first row, end row, bytes, offsets, and the place in its text where the slice begins. A long text
    comes in stretches that overlap by a byte less than a string, so that each string is in one of them as a whole."""
    for i, j, data, offsets in text_slices(column, _SLICE):
        if j - i > 1 or len(data) <= _STRETCH + length:
            yield i, j, data, offsets, 0
            continue
        for at in range(0, len(data) - length + 1, _STRETCH):
            part = data[at : at + _STRETCH + length - 1]
            yield i, j, part, np.array([0, len(part)]), at


class Suffixes:
    """Contexts laid end to end, and comparisons of their suffixes."""

    def __init__(self, contexts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.h = _sums(self.data)

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the suffixes at x and y agree, up to `most`, by binary search over their hashes."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
        inverse = _powers(_INVERSE, (len(self.h) - 1).bit_length())
        px, py, hx, hy = inverse[x], inverse[y], self.h[x], self.h[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.h[x + mid] - hx) * px == (self.h[y + mid] - hy) * py
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common_before(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the bytes before x and before y agree, up to `most`."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
        inverse = _powers(_INVERSE, (len(self.h) - 1).bit_length())
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.h[x] - self.h[x - mid]) * inverse[x - mid] == (self.h[y] - self.h[y - mid]) * inverse[y - mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves are equal: what the hashes said, verified."""
        out = np.ones(len(x), bool)
        for at in range(0, len(x), 4096):
            s = slice(at, at + 4096)
            some = np.flatnonzero(size[s] > 0) + at
            if len(some):
                bad = self.data[gather_runs(x[some], size[some])] != self.data[gather_runs(y[some], size[some])]
                out[some] = ~np.logical_or.reduceat(bad, np.cumsum(size[some]) - size[some])
        return out

    def sort(self, group: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The order of the suffixes [at, at + size) in each group (ascending, groups side by side): mergesort, all runs of a
        level at once, each element finding its place in the other run by binary search."""
        n = len(at)
        order = np.arange(n)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, n))
        base, total = np.repeat(begin, count), np.repeat(count, count)
        place = np.arange(n) - base
        width = 1
        while width < count.max(initial=1):
            run = place // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, total), np.minimum(other + width, total)
            start, first = low.copy(), (run & 1) == 0
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                x, y = order[live], order[base[live] + mid]
                common = self.common(at[x], at[y], np.minimum(size[x], size[y]))
                ended_y, ended_x = common >= size[y], common >= size[x]
                after = ~(ended_x | ended_y)
                less = np.where(ended_x, ended_y & (size[y] < size[x]), True)  # y before x
                less[after] = self.data[(at[y] + common)[after]] < self.data[(at[x] + common)[after]]
                tie = (ended_x & ended_y) & (size[x] == size[y])
                less = np.where(tie, ~first[live], less)
                low[live] = np.where(less, mid + 1, low[live])
                high[live] = np.where(less, high[live], mid)
                live = live[low[live] < high[live]]
            target = base + (run & ~1) * width + (place - run * width) + (low - start)
            moved = np.empty(n, np.int64)
            moved[target] = order
            order = moved
            width *= 2
        return order


def repeats(gram: np.ndarray, off: np.ndarray, w: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct blocks (those of a group side by side, gram numbers the group): block, first and last start in it, of stretches of starts whose strings are in another block."""
    text = Suffixes(contexts)
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    count = np.diff(np.append(begin, len(gram)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    few = np.repeat(count <= FEW, count) & np.repeat(count > 1, count)
    at = np.flatnonzero(few)
    if len(at):
        # the sparse suffix array of the anchors, with the common extensions of neighbours
        anchor = text.start + off
        order = at[text.sort(gram[at], anchor[at], (text.end - anchor)[at])]
        same = gram[order[1:]] == gram[order[:-1]]
        ahead = np.zeros(len(order), np.int64)
        x, y = order[:-1], order[1:]
        ahead[:-1] = np.where(same, text.common(anchor[x], anchor[y], np.where(same, np.minimum(text.end[x] - anchor[x], text.end[y] - anchor[y]), 0)), 0)
        right = ahead.copy()
        for d in range(1, min(FEW, len(order))):
            # right: the least extension on the way from each to the d-th after it
            pair = np.flatnonzero(right[: len(order) - d] > 0)
            pair = pair[gram[order[pair]] == gram[order[pair + d]]]
            if not len(pair):
                break
            x, y, r = order[pair], order[pair + d], right[pair]
            most = np.minimum(off[x], off[y])
            use = r + most >= length
            x, y, r, most = x[use], y[use], r[use], most[use]
            left = text.common_before(anchor[x], anchor[y], most)
            use = r + left >= length
            x, y, r, left = x[use], y[use], r[use], left[use]
            good = text.equal(anchor[x] - left, anchor[y] - left, left + r)
            for k in np.flatnonzero(~good).tolist():  # a collision: count by the bytes themselves
                a, b = contexts[x[k]], contexts[y[k]]
                i, j = int(off[x[k]]), int(off[y[k]])
                n = 0
                while n < min(len(a) - i, len(b) - j) and a[i + n] == b[j + n]:
                    n += 1
                m = 0
                while m < min(i, j) and a[i - m - 1] == b[j - m - 1]:
                    m += 1
                r[k], left[k] = n, m
            for b in (x, y):
                lo, hi = np.maximum(off[b] - left, 0), np.minimum(off[b] + r - length, w[b] - 1)
                use = lo <= hi
                out.append((b[use], lo[use], hi[use]))
            shifted = np.zeros(len(order), np.int64)
            shifted[: len(order) - d] = np.minimum(right[: len(order) - d], ahead[d:])
            right = shifted
    for i in np.flatnonzero(count > FEW).tolist():
        own = np.arange(begin[i], begin[i] + count[i])
        # the suffixes at every start, side by side where they are equally far from the anchor
        block = np.repeat(own, w[own])
        start = np.arange(len(block)) - np.repeat(np.cumsum(w[own]) - w[own], w[own])
        away = off[block] - start
        by = np.argsort(away, kind="stable")
        block, start, away = block[by], start[by], away[by]
        where = text.start[block] + start
        size = np.full(len(where), length)
        order = text.sort(away, where, size)
        block, start, where, away = block[order], start[order], where[order], away[order]
        near = np.flatnonzero(away[1:] == away[:-1])
        near = near[text.common(where[near], where[near + 1], size[near]) >= length]
        near = near[text.equal(where[near], where[near + 1], size[near])]
        hit = np.unique(np.concatenate([near, near + 1]))
        out.append((block[hit], start[hit], start[hit]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of [start, end) spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: What an entry is: of an anchor that stands twice in its task; one for all such, to tell other tasks; of an anchor that stands once.
_FOUND, _TOLD, _ALONE = 0, 1, 2
_ENTRY = np.dtype([("gram", np.uint64), ("block", np.uint64), ("key", "S16"), ("s", np.uint64), ("w", np.uint16), ("kind", np.uint8)])


def _combined(x: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A task's entries: those of an anchor that stands in two places of them need no other task, and one of them tells the rest.
    So no bucket gets more than an entry a task for an anchor, however often it stands."""
    x = x[np.argsort(x["gram"], kind="stable")]
    new = np.append(True, x["gram"][1:] != x["gram"][:-1])
    alone = new & np.append(new[1:], True)
    told = x[new & ~alone]
    x["kind"] = np.where(alone, _ALONE, _FOUND)
    told["kind"] = _TOLD
    key = x["key"].copy().view(np.uint64).reshape(-1, 2)[:, 0]
    bucket = np.concatenate([np.where(alone, x["gram"], key), told["gram"]]) % np.uint64(buckets)
    whole = np.concatenate([x, told])
    by = np.argsort(bucket, kind="stable")
    whole, bucket = whole[by], bucket[by].astype(np.int32)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return pa.RecordBatch.from_arrays([pa.array(bucket[np.append(0, cut)]), pa.array([p.tobytes() for p in np.split(whole, cut)], pa.binary())], ["bucket", "entries"])


def _shared(table: pa.Table) -> pa.Table:
    """The entries of a bucket whose anchor stands in two places or more."""
    x = np.concatenate([np.frombuffer(e.as_buffer(), _ENTRY) for e in table["entries"]])
    found, open_ = x[x["kind"] == _FOUND], x[x["kind"] != _FOUND]
    key = open_["key"].copy().view(np.uint64).reshape(-1, 2)
    by = np.lexsort((open_["s"], key[:, 1], key[:, 0], open_["gram"]))
    open_, key = open_[by], key[by]
    if len(open_):
        new = np.append(True, open_["gram"][1:] != open_["gram"][:-1])
        other = new | np.append(True, (key[1:] != key[:-1]).any(1) | (open_["s"][1:] != open_["s"][:-1]))
        group = np.cumsum(new) - 1
        many = (np.bincount(group, other) > 1) | (np.bincount(group, open_["kind"] == _TOLD) > 0)
        found = np.concatenate([found, open_[many[group] & other & (open_["kind"] == _ALONE)]])
    ids = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.arange(0, 16 * len(found) + 16, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(found["key"]).view(np.uint8))])
    return pa.table({"gram": found["gram"].astype(np.int64), "block": found["block"].astype(np.int64), "key": ids, "s": found["s"].astype(np.int64), "w": found["w"].astype(np.int32)})


class Dedup:
    """One run over the texts (text, a column of strings without nulls); what several steps read is written to the shared folder."""

    def __init__(self, texts: DataFrame, length: int) -> None:
        self.spark = texts.sparkSession
        small_batches(self.spark)
        self.length, self.gram = length, max(1, length // 2)
        self.texts = texts.where(F.octet_length("text") >= length)
        self.parts = max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def spans(self) -> Stored:
        """key (md5 of the text), spans array<struct<s, e>> of starts of repeated strings, of texts with any."""
        total = self.texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        found = Stored(self.entries(max(self.parts, total // self.gram // 250_000)), "anchors")
        n = found.read().count()
        contexts = Stored(self.contexts(found.read(), n), "contexts")
        counts = contexts.read().groupBy("gram").agg(F.count_distinct("block").alias("n"))
        large = Stored(counts.where(F.col("n") > GROUP).withColumnRenamed("n", "n_all"), "large")
        resolved = Stored(self.resolve(contexts.read(), large.read(), contexts.read().count()), "resolved")
        marks = resolved.read().where("a is null").select("gram", "block", "lo", "hi")
        more = self.merged(contexts, large, resolved) if large.read().limit(1).count() else None
        marks = Stored(marks.union(more.read()) if more else marks, "marks")
        for table in (contexts, large, resolved, *([more] if more else ())):
            table.drop()
        where = found.read().join(marks.read(), ["gram", "block"]).select("key", (F.col("s") + F.col("lo")).alias("s"), (F.col("s") + F.col("hi") + 1).alias("e"))
        spans = Stored(where.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
        found.drop()
        marks.drop()
        return spans

    def entries(self, buckets: int) -> DataFrame:
        """gram, block, key, s, w of the blocks whose anchor stands in two places or more."""
        length, gram = self.length, self.gram

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            held: list[np.ndarray] = []
            count = 0
            for batch in batches:
                column = batch.column(0)
                fresh: dict[int, bytes] = {}
                for row in range(batch.num_rows):
                    k = hashlib.md5(column[row].as_buffer()).digest()
                    if k not in seen:
                        seen.add(k)
                        fresh[row] = k
                for i, j, data, offsets, begin in stretches(column, length):
                    b = blocks(data, offsets, length, gram)
                    keys, keep = np.zeros(j - i, "S16"), np.zeros(j - i, bool)
                    for d in range(i, j):
                        if d in fresh:
                            keys[d - i], keep[d - i] = fresh[d], True
                    use = keep[b["doc"]]
                    own = np.empty(int(use.sum()), _ENTRY)
                    for name in ("gram", "block", "w"):
                        own[name] = b[name][use]
                    own["key"], own["s"] = keys[b["doc"][use]], (b["s"] - offsets[b["doc"]])[use] + begin
                    held.append(own)
                    count += len(own)
                    if count > ENTRIES:
                        yield _combined(np.concatenate(held), buckets)
                        held, count = [], 0
                if len(seen) > 200_000:
                    seen.clear()
            if count:
                yield _combined(np.concatenate(held), buckets)

        packed = self.texts.select("text").mapInArrow(tidy(run), "bucket int, entries binary")
        return packed.groupBy("bucket").applyInArrow(tidy_table(_shared), "gram long, block long, key binary, s long, w int")

    def contexts(self, found: DataFrame, n: int) -> DataFrame:
        """gram, block, off, w, n, context: the distinct blocks of a task whose anchor was found, and in how many places of it they
        stand, equal in bytes. The anchors are told by a Bloom filter of bounded size, so there are a few more."""
        bits = 1 << min(BITS.bit_length() - 1, max(16, (12 * n).bit_length()))

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits >> 3, np.uint8)
            for batch in batches:
                at = _bloom(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            parts = [own[k : k + 65536].tobytes() for k in range(0, len(own), 65536)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([_task()] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part", "bits"])

        chunks = _summed(found.select("gram").distinct().coalesce(self.parts).mapInArrow(tidy(fill), "chunk int, part int, bits binary"), "chunk", "bits", np.uint8, np.bitwise_or, self.parts)
        bloom = self.spark.sparkContext.broadcast(b"".join(chunks[i].tobytes() for i in sorted(chunks)) or bytes(bits >> 3))
        length, gram = self.length, self.gram
        names = ["gram", "block", "off", "w", "n", "context"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = np.frombuffer(bloom.value, np.uint8)
            held: dict[tuple[int, bytes], list[int]] = {}
            size = 0

            def sent() -> pa.RecordBatch:
                rows = list(held.items())
                numbers = np.array([v for _, v in rows], np.int64).reshape(-1, 4)
                columns = [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array(numbers[:, 0]), *[pa.array(numbers[:, c].astype(np.int32)) for c in (1, 2, 3)], pa.array([k[1] for k, _ in rows], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names)

            for batch in batches:
                for _, _, data, offsets, _ in stretches(batch.column(0), length):
                    b = blocks(data, offsets, length, gram)
                    hit = np.flatnonzero(((have[(at := _bloom(b["gram"], bits)) >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)) if len(b["gram"]) else np.zeros(0, np.int64)
                    rows = zip(*(b[c][hit].tolist() for c in ("s", "w", "off")), b["gram"][hit].view(np.int64).tolist(), b["block"][hit].view(np.int64).tolist(), strict=True)
                    for s, w, off, g, block in rows:
                        k = (g, data[s : s + w - 1 + length].tobytes())
                        if k in held:
                            held[k][3] += 1
                        else:
                            held[k] = [block, off, w, 1]
                            size += len(k[1])
                    if size > HELD:
                        yield sent()
                        held, size = {}, 0
            if held:
                yield sent()

        return self.texts.select("text").mapInArrow(tidy(run), "gram long, block long, off int, w int, n int, context binary")

    def resolve(self, contexts: DataFrame, large: DataFrame, rows: int) -> DataFrame:
        """gram, block, lo, hi: starts in a block whose strings stand elsewhere too; the strings equal in a group of GROUP blocks.
        With a, b (a string's hash): of anchors with several groups, the starts that others must be asked about (own: not
        known yet to repeat)."""
        length = self.length

        def run(table: pa.Table) -> pa.Table:
            gram, salt, block, large_ = (table[c].to_numpy() for c in ("gram", "salt", "block", "large"))
            by = np.lexsort((block, salt, gram))
            gram, salt, block, large_ = gram[by], salt[by], block[by], large_[by]
            off, w, times = (table[c].to_numpy().astype(np.int64)[by] for c in ("off", "w", "n"))
            context = table["context"].take(pa.array(by)).to_pylist()
            first = np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]))
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            for k in np.flatnonzero(~first).tolist():
                if context[k] != context[head[k]]:
                    raise ValueError("two strings have one hash of 128 bits")
            times = np.add.reduceat(times, np.flatnonzero(first)) if len(times) else times
            gram, salt, block, large_, off, w = (x[first] for x in (gram, salt, block, large_, off, w))
            context = [context[k] for k in np.flatnonzero(first).tolist()]
            begin = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))) if len(gram) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(gram))))
            whole, none = np.flatnonzero(times > 1), np.zeros(0, np.int64)
            out: list[tuple[np.ndarray, ...]] = [(whole, np.zeros(len(whole), np.int64), w[whole] - 1)]
            asked_: list[tuple[np.ndarray, ...]] = []
            i = 0
            while i < len(gram):
                # whole groups, about 4000 blocks at a time
                j = int(np.append(begin, len(gram))[np.searchsorted(begin, i + 4000, "right")]) if i + 4000 < len(gram) else len(gram)
                b, lo, hi = repeats(group[i:j], off[i:j], w[i:j], context[i:j], length)
                out.append((b + i, lo, hi))
                asked = np.flatnonzero(large_[i:j]) + i
                if len(asked):
                    asked_.append(_unmatched(asked, w, times, context, (b + i, lo, hi), length))
                i = j
            at, lo, hi = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(3))
            at, lo, hi = _joined(at, lo, hi)
            told = [np.concatenate([x[k] for x in asked_] or [none]).astype(np.int64) for k in range(5)]
            mask = np.append(np.ones(len(at), bool), np.zeros(len(told[0]), bool))
            both = lambda x, y: pa.array(np.append(x, y), mask=mask)
            at, lo, hi = np.append(at, told[0]), np.append(lo, told[1]), np.append(hi, told[1])
            zero = np.zeros(len(mask) - len(told[0]), np.int64)
            return pa.table({"gram": gram[at], "block": block[at], "lo": lo, "hi": hi, "a": both(zero, told[2]), "b": both(zero, told[3]), "own": pa.array(np.append(zero, told[4]) == 1)})

        salted = contexts.join(large, "gram", "left").withColumn("salt", F.when(F.col("n_all").isNull(), 0).otherwise(F.pmod(F.xxhash64("block"), F.ceil(F.col("n_all") / GROUP))).cast("long"))
        bucket = F.pmod(F.xxhash64("gram", "salt"), F.lit(max(self.parts, rows // 20_000))).cast("int")
        rows_ = salted.select("gram", "salt", "block", "off", "w", "n", "context", F.col("n_all").isNotNull().alias("large"), bucket.alias("bucket"))
        return rows_.groupBy("bucket").applyInArrow(tidy_table(run), "gram long, block long, lo long, hi long, a long, b long, own boolean")

    def merged(self, contexts: Stored, large: Stored, resolved: Stored) -> Stored:
        """The groups of an anchor, merged: gram, block, lo, hi of starts whose strings stand in blocks of another group. Strings
        meet by hash, each with one of the others, and bytes are compared."""
        length = self.length
        asked = resolved.read().where("a is not null")
        met = asked.groupBy("gram", "a", "b").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y")
        met = Stored(met, "met")
        other = F.when(F.col("block") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("other")
        hits = asked.where("own").join(met.read(), ["gram", "a", "b"]).select("gram", "block", other, "lo")
        hits = Stored(hits.groupBy("gram", "block", "other").agg(F.sort_array(F.collect_list("lo")).alias("los")), "hits")
        met.drop()
        texts = contexts.read().join(large.read().select("gram"), "gram", "left_semi").dropDuplicates(["gram", "block"])
        texts = Stored(texts.select("gram", "block", "off", "context"), "texts")
        theirs = texts.read().select("gram", F.col("block").alias("other"), F.col("off").alias("off_y"), F.col("context").alias("y"))
        pairs = hits.read().join(texts.read(), ["gram", "block"]).join(theirs, ["gram", "other"]).select("gram", "block", "los", "off", "context", "off_y", "y")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                for r in batch.to_pylist():
                    shift = r["off_y"] - r["off"]
                    out += [(r["gram"], r["block"], lo) for lo in r["los"] if lo + shift >= 0 and r["context"][lo : lo + length] == r["y"][lo + shift : lo + shift + length]]
                columns = [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1, 2, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "block", "lo", "hi"])

        marks = Stored(pairs.mapInArrow(tidy(run), "gram long, block long, lo long, hi long"), "merged")
        hits.drop()
        texts.drop()
        return marks


def _joined(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches lo to hi of blocks, those that touch made one."""
    if not len(at):
        return at, lo, hi
    wide = int(hi.max()) + 3
    start, end = at * wide + lo, at * wide + hi + 1
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    start, end = start[new], end[np.append(new[1:], len(end)) - 1]
    return start // wide, start % wide, end - 1 - start // wide * wide


def _unmatched(asked: np.ndarray, w: np.ndarray, times: np.ndarray, contexts: list[bytes], found: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """Of the blocks `asked`: each start whose string no other of the group equals (1), and one start for each string that some do (0)."""
    text = Suffixes([contexts[k] for k in asked.tolist()])
    own = w[asked]
    base = np.cumsum(own) - own
    known = np.zeros(int(own.sum()) + 1, np.int64)
    place = np.full(len(w), -1)
    place[asked] = np.arange(len(asked))
    b, lo, hi = found
    mine = place[b] >= 0
    at = base[place[b[mine]]]
    np.add.at(known, at + lo[mine], 1)
    np.add.at(known, at + hi[mine] + 1, -1)
    marked = (np.cumsum(known)[:-1] > 0) | np.repeat(times[asked] > 1, own)
    row = np.repeat(np.arange(len(asked)), own)
    start = np.arange(len(row)) - base[row]
    where = text.start[row] + start
    x = _hash(text.h, where, where + length)
    half = length // 2
    y = mix(_hash(text.h, where, where + half)) + mix(_hash(text.h, where + half, where + length) ^ np.uint64(0x5851F42D4C957F2D))
    told = np.zeros(len(row), bool)
    some = np.flatnonzero(marked)
    some = some[np.lexsort((y[some], x[some]))]
    told[some[np.append(True, (x[some][1:] != x[some][:-1]) | (y[some][1:] != y[some][:-1]))[: len(some)]]] = True
    take = np.flatnonzero(~marked | told)
    return asked[row[take]], start[take], x[take].view(np.int64), y[take].view(np.int64), (~marked[take]).astype(np.int64)


def _bloom(gram: np.ndarray, bits: int) -> np.ndarray:
    x, y = mix(gram), mix(gram ^ np.uint64(0x6A09E667F3BCC909))
    return np.stack([(v % np.uint64(bits)).astype(np.int64) for v in (x, y, x ^ (y >> np.uint64(9)))])


def dedup(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", out: str = "digest", keep: tuple[str, ...] = (), passage: int | None = None) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also starts anywhere else, in the same text or another.

    out="digest": id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256. out="text": id, the kept columns, and
    text, what remains; bytes of a character cut apart go with what was cut. With `passage` (bytes), the digest has two more
    columns: n_passage_bytes, what repeated strings of that length cover, and text, what remains without them. Strings are
    judged on the input; matches never cross texts. A null or empty text is empty, and one of under `length` bytes stays.
    Repeated rows have a row each, and texts equal to another of `length` bytes or more are removed whole. A very long text
    is read in stretches of a fixed size. An empty table gives no rows. Other columns are left out.
    """
    digest = out == "digest"
    rest = [F.col(f"`{x}`").alias(f"kept_{i}") for i, x in enumerate(keep)]
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *rest)
    lengths = [length, *([passage] if digest and passage else [])]
    key = F.unhex(F.md5("text")).alias("key")
    copies = docs.where(F.octet_length("text") >= min(lengths)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    marks, held = copies, [Dedup(docs.select("text"), n).spans() for n in lengths]
    for k, found in enumerate(held):
        marks = marks.join(found.read().withColumnRenamed("spans", f"spans_{k}"), "key", "full_outer")
    marks = Stored(marks, "marks")
    for found in held:
        found.drop()
    names = [f"spans_{k}" for k in range(len(lengths))]
    others = [f"kept_{i}" for i in range(len(keep))]
    # short texts stay as they are; the others meet what was found by their hash, all rows of one text in as many tasks as it takes
    long = docs.where(F.octet_length("text") >= min(lengths)).withColumn("key", key).join(marks.read(), "key", "left").select("id", "text", "copied", *names, *others)
    kind = "array<struct<s: bigint, e: bigint>>"
    short = docs.where(F.octet_length("text") < min(lengths)).select("id", "text", F.lit(None).cast("boolean").alias("copied"), *[F.lit(None).cast(kind).alias(x) for x in names], *others)
    rows = long.union(short)
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, " + ("n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "text string")
    schema += ", n_passage_bytes long, text string" if len(lengths) > 1 else ""
    schema += "".join(f", `{x}` {kinds[x]}" for x in keep)

    def left(data: bytes, n: int, copied: bool, spans: list[dict] | None) -> tuple[list[tuple[int, int]], list[bytes]]:
        cut = [(0, len(data))] if copied and len(data) >= n else _runs([(x["s"], x["e"] - 1 + n) for x in spans or ()])
        kept, at = [], 0
        for s, e in cut:
            kept.append(data[at:s])
            at = e
        return cut, [*kept, data[at:]]

    def joined(pieces: list[bytes]) -> str:
        return b"".join(x.decode("utf-8", "ignore").encode() for x in pieces).decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered = lambda cut: sum(e - s for s, e in cut)
        for batch in batches:
            out_rows: list[tuple] = []
            for k in range(batch.num_rows):
                data, copied = batch.column(1)[k].as_buffer().to_pybytes(), bool(batch.column(2)[k].as_py())
                cut, pieces = left(data, length, copied, batch.column(3)[k].as_py())
                row = (len(data), covered(cut), len(cut), hashlib.sha256(b"".join(pieces)).hexdigest()) if digest else (joined(pieces),)
                if len(lengths) > 1:
                    cut, pieces = left(data, lengths[1], copied, batch.column(4)[k].as_py())
                    row += (covered(cut), joined(pieces))
                out_rows.append(row)
            types = [*((pa.int64(), pa.int64(), pa.int64(), pa.string()) if digest else (pa.string(),)), *((pa.int64(), pa.string()) if len(lengths) > 1 else ())]
            columns = [*(("n_bytes", "n_removed", "n_spans", "kept_sha256") if digest else ("text",)), *(("n_passage_bytes", "text") if len(lengths) > 1 else ())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[c] for x in out_rows], t) for c, t in enumerate(types)], *batch.columns[3 + len(lengths) :]], [id_col, *columns, *keep])

    return rows.mapInArrow(tidy(run), schema)
