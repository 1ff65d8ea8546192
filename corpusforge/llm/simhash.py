"""SimHash near duplicates by an inverted index of fingerprint bytes with a count filter.

A fingerprint has eight positional bytes. Fingerprints that differ in at most two bits differ in at most two of them, so a
linked pair shares at least six: that many shared bytes is what the count filter asks for before bits are compared. A posting
is keyed by several positional bytes at once: of the three blocks of positions a linked pair shares one whole. In each
posting the shared bytes of every pair are tallied. A posting that is too long to tally goes on to postings of six positional
bytes; they hold at most 2^16 different fingerprints, and there each fingerprint looks its 136 neighbours up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ASCII_SPACE, LOWER, Stored, gather_runs, small_batches, text_slices, tidy, tidy_table
from corpusforge.llm.ngram_join import components

#: Words in a shingle, seed of its hash, bits in which linked fingerprints may differ.
WORDS, SEED, BITS = 3, 42, 2
#: Fingerprints of a posting that is tallied pair by pair; rows of a call; bytes of text of a slice; shingles whose bits are counted at once.
POSTING, CALL, SLICE, COUNTED = 1024, 20_000, 1 << 20, 1 << 16
#: Positional bytes of the first postings: two differing bits leave one of the blocks whole.
BLOCKS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Positional bytes that a linked pair shares at least.
SHARED = 8 - BITS
#: For each byte, its bits as eight bytes.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if over half the hashes of its shingles, repeats included, have it."""
    docs = len(offsets) - 1
    out = np.zeros(docs, np.uint64)
    space = ASCII_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | fresh[1:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return out
    stop = np.flatnonzero(space | fresh[:-1])
    length = np.append(stop, len(data))[np.searchsorted(stop, at, "right")] - at
    # all words one after another, a space after each: a shingle is a run of these bytes
    after = np.cumsum(length + 1)
    line = np.append(LOWER[data], np.uint8(0x20))[gather_runs(at, length + 1)]
    line[after - 1] = 0x20
    doc = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    size = np.minimum(count, words)
    shingle = np.maximum(count - words + 1, (count > 0).astype(np.int64))
    head = gather_runs(first, shingle)
    of = np.repeat(np.arange(docs), shingle)
    starts, ends = (after - length - 1)[head], (after - 1)[head + size[of] - 1]
    total = np.zeros((docs, 64), np.int64)
    raw, digest = line.tobytes(), xxhash.xxh64_intdigest
    for a in range(0, len(head), COUNTED):
        s, own = slice(a, a + COUNTED), of[a : a + COUNTED]
        h = np.fromiter((digest(raw[i:j], seed) for i, j in zip(starts[s].tolist(), ends[s].tolist(), strict=True)), np.uint64, len(own))
        # eight bits of a hash are eight counters of a byte; they are added in runs of one text that can't overflow
        cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (np.arange(1, len(own)) % 255 == 0)))
        sums = np.add.reduceat(_COUNTERS[h.view(np.uint8).reshape(-1, 8)], cut, axis=0)
        np.add.at(total, own[cut], sums.view(np.uint8))
    return np.packbits(2 * total > shingle[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Joins the roots of pairs (a, b); the pairs that joined something. parent leads from each place straight to its root."""
    apart = parent[a] != parent[b]
    joined = []
    for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        p, q = x, y
        while parent[p] != p:
            p = int(parent[p])
        while parent[q] != q:
            q = int(parent[q])
        if p != q:
            parent[max(p, q)] = min(p, q)
            joined.append((x, y))
    if joined:
        while (up := parent[parent]).tolist() != parent.tolist():
            parent[:] = up
    return joined


def tallied(group: np.ndarray, fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (places) that join what all links within groups join; rows of a group stand together.

    Every pair of a group is tallied: shared positional bytes first, and where they are enough the differing bits."""
    parent, links = np.arange(len(fp)), []
    left = np.arange(len(fp))
    for d in range(1, len(fp)):
        left = left[left + d < len(fp)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        differ = fp[left] ^ fp[left + d]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        keep = shared >= 8 - bits
        keep[keep] = np.bitwise_count(differ[keep]) <= bits
        links += _union(parent, left[keep], left[keep] + d)
    return links


def neighbours(fp: np.ndarray, free: int) -> list[tuple[int, int]]:
    """As tallied(), for one posting of distinct, ascending fingerprints that differ in the bits of `free` only."""
    parent, links = np.arange(len(fp)), []
    single = [np.uint64(1 << k) for k in range(64) if free >> k & 1]
    for mask in [*single, *[a | b for a, b in combinations(single, 2)]]:
        other = fp ^ mask
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        found = np.flatnonzero((fp[at] == other) & (at > np.arange(len(fp))))
        links += _union(parent, found, at[found])
    return links


def _mask(positions: Iterable[int]) -> int:
    """The bits of these bytes, as a signed 64-bit integer."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(table: pa.Table, long: int) -> pa.Table:
    """Links within the postings of one call: rows mask, value, fp."""
    mask, value, fp = (table[c].to_numpy() for c in ("mask", "value", "fp"))
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, value, mask))
    mask, value, fp = mask[order], value[order], fp[order]
    new = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
    once = new | np.append(True, fp[1:] != fp[:-1])
    mask, fp, group = mask[once], fp[once], (np.cumsum(new) - 1)[once]
    size = np.bincount(group)
    few = np.flatnonzero((size[group] <= long) & (size[group] > 1))
    links = [(few[a], few[b]) for a, b in tallied(group[few], fp[few])]
    begin = np.cumsum(size) - size
    for g in np.flatnonzero(size > long).tolist():
        own = slice(begin[g], begin[g] + size[g])
        links += [(begin[g] + a, begin[g] + b) for a, b in neighbours(fp[own], ~int(mask[begin[g]]) & (1 << 64) - 1)]
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": fp[ends[:, 0]].view(np.int64), "b": fp[ends[:, 1]].view(np.int64)})


def _links_of(postings: DataFrame, rows: int) -> DataFrame:
    """Links within postings (mask, value, fp), many postings to a call."""
    long = POSTING
    bucket = F.pmod(F.xxhash64("mask", "value"), F.lit(rows // CALL + 1)).cast("int")
    return postings.select("mask", "value", "fp", bucket.alias("bucket")).groupBy("bucket").applyInArrow(tidy_table(lambda t: _postings(t, long)), "a long, b long")


def links(fps: DataFrame) -> Stored:
    """Links (a, b) of distinct fingerprints (fp) that join what all links join."""
    n = fps.count()
    first = [_mask(b) for b in BLOCKS]
    of_first = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for m in first]))
    postings = fps.select("fp", of_first.alias("x")).select("fp", "x.mask", "x.value")
    long = Stored(postings.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > POSTING), "long_postings")
    marked = Stored(postings.join(long.read(), ["mask", "value"], "left"), "postings")
    short = _links_of(marked.read().where("n is null"), len(BLOCKS) * n)
    found = short
    if long.read().limit(1).count():
        # the bytes left out are two of those outside the block
        six = {m: [_mask(set(range(8)) - set(out)) for out in combinations(sorted(set(range(8)) - set(b)), 8 - SHARED)] for m, b in zip(first, BLOCKS, strict=True)}
        masks = F.coalesce(*[F.when(F.col("mask") == m, F.array(*[F.lit(x) for x in own])) for m, own in six.items()])
        longer = marked.read().where("n is not null").select("fp", F.explode(masks).alias("mask"))
        longer = Stored(longer.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"), "long_postings")
        found = short.union(_links_of(longer.read(), longer.read().count()))
        out = Stored(found, "links")
        longer.drop()
    else:
        out = Stored(found, "links")
    long.drop()
    marked.drop()
    return out


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, fp (the 64 bits as a long) of every row."""
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints(data, offsets, words, seed).view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {dict(rows.dtypes)['id']}, fp long")


def near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that links lead to, the row's own included) of every row.

    Words are runs without ASCII white space, A-Z lowered; a shingle is `words` of them joined by spaces, a text of fewer words
    is one shingle, and a text without words, null or empty, has fingerprint zero and is linked like any other. Equal
    fingerprints are one class, so copies are linked without their pairs. Repeated rows have a row each; a row of null id takes
    its component's id, null if no row there has one. A bit set in exactly half the hashes is 0. A very long text is hashed
    whole in one worker. An empty table gives no rows. Other columns are left out.
    """
    docs = Stored(fingerprint(df, id_col, text_col, words, seed), "fingerprints")
    one = Stored(docs.read().groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = links(one.read().select("fp"))
    label = Stored(components(found.read()).withColumnRenamed("node", "fp"), "labels")
    found.drop()
    least = label.read().join(one.read(), "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    least = Stored(least, "components")
    of = label.read().join(least.read(), "label").select("fp", "component_id")
    known = Stored(one.read().join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "known")
    for table in (one, label, least):
        table.drop()
    return docs.read().join(known.read(), "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
