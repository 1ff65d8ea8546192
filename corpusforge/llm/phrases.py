"""Phrase collocations by compressed position bitmaps, extended depth-first.

The words of a shard (texts of one language) stand on one axis of positions, with a free position after each piece. A word's
bitmap is kept compressed: its 64-bit blocks that aren't zero. A phrase is extended by a shift of its bitmap, an AND with the
bitmaps of the words that stand there, and a popcount; the free positions stop it at a piece's end. Popcounts are summed over
shards, twice: first those of all words and pairs by hash, which leaves what can reach the least count; then, by the words
themselves, those of phrases that this doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import LOWER, Stored, gather_runs, mix, small_batches, strings, tidy, tidy_table
from corpusforge.llm.ngram_join import _summed, _task

#: Words of a phrase at most, least count of a candidate, share of a longer one (in hundredths) that a phrase drops out by, phrases of a language.
LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of text of a shard, bytes of text whose counts meet in one call, blocks of bitmaps that are extended at once, bits of the filter at most.
SHARD, MET, BLOCKS, FILTER = 8 << 20, 32 << 20, 1 << 18, 1 << 28
#: Parts of a language whose first phrases are found apart.
PARTS = 32
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


class Shard:
    """The words of a shard and their bitmaps: entries (word, block, mask), by word and block."""

    def __init__(self, data: np.ndarray, lang: str) -> None:
        low = LOWER[data]
        gap, cut = _GAP[low], _CUT[low]
        word = np.concatenate([[False], ~gap, [False]])
        at, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        piece = np.cumsum(cut)[at]
        self.n = len(at)
        place = np.arange(self.n)
        place[1:] += np.cumsum(piece[1:] != piece[:-1])
        ends = np.cumsum(end - at)
        coded = pc.dictionary_encode(strings(low[gather_runs(at, end - at)], ends - (end - at), ends))
        self.words = coded.dictionary
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = mix(np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in self.words.to_pylist()), np.uint64, len(self.words)))
        key = np.sort(coded.indices.to_numpy().astype(np.int64) << 34 | place)
        place = key & (1 << 34) - 1
        key >>= 6
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if self.n else np.zeros(0, np.int64)
        self.mask = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first) if self.n else np.zeros(0, np.uint64)
        self.word, self.block = key[first] >> 28, key[first] & (1 << 28) - 1
        self.entry = np.full(((int(place.max(initial=0)) >> 6) + 2) << 6, -1, np.int64)
        self.entry[place] = np.repeat(np.arange(len(first)), np.diff(np.append(first, self.n)))
        self.start = np.searchsorted(self.word, np.arange(len(self.words) + 1))

    def counts(self) -> np.ndarray:
        """How often each word stands."""
        return np.add.reduceat(np.bitwise_count(self.mask), self.start[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def runs(self) -> Iterator[slice]:
        """Entries of whole words, about BLOCKS at a time."""
        a = 0
        while a < len(self.word):
            b = int(self.start[max(np.searchsorted(self.start, a + BLOCKS, "right") - 1, self.word[a] + 1)])
            yield slice(a, b)
            a = b

    def extend(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of phrases one word longer: entries (phrase, word added, block, mask), the mask on the last word."""
        over = np.flatnonzero(mask >> np.uint64(63))
        phrase, block = np.append(phrase, phrase[over]), np.append(block, block[over] + 1)
        mask = np.append(mask << np.uint64(1), np.ones(len(over), np.uint64))
        rows, rest = np.flatnonzero(mask), mask[mask != 0]
        found = []
        while len(rows):  # the words that stand where bits are
            low = rest & (~rest + np.uint64(1))
            entry = self.entry[(block[rows] << 6) + np.bitwise_count(low - np.uint64(1))]
            there = entry >= 0
            found.append(rows[there] << 32 | entry[there])
            rest = rest ^ low
            rows, rest = rows[rest != 0], rest[rest != 0]
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(found) > 1:
            pairs = np.unique(pairs)
        row, entry = pairs >> 32, pairs & (1 << 32) - 1
        return phrase[row], self.word[entry], self.block[entry], mask[row] & self.mask[entry]


def popcounts(first: np.ndarray, word: np.ndarray, mask: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (first, word), how often each stands, and the place of each entry among them."""
    key, of = np.unique(first * words + word, return_inverse=True)
    return key, np.bincount(of, np.bitwise_count(mask), len(key)).astype(np.int64), of


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0xD1342543DE82EF95)))


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bucket, which rises with it, and 32 more bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bits(bucket: np.ndarray, rest: np.ndarray, size: int) -> np.ndarray:
    """Two places of a filter for each hash."""
    x = mix(bucket.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64))
    return np.stack([(x % np.uint64(size)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)])


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Language and bytes of shards: texts with a piece's end after each, cut at pieces' ends into SHARD bytes or little more."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, np.ndarray]]:
        data = np.frombuffer(b"".join(held.pop(lang)), np.uint8)
        del size[lang]
        a = 0
        while len(data) - a > SHARD:
            b = a + SHARD
            while b < len(data) and not (stop := np.flatnonzero(_CUT[data[b : b + 4096]])[:1]).size:
                b += 4096
            b = min(len(data), b + int(stop[0]) + 1 if b < len(data) else len(data))
            yield lang, data[a:b]
            a = b
        if a < len(data):
            yield lang, data[a:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer()
            if raw is not None and raw.size:
                held.setdefault(lang, []).append(raw.to_pybytes() + b"\n")
                size[lang] = size.get(lang, 0) + raw.size + 1
                if size[lang] >= SHARD:
                    yield from cut(lang)
                elif sum(size.values()) >= 4 * SHARD:  # of many languages the one with most
                    yield from cut(max(size, key=size.__getitem__))
    for lang in list(held):
        yield from cut(lang)


def _hashed(texts: DataFrame, buckets: int, least: int) -> DataFrame:
    """bucket, rest: hashes of words and pairs whose popcounts, summed over shards, reach `least`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in shards(batches):
            s = Shard(data, lang)
            h, n = [s.hash], [s.counts()]
            for own in s.runs():
                key, count, _ = popcounts(*[x for i, x in enumerate(s.extend(s.word[own], s.block[own], s.mask[own])) if i != 2], len(s.words))
                h.append(_pair(s.hash[key // len(s.words)], s.hash[key % len(s.words)]))
                n.append(count)
            h, n = np.concatenate(h), np.minimum(np.concatenate(n), 255).astype(np.uint8)
            order = np.argsort(h)
            bucket, rest = _dealt(h[order], buckets)
            n = n[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            for a in range(0, len(cut) - 1, 256):  # a batch holds some buckets only
                ends = cut[a : a + 257]
                parts = [(rest[x:y].tobytes(), n[x:y].tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]]), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "rest", "n"])

    def gather(table: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["rest"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["n"]])
        both = np.sort(rest.astype(np.uint64) << np.uint64(8) | n)
        rest, n = both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        keep = np.add.reduceat(n, first) >= least
        found = rest[first[keep]].astype(np.int64)
        return pa.table({"bucket": np.full(len(found), table["bucket"][0].as_py(), np.int64), "rest": found})

    rows = texts.mapInArrow(tidy(run), "bucket long, rest binary, n binary")
    return rows.groupBy("bucket").applyInArrow(tidy_table(gather), "bucket long, rest long")


def _filter(found: Stored, parts: int) -> bytes:
    """A Bloom filter of the hashes, of FILTER bits at most; what it lets through in excess is summed and then dropped."""
    n = found.read().count()
    size = 1 << min(FILTER.bit_length() - 1, max(16, (16 * max(1, n)).bit_length()))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for batch in batches:
            own[_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size).ravel()] = True
        packed = np.packbits(own, bitorder="little")
        blobs = [packed[k : k + 65536].tobytes() for k in range(0, len(packed), 65536)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array([_task()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "bits"])

    chunks = _summed(found.read().coalesce(parts).mapInArrow(tidy(fill), "chunk int, part int, bits binary"), "chunk", "bits", np.uint8, np.bitwise_or, parts)
    return b"".join(chunks[i].tobytes() for i in sorted(chunks)) or bytes(size // 8)


def counted(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), n: all phrases of up to `longest` words that occur `least` times or more in a
    language, and the number of all its words as n of the phrase ''."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(parts, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MET + 1)
    found = Stored(_hashed(texts, buckets, least), "frequent")
    held = spark.sparkContext.broadcast(_filter(found, parts))
    found.drop()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)

        def can(h: np.ndarray) -> np.ndarray:
            at = _bits(*_dealt(h, buckets), 8 * len(bits))
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)

        for lang, data in shards(batches):
            s = Shard(data, lang)
            v, words = len(s.words), s.words.cast(pa.string())

            def row(parts: list[np.ndarray], n: np.ndarray, lang=lang, words=words) -> pa.RecordBatch:
                taken = [words.take(pa.array(p)) for p in parts]
                text = pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]
                return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), text, pa.array(n)], ["lang", "phrase", "n"])

            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([s.n], pa.int64())], ["lang", "phrase", "n"])
            frequent = can(s.hash)
            single = np.flatnonzero(frequent)
            yield row([single], s.counts()[single])
            for own in s.runs():
                use = frequent[s.word[own]]
                entries = (s.word[own][use], s.block[own][use], s.mask[own][use])
                phrase, columns = entries[0], None  # the phrase of each entry; the words of each phrase, as columns
                for _ in range(longest - 1):
                    last, added, block, mask = s.extend(phrase, *entries[1:])
                    before = last if columns is None else columns[-1][last]
                    fits = frequent[added]
                    fits[fits] = can(_pair(s.hash[before[fits]], s.hash[added[fits]]))
                    last, added, block, mask = last[fits], added[fits], block[fits], mask[fits]
                    key, n, phrase = popcounts(last, added, mask, v)
                    head, tail = key // v, key % v
                    columns = [head, tail] if columns is None else [*[c[head] for c in columns], tail]
                    entries = (added, block, mask)
                    if not len(key):
                        break
                    yield row(columns, n)

    rows = texts.mapInArrow(tidy(run), "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _head(k: int) -> Column:
    """The first k words of `phrase`."""
    return F.substring_index("phrase", " ", k)


def _rest(k: int) -> Column:
    """`phrase` without its first k words."""
    return F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` first phrases of each language.

    Texts (A-Z lowered, null: empty) are split at [.,;:!?] and line ends into pieces, these at spaces and tabs into words. A
    candidate has 2 to `longest` words and a = f(phrase) >= least, where f counts all occurrences within pieces. Its score is
    the least floor(10^6 a^2 / (l r)) of its cuts, l and r the counts of the parts, the earliest cut of equal ones. A candidate
    that stands inside a longer one with 100 f(longer) >= share * a goes. Order: score, a descending, then the phrase by bytes,
    so no ties are left. Everything is per language, null is `und`. Repeated rows count each. A language without candidates, and
    an empty table, give no rows; other columns are left out. Counts are exact to 10^16. A piece is held whole in one worker.
    """
    counts = Stored(counted(df, lang_col, text_col, longest, least), "counts")
    all_words = counts.read().where("phrase = ''").select("lang", F.col("n").alias("n"))
    size = F.size(F.split("phrase", " "))
    own = counts.read().where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("n").alias("a"))
    cut = F.array(*[F.struct(F.lit(k).alias("k"), _head(k).alias("first"), _rest(k).alias("rest")) for k in range(1, longest)])
    cuts = own.select("lang", "phrase", "a", F.explode(F.slice(cut, 1, size - 1)).alias("x")).select("lang", "phrase", "a", "x.*")
    part = counts.read().where("phrase <> ''")
    scored = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    scored = scored.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    scored = scored.withColumn("top", (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("top div under"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    # every phrase inside a longer candidate, with the largest count of those
    inside = [F.expr(f"CASE WHEN size(w) >= {i + k - 1} THEN array_join(slice(w, {i}, {k}), ' ') END") for k in range(2, longest) for i in range(1, longest - k + 2)]
    longer = own.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2)
    if inside:
        held = longer.select("lang", F.col("a").alias("of"), "phrase", F.explode(F.array_distinct(F.array(*inside))).alias("short")).where("short <> phrase")
        held = held.groupBy("lang", F.col("short").alias("phrase")).agg(F.max("of").alias("most"))
        best = best.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    # the first of a language are among the first of its parts: the last step reads PARTS times `top` rows, however many there are
    order = (F.desc("score"), F.desc("a"), "phrase")
    first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
    best = best.withColumn("place", first).where(F.col("place") <= top).drop("place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
