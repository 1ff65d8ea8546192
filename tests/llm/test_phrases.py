"""Phrase collocations against DuckDB and plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusforge.llm import phrases
from corpusforge.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query(spark, sf_dir):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_phrases']})").fetchall()
    assert rows(QUERIES["op12_phrases"](spark, sf_dir)) == sorted(want) and len(want) > 50


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", low)]


def plain(docs, top=2000, least=10, share=50):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in words(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        own = [p for p, a in c.items() if len(p) > 1 and a >= least]
        best = {p: min((10**6 * c[p] ** 2 // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))) for p in own}
        gone = {q[i : i + 2] for q in own if len(q) == 3 for i in (0, 1) if 100 * c[q] >= share * c[q[i : i + 2]]}
        kept = sorted((p for p in own if p not in gone), key=lambda p: (-best[p][0], -c[p], " ".join(p).encode()))[:top]
        out += [(lang, i + 1, " ".join(p), c[p], c[p[: best[p][1]]], c[p[best[p][1] :]], n[lang], best[p][0]) for i, p in enumerate(kept)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "\u00e9t\u00e9", "a", "b", "c", "New", "york", "x\x1cy", "\u00a0z"]
    docs = []
    for _ in range(n):
        w = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", " \t", ";?"]) for _ in range(rng.randrange(60))]
        docs.append((rng.choice(["en", "de", None]), " ".join(w)))
    return [*docs, (None, None), ("en", ""), ("fr", " . ,\n"), ("en", "a a a a a a a a a a a a"), ("xx", "q " * 9), ("yy", "q " * 11)]


@pytest.mark.parametrize(("shard", "blocks", "met"), [(8 << 20, 1 << 18, 32 << 20), (200, 3, 500)])
def test_counts_and_scores(spark, monkeypatch, shard, blocks, met):
    """In large shards and in many small ones that split texts."""
    for name, value in (("SHARD", shard), ("BLOCKS", blocks), ("MET", met)):
        monkeypatch.setattr(phrases, name, value)
    docs = corpus(4, 150)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert rows(phrases.collocations(table)) == plain(docs)
    assert rows(phrases.collocations(table, top=5)) == plain(docs, top=5)


def test_bitmaps_shift_over_blocks_and_stop_at_pieces():
    """A phrase over the ends of 64-bit blocks; none over the end of a piece."""
    s = phrases.Shard(np.frombuffer(("a b " * 100 + ". b a").encode(), np.uint8), "en")
    a, b = s.words.to_pylist().index(b"a"), s.words.to_pylist().index(b"b")
    own = s.word == a
    key, n, _ = phrases.popcounts(*[x for i, x in enumerate(s.extend(s.word[own], s.block[own], s.mask[own])) if i != 2], len(s.words))
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {a * len(s.words) + b: 100}
    own = s.word == b
    key, n, _ = phrases.popcounts(*[x for i, x in enumerate(s.extend(s.word[own], s.block[own], s.mask[own])) if i != 2], len(s.words))
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == {b * len(s.words) + a: 100}


def test_edges(spark):
    kind = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], kind)).count() == 0
    wide = spark.createDataFrame([(1, "p q " * 12, None), (None, None, "en"), (1, "p q " * 12, None)], kind).selectExpr("*", "1 AS n", "2 AS phrase", "3 AS a", "4 AS rank", "5 AS bucket", "6 AS rest")
    assert rows(phrases.collocations(wide)) == plain([(None, "p q " * 12)] * 2)


def test_one_very_long_text(spark):
    """20 MB in one row, without a piece's end for long stretches."""
    rng = np.random.default_rng(5)
    half = " ".join("".join(rng.choice(list("abcdefgh"), 59)) for _ in range(3000)) + " "
    text = half * 60 + "." + half * 60
    got = rows(phrases.collocations(spark.createDataFrame([("en", text)], "lang string, text string")))
    assert got == plain([("en", text)])
