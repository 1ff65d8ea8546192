"""SimHash near duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from corpusforge.llm import simhash
from corpusforge.llm.queries import QUERIES


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """The least place that links of at most two bits lead to."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(fps))]


TEXTS = [None, "", " \n\t ", "a", "A", "a b", "A  B", "a b c", "a b c d", "\u00c9 b c", "\u00e9 b c", "x" * 3000, "x y " * 900]


def test_fingerprints(monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") for _ in range(n)) + rng.choice(["", " ", "\n"]) for n in (50, 254, 255, 256, 257, 258, 513, 700)] + TEXTS
    raw = [(t or "").encode() for t in texts]
    for most in (7, 1 << 16):
        monkeypatch.setattr(simhash, "COUNTED", most)
        got = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw]))
        assert got.tolist() == [fingerprint(t) for t in texts]


def planted(seed, n):
    """Fingerprints around some centres, chains of them, and others."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(n):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
        for _ in range(n // 4):
            c ^= sum(1 << b for b in rng.sample(range(64), 2))
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize(("posting", "call"), [(1024, 20_000), (8, 50), (1, 10)])
def test_links(spark, monkeypatch, posting, call):
    """All postings, short and long ones, lead to the components of brute force; every link is one."""
    monkeypatch.setattr(simhash, "POSTING", posting)
    monkeypatch.setattr(simhash, "CALL", call)
    fps = planted(5, 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).read().collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    place = {x: k for k, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        x, y = sorted((find(place[a]), find(place[b])))
        parent[y] = x
    assert [find(k) for k in range(len(fps))] == brute(fps)


def test_neighbours_of_a_full_posting():
    """All 2^16 fingerprints of one posting are one component, found without pairs."""
    fp = np.arange(1 << 16, dtype=np.uint64) << np.uint64(24)
    assert len(simhash.neighbours(fp, 0xFFFF << 24)) == len(fp) - 1


def test_query(spark, sf_dir):
    """The whole table: fingerprints, and components by brute force over them."""
    rows = sorted(QUERIES["op11_simhash"](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = [fingerprint(t) for _, t in docs]
    assert [(r["doc_id"], r["fingerprint"]) for r in rows] == [(i, f"{x:016x}") for (i, _), x in zip(docs, want, strict=True)]
    assert [r["component_id"] for r in rows] == [docs[k][0] for k in brute(want)]


def test_short_texts_and_null_ids(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS * 2)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in rows]
    for k, root in enumerate(brute(fps)):
        ids = [rows[j][0] for j, other in enumerate(brute(fps)) if other == root and rows[j][0] is not None]
        assert got[rows[k][0], f"{fps[k]:016x}"] == min(ids)
