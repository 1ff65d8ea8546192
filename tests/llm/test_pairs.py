"""N-gram join and suffix dedup against brute force."""

import hashlib
import random
import re

import pytest

from corpusforge.llm import ngram_join, suffix_dedup
from corpusforge.llm.common import Stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def family(rng, n, words=400, size=120):
    vocabulary = [f"w{i}" for i in range(words)]
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(size)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [" ".join(rng.choice(vocabulary) for _ in range(30)) + " " + " ".join(base[:60]) for _ in range(n // 4)]
    return out


EDGE = [None, "", "   ", "a", "a b", "A  B", "a b c d e", "a b c d e f", "É b", "é b", "x y z", "x y z"]


def joined(spark, docs):
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, cid string")
    return sorted((tuple(r) for r in ngram_join.join(rows).collect()), key=lambda r: (r[0] is None, r))


def test_join(spark):
    texts = family(random.Random(1), 150) + EDGE
    docs = list(enumerate(texts)) + [(7, texts[7]), (3, None)]
    assert joined(spark, docs) == brute_components(docs)


def test_join_without_the_first_round(spark, monkeypatch):
    """The prefix round alone finds all links, in small blocks too."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join.Join, "by_minima", lambda self, one: Stored(self.spark.createDataFrame([], "a binary, b binary"), "links"))
    docs = list(enumerate(family(random.Random(2), 60) + EDGE))
    assert joined(spark, docs) == brute_components(docs)


def test_join_of_a_chain(spark):
    """Texts that link in a line are one component, though its ends share little."""
    words = [f"v{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 4 : i * 4 + 104])) for i in range(50)]
    assert {c for _, _, c in joined(spark, docs)} == {0} and joined(spark, docs) == brute_components(docs)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, "a b c d e f"), (2, "a b c d e f")]])
def test_join_of_little(spark, docs):
    got = joined(spark, docs)
    assert len(got) == len(docs)
    if len(docs) == 2:
        assert {r[2] for r in got} == {2}


def brute_dedup(docs, n):
    count = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for p in range(len(b) - n + 1):
            count[b[p : p + n]] = count.get(b[p : p + n], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def pieces(seed):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [make(rng.choice([30, 45, 60, 90])) for _ in range(12)]
    docs = [(i, " ".join(rng.choice([make(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(6)))) for i in range(200)]
    return docs + [(900, None), (901, ""), (902, "a" * 200), (903, "ab" * 100), (904, docs[5][1]), (904, docs[5][1])]


def removed(spark, docs, n):
    return sorted(tuple(r) for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), length=n).collect())


@pytest.mark.parametrize(("few", "group"), [(32, 512), (3, 512), (3, 8), (2, 4)])
def test_dedup(spark, monkeypatch, few, group):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = pieces(few + group)
    assert removed(spark, docs, 40) == brute_dedup(docs, 40)


def test_dedup_of_very_many_blocks_at_one_anchor(spark):
    """One passage in 2500 texts, each time between other words: more blocks of an anchor than one sort holds, and some of them shared further."""
    rng = random.Random(8)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, ends = text(60), [text(30) for _ in range(40)]
    docs = [(i, (rng.choice(ends) if i % 3 else text(30)) + passage[: rng.randrange(45, 60)] + (rng.choice(ends) if i % 2 else text(30))) for i in range(2500)]
    assert removed(spark, docs, 40) == brute_dedup(docs, 40)


def test_dedup_in_small_tasks_and_stretches(spark, monkeypatch):
    for name, value in (("ENTRIES", 50), ("HELD", 2000), ("_SLICE", 200), ("_STRETCH", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = [*pieces(9), (910, "ab cd " * 300), (911, "".join(random.Random(3).choice("ab") for _ in range(5000)) * 2)]
    assert removed(spark, docs, 40) == brute_dedup(docs, 40)


def test_dedup_of_passages(spark):
    """The further columns of the digest are those of a run at the shorter length."""
    docs = pieces(12)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.dedup(rows, 60, passage=30).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute_dedup(docs, 60)
    short = {r[0]: r for r in brute_dedup(docs, 30)}
    assert all(r["n_passage_bytes"] == short[r["doc_id"]][2] for r in got)
    plain = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(rows, 30, out="text").collect()}
    assert {r["doc_id"]: r["text"] for r in got} == plain


def test_dedup_at_400(spark):
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared = text(700)
    docs = [(1, text(900) + shared + text(300)), (2, shared + text(10)), (3, text(500)), (4, shared[:399]), (5, shared[100:500]), (6, text(450) * 2)]
    assert removed(spark, docs, 400) == brute_dedup(docs, 400)


def test_dedup_of_nothing(spark):
    assert removed(spark, [], 40) == []


def test_suffix_sort():
    rng = random.Random(5)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    text = suffix_dedup.Suffixes(contexts)
    import numpy as np

    group = np.repeat([0, 1, 2], 20)
    order = text.sort(group, text.start, text.end - text.start)
    assert [contexts[i] for i in order] == [c for g in range(3) for c in sorted(contexts[g * 20 : g * 20 + 20])]
