"""Subwords against a plain longest match, and windows of pairs against plain counting."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusforge import catalog
from corpusforge.functions.subwords import Subwords, printable_bytes
from corpusforge.plans import search

PATH = public_tokenizers.path("word_bpe_49k.json")
catalog.load()


def plain(vocabulary, text, end="</w>", of_bytes=True):
    """From the left, at each place the longest slice that is a piece."""
    sign = {b: c for c, b in printable_bytes().items()}
    out = []
    for word in re.findall(r"\w+|[^\w\s]", (text or "").lower()):
        chars, at, own = "".join(sign[b] for b in word.encode()) if of_bytes else word, 0, []
        while at < len(chars):
            for stop in range(len(chars), at, -1):
                piece = chars[at:stop]
                if stop == len(chars) and piece + end in vocabulary:
                    piece += end
                if piece in vocabulary and (end == "" or not piece.endswith(end) or stop == len(chars)):
                    own.append(piece)
                    at = stop
                    break
            else:
                own, at = ["<unk>"], len(chars)
        out += own
    return out


@pytest.fixture(scope="module")
def subwords():
    return Subwords.read(PATH)


TEXTS = [None, "", "  ", "The quick-brown fox's 12,345.67!", "Überraschung naïve café 你好 😀", "a" * 500, "x y\tz\n_", "İ ẞ ﬁ"]


def test_longest_match(spark, subwords):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeéß你 .,-_19") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", subwords.tokens(F.col("t")).alias("p"), subwords.ids(F.col("t")).alias("ids"), subwords.count(F.col("t")).alias("n")).collect()
    for r in got:
        want = plain(subwords.vocabulary, texts[r["i"]])
        assert (r["p"], r["n"], r["ids"]) == (want, len(want), [subwords.vocabulary.get(p, -1) for p in want])


def test_unknown_words_and_vocabularies_without_ends(spark):
    marked = Subwords({"a": 0, "b</w>": 1, "ab": 2, "c</w>": 3, "abc</w>": 4}, of_bytes=False)
    assert [marked.split(w) for w in ("ab", "abc", "aab", "abb", "ca", "x", "ac")] == [["ab"], ["abc</w>"], ["a", "ab"], ["ab", "b</w>"], ["<unk>"], ["<unk>"], ["a", "c</w>"]]
    for w in ("ab", "abc", "aab", "abb", "ca", "x", "ac", "aabc"):
        assert marked.split(w) == plain(marked.vocabulary, w, of_bytes=False), w
    free = Subwords({"a": 0, "ab": 1, "é": 2}, end="", of_bytes=False)
    assert [free.split(w) for w in ("aba", "éab", "b")] == [["ab", "a"], ["é", "ab"], ["<unk>"]]


def test_pieces_of_a_text(spark, subwords):
    text = "the unbelievable words of this text " * 20
    (got,) = spark.createDataFrame([(text,)], "t string").select(subwords.words(F.col("t"), 7)).first()
    assert " ".join(got).split() == text.split() and all(len(subwords.text(p)) <= 7 for p in got)
    assert spark.createDataFrame([(None,)], "t string").select(subwords.words(F.col("t"), 7)).first()[0] == [""]


def test_queries(spark, sf_dir, subwords):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    counts = {i: plain(subwords.vocabulary, t) for i, t in docs.items()}
    got = {r["doc_id"]: r["n"] for r in catalog.QUERIES["subword_tokens"](spark, sf_dir).collect()}
    assert got == {i: len(p) for i, p in counts.items()}
    # the search is BM25 over these pieces
    import math
    from collections import Counter

    asked = {r["item_id"]: plain(subwords.vocabulary, r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    tf = {i: Counter(p) for i, p in counts.items()}
    df, n = Counter(p for c in tf.values() for p in c), len(docs)
    mean = sum(map(len, counts.values())) / n
    top = {}
    for r in catalog.QUERIES["bm25_topk_subwords"](spark, sf_dir).collect():
        top.setdefault(r["query_id"], []).append((r["rank"], r["doc"], r["score"]))
    for q, terms in list(asked.items())[:20]:
        score = {i: sum(math.log(1 + (n - df[p] + 0.5) / (df[p] + 0.5)) * c[p] / (c[p] + 1.5 * (0.25 + 0.75 * len(counts[i]) / mean)) for p in terms if p in c) for i, c in tf.items()}
        best = sorted(((-round(s, 6), i) for i, s in score.items() if s > 0))[:10]
        assert [round(s, 4) for _, _, s in sorted(top[q])] == [round(-s, 4) for s, _ in best]


def test_windows_of_pairs(spark):
    rows = [(1, 1, "a b", " ".join("abcdefghij")), (1, 2, "a b", "x"), (1, 3, "a b", ""), (1, 4, "a b", None), (2, 1, "", "a b"), (3, 1, " ".join("q" * 9), "a b c")]
    pairs = spark.createDataFrame(rows, "query_id int, id int, text string, content string")
    got = {}
    for r in search.pair_windows(pairs.fillna(""), 9).collect():
        got.setdefault((r["query_id"], r["id"]), []).append((r["pos"], "".join(r["w"])))
    assert {k: [w for _, w in sorted(v)] for k, v in got.items()} == {(1, 1): ["abcd", "efgh", "ij"], (1, 2): ["x"], (1, 3): [""], (1, 4): [""], (2, 1): ["ab"], (3, 1): ["a", "b", "c"]}
    score = lambda how: {(r["query_id"], r["id"]): round(r["score"], 6) for r in search.pair_scores(pairs.fillna(""), 9, how).collect()}
    assert (score("max")[1, 1], score("mean")[1, 1], score("first")[1, 1]) == (1.0, 0.333333, 1.0)
    assert score("max")[2, 1] == score("max")[1, 3] == 0.0
