"""Queries over whole tables, against brute force in plain Python."""

import math
import re
from collections import Counter

import numpy as np

from corpusforge import catalog
from corpusforge.plans import search, vectors

catalog.load()


def save(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(["the cat sat", "the dog, the cat", "a rare word", "", "the end of it", "one 2 three two", "cat cat cat"])]
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"\w+", text.lower())


def test_vectors_of_all_documents(spark, tmp_path):
    d = save(spark, tmp_path, "documents", DOCS, DOCS_SCHEMA)
    tf = {r[0]: Counter(words(r[1])) for r in DOCS}
    df = Counter(t for c in tf.values() for t in c)
    mean = sum(c.total() for c in tf.values()) / len(DOCS)
    want = {}
    for doc, c in tf.items():
        for t, n in c.items():
            want[doc, t] = math.log(1 + (len(DOCS) - df[t] + 0.5) / (df[t] + 0.5)) * n / (n + 1.5 * (0.25 + 0.75 * c.total() / mean))
    got = {(r["doc"], r["term"]): r["weight"] for r in catalog.QUERIES["bm25_document_vectors"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_vector_searches_of_all_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 64)
    monkeypatch.setattr(search, "BLOCK", 2)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((330, 8)).astype(np.float32)
    x[200:260] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = save(spark, tmp_path, "embeddings", [(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    score = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 6)
    best = lambda q, k: sorted(range(330), key=lambda i: (-score[q, i], i))[:k]
    queries = range(0, 330, 50)
    got = catalog.QUERIES["vector_topk"](spark, d).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(q, n + 1, i) for q in queries for n, i in enumerate(best(q, 10))]
    got = catalog.QUERIES["vector_topk_candidates"](spark, d).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(q, n + 1, i) for q in queries for n, i in enumerate(best(q, 5))]


def test_index_of_all_terms(spark, tmp_path):
    d = save(spark, tmp_path, "documents", DOCS, DOCS_SCHEMA)
    tf = {r[0]: Counter(words(r[1])) for r in DOCS}
    df = Counter(t for c in tf.values() for t in c)
    mean = sum(c.total() for c in tf.values()) / len(DOCS)
    assert {(r["term"], r["df"]) for r in catalog.QUERIES["bm25_term_stats"](spark, d).collect()} == set(df.items())
    got = sorted((r["term"], r["doc"], r["tf"], r["len"], r["df"], r["n"], round(r["avg_len"], 9)) for r in catalog.QUERIES["index_save_load"](spark, d).collect())
    assert got == sorted((t, doc, n, c.total(), df[t], len(DOCS), round(mean, 9)) for doc, c in tf.items() for t, n in c.items())


def test_order_and_context_of_all_documents(spark, tmp_path):
    d = save(spark, tmp_path, "documents", [(i, "x" * 100 + str(i), "en", f"src{i % 3}", 101) for i in range(40)], DOCS_SCHEMA)
    got = sorted((r["source"], r["place"], r["doc_id"]) for r in catalog.QUERIES["date_order"](spark, d).collect())
    want = []
    for s in range(3):
        own = sorted((i for i in range(40) if i % 3 == s), key=lambda i: (i % 17 == 0, i))
        want += [(f"src{s}", n + 1, i) for n, i in enumerate(own)]
    assert got == want
    got = {r["doc_id"]: r["block"] for r in catalog.QUERIES["context_text"](spark, d).collect()}
    assert got == {i: f"[1] [en src{i % 3}] {'x' * 100}{i}\n\n[2] x" for i in range(40)}


def test_history_of_all_turns(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(5) for t in range(4)]
    d = save(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in catalog.QUERIES["history_append"](spark, d).collect()) == rows


def test_vector_index(spark, tmp_path, monkeypatch):
    """Recall of the index in cells against the exact search, cells of several shards too; all cells give the exact result."""
    monkeypatch.setattr(search, "SHARD", 40)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 2
    x = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (None, x[0].tolist())], "id long, v array<double>")
    asked = rows.where("id % 50 = 0 and v is not null").selectExpr("id as query_id", "v as query")
    vectors.save(vectors.build(rows, 20), str(tmp_path))
    index = vectors.load(spark, str(tmp_path))
    exact = {(r["query_id"], r["rank"]): r["id"] for r in search.vector_topk(asked, rows, 10).collect()}
    every = {(r["query_id"], r["rank"]): r["id"] for r in vectors.topk(index, asked, 10, 20).collect()}
    assert every == exact and len(exact) == 300
    found = {(r["query_id"], r["id"]) for r in vectors.topk(index, asked, 10).collect()}
    assert len(found & {(q, i) for (q, _), i in exact.items()}) >= 0.9 * len(exact)


def test_members_of_a_large_family(spark, tmp_path):
    """One family in many ranges is numbered without gaps, ties by id."""
    from corpusforge.operators import families

    rows = [("doc-1", "doc-1", 0)] + [(f"doc-{k}", "doc-1", k // 3) for k in range(2, 400)] + [("doc-900", "doc-5000", 1), ("doc-901", None, 1)]
    df = spark.createDataFrame(rows, "ID string, Family string, ord int").repartition(7)

    def cut(x):
        x.write.parquet(f"file://{tmp_path}/dealt")
        return spark.read.parquet(f"file://{tmp_path}/dealt")

    got = {}
    for r in families.family_members(df, cut=cut).collect():
        got.setdefault(r["family_key"], []).append((r["place"], r["id"]))
    large = sorted((o, i) for i, f, o in rows if f == "doc-1")
    assert [i for _, i in sorted(got["1"])] == [i for _, i in large] and sorted(p for p, _ in got["1"]) == list(range(1, len(large) + 1))
    assert got["single_doc-900"] == [(1, "doc-900")] and got["single_doc-901"] == [(1, "doc-901")]


def test_guards_of_a_search(spark):
    from pyspark.sql import functions as F

    from corpusforge.plans import index

    made = index.build(spark.createDataFrame([(1, "a", "x")], "doc_id long, content string, source string"), scope=F.col("source"))
    sources = spark.createDataFrame([("x",), ("y",)], "name string")
    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (4, "a", None), (5, "a", "")], "query_id long, text string, source string")
    good, bad = search.searchable(asked, sources, made)
    assert sorted(r["query_id"] for r in good.collect()) == [1, 4, 5] and sorted(map(tuple, bad.collect())) == [(2, search.NO_DOCUMENTS), (3, search.NO_SOURCE)]
    empty = index.build(spark.createDataFrame([], "doc_id long, content string, source string"), scope=F.col("source"))
    good, bad = search.searchable(asked, sources, empty)
    assert good.count() == 0 and sorted(map(tuple, bad.collect())) == [(1, search.NO_DOCUMENTS), (2, search.NO_DOCUMENTS), (3, search.NO_SOURCE), (4, search.NO_DOCUMENTS), (5, search.NO_DOCUMENTS)]
