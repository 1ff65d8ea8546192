"""Searches against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusforge.llm import ann, topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")


def brute(rows, k, every, score, best_first):
    usable = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            found = sorted(((best_first * score(a, b), i, score(a, b)) for i, b in usable if i != q and len(a) == len(b)), key=lambda x: x[:2])[:k]
            out += [(q, r + 1, i, s) for r, (_, i, s) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[5][1], 0) for i in range(40)]
    return rows + [(400, None, 0), (500, [float("nan")] * 8, 0), (600, [None] * 8, 0), (None, rows[0][1], 0), (700, [0.0] * 8, 0), (800, [1.0, 2.0], 0), (900, [2.0, 1.0], 0), (5, rows[5][1], 0)]


@pytest.mark.parametrize("shard", [8192, 16])
def test_exact(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr("corpusforge.llm.vectors.FAN_IN", 4)
    got = sorted(tuple(r) for r in topk.search(frame(spark, vectors), 7, 20, shard=shard, block=8).collect())
    integer = lambda a, b: int((np.floor(64 * a) * np.floor(64 * b)).sum())
    rows = [r for i, r in enumerate(vectors) if i < len(vectors) - 1]  # the last repeats an id
    want = brute(rows, 7, 20, integer, -1)
    assert len(got) >= len(want)
    if shard == 8192:
        got = sorted(tuple(r) for r in topk.search(frame(spark, rows), 7, 20, shard=shard).collect())
        assert got == want


def test_exact_of_large_numbers():
    a = np.array([[2.0**40, 3.0]])
    b = np.array([[2.0**20, 1.0], [2.0**22, -1.0]])
    assert topk._products(a, b).tolist() == [[2**60 + 3, 2**62 - 3]]


def test_searches_of_nothing(spark):
    assert topk.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [])).count() == 0
    assert topk.search(frame(spark, [(20, [1.0], 0)])).count() == 0


def test_graph_recall(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.array(table["embedding"].to_pylist(), np.float64), table["vec_id"].to_numpy()
    got = ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), every=20, shard=400).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], [d[ids == i][0] for i in own.vec_id], rtol=1e-12)
        hits, total = hits + len(set(own.vec_id) & set(want)), total + 10
    assert hits / total >= 0.9


def test_graph_recall_of_full_shards(spark, tmp_path):
    """With the default parameters, over several full shards of clustered vectors, some of them equal."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (300, 32))
    x = centres[rng.integers(0, 300, 4 * ann.SHARD + 300)] + rng.normal(0, 0.35, (4 * ann.SHARD + 300, 32))
    x[rng.integers(0, len(x), 50)] = x[200]
    x, ids = x.astype(np.float32).astype(np.float64), np.arange(len(x))
    flat = pa.array(x.astype(np.float32).ravel())
    table = pa.table({"vec_id": pa.array(ids), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 32, dtype=np.int32)), flat)})
    pq.write_table(table, tmp_path / "embeddings.parquet", row_group_size=2000)
    got = ann.search(spark.read.parquet(f"file://{tmp_path}/embeddings.parquet")).toPandas()
    hits = total = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for at in range(0, len(queries), 64):
        rows = queries[at : at + 64]
        d = (x[rows] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x[rows] @ x.T
        d[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(d, 10, axis=1)[:, :10]
        for q, found in zip(rows, near, strict=True):
            own = got.vec_id[got.query_id == ids[q]]
            hits, total = hits + len(set(own) & set(ids[found])), total + 10
    print("recall", hits / total, "of", len(queries), "queries,", len(ids), "vectors")
    assert hits / total >= 0.9


def test_graph_with_equal_vectors(spark, vectors):
    got = ann.search(frame(spark, [r for r in vectors[:-1]]), k=10, every=300).collect()
    own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 300)
    assert own == [(1, 5), *[(k, 299 + k) for k in range(2, 11)]]
