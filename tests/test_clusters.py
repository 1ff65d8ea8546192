"""Mini-batch k-means against plain numpy, and triplets against their rule."""

import numpy as np
import pytest

from corpusforge.plans import clusters


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def plain(rows, k, batches, rounds, decay):
    """rows: (id, batch, hash order, v), one batch after another."""
    centres = np.array([v for _, _, _, v in sorted(rows, key=lambda r: r[2])[:k]])
    weight = np.zeros(len(centres))
    for _ in range(rounds):
        for b in range(batches):
            own = np.array([v for _, o, _, v in rows if o == b]).reshape(-1, centres.shape[1])
            cell = ((own[:, None] - centres) ** 2).sum(2).argmin(1)
            n = np.bincount(cell, minlength=len(centres)).astype(float)
            weight = decay * weight + n
            for c in np.flatnonzero(n):
                centres[c] = centres[c] + ((own[cell == c] - centres[c]).sum(0)) / weight[c]
    return centres


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_against_numpy(spark, monkeypatch, parts):
    from pyspark.sql import functions as F

    monkeypatch.setattr(clusters, "FAN", 2)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in (0, 3, -3, 6)])
    df = table(spark, x).repartition(parts)
    got = clusters.fit(df, 5, batches=3, rounds=2, decay=0.8)
    marks = df.select("id", clusters.batch_of(3, 42).alias("b"), F.xxhash64("id", F.lit(43)).alias("h")).collect()
    want = plain([(r["id"], r["b"], (r["h"], r["id"]), x[r["id"]]) for r in marks], 5, 3, 2, 0.8)
    assert np.allclose(got, want, atol=1e-9)
    own = {r["id"]: r["cluster"] for r in clusters.assign(df, got).collect()}
    assert own == dict(enumerate(((x[:, None] - want) ** 2).sum(2).argmin(1).tolist()))


def test_documents_of_one_kind_come_together(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in (0, 5)])
    df = table(spark, x)
    own = {r["id"]: r["cluster"] for r in clusters.assign(df, clusters.fit(df, 6, batches=2)).collect()}
    assert not {own[i] for i in range(40)} & {own[i] for i in range(40, 80)}
    assert clusters.fit(df.limit(0), 3).shape == (0, 0) and len(clusters.fit(df.limit(2), 3)) == 2


@pytest.mark.parametrize("paired", [256, 4])
def test_triplets(spark, monkeypatch, paired):
    monkeypatch.setattr(clusters, "PAIRED", paired)
    cluster = {i: (0 if i < 30 else 2 if i < 37 else 5) for i in range(38)}
    df = spark.createDataFrame(sorted(cluster.items()), "id long, cluster int")
    rows = clusters.triplets(df).collect()
    after = {0: 2, 2: 5, 5: 0}
    assert all(cluster[r["positive"]] == cluster[r["anchor"]] == r["cluster"] and r["positive"] != r["anchor"] and cluster[r["negative"]] == after[r["cluster"]] for r in rows)
    anchors = [r["anchor"] for r in rows]
    assert len(set(anchors)) == len(anchors) and 37 not in anchors and (paired == 4 or set(anchors) == set(range(37)))
    assert clusters.triplets(df.where("cluster = 0")).count() == 0


def test_a_batch_reads_its_own_rows(spark, sf_dir, tmp_path, monkeypatch):
    """Clusters of documents come from vectors written by batch; the clusters are those of vectors in memory."""
    from corpusforge.plans import training

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plans, sums = [], clusters._sums
    monkeypatch.setattr(clusters, "_sums", lambda rows, centres: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), sums(rows, centres))[1])

    def cut(df):
        df.write.partitionBy("batch").parquet(f"{tmp_path}/v")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/v")

    training.cluster(docs, 4, content="text", cut=cut)
    assert len(plans) == 3 * clusters.BATCHES and all("PartitionFilters: [isnotnull(batch" in p for p in plans)
