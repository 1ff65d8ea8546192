"""Clusters of chunks by mini-batch k-means: batches by a hash in a fixed order, counts that decay, sums as a tree; and training
triplets from the chunks of one cluster and of the next."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.plans.index import bounded_batches
from corpusforge.plans.vectors import nearest

#: Partial sums that one call adds, chunks of a cluster that are paired with each other.
FAN, PAIRED = 64, 256
#: Batches of rows.
BATCHES = 8


def batch_of(n: int, seed: int):
    """The batch of a row, from its id."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows (v) are nearest to each centre, and their sums: of each task, then added FAN at a time. What comes to the
    driver is one row a centre."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, sums = np.zeros(len(centres)), np.zeros_like(centres)
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell = nearest(v, centres, 1)[:, 0]
                n += np.bincount(cell, minlength=len(centres))
                np.add.at(sums, cell, v)
        some = np.flatnonzero(n)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), part, np.int32)), pa.array(n[some]), pa.array([sums[c].tobytes() for c in some], pa.binary())], ["cluster", "part", "n", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer()) for b in table["sums"])
        return pa.table({"cluster": table["cluster"].slice(0, 1), "part": table["part"].slice(0, 1), "n": [float(np.sum(table["n"].to_numpy()))], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "cluster int, part int, n double, sums binary"
    found, tasks = rows.select("v").mapInArrow(own, kind), rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("cluster", "part").applyInArrow(add, kind)
    n, sums = np.zeros(len(centres)), np.zeros_like(centres)
    for r in found.collect():
        n[r["cluster"]] += r["n"]
        sums[r["cluster"]] += np.frombuffer(r["sums"])
    return n, sums


def updated(centres: np.ndarray, weight: np.ndarray, n: np.ndarray, sums: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their weights after a batch: weights decay, and a centre moves by its rows' share in its weight."""
    weight = decay * weight + n
    share = np.divide(1.0, weight, out=np.zeros_like(weight), where=n > 0)
    return centres + share[:, None] * (sums - n[:, None] * centres), weight


def fit(rows: DataFrame, k: int, batches: int = BATCHES, rounds: int = 3, decay: float = 0.9, seed: int = 42, cut: Callable[[DataFrame], DataFrame] | None = None) -> np.ndarray:
    """Centres of rows (id, v, of one length), k at most: they begin as the k rows of the smallest hashes, and see each batch once a
    round, in the order of their numbers. cut writes the rows once (by batch, where it can), so that a batch is read alone. Rows may
    hold their batch, as batch_of() gives it: then they are read as they are."""
    bounded_batches(rows.sparkSession)
    numbered = rows if "batch" in rows.columns else rows.select("id", "v", batch_of(batches, seed).alias("batch"))
    numbered = cut(numbered) if cut else numbered
    first = numbered.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(k).collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([r["v"] for r in first], np.float64)
    weight = np.zeros(len(centres))
    for _ in range(rounds):
        for b in range(batches):
            n, sums = _sums(numbered.where(F.col("batch") == b), centres)
            centres, weight = updated(centres, weight, n, sums, decay)
    return centres


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster of rows (id, v): the nearest centre, ties to the first. Clusters without rows don't appear."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(v, centres, 1)[:, 0].astype(np.int32))], ["id", "cluster"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, cluster int")


def places(assigned: DataFrame, seed: int = 42) -> DataFrame:
    """Adds block and place: a cluster's chunks in blocks of about PAIRED, by a hash, numbered within a block. A large cluster is in
    many blocks, so no task holds it."""
    sizes = assigned.groupBy("cluster").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("blocks"))
    rows = assigned.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
    own = F.row_number().over(Window.partitionBy("cluster", "block").orderBy(F.xxhash64("id", F.lit(seed + 2)), "id"))
    return rows.withColumn("place", own - 1).withColumn("size", F.count("*").over(Window.partitionBy("cluster", "block")))


def triplets(assigned: DataFrame, seed: int = 42) -> DataFrame:
    """anchor, positive (the next chunk of its block, of one cluster), negative (a chunk of the next cluster, by its place): one for
    each chunk whose block has another and if there are two clusters. Clusters follow each other by number, the last meets the first."""
    rows = places(assigned, seed)
    clusters = assigned.select("cluster").distinct()
    order = Window.orderBy("cluster")  # a row for each cluster
    after = clusters.withColumn("next", F.coalesce(F.lead("cluster").over(order), F.min("cluster").over(Window.partitionBy())))
    held = rows.select(F.col("cluster").alias("next"), F.col("block").alias("n_block"), F.col("place").alias("n_place"), F.col("id").alias("negative"))
    sizes = rows.groupBy(F.col("cluster").alias("next"), F.col("block").alias("n_block")).agg(F.count("*").alias("n_size"))
    blocks = rows.select(F.col("cluster").alias("next"), F.col("blocks").alias("n_blocks")).distinct()
    positive = rows.select("cluster", "block", F.col("place").alias("p_place"), F.col("id").alias("positive"))
    made = rows.where("size > 1").withColumn("p_place", (F.col("place") + 1) % F.col("size")).join(positive, ["cluster", "block", "p_place"])
    made = made.join(after.where("next <> cluster"), "cluster").join(blocks, "next").withColumn("n_block", F.col("block") % F.col("n_blocks")).join(sizes, ["next", "n_block"])
    made = made.withColumn("n_place", (F.col("place") % F.col("n_size")).cast("int"))
    return made.join(held, ["next", "n_block", "n_place"]).select(F.col("id").alias("anchor"), "positive", "negative", "cluster")
