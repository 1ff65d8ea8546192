"""An index of vectors in cells: each vector stands in the cell of its nearest centre, and a query looks into the nearest cells only.

The centres are fitted on a bounded sample; every vector is indexed. With as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.plans import search

#: Vectors that the centres are fitted on, drawn by a hash of the id; rounds of the fit; rows that are compared with all centres at once.
SAMPLE, ROUNDS, TILE = 20_000, 12, 1024


@dataclass
class VectorIndex:
    """centres (cells x dimensions), and rows (cell, shard, id, v): a large cell is dealt to shards of about search.SHARD vectors."""

    centres: np.ndarray
    rows: DataFrame
    shards: dict[int, int]


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, ties to the first."""
    out, own = np.empty((len(x), n), np.int64), (centres**2).sum(1)[None, :]
    for at in range(0, len(x), TILE):  # what stands in memory doesn't grow with the rows
        apart = own - 2 * x[at : at + TILE] @ centres.T
        least = np.partition(apart, n - 1, axis=1)[:, n - 1 : n] if n < len(centres) else apart.max(1, keepdims=True)
        row, col = np.nonzero(apart <= least)
        by = np.lexsort((col, apart[row, col], row))
        row, col = row[by], col[by]
        out[at : at + TILE] = col[np.arange(len(row)) - np.searchsorted(row, row) < n].reshape(-1, n)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _whole(df: DataFrame, id_: str, v: str) -> DataFrame:
    return df.select(F.col(id_).cast("long").alias(id_), F.col(v).cast("array<double>").alias(v)).where(F.col(id_).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0))


def _cells(df: DataFrame, id_: str, v: str, centres: np.ndarray, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(_matrix(batch.column(1)), centres, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.int32()))], [id_, v, "cells"])

    return df.mapInArrow(run, f"{id_} long, {v} array<double>, cells array<int>").select(id_, v, F.explode("cells").alias("cell"))


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Fits the centres on at most `sample` vectors (id, v, of one length) and gives each vector its cell."""
    rows = _whole(vectors, "id", "v")
    total = rows.count()
    cells = min(cells or max(1, int(total**0.5 / 2)), max(1, total))
    drawn = rows.select("v").orderBy(F.xxhash64("id")).limit(sample).collect()
    x = np.array([r["v"] for r in drawn]) if drawn else np.zeros((1, 1))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    placed = _cells(rows, "id", "v", centres, 1)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    shards = {c: -(-n // search.SHARD) for c, n in sizes.items()}
    dealt = _sharded(placed, shards).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    return VectorIndex(centres, dealt.select("id", "v", "cell", "shard"), shards)


def _sharded(df: DataFrame, shards: dict[int, int]) -> DataFrame:
    """Adds shards, the number of shards of the row's cell: a row for each cell, which is some thousands even for large tables."""
    sizes = df.sparkSession.createDataFrame(sorted(shards.items()), "cell int, shards int")
    return df.join(F.broadcast(sizes), "cell", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))


def save(index: VectorIndex, path: str) -> None:
    """The vectors by cell, and the centres."""
    # a cell's shards come from a task each, so the files are as many as shards, however many tasks read the vectors
    index.rows.repartition("cell", "shard").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = index.rows.sparkSession
    spark.createDataFrame([(i, c.tolist(), index.shards.get(i, 1)) for i, c in enumerate(index.centres)], "cell int, centre array<double>, shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> VectorIndex:
    held = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
    rows = spark.read.schema("shard int, id long, v array<double>, cell int").parquet(f"{path}/vectors")
    return VectorIndex(np.array([r["centre"] for r in held]), rows, {r["cell"]: r["shards"] for r in held})


def topk(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """query_id, id, score, rank: of the vectors in the `probes` nearest cells of each query (query_id, query), the k best by inner product."""
    asked = _cells(_whole(queries, "query_id", "query"), "query_id", "query", index.centres, min(probes, len(index.centres)))
    asked = _sharded(asked, index.shards).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    lists = asked.groupBy("cell", "shard").cogroup(index.rows.groupBy("cell", "shard")).applyInArrow(search._tile(k), "query_id long, id long, score double")
    return search.ranked(lists, k, key="id")
