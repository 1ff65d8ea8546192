"""Exact top-k search: tiled matrix products of queries and shards, partial selection in each tile, tree merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.vectors import matrix, merge_top, shard_of, shards_for, usable

#: Candidates in a shard and queries in a block: a tile is their product.
SHARD, BLOCK = 8192, 2048
#: Queries whose scores stand in memory at once.
ROWS = 256


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by floating point while no sum can pass 2^53, else by integers of any size, held to the range of a long."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in a], object).dot(np.array([[int(x) for x in row] for row in b], object).T)
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the k best candidates of each query, itself apart; ties go to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    for at in range(0, len(queries), ROWS):
        score = _products(queries[at : at + ROWS], vectors)
        own = query_ids[at : at + ROWS]
        other = own[:, None] != ids[None, :]
        if len(ids) > k + 1:
            # the (k+1)-th best score, for the query's own row may be among them; all that tie with it stay for the exact choice
            least = np.partition(score, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
            row, col = np.nonzero((score >= least[:, None]) & other)
        else:
            row, col = np.nonzero(other)
        value = score[row, col]
        by = np.lexsort((col, -value.astype(object) if (value == np.iinfo(np.int64).min).any() else -value, row))
        row, col, value = row[by], col[by], value[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        take = place < k
        out.append((own[row[take]], ids[col[take]], value[take]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3)) if out else (np.zeros(0, np.int64),) * 3


def search(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of all other rows for each row whose id is divisible by `every`.

    A component x counts as floor(scale * x); the score is the integer inner product, exact, held to the range of a long.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows of null id; a zero vector scores
    0. Vectors of different lengths aren't compared. Ties go to the smaller id; repeated rows count each, but a row never
    finds one of its own id. An empty table has no result. Shards and blocks are dealt by a hash of the id, so no value in
    the data can make a task large; each pair of a shard and a block is one task's work.
    """
    rows = usable(df, id_col, vector_col, allow_zero=True).withColumn("v", F.transform("v", lambda x: _floor(x * scale)))
    n = rows.count()
    shards, blocks = shards_for(n, shard), shards_for(-(-n // every), block)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("dim").alias("dim")).withColumn("block", shard_of(F.col("query_id"), blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    candidates = rows.select("vec_id", "v", F.col("dim").alias("dim")).withColumn("shard", shard_of(F.col("vec_id"), shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile_table(left: pa.Table, right: pa.Table) -> pa.Table:
        shard_ = left["shard"][0].as_py() if len(left) else 0
        if not len(left) or not len(right):
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = tile_top(left["query_id"].to_numpy(), matrix(left["query"].combine_chunks()), right["vec_id"].to_numpy(), matrix(right["v"].combine_chunks()), k)
        return pa.table({"query_id": found[0], "shard": pa.array(np.full(len(found[0]), shard_, np.int32)), "vec_id": found[1], "score": found[2]})

    keys = ["shard", "block", "dim"]
    lists = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile_table, "query_id long, shard int, vec_id long, score long")
    return merge_top(lists, shards, k, [F.desc("score"), F.asc("vec_id")]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _floor(x):
    """The floor as a double, beyond the range of a long too: above 2^53 a double is whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
