"""What the two vector searches share: usable vectors, shards of bounded size, and merging of top lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Top lists that one task merges for a query.
FAN_IN = 32


def usable(df: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """vec_id, v array<double>, dim of rows whose id and vector aren't null and whose components are all finite (and not all zero)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    if not allow_zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size(v))


def shards_for(rows: int, size: int) -> int:
    """How many shards hold `rows` at about `size` each."""
    return max(1, -(-rows // size))


def shard_of(id_: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(shards)).cast("int")


def merge_top(lists: DataFrame, shards: int, k: int, order: list[Column]) -> DataFrame:
    """The k first rows of each query by `order`, of rows (query_id, shard, ...) with k at most from each shard: merged as a tree,
    so that a task never gets more than FAN_IN lists of a query."""
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("shard")


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)
