"""The context of an answer: token budget, eviction, order of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admit(pieces: DataFrame, budget: int, query: str = "query_id", pos: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Pieces in order while their running total fits; the first that doesn't ends it, and smaller ones after it stay out."""
    w = Window.partitionBy(query).orderBy(pos)
    total = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = pieces.withColumn("running", total)
    over = F.max((F.col("running") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("over", over).where("over = 0").drop("over")


def evict(pieces: DataFrame, budget: int, query: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """What stays when reasoning goes first, then context, each the oldest first, until the rest fits."""
    w = Window.partitionBy(query).orderBy(F.desc("is_context"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("kept_tokens", F.sum(tokens).over(w)).where(F.col("kept_tokens") <= budget)


def most_recent(pieces: Column, n: int = 2) -> Column:
    return F.slice(pieces, F.greatest(F.size(pieces) - n, F.lit(0)) + 1, n)


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.dropDuplicates(["query_id", "chunk_id"])
