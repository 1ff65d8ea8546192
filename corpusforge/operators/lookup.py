"""Lookups by id and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(ids: DataFrame, rows: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows for the ids in their order (ids.pos), repeated ones repeated; strict raises on an id that is not there."""
    joined = ids.join(rows.withColumn("_found", F.lit(True)), key, "left")
    if strict:
        check = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col(key)))).otherwise(F.col(key))
        joined = joined.withColumn(key, check)
    return joined.drop("_found").orderBy("pos")


def sample(rows: DataFrame, k: int, key: str, seed: str = "42") -> DataFrame:
    """k rows without replacement, the first by a hash of the key, so that a sample can be drawn again."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(max(k, 1))


def page(history: DataFrame, limit: int, skip: int = 0, *ties: str) -> DataFrame:
    """The newest first."""
    return history.orderBy(F.desc("timestamp"), *ties).offset(skip).limit(limit)


def describe_source(sources: DataFrame, name: str) -> str:
    found = sources.where(F.col("name") == name).select("description").take(1)
    if not found:
        raise ValueError(f"unknown source: {name}")
    return found[0][0]


def candidate_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks, "doc_uuid")


def parents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(chunks.select("doc_uuid"), "doc_uuid", "left_semi")


def cited_documents(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents in the order of the citations; missing_document for a chunk that isn't known."""
    return cited.join(chunks.select("chunk_id", "doc_uuid"), "chunk_id", "left").withColumn("doc_uuid", F.coalesce("doc_uuid", F.lit("missing_document")))


def orphans(chunks: DataFrame, docs: DataFrame, key: str = "doc_uuid") -> DataFrame:
    """Chunks whose document isn't among the given ones: none, where an answer and its documents belong together."""
    return chunks.join(docs.select(key), key, "left_anti")


def evidence(rounds: list[DataFrame]) -> DataFrame:
    """What the rounds of a question have brought, one after another; repeated rows stay."""
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out
