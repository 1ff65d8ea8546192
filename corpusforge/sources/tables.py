"""Test tables in the roles of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.ids import dashed

# Kinds of documents, as the filter of the interface names them.
KINDS = ["Email", "PDF", "Word processing", "Presentation", "Spreadsheet", "Chatbericht"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a uuid, a date (none for every 17th) and a kind (none for every 23rd)."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        "doc_id", F.col("text").alias("content"), "lang", "source", dashed(F.md5(F.col("doc_id").cast("string"))).alias("uuid"),
        F.when(F.col("doc_id") % 17 != 0, day).alias("create_date"), F.when(F.col("doc_id") % 23 != 0, kind).alias("type"), F.concat(F.lit("https://example.org/d/"), F.col("doc_id")).alias("link"),
    )


#: The same in DuckDB's SQL, as a named query `docs`.
DOCS_SQL = """docs AS (
    SELECT doc_id, text AS content, lang, source,
        concat_ws('-', substr(md5(doc_id::VARCHAR), 1, 8), substr(md5(doc_id::VARCHAR), 9, 4), substr(md5(doc_id::VARCHAR), 13, 4), substr(md5(doc_id::VARCHAR), 17, 4), substr(md5(doc_id::VARCHAR), 21, 12)) AS uuid,
        CASE WHEN doc_id % 17 <> 0 THEN DATE '2020-01-01' + (doc_id % 1000)::INTEGER END AS create_date,
        CASE WHEN doc_id % 23 <> 0 THEN ['Email', 'PDF', 'Word processing', 'Presentation', 'Spreadsheet', 'Chatbericht'][doc_id % 6 + 1] END AS type,
        'https://example.org/d/' || doc_id AS link
    FROM documents)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their lines as rows of metadata: an order is the head of the family of its lines."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("doc-"), F.col("o_orderkey")).alias("ID"), F.concat(F.lit("doc-"), F.col("o_orderkey")).alias("Family"), F.lit(0).alias("ord"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc-"), F.col("l_orderkey") * 10 + F.col("l_linenumber") + 100_000_000).alias("ID"), F.concat(F.lit("doc-"), F.col("l_orderkey")).alias("Family"), F.col("l_linenumber").alias("ord"))
    rows = o.union(li)
    name = F.concat(F.lit("name of "), F.col("ID"))
    return rows.select("ID", "Family", "ord", name.alias("Document"), F.concat(F.lit("https://example.org/"), F.col("ID")).alias("Document Link"), F.concat(F.lit("b"), F.col("Family")).alias("besluit_id"))


METADATA_SQL = """metadata AS (
    SELECT "ID", "Family", ord, 'name of ' || "ID" AS "Document", 'https://example.org/' || "ID" AS "Document Link", 'b' || "Family" AS besluit_id FROM (
        SELECT 'doc-' || o_orderkey AS "ID", 'doc-' || o_orderkey AS "Family", 0 AS ord FROM orders
        UNION ALL SELECT 'doc-' || (l_orderkey * 10 + l_linenumber + 100000000), 'doc-' || l_orderkey, l_linenumber FROM lineitem))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a history: a minute for each conversation, a second for each turn."""
    c = table(spark, sf_dir, "conversations")
    at = F.lit(1_600_000_000) + F.col("conv_id") * 60 + F.col("turn")
    return c.select(F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "conv_id", "turn", "role", "text")


HISTORY_SQL = """history AS (
    SELECT strftime(make_timestamp((1600000000 + conv_id * 60 + turn) * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp, conv_id, turn, role, text FROM conversations)"""
