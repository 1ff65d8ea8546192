"""Chunks made for the documents that a search has found, against the same chunks as a table."""

from pyspark.sql import functions as F

from corpusforge.config import Settings
from corpusforge.functions.ids import dashed
from corpusforge.operators import chunking
from corpusforge.plans import index, qa, search, trace

DOCS = [(1, "The red fox runs. It runs over the hill."), (2, "A blue whale swims in the sea. The whale is old."), (3, "Green grass grows on the hill."), (4, "The sea is deep. And it is blue."), (5, "Never asked for. Nor cut.")]
ASKED = [(1, "red fox hill"), (2, "blue whale sea"), (3, "green grass"), (4, "zebra")]


def sides(spark):
    docs = spark.createDataFrame(DOCS, "doc long, content string").withColumn("uuid", dashed(F.md5(F.col("doc").cast("string")))).withColumn("create_date", F.lit(None).cast("date")).withColumn("type", F.lit("PDF")).withColumn("link", F.lit(""))
    cut = lambda rows, keep: chunking.chunks(rows, chunking.naive(F.col("content"), Settings(ideal_chunk_size=20)), keep=keep)

    def made(found):
        rows = docs.join(found, "doc")
        # a document that no question has found isn't cut
        rows = rows.withColumn("content", F.when(F.col("doc") == 5, F.raise_error(F.lit("cut"))).otherwise(F.col("content")))
        return cut(rows, tuple(found.columns)).select("chunk_id", "content", *found.columns)

    table = cut(docs, ("doc",)).select("chunk_id", "doc", "content")
    held = index.build(docs.withColumnRenamed("doc", "doc_id"))
    return held, docs.select("doc", "type", "create_date"), (table, made), spark.createDataFrame(ASKED, "query_id long, text string")


def test_as_with_a_table(spark, tmp_path):
    held, docs, both, asked = sides(spark)
    n = iter(range(10_000))

    def cut(df):
        at = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    by_sea = lambda c: F.when(F.contains(c, F.lit("sea")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    for run in (
        lambda c: search.find(held, docs, c, asked),
        lambda c: search.find(held, docs, c, asked, embed=by_sea, score=lambda q, c: F.length(c).cast("double")),
        lambda c: qa.answer_standard(held, docs, c, asked),
        lambda c: trace.trace_lines(trace.answer_traced(held, docs, c, asked, settings=Settings(max_rounds=1), cut=cut)[1]),
    ):
        table, made = (sorted(map(str, run(c).collect())) for c in both)
        assert table == made
        assert len(table) >= 4


def test_the_catalogs_chunks(spark, sf_dir):
    """Of one document asked for, only its chunks, as the whole table of chunks has them."""
    from corpusforge.catalog.retrieval import _chunks
    from corpusforge.sources.tables import documents

    whole = chunking.chunks(documents(spark, sf_dir).withColumnRenamed("doc_id", "doc"), chunking.naive(F.col("content")), keep=("doc",)).where("doc in (3, 7)")
    found = spark.createDataFrame([(3, 1), (7, 2)], "doc long, place int")
    rows = lambda df: sorted((r["chunk_id"], r["doc"], r["content"]) for r in df.collect())
    assert rows(_chunks(spark, sf_dir)(found)) == rows(whole)
