"""Batches to Python are bounded by bytes, not by rows alone."""

from pyspark.sql import functions as F

from corpusforge.operators import chunking


def test_semantic_chunks_go_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3).select(F.lit("One thing. Another thing.").alias("content"))
    assert docs.select(F.explode(chunking.semantic(F.col("content")))).count() >= 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
