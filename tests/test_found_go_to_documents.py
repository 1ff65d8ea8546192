"""The few documents that a search has found go to the table of documents, which isn't shuffled."""

import pytest

from corpusforge import catalog

catalog.load()


@pytest.mark.parametrize("name", ["find_whole_documents", "find_end_to_end"])
def test_find(spark, sf_dir, name):
    assert_stays(spark, sf_dir, name)


def assert_stays(spark, sf_dir, name):
    """Even where Spark itself would broadcast nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["source_documents_of_chunks", "candidate_chunks", "bm25_topk_filtered"])
def test_lookups(spark, sf_dir, name):
    assert_stays(spark, sf_dir, name)
