"""Traces of answers: a judge that fails, retries, chunks met before, and the state as a fold of events."""

import pytest
from pyspark.sql import functions as F

from corpusforge.config import Settings
from corpusforge.plans import index, judge, qa, trace

DOCS = [(1, "the red fox runs over the hill"), (2, "a blue whale swims in the sea"), (3, "green grass grows on the hill"), (4, "the sea is deep and blue")]
ASKED = [(1, "red fox hill"), (2, "blue whale sea"), (3, "green grass"), (4, "zebra")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string")
    plain = docs.select(F.col("doc_id").alias("doc"), F.lit("PDF").alias("type"), F.lit(None).cast("date").alias("create_date"))
    return index.build(docs), plain, docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("doc"), "content"), spark.createDataFrame(ASKED, "query_id long, text string")


def failing(always, first):
    def stage(rows, attempt):
        made = trace.ruled(judge.RuleJudge())(rows, attempt)
        fails = F.col("query_id").isin(always) | (F.lit(attempt == 0) & F.col("query_id").isin(first))
        return made.withColumn("error", F.when(fails, F.concat(F.lit(f"attempt {attempt} of "), "query_id")))

    return stage


def run(spark, corpus, tmp_path, stage=None, **options):
    n = iter(range(10_000))

    def cut(df):
        at = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return tuple(cut(x) for x in trace.answer_traced(*corpus, stage, cut=cut, **options))


def test_the_same_answers_as_without_a_trace(spark, corpus, tmp_path):
    answers, events = run(spark, corpus, tmp_path)
    want = {r["query_id"]: (r["answer"], r["chunk_ids"], r["status"], r["rounds"], r["subqueries"]) for r in qa.answer_adaptive(*corpus).collect()}
    got = {r["query_id"]: (r["answer"], r["chunk_ids"]) for r in answers.collect()}
    state = {r["query_id"]: r for r in trace.folded(events).collect()}
    assert {q: (*got[q], state[q]["status"], state[q]["rounds"], state[q]["asked"]) for q in got} == want
    assert all(r["answered"] and r["failed_rounds"] == r["retries"] == 0 for r in state.values())
    # the same events twice, and in parts, fold to the same state
    again = trace.folded(events.union(events).repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, trace.folded(events).collect()))


def test_a_failing_judge(spark, corpus, tmp_path):
    """Question 2 fails always: all that was found counts. Question 3 fails once, and is as without failure."""
    sources = spark.createDataFrame([("land", "fox hill grass"), ("water", "whale sea")], "name string, description string")
    answers, events = run(spark, corpus, tmp_path, failing([2], [3]), sources=sources, settings=Settings(max_rounds=2))
    plain = {r["query_id"]: (r["answer"], r["chunk_ids"]) for r in qa.answer_adaptive(*corpus, settings=Settings(max_rounds=2)).collect()}
    got = {r["query_id"]: (r["answer"], r["chunk_ids"]) for r in answers.collect()}
    assert all(got[q] == plain[q] for q in (1, 3, 4)) and set(plain[2][1]) <= set(got[2][1]) and got[2][0] != qa.NO_INFORMATION
    state = {r["query_id"]: r for r in trace.folded(events).collect()}
    assert state[2]["failed_rounds"] >= 1 and state[2]["retries"] == state[2]["failed_rounds"] and state[2]["sources"] == ["water"]
    assert (state[3]["failed_rounds"], state[3]["retries"]) == (0, 1) and state[1]["retries"] == 0 and got[4][0] == qa.NO_INFORMATION
    lines = {r["query_id"]: r["lines"] for r in trace.trace_lines(events).collect()}
    assert lines[2][:5] == ["subquery blue sea whale", "source water", f"found {state[2]['found']}", "retried attempt 0 of 2", "judge_failed attempt 1 of 2"] and lines[2][-1].startswith("answer ")
    assert lines[4][2] == "found 0" and lines[4][-1] == "answer 0"


def test_chunks_met_before(spark, corpus, tmp_path):
    """A second round that finds the same chunks only says so."""
    docs, questions = corpus[:3], spark.createDataFrame([(9, "red fox zebra hill")], "query_id long, text string")

    class Lacking(judge.RuleJudge):
        def uncovered(self, question, context):
            return F.array(F.lit("hill"), F.lit("fox"))

    answers, events = run(spark, (*docs, questions), tmp_path, judge=Lacking(), settings=Settings(max_rounds=3))
    (state,) = trace.folded(events).collect()
    kinds = [(r["round"], r["kind"]) for r in events.collect()]
    assert (2, "seen") in kinds and state["status"] == "EXHAUSTED" and state["rounds"] == 2 and state["answered"]
