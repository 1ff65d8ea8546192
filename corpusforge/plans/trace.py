"""Answers in rounds with a trace: an append-only table of events, errors of a judge as values, and the state as a fold of events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.config import Settings
from corpusforge.functions.answers import tokens as token_estimate
from corpusforge.operators.context import admit
from corpusforge.operators.filters import SearchFilter, drop_seen
from corpusforge.plans.index import LexicalIndex
from corpusforge.plans.judge import Judge, RuleJudge, status, subquery
from corpusforge.plans.qa import compose, select_source
from corpusforge.plans.search import Chunks, find, with_content

#: query_id, round (from 1; 0 is after the last), place within a round, kind, payload.
EVENTS = "query_id bigint, round int, place int, kind string, payload string"
#: Kinds in the order that they have in a round.
KINDS = ("subquery", "source", "found", "seen", "retried", "judge_failed", "judged", "status", "answer")
#: A stage of a judge: rows (query_id, question, chunk_id, content) and the attempt (from 0) to the same rows with `relevant` and `error`.
Stage = Callable[[DataFrame, int], DataFrame]


def ruled(judge: Judge) -> Stage:
    """A judge's rule as a stage that never fails."""
    return lambda rows, _: rows.withColumn("relevant", judge.relevant(F.col("question"), F.col("content"))).withColumn("error", F.lit(None).cast("string"))


def attempted(rows: DataFrame, stage: Stage, attempts: int, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows with `relevant` and `error`, and query_id, attempt, error of what failed. A question fails as a whole if one of its
    rows does; only failed questions are asked again, `attempts` times in all, and the last error stays in their rows."""
    done, failures, left = [], [], rows
    for attempt in range(attempts):
        tried = cut(stage(left, attempt).select(*rows.columns, "relevant", "error"))
        bad = cut(tried.where("error is not null").groupBy("query_id").agg(F.min("error").alias("failed")))
        failures.append(bad.select("query_id", F.lit(attempt).alias("attempt"), F.col("failed").alias("error")))
        done.append(tried.join(bad, "query_id", "left_anti"))
        left = tried.join(bad, "query_id")
        if attempt + 1 == attempts:
            done.append(left.withColumn("error", F.col("failed")).drop("failed"))
        left = left.select(*rows.columns)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.union, failures)


def event(rows: DataFrame, turn: int, kind: str, payload: Column) -> DataFrame:
    return rows.select("query_id", F.lit(turn).alias("round"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))


def answer_traced(index: LexicalIndex, docs: DataFrame, chunks: Chunks, queries: DataFrame, stage: Stage | None = None, attempts: int = 2, sources: DataFrame | None = None, settings: Settings = Settings(), filters: SearchFilter | None = None, cut: Callable[[DataFrame], DataFrame] | None = None, judge: Judge | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers as answer_adaptive() gives them, and the events that led there.

    A stage that still fails for a question after its attempts doesn't end it: all that the round found counts, and the trace has
    the error. A round whose chunks were all met before adds nothing and says so. cut writes a table and reads it again, so no
    round is worked out twice."""
    judge, cut = judge or RuleJudge(), cut or (lambda df: df)
    stage = stage or ruled(judge)
    state = queries.select("query_id", "text", F.array().cast("array<string>").alias("asked"), F.lit("").alias("seen_text"), F.lit("NOT_READY").alias("status"))
    asked, seen, context, events = queries.count(), None, None, []
    for turn in range(1, settings.max_rounds + 1):
        lacking = judge.uncovered(F.col("text"), F.col("seen_text"))
        state = cut(state.withColumn("ask", F.when(F.col("status") == "NOT_READY", subquery(lacking, F.col("text"), F.col("asked")))))
        asks = state.where("ask is not null").select("query_id", F.col("ask").alias("text"))
        events.append(event(asks, turn, "subquery", F.col("text")))
        if sources is not None:
            events.append(event(select_source(asks, sources), turn, "source", F.col("source")))
        found = cut(find(index, docs, chunks, asks, settings, filters))
        fresh = found if seen is None else cut(drop_seen(found, seen))
        counts = asks.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("all")), "query_id", "left").join(fresh.groupBy("query_id").agg(F.count("*").alias("new")), "query_id", "left").fillna(0)
        events.append(event(counts.where("`all` = 0 or new > 0"), turn, "found", F.col("new")))
        events.append(event(counts.where("`all` > 0 and new = 0"), turn, "seen", F.col("all")))
        seen = fresh.select("query_id", "chunk_id") if seen is None else seen.union(fresh.select("query_id", "chunk_id"))
        rows = with_content(fresh, chunks, asked * settings.final_chunks_k).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        judged, failures = attempted(cut(rows.select("query_id", "chunk_id", "content", "question", "rank")), stage, attempts, cut)
        judged = cut(judged.where(F.col("relevant") | F.col("error").isNotNull()))
        events.append(event(failures.where(F.col("attempt") < attempts - 1), turn, "retried", F.col("error")))
        events.append(event(failures.where(F.col("attempt") == attempts - 1), turn, "judge_failed", F.col("error")))
        kept = asks.select("query_id").join(judged.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left").fillna(0)
        events.append(event(kept, turn, "judged", F.col("kept")))
        rows = judged.select("query_id", "chunk_id", "content", "question", (F.col("rank") + (turn - 1) * settings.final_chunks_k).alias("pos"), token_estimate(F.col("content")).alias("tokens"))
        context = rows if context is None else context.union(rows)
        new = rows.groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("content"))).alias("new_text"))
        state = state.join(new, "query_id", "left").withColumn("asked", F.when(F.col("ask").isNotNull(), F.concat("asked", F.array("ask"))).otherwise(F.col("asked")))
        state = state.withColumn("seen_text", F.concat_ws(" ", "seen_text", "new_text"))
        told = status(judge.uncovered(F.col("text"), F.col("seen_text")), F.col("new_text").isNotNull())
        state = cut(state.withColumn("status", F.when(F.col("ask").isNull(), F.col("status")).otherwise(told)))
        events.append(event(state.where("ask is not null"), turn, "status", F.col("status")))
        state = state.select("query_id", "text", "asked", "seen_text", "status")
    answers = cut(compose(admit(context, settings.context_tokens), queries))
    events.append(event(answers, 0, "answer", F.size("chunk_ids")))
    return answers, reduce(DataFrame.union, events)


def folded(events: DataFrame) -> DataFrame:
    """The state of each question from its events alone: rounds, subqueries in order, sources, chunks found and kept, failed rounds,
    the last status, and whether it has an answer. Events may come in any order, and twice."""
    once = events.distinct()
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    number = F.col("payload").cast("bigint")
    made = once.groupBy("query_id").agg(
        F.coalesce(F.max(of("subquery", F.col("round"))), F.lit(0)).alias("rounds"), F.sort_array(F.collect_list(of("subquery", F.struct("round", "payload")))).alias("asked"), F.array_sort(F.collect_set(of("source", F.col("payload")))).alias("sources"),
        F.coalesce(F.sum(of("found", number)), F.lit(0)).alias("found"), F.coalesce(F.sum(of("judged", number)), F.lit(0)).alias("kept"), F.count_if(F.col("kind") == "judge_failed").alias("failed_rounds"), F.count_if(F.col("kind") == "retried").alias("retries"),
        F.max_by(of("status", F.col("payload")), of("status", F.col("round"))).alias("status"), F.coalesce(F.max(of("answer", F.lit(True))), F.lit(False)).alias("answered"),
    )
    return made.withColumn("asked", F.transform("asked", lambda a: a["payload"]))


def trace_lines(events: DataFrame) -> DataFrame:
    """query_id, lines: each question's events as text, in order."""
    order = F.struct(F.when(F.col("round") == 0, 1 << 30).otherwise(F.col("round")).alias("r"), "place", F.concat_ws(" ", "kind", "payload").alias("line"))
    return events.distinct().groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]).alias("lines"))
