"""Questions in batches: choice of a source, retrieval, judging, context, answer; in one round or in several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.config import Settings
from corpusforge.functions.answers import tokens as token_estimate
from corpusforge.functions.text import sentences
from corpusforge.operators.context import admit
from corpusforge.operators.filters import SearchFilter, drop_seen
from corpusforge.plans.index import LexicalIndex, tokens
from corpusforge.plans.judge import Judge, RuleJudge, status, subquery
from corpusforge.plans.search import Chunks, Embedder, PairScorer, find, overlap, with_content

NO_INFORMATION = "Er is geen informatie gevonden om deze vraag te beantwoorden."


def select_source(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, source: the one whose description shares most words with the question; the first by name when none does."""
    if not sources.take(1):
        raise ValueError("there are no sources")
    words = lambda c: F.explode(F.array_distinct(tokens(c))).alias("word")
    held = sources.select("name", words(F.concat_ws(" ", "name", "description")))
    asked = queries.select("query_id", words(F.col("text")))
    hits = asked.join(held, "word").groupBy("query_id", "name").agg(F.count("*").alias("shared"))
    best = hits.groupBy("query_id").agg(F.min_by("name", F.struct(-F.col("shared"), "name")).alias("source"))
    first = sources.agg(F.min("name")).first()[0]
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("source", F.lit(first)).alias("source"))


def best_sentence(question, content):
    """The sentence of a text that shares most words with the question, the first of such."""
    parts = F.transform(sentences(content), lambda s, i: F.struct(overlap(question, s).alias("o"), (-i).alias("i"), s.alias("s")))
    return F.array_max(parts)["s"]


def relevant_context(found: DataFrame, chunks: Chunks, queries: DataFrame, judge: Judge, budget: int, each: int = Settings().final_chunks_k) -> DataFrame:
    """The chunks that the judge calls relevant, as far as the budget goes; `each` were found for a question at most."""
    rows = with_content(found, chunks, queries.count() * each).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    rows = rows.where(judge.relevant(F.col("question"), F.col("content"))).withColumn("tokens", token_estimate(F.col("content")))
    return admit(rows.withColumnRenamed("rank", "pos"), budget)


def compose(context: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, answer, chunk_ids: the best sentence of each piece with its number; a fixed text without pieces."""
    rows = context.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    rows = rows.withColumn("line", F.concat(F.trim(best_sentence(F.col("question"), F.col("content"))), F.lit(" ["), F.col("n"), F.lit("]")))
    made = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "line", "chunk_id"))).alias("x"))
    made = made.select("query_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("answer"), F.transform("x", lambda y: y["chunk_id"]).alias("chunk_ids"))
    joined = queries.select("query_id").join(made, "query_id", "left")
    return joined.select("query_id", F.coalesce("answer", F.lit(NO_INFORMATION)).alias("answer"), F.coalesce("chunk_ids", F.array().cast("array<bigint>")).alias("chunk_ids"))


def answer_standard(index: LexicalIndex, docs: DataFrame, chunks: Chunks, queries: DataFrame, settings: Settings = Settings(), judge: Judge | None = None, filters: SearchFilter | None = None, embed: Embedder | None = None, score: PairScorer | None = None) -> DataFrame:
    """One round: search, judge, fill the context, answer. A judge that finds nothing gives the fixed text."""
    found = find(index, docs, chunks, queries, settings, filters, embed=embed, score=score)
    return compose(relevant_context(found, chunks, queries, judge or RuleJudge(), settings.context_tokens, settings.final_chunks_k), queries)


def answer_adaptive(index: LexicalIndex, docs: DataFrame, chunks: Chunks, queries: DataFrame, settings: Settings = Settings(), judge: Judge | None = None, filters: SearchFilter | None = None, checkpoint=None, embed: Embedder | None = None, score: PairScorer | None = None) -> DataFrame:
    """Up to max_rounds rounds, each with a query for what the context still lacks; chunks that were met aren't met again.
    Beside the answer: status, rounds, and subqueries, what was asked in each round.

    The plan grows by one search a round; checkpoint (DataFrame -> DataFrame) may cut it between rounds.
    """
    judge = judge or RuleJudge()
    cut = checkpoint or (lambda df: df)
    state = queries.select("query_id", "text", F.array().cast("array<string>").alias("asked"), F.lit("").alias("seen_text"), F.lit("NOT_READY").alias("status"))
    seen = None
    context = None
    asked = queries.count()
    for turn in range(settings.max_rounds):
        lacking = judge.uncovered(F.col("text"), F.col("seen_text"))
        state = cut(state.withColumn("ask", F.when(F.col("status") == "NOT_READY", subquery(lacking, F.col("text"), F.col("asked")))))
        found = find(index, docs, chunks, state.where("ask is not null").select("query_id", F.col("ask").alias("text")), settings, filters, embed=embed, score=score)
        fresh = cut(found if seen is None else drop_seen(found, seen))
        seen = fresh.select("query_id", "chunk_id") if seen is None else seen.union(fresh.select("query_id", "chunk_id"))
        rows = with_content(fresh, chunks, asked * settings.final_chunks_k).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
        rows = rows.where(judge.relevant(F.col("question"), F.col("content"))).withColumn("pos", F.col("rank") + turn * settings.final_chunks_k)
        rows = cut(rows.withColumn("tokens", token_estimate(F.col("content"))).select("query_id", "chunk_id", "content", "question", "pos", "tokens"))
        context = rows if context is None else context.union(rows)
        new = rows.groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("content"))).alias("new_text"))
        state = state.join(new, "query_id", "left").withColumn("asked", F.when(F.col("ask").isNotNull(), F.concat("asked", F.array("ask"))).otherwise(F.col("asked")))
        state = state.withColumn("seen_text", F.concat_ws(" ", "seen_text", "new_text"))
        state = state.withColumn("status", F.when(F.col("ask").isNull(), F.col("status")).otherwise(status(judge.uncovered(F.col("text"), F.col("seen_text")), F.col("new_text").isNotNull())))
        state = state.select("query_id", "text", "asked", "seen_text", "status")
    answers = compose(admit(context, settings.context_tokens), queries)
    return answers.join(state.select("query_id", "status", F.size("asked").alias("rounds"), F.col("asked").alias("subqueries")), "query_id")


def invariants(answers: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows that break what must hold: each chunk's document is known, and no chunk is cited twice in an answer."""
    strays = found.join(docs, "doc", "left_anti").select("query_id", F.lit("unknown document").alias("broken"))
    twice = answers.where(F.size("chunk_ids") != F.size(F.array_distinct("chunk_ids"))).select("query_id", F.lit("chunk cited twice").alias("broken"))
    return strays.union(twice)


def intermediate_answer(pieces, trace, question):
    """From the two latest pieces of context and the answer before (the last that the trace has): the best sentences, after it."""
    from corpusforge.functions.answers import trace_answer
    from corpusforge.operators.context import most_recent

    before = F.element_at(F.filter(F.transform(trace, trace_answer), lambda x: x.isNotNull()), -1)
    before = F.when(F.size(F.filter(F.transform(trace, trace_answer), lambda x: x.isNotNull())) > 0, before)
    return F.concat_ws(" ", before, F.array_join(F.transform(most_recent(pieces), lambda p: F.trim(best_sentence(question, p))), " "))


def suggestions(uncovered, n: int = 3):
    """struct<suggestions, explanation>: questions by a template for words still open, without unsafe ones, which are told of."""
    from corpusforge.plans.judge import safe_suggestions

    made = F.transform(F.slice(uncovered, 1, n), lambda w: F.concat(F.lit("Wat staat er over "), w, F.lit("?")))
    safe = safe_suggestions(made)
    told = F.when(F.size(safe) < F.size(made), "Sommige suggesties zijn weggelaten. ").otherwise("")
    return F.struct(safe.alias("suggestions"), F.concat(told, F.lit("Woorden van de vraag zonder antwoord.")).alias("explanation"))


def verified(question, chunk, least: float = 0.5):
    """Whether a chunk can answer a made question: enough of its words are there."""
    return overlap(question, chunk) >= least
