"""Indexes and tables that grow by batches and by streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.catalog.corpus import _folder
from corpusforge.catalog.retrieval import _INDEX, _once, _questions
from corpusforge.plans import search
from corpusforge.plans.index import with_counts
from corpusforge.plans.segments import Segments
from corpusforge.sources.tables import HISTORY_SQL, documents, table
from corpusforge.streaming import streams
from corpusforge.streaming.batches import BatchTable

#: The final state of the batches below, in SQL, in the place of documents.
_FINAL = """final AS (
    SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN lang || ' ' || source WHEN doc_id % 6 = 0 THEN text || ' replaced once' ELSE text END AS text
    FROM documents WHERE doc_id % 35 <> 1)"""
_GROWN = _FINAL + "," + _INDEX.replace("FROM documents", "FROM final")


def _grown(spark, d):
    """Three batches: two thirds of the documents; the rest, and new texts for every sixth; new texts for every fifth (some of
    them replaced before), while others are removed."""

    def make(at):
        docs = documents(spark, d).select("doc_id", "content", "lang", "source")
        held = Segments(spark, at)
        third = F.col("doc_id") % 3 == 2
        held.add(docs.where(~third), 1)
        held.add(docs.where(third | (F.col("doc_id") % 6 == 0)).withColumn("content", F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit(" replaced once"))).otherwise(F.col("content"))), 2)
        gone = docs.where("doc_id % 35 = 1").select(F.lit("all").alias("scope"), F.col("doc_id").alias("doc"))
        held.add(docs.where("doc_id % 5 = 0").withColumn("content", F.concat_ws(" ", "lang", "source")), 3, removed=gone)

    return Segments(spark, _once(spark, ("segments", d), make))


@query("index_upsert", f"WITH {_GROWN} SELECT p.term, doc, tf, len, df, n, round(avg_len, 9) AS avg_len FROM postings p JOIN terms USING (term) JOIN lens USING (doc) CROSS JOIN corpus")
def index_upsert(spark, d):
    """After three batches with replaced and removed documents: each posting with its term's and its corpus's statistics."""
    held = _grown(spark, d).index()
    rows = with_counts(held.postings, held.terms).join(F.broadcast(held.corpus), "scope")
    return rows.select("term", "doc", "tf", F.col("len").cast("long").alias("len"), "df", "n", F.round("avg_len", 9).alias("avg_len"))


@query("index_upsert_topk", f"WITH {_GROWN} SELECT query_id, doc, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def index_upsert_topk(spark, d):
    """The search over the index that grew by batches."""
    return search.bm25(_grown(spark, d).index(), _questions(spark, d), 10).select("query_id", "doc", "score", "rank")


@query("index_compacted", f"WITH {_GROWN} SELECT term, df FROM terms")
def index_compacted(spark, d):
    """Terms of the same index after its segments were merged to one."""
    held = _grown(spark, d)
    at = _once(spark, ("compacted", d), lambda at: held.compact(at))
    return Segments(spark, at).index().terms.select("term", "df")


def _stream(spark, d, name):
    """The files of a table as a stream."""
    return streams.read_table(spark, f"{d}/{name}.parquet", table(spark, d, name).schema)


def _written(spark, d, events, name):
    """Events written by a stream to files, and read."""
    at = _folder(spark, name)
    streams.append(events, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out")


_STEPS = """s AS (SELECT conv_id, turn, text, 1600000000 + conv_id * 60 + turn AS sec,
    CASE WHEN role = 'assistant' AND turn >= 3 THEN 'final' WHEN role = 'system' AND turn > 0 THEN 'error' ELSE 'step' END AS kind FROM conversations),
e AS (SELECT conv_id, min(turn) FILTER (kind <> 'step') AS until_, max(sec) AS latest, count(*) AS n FROM s GROUP BY conv_id)"""


@query("stream_answers", f"""WITH {_STEPS}
SELECT conv_id AS query_id, turn AS step, CASE kind WHEN 'final' THEN 'final_response' WHEN 'error' THEN 'error' ELSE 'reasoning_update' END AS event, text AS label,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM s JOIN e USING (conv_id) WHERE until_ IS NULL OR turn <= until_
UNION ALL SELECT conv_id, n + 1, 'error', 'Query processing failed', n FROM e WHERE until_ IS NULL AND latest + 1800 < (SELECT max(sec) FROM s)""")
def stream_answers(spark, d):
    """Conversations as questions: the first late reply of the assistant is the answer, a late word of the system an error; a
    question without either that event time has left half an hour behind ends with an error."""
    kind = F.when((F.col("role") == "assistant") & (F.col("turn") >= 3), "final").when((F.col("role") == "system") & (F.col("turn") > 0), "error").otherwise("step")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("conv_id") * 60 + F.col("turn"))
    steps = _stream(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("step"), kind.alias("kind"), F.col("text").alias("label"), at.alias("at"))
    return _written(spark, d, streams.question_events(steps, "30 minutes"), "answers")


@query("stream_steps_cumulative", "SELECT conv_id AS query_id, count(*) AS steps, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def stream_steps_cumulative(spark, d):
    steps = _stream(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("step"), F.lit("step").alias("kind"), F.col("role").alias("label"), F.timestamp_seconds(F.lit(1)).alias("at"))
    rows = streams.cumulative_steps(_written(spark, d, streams.question_events(steps), "steps"))
    return rows.select("query_id", F.size("steps").cast("long").alias("steps"), F.array_join(F.transform("steps", lambda s: s["label"]), ",").alias("roles"))


@query("stream_event_windows", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """Each batch upserts the windows that it changed."""
    at = _folder(spark, "windows")
    windows = streams.event_windows(_stream(spark, d, "events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    held = BatchTable(spark, f"{at}/out", "day string, event_type string, n bigint, total double", ("day", "event_type"))
    streams.upsert(windows, held, f"{at}/state").awaitTermination()
    return held.read()


@query("stream_history", "WITH " + HISTORY_SQL + " SELECT timestamp, conv_id, turn, role, text FROM history")
def stream_history(spark, d):
    """The history kept by a stream: a turn that comes twice stands once."""
    at = _folder(spark, "history")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd HH:mm:ss")
    rows = _stream(spark, d, "conversations").select(stamp.alias("timestamp"), "conv_id", "turn", "role", "text")
    held = BatchTable(spark, f"{at}/out", "timestamp string, conv_id bigint, turn bigint, role string, text string", ("conv_id", "turn"))
    for _ in range(2):  # the second run starts where the first has ended
        streams.upsert(rows, held, f"{at}/state", "append").awaitTermination()
    return held.read()


@query("stream_index", f"WITH {_INDEX} SELECT query_id, doc, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def stream_index(spark, d):
    """An index kept by a stream, a segment for each batch, and the search over it."""

    def make(at):
        held = Segments(spark, f"{at}/index")
        streams.each_batch(_stream(spark, d, "documents"), lambda df, n: held.add(df, n + 1, content="text"), f"{at}/state").awaitTermination()

    held = Segments(spark, _once(spark, ("stream_index", d), make) + "/index")
    return search.bm25(held.index(), _questions(spark, d), 10).select("query_id", "doc", "score", "rank")
