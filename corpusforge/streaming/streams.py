"""Streams: ingestion of documents, events of questions, windows over events. Nothing passes through the driver: results go to
files, or batch by batch into a table that a repeated batch leaves as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusforge.functions.answers import event_frame
from corpusforge.streaming.batches import BatchTable

#: The names of the events of a question, and what a question that gets no answer in time is told.
UPDATE, FINAL, ERROR = "reasoning_update", "final_response", "error"
NO_ANSWER = "Query processing failed"


def read_files(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files of a table as a stream, be it one file or a folder of them. A stream takes a file's own path for a folder's, and a
    name of files alone doesn't match what lies in a folder; a pattern of the one path is right for both."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, then an end: each file is taken once, also over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Gives all that is there now to save(rows, batch number), batch by batch. A batch that failed comes again under its number,
    so save() must take the place of what it wrote under that number before."""
    return stream.writeStream.foreachBatch(lambda df, number: save(df, number)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert(stream: DataFrame, table: BatchTable, checkpoint: str, mode: str = "update", keep: int = 20) -> StreamingQuery:
    """Upserts each batch's rows by the table's keys; after every `keep` batches they are merged to one."""

    def save(df: DataFrame, number: int) -> None:
        table.write(df, number)
        if number % keep == keep - 1:
            table.merge()

    return each_batch(stream, save, checkpoint, mode)


def question_events(steps: DataFrame, patience: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """query_id, step, event, label, n: the events of questions from their steps (query_id, step, kind, label, at).

    Each step gives an update, n being how many steps the question has by then. A step of kind `final` or `error` gives that
    event and ends the question; so does an error when event time has passed the last step by `patience`. A question ends once:
    what comes for it later, or stands after the end in the same batch, gives nothing. The state of a question is two numbers,
    kept for `patience` after its end. A question's rows of one batch are held together in one worker; per_trigger bounds them.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        rows: list[tuple] = []
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            rows, ended = [(key[0], n + 1, ERROR, NO_ANSWER, n)], True
            state.update((n, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait + 1)
        else:
            held = pd.concat(list(frames)).sort_values(["step", "kind"], kind="stable")
            until = int(held["at"].max().timestamp() * 1000) + wait
            if not ended:
                for step, kind, label in held[["step", "kind", "label"]].itertuples(index=False):
                    n += 1
                    ended = kind in ("final", "error")
                    rows.append((key[0], step, {"final": FINAL, "error": ERROR}.get(kind, UPDATE), label, n))
                    if ended:
                        break
            state.update((n, ended))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["query_id", "step", "event", "label", "n"])

    timed = steps.withWatermark("at", late).groupBy("query_id")
    return timed.applyInPandasWithState(run, "query_id bigint, step bigint, event string, label string, n bigint", "n bigint, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def cumulative_steps(events: DataFrame) -> DataFrame:
    """query_id and all its steps, in order, of written events."""
    return events.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("step", "label"))).alias("steps"))


def frames(steps: DataFrame) -> DataFrame:
    return steps.select("query_id", event_frame(F.lit("status"), F.to_json(F.struct("steps"))).alias("frame"))


def event_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type; event time as a timestamp with a zone, for the watermark. In update mode the
    state of a window goes when the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
