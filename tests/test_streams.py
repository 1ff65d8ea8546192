"""Streams over several files and restarts."""

import pytest
from pyspark.sql import functions as F

from corpusforge.plans.segments import Segments
from corpusforge.streaming import streams
from corpusforge.streaming.batches import BatchTable

STEPS = "query_id long, step long, kind string, label string, at timestamp"


def put(spark, rows, path):
    """One more file of steps; at is in seconds."""
    made = spark.createDataFrame(rows, "query_id long, step long, kind string, label string, s long")
    made.select("query_id", "step", "kind", "label", F.timestamp_seconds(F.col("s") + 1000).alias("at")).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    stream = streams.question_events(streams.read_files(spark, f"{tmp_path}/in", STEPS, per_trigger=1), **options)
    streams.append(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = spark.read.schema("query_id long, step long, event string, label string, n long").parquet(f"{tmp_path}/out").collect()
    return sorted(tuple(r) for r in rows)


U, E, A = streams.UPDATE, streams.ERROR, streams.FINAL


def test_questions_end_once_over_batches_and_restarts(spark, tmp_path):
    tmp_path = f"file://{tmp_path}"
    put(spark, [(1, 1, "step", "a", 0), (2, 1, "step", "x", 1), (3, 1, "step", "p", 2), (3, 2, "final", "q", 3), (3, 3, "step", "after the end", 4)], f"{tmp_path}/in")
    first = [(1, 1, U, "a", 1), (2, 1, U, "x", 1), (3, 1, U, "p", 1), (3, 2, A, "q", 2)]
    assert run(spark, tmp_path, patience="100 seconds", late="10 seconds") == first
    put(spark, [(1, 2, "step", "b", 20), (3, 4, "final", "twice", 21), (2, 2, "error", "broken", 22)], f"{tmp_path}/in")
    second = sorted([*first, (1, 2, U, "b", 2), (2, 2, E, "broken", 2)])
    assert run(spark, tmp_path, patience="100 seconds", late="10 seconds") == second
    # a restart without new files adds nothing; a question that waited too long gets its error
    assert run(spark, tmp_path, patience="100 seconds", late="10 seconds") == second
    put(spark, [(4, 1, "step", "late", 500)], f"{tmp_path}/in")
    third = sorted([*second, (1, 3, E, streams.NO_ANSWER, 2), (4, 1, U, "late", 1)])
    assert run(spark, tmp_path, patience="100 seconds", late="10 seconds") == third
    put(spark, [(4, 2, "final", "done", 510)], f"{tmp_path}/in")
    last = run(spark, tmp_path, patience="100 seconds", late="10 seconds")
    assert last == sorted([*third, (4, 2, A, "done", 2)])
    ends = [q for q, _, e, _, _ in last if e != U]
    assert sorted(ends) == [1, 2, 3, 4]


def test_batches_repeated_and_merged(spark, tmp_path):
    held = BatchTable(spark, f"file://{tmp_path}/t", "k long, v string, w int", ("k",))
    make = lambda rows: spark.createDataFrame(rows, "k long, v string, w int")
    rows = lambda: sorted(tuple(r) for r in held.read().collect())
    assert rows() == []
    held.write(make([(1, "a", 1), (2, "b", 1), (2, "c", 1)]), 0)
    held.write(make([(1, "z", 0), (3, None, None)]), 1)
    want = [(1, "z", 0), (2, "c", 1), (3, None, None)]
    assert rows() == want
    held.write(make([(1, "z", 0), (3, None, None)]), 1)
    assert rows() == want
    held.merge()
    assert rows() == want and held.batches() == ["merged=1"]
    held.write(make([(1, "z", 0), (3, None, None)]), 1)  # the last batch comes again after the merge
    assert rows() == want
    held.write(make([(3, "new", 2)]), 2)
    held.merge()
    assert rows() == [*want[:2], (3, "new", 2)] and held.batches() == ["merged=2"]


def test_a_failed_batch_is_taken_again(spark, tmp_path):
    """The job fails after it has written its second batch; the next run leaves nothing out and nothing twice."""
    at = f"file://{tmp_path}"
    for k in range(3):
        spark.createDataFrame([(k, str(k)), (7, f"of {k}")], "k long, v string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    held = BatchTable(spark, f"{at}/t", "k long, v string", ("k",))
    stream = streams.read_files(spark, f"{at}/in", "k long, v string", per_trigger=1)

    def broken(df, number):
        held.write(df, number)
        if number == 1:
            raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        streams.each_batch(stream, broken, f"{at}/state").awaitTermination()
    streams.each_batch(stream, held.write, f"{at}/state").awaitTermination()
    assert sorted(r["k"] for r in held.read().collect()) == [0, 1, 2, 7] and held.batches() == ["batch=0", "batch=1", "batch=2"]


def test_windows_are_upserted_and_leave_the_state(spark, tmp_path):
    at = f"file://{tmp_path}"
    for days in ((1, 1, 2), (2, 3), (9,)):
        rows = spark.createDataFrame([(d, "a", 1.0) for d in days], "d int, event_type string, value double")
        rows.select(F.timestamp_seconds(F.col("d") * 86400 + 60).alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{at}/in")
    made = streams.event_windows(streams.read_files(spark, f"{at}/in", "ts timestamp, event_type string, value double", per_trigger=1))
    held = BatchTable(spark, f"{at}/t", "day long, event_type string, n long, total double", ("day", "event_type"))
    query = streams.upsert(made.select((F.unix_timestamp("w.start") / 86400).cast("long").alias("day"), "event_type", "n", "total"), held, f"{at}/state", keep=2)
    query.awaitTermination()
    assert sorted(tuple(r) for r in held.read().collect()) == [(1, "a", 2, 2.0), (2, "a", 2, 2.0), (3, "a", 1, 1.0), (9, "a", 1, 1.0)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_an_index_of_a_stream(spark, tmp_path):
    """A document that comes again replaces itself, over files and over a repeated batch."""
    at = f"file://{tmp_path}"
    for batch in ([(1, "a b"), (2, "c")], [(1, "d")], [(3, "a"), (2, None)]):
        spark.createDataFrame(batch, "doc_id long, content string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    held = Segments(spark, f"{at}/index")
    calls = []

    def save(df, number):
        held.add(df, number + 1)
        calls.append(number)
        if len(calls) == 2:
            raise ValueError("lost")

    stream = streams.read_files(spark, f"{at}/in", "doc_id long, content string", per_trigger=1)
    with pytest.raises(Exception, match="lost"):
        streams.each_batch(stream, save, f"{at}/state").awaitTermination()
    streams.each_batch(stream, save, f"{at}/state").awaitTermination()
    index = held.index()
    assert calls == [0, 1, 1, 2]
    assert sorted((r["term"], r["df"]) for r in index.terms.collect()) == [("a", 1), ("d", 1)]
    assert [(r["n"], round(r["avg_len"], 6)) for r in index.corpus.collect()] == [(3, 0.666667)]


def test_a_table_is_one_file_or_a_folder_of_files(spark, sf_dir, tmp_path):
    """Tables that are folders of files came as empty streams: stream_ingest_documents, stream_history, stream_steps_cumulative,
    stream_answers and stream_index gave nothing."""
    from corpusforge import catalog

    catalog.load()
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name in ("stream_ingest_documents", "stream_history", "stream_steps_cumulative", "stream_answers", "stream_index"):
        one, many = (sorted(map(str, catalog.QUERIES[name](spark, at).collect())) for at in (sf_dir, f"file://{tmp_path}"))
        assert one == many and many, name
