"""Scans, filters, lookups, history, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.functions.answers import cited_ids, citation_numbers, compress_ids, decompress_ids, renumber, tokens
from corpusforge.operators import context, filters, lookup, metadata
from corpusforge.operators.filters import SearchFilter
from corpusforge.plans import evaluate, judge, training
from corpusforge.sources.tables import DOCS_SQL, HISTORY_SQL, documents, history, table
from corpusforge.streaming import streams

_D = "WITH " + DOCS_SQL + " "


@query("scan_documents", _D + "SELECT doc_id, uuid, type, CAST(create_date AS VARCHAR) AS create_date, link, source FROM docs WHERE content IS NOT NULL AND uuid IS NOT NULL")
def scan_documents(spark, d):
    docs = documents(spark, d).where("content is not null and uuid is not null")
    return docs.select("doc_id", "uuid", "type", F.col("create_date").cast("string").alias("create_date"), "link", "source")


@query("source_list", "SELECT DISTINCT source AS name, 'documents of ' || source AS description FROM documents")
def source_list(spark, d):
    return documents(spark, d).select(F.col("source").alias("name"), F.concat(F.lit("documents of "), "source").alias("description")).distinct()


@query("source_counts", "SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages FROM documents GROUP BY source")
def source_counts(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"))


def _filtered(name, f, where):
    @query(name, _D + f"SELECT doc_id, type, CAST(create_date AS VARCHAR) AS create_date FROM docs WHERE {where}")
    def run(spark, d):
        return filters.apply(documents(spark, d), f).select("doc_id", "type", F.col("create_date").cast("string").alias("create_date"))


_a, _b = datetime(2020, 6, 1), datetime(2021, 3, 31)
_filtered("filter_period", SearchFilter(_a, _b), "create_date BETWEEN DATE '2020-06-01' AND DATE '2021-03-31'")
_filtered("filter_types", SearchFilter(types=("Email", "PDF")), "type IN ('Email', 'PDF')")
_filtered("filter_period_and_types", SearchFilter(_a, _b, ("PDF",)), "create_date BETWEEN DATE '2020-06-01' AND DATE '2021-03-31' AND type IN ('PDF')")
_filtered("filter_open_ended", SearchFilter.from_request("2021-01-01", "not a date"), "create_date >= DATE '2021-01-01'")


@query("lookup_documents_ordered", _D + "SELECT q.item_id AS pos, q.item_id * 7 % 50 AS doc_id, d.uuid FROM benchmark q LEFT JOIN docs d ON d.doc_id = q.item_id * 7 % 50")
def lookup_documents_ordered(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 7 % 50).alias("doc_id"))
    return lookup.ordered(ids, documents(spark, d).select("doc_id", "uuid"), "doc_id").select("pos", "doc_id", "uuid")


@query("lookup_chunk_source", _D + "SELECT q.item_id, d.source FROM benchmark q JOIN docs d ON d.doc_id = q.item_id * 3")
def lookup_chunk_source(spark, d):
    ids = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    return ids.join(documents(spark, d).select("doc_id", "source"), "doc_id").select("item_id", "source")


@query("sample_documents", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '42'), doc_id LIMIT 25")
def sample_documents(spark, d):
    return lookup.sample(documents(spark, d), 25, "doc_id").select("doc_id")


@query("date_order", _D + "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY create_date NULLS LAST, doc_id) AS place FROM docs")
def date_order(spark, d):
    """All sources, ordered within each."""
    return filters.places_by_date(documents(spark, d).withColumn("rank", F.col("doc_id")), "source").select("source", "doc_id", "place")


@query("history_page", "WITH " + HISTORY_SQL + " SELECT timestamp, conv_id, turn, role FROM history ORDER BY timestamp DESC, conv_id, turn LIMIT 20 OFFSET 10")
def history_page(spark, d):
    return lookup.page(history(spark, d), 20, 10, "conv_id", "turn").select("timestamp", "conv_id", "turn", "role")


@query("last_intermediate", "SELECT conv_id, max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_intermediate(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))


@query("chat_records", "WITH q AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, max_by(text, turn) AS response, count(*) AS turns FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, question, response, turns FROM q JOIN a USING (conv_id)")
def chat_records(spark, d):
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    a = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("response"), F.count("*").alias("turns"))
    return q.join(a, "conv_id").select("conv_id", "question", "response", "turns")


def _pieces(spark, d):
    """Pieces of context: documents of a source as a question's, in order of their ids."""
    return documents(spark, d).select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), tokens(F.col("content")).alias("tokens"))


_PIECES = "p AS (SELECT source AS query_id, doc_id AS chunk_id, doc_id AS pos, CAST(floor(length(text) / 4) AS INTEGER) AS tokens FROM documents)"


@query("dedupe_seen_chunks", f"WITH {_PIECES} SELECT query_id, chunk_id FROM p WHERE chunk_id % 3 <> 0")
def dedupe_seen_chunks(spark, d):
    p = _pieces(spark, d)
    return filters.drop_seen(p, p.where("chunk_id % 3 = 0")).select("query_id", "chunk_id")


@query("relevant_chunks", "SELECT doc_id, pos FROM (SELECT doc_id, doc_id % 5 AS pos, CASE WHEN doc_id % 7 = 0 THEN [0, 9] ELSE [1, 3] END AS i FROM documents) WHERE list_contains(i, pos) AND len(list_filter(i, lambda x: x < 0 OR x >= 5)) = 0")
def relevant_chunks(spark, d):
    indices = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(3)))
    rows = documents(spark, d).select("doc_id", (F.col("doc_id") % 5).alias("pos"), indices.cast("array<bigint>").alias("indices"), F.lit(5).alias("size"))
    return filters.judged_relevant(rows).select("doc_id", "pos")


@query("context_budget", f"WITH {_PIECES}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos) AS running FROM p) SELECT query_id, chunk_id, CAST(running AS BIGINT) AS running FROM (SELECT *, max(running > 5000) OVER (PARTITION BY query_id ORDER BY pos) AS over FROM r) WHERE NOT over")
def context_budget(spark, d):
    return context.admit(_pieces(spark, d), 5000).select("query_id", "chunk_id", F.col("running").cast("long").alias("running"))


@query("evict_oldest", f"WITH {_PIECES}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY chunk_id % 2 DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS kept FROM p) SELECT query_id, chunk_id, CAST(kept AS BIGINT) AS kept_tokens FROM r WHERE kept <= 8000")
def evict_oldest(spark, d):
    rows = _pieces(spark, d).withColumn("is_context", F.col("chunk_id") % 2)
    return context.evict(rows, 8000).select("query_id", "chunk_id", F.col("kept_tokens").cast("long").alias("kept_tokens"))


@query("used_sources", "SELECT lang, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY lang")
def used_sources(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


_NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all(t, '[0-9]+', 0), lambda x: x::BIGINT)))"


def _cited(spark, d):
    text = F.concat(F.lit("intro [z] ["), F.col("turn") + 7, F.lit("] and ["), F.col("turn") + 2, F.lit(","), F.col("turn") + 7, F.lit(",11]. See [12] ["), F.col("conv_id"), F.lit("]."))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("t"))


_CITED = "c AS (SELECT conv_id, turn, 'intro [z] [' || (turn + 7) || '] and [' || (turn + 2) || ',' || (turn + 7) || ',11]. See [12] [' || conv_id || '].' AS t FROM conversations), n AS (SELECT *, " + _NUMBERS + " AS numbers FROM c)"


@query("citations_reorder", f"WITH {_CITED} SELECT conv_id, turn, 'intro [z] [' || list_position(numbers, turn + 7) || '] and [' || list_position(numbers, turn + 2) || ',' || list_position(numbers, turn + 7) || ',' || list_position(numbers, 11) || ']. See [' || list_position(numbers, 12) || '] [' || list_position(numbers, conv_id) || '].' AS text, numbers FROM n")
def citations_reorder(spark, d):
    return _cited(spark, d).select("conv_id", "turn", renumber(F.col("t")).alias("text"), citation_numbers(F.col("t")).alias("numbers"))


@query("citations_chunk_order", f"WITH {_CITED} SELECT conv_id, turn, list_transform(numbers, lambda x: CASE WHEN x BETWEEN 1 AND 12 THEN 'c' || x ELSE 'missing_chunk_' || x END) AS ids FROM n")
def citations_chunk_order(spark, d):
    ids = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("c"), i))
    return _cited(spark, d).select("conv_id", "turn", cited_ids(F.col("t"), ids).alias("ids"))


@query("citation_documents", f"WITH {_CITED}, u AS (SELECT conv_id, turn, unnest(numbers) AS x FROM n) SELECT conv_id, turn, x AS chunk_id, coalesce('doc-' || d.doc_id, 'missing_document') AS doc_uuid FROM u LEFT JOIN documents d ON d.doc_id = x")
def citation_documents(spark, d):
    cited = _cited(spark, d).select("conv_id", "turn", F.explode(citation_numbers(F.col("t"))).alias("chunk_id"))
    chunks = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc-"), "doc_id").alias("doc_uuid"))
    return lookup.cited_documents(cited, chunks).select("conv_id", "turn", "chunk_id", "doc_uuid")


@query("ids_compress_roundtrip", "SELECT doc_id, base64(('[\"' || doc_id || '\",\"' || source || '\"]')::BLOB) AS packed, [doc_id::VARCHAR, source] AS ids FROM documents")
def ids_compress_roundtrip(spark, d):
    packed = compress_ids(F.array(F.col("doc_id").cast("string"), "source"))
    return documents(spark, d).select("doc_id", packed.alias("packed")).withColumn("ids", decompress_ids(F.col("packed")))


@query("safety_keywords", "SELECT doc_id, list_filter(['the', 'que', 'zzz'], lambda w: contains(lower(text), w)) AS found FROM documents")
def safety_keywords(spark, d):
    return documents(spark, d).select("doc_id", judge.keywords(F.col("content"), ["the", "que", "zzz"]).alias("found"))


@query("safety_verdict", "SELECT d.doc_id, contains(lower(text), 'que') AS has_dangerous_keywords, toxic * 2 AS sensitivity_level, contains(lower(text), 'que') OR toxic * 2 >= 2 OR quality <> 1 AS flagged FROM documents d JOIN labels USING (doc_id)")
def safety_verdict(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    v = judge.safety(F.col("content"), F.col("toxic") * 2, F.col("quality") == 1, ["que"])
    return rows.select("doc_id", v.alias("v")).select("doc_id", "v.has_dangerous_keywords", "v.sensitivity_level", "v.flagged")


_PRED = "p AS (SELECT CAST(length(text) % 3 > 0 AS INTEGER) AS predicted, quality AS label FROM documents JOIN labels USING (doc_id))"


def _predicted(spark, d):
    return documents(spark, d).join(table(spark, d, "labels"), "doc_id").select((F.length("content") % 3 > 0).cast("int").alias("predicted"), F.col("quality").alias("label"))


@query("confusion_matrix", f"WITH {_PRED}, c AS (SELECT count(*) FILTER (predicted = 1 AND label = 1) AS tp, count(*) FILTER (predicted = 1 AND label <> 1) AS fp, count(*) FILTER (predicted <> 1 AND label = 1) AS fn, count(*) FILTER (predicted <> 1 AND label <> 1) AS tn FROM p) SELECT *, 100.0::DOUBLE * (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c")
def confusion_matrix(spark, d):
    return evaluate.confusion(_predicted(spark, d))


@query("weighted_f1", f"WITH {_PRED}, l AS (SELECT label AS l, count(*) AS n, count(*) FILTER (predicted = label) AS tp FROM p GROUP BY 1), m AS (SELECT predicted AS l, count(*) AS m FROM p GROUP BY 1), e AS (SELECT n, tp, CASE WHEN coalesce(m, 0) > 0 THEN tp / m ELSE 0 END AS p, tp / n AS r FROM l LEFT JOIN m USING (l)), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM e) SELECT round(sum(tp) / sum(n), 9) AS accuracy, round(sum(p * n) / sum(n), 9) AS precision, round(sum(r * n) / sum(n), 9) AS recall, round(sum(f * n) / sum(n), 9) AS f1 FROM f")
def weighted_f1(spark, d):
    return evaluate.weighted_scores(_predicted(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("train_eval_split", "SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '42'), 1, 7))::BIGINT < 214748364 AS train FROM documents")
def train_eval_split(spark, d):
    return training.split(documents(spark, d), "doc_id").select("doc_id", "train")


@query("upsert_documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS source FROM documents")
def upsert_documents(spark, d):
    docs = documents(spark, d).select("doc_id", "source")
    return metadata.upsert(docs, docs.where("doc_id % 4 = 0").withColumn("source", F.lit("new")), "doc_id")


@query("run_summary", "SELECT lang AS mode, count(*) FILTER (doc_id % 10 <> 0) AS successes, count(*) FILTER (doc_id % 10 = 0) AS failures FROM documents GROUP BY lang")
def run_summary(spark, d):
    return evaluate.run_summary(documents(spark, d).select(F.col("lang").alias("mode"), (F.col("doc_id") % 10 != 0).alias("ok")))


def _folder(spark, name):
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stream_ingest_documents", "SELECT doc_id, length(text) AS size FROM documents WHERE text IS NOT NULL")
def stream_ingest_documents(spark, d):
    at = _folder(spark, "ingest")
    stream = streams.read_table(spark, f"{d}/documents.parquet", table(spark, d, "documents").schema).where("text is not null")
    streams.append(stream.select("doc_id", F.length("text").cast("long").alias("size")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("doc_id bigint, size bigint").parquet(f"{at}/out")


@query("history_append", "WITH " + HISTORY_SQL + " SELECT timestamp, conv_id, turn, role, text FROM history")
def history_append(spark, d):
    """All turns, whole."""
    from corpusforge.sources import writers

    at, rows = _folder(spark, "history"), history(spark, d)
    writers.history(rows.where("conv_id % 2 = 0"), at)
    writers.history(rows.where("not (conv_id % 2 <=> 0)"), at)
    return spark.read.schema(rows.schema).parquet(at)


@query("orphan_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 7 NOT IN (0, 3)")
def orphan_chunks(spark, d):
    docs = documents(spark, d)
    return lookup.orphans(docs.select(F.col("doc_id").alias("chunk_id"), F.col("uuid").alias("doc_uuid")), docs.where("doc_id % 7 in (0, 3)").select(F.col("uuid").alias("doc_uuid"))).select("chunk_id")


@query("evidence_of_rounds", "SELECT source AS query_id, doc_id AS chunk_id FROM documents UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 3 = 0")
def evidence_of_rounds(spark, d):
    first = documents(spark, d).select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return lookup.evidence([first, first.where("chunk_id % 3 = 0")])


@query("evaluation_file", "SELECT source AS type, count(*) AS n, round(avg(n_chars), 6) AS value FROM documents GROUP BY source")
def evaluation_file(spark, d):
    """Values of an evaluation, written as JSON and read again."""
    from corpusforge.sources import writers

    at = _folder(spark, "evaluation")
    writers.evaluation(table(spark, d, "documents").groupBy(F.col("source").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("value")), at)
    return spark.read.schema("type string, n bigint, value double").json(at)
