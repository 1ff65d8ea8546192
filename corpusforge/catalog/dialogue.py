"""Replies, frames, context text and the small pieces of a dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.catalog.text import _ISSUES
from corpusforge.functions import answers, text
from corpusforge.operators import context, filters, metadata
from corpusforge.plans import judge, qa, training
from corpusforge.sources.tables import DOCS_SQL, documents, table

_D = "WITH " + DOCS_SQL + " "

#: The first three of a text's long words, in their order: what a question may still lack.
_OPEN = "list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 12)))[1:3]"


def _open():
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.split("content", " "), lambda w: F.length(w) >= 12))), 1, 3)


@query("reply_parse", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'READY' END AS status FROM documents")
def reply_parse(spark, d):
    whole = F.concat(F.lit('{"status": "READY", "reasoning": "r'), "doc_id", F.lit('"}'))
    reply = F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, '{"status": "READY"}').otherwise("no json")
    return documents(spark, d).select("doc_id", judge.replies(reply, "status string, reasoning string", ("status", "reasoning"))["status"].alias("status"))


@query("reply_verdict", "WITH r AS (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'geen' ELSE 'REDEN: ' || source || ' ' END AS r FROM documents) SELECT doc_id, contains(upper(string_split(r, chr(10))[1]), 'JA') AS valid, nullif(trim(regexp_extract(r, 'REDEN:(.*)', 1)), '') AS reason FROM r")
def reply_verdict(spark, d):
    """Whole texts as replies: their first lines say JA or not."""
    reply = F.concat("content", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "geen").otherwise(F.concat(F.lit("REDEN: "), "source", F.lit(" "))))
    return documents(spark, d).select("doc_id", answers.verdict(reply).alias("v")).select("doc_id", "v.valid", "v.reason")


@query("progress_status", "SELECT doc_id, CASE WHEN len(list_filter(['the', 'que', 'und', 'of'], lambda w: NOT list_contains(string_split(text, ' '), w))) = 0 THEN 'READY' WHEN length(text) % 2 = 0 THEN 'EXHAUSTED' ELSE 'NOT_READY' END AS status FROM documents")
def progress_status(spark, d):
    open_ = F.array_except(F.array(*[F.lit(x) for x in ("the", "que", "und", "of")]), F.split("content", " "))
    return documents(spark, d).select("doc_id", judge.status(open_, F.length("content") % 2 == 1).alias("status"))


@query("next_subquery", f"WITH o AS (SELECT doc_id, lang, coalesce(nullif(array_to_string({_OPEN}, ' '), ''), lang) AS made FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR made = 'en' THEN made || ' (meer details)' ELSE made END AS ask FROM o")
def next_subquery(spark, d):
    before = F.array(F.lit("en"), F.when(F.col("doc_id") % 2 == 0, F.array_join(F.transform(_open(), lambda w: w), " ")).otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""))
    return documents(spark, d).select("doc_id", judge.subquery(_open(), F.col("lang"), before).alias("ask"))


@query("suggested_questions", f"WITH o AS (SELECT doc_id, list_transform(CASE WHEN doc_id % 2 = 0 THEN list_prepend('bommen', {_OPEN}) ELSE {_OPEN} END, lambda w: 'Wat staat er over ' || w || '?')[1:3] AS made FROM documents), s AS (SELECT *, list_filter(made, lambda x: NOT contains(lower(x), 'bom')) AS safe FROM o) SELECT doc_id, safe AS suggestions, CASE WHEN len(safe) < len(made) THEN 'Sommige suggesties zijn weggelaten. ' ELSE '' END || 'Woorden van de vraag zonder antwoord.' AS explanation FROM s")
def suggested_questions(spark, d):
    words = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(F.lit("bommen")), _open())).otherwise(_open())
    return documents(spark, d).select("doc_id", qa.suggestions(words).alias("s")).select("doc_id", "s.suggestions", "s.explanation")


@query("intermediate_answers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'eerder ' || lang || ' ' END || CASE WHEN doc_id % 2 = 0 THEN 'geld van ' || source || '.' ELSE 'geld in ' || lang || '.' END || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'Eerst dit.' ELSE 'en geld daar.' END AS answer FROM documents")
def intermediate_answers(spark, d):
    """Traces with and without an answer before; the best sentence stands first or last, and counts as the first where none has a word."""
    told = F.concat(F.lit('Tussenantwoord: {"answer": "eerder '), "lang", F.lit('"}'))
    trace = F.array(F.lit("start"), F.when(F.col("doc_id") % 3 == 0, F.lit("niets")).otherwise(told), F.lit("end"))
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Niets. geld van "), "source", F.lit("."))).otherwise(F.concat(F.lit("geld in "), "lang", F.lit(". Niets.")))
    third = F.when(F.col("doc_id") % 5 == 0, "Eerst dit. Dan dat.").otherwise("en geld daar. Niets.")
    return documents(spark, d).select("doc_id", qa.intermediate_answer(F.array(F.lit("oud geld."), second, third), trace, F.lit("geld")).alias("answer"))


@query("verified_questions", "SELECT doc_id, contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ', ' the ') AS valid FROM documents")
def verified_questions(spark, d):
    return documents(spark, d).select("doc_id", qa.verified(F.lit("the zzz"), F.col("content")).alias("valid"))


@query("context_text", "SELECT doc_id, '[1] [' || lang || ' ' || source || '] ' || text || chr(10) || chr(10) || '[2] x' AS block, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def context_text(spark, d):
    """The context of whole texts."""
    piece = answers.piece_text(F.col("lang"), F.col("source"), F.col("content"))
    return documents(spark, d).select("doc_id", answers.numbered(F.array(piece, F.lit("x"))).alias("block"), answers.tokens(F.col("content")).alias("tokens"))


@query("context_distinct", "SELECT DISTINCT source AS query_id, doc_id // 2 AS chunk_id FROM documents")
def context_distinct(spark, d):
    rows = documents(spark, d).select(F.col("source").alias("query_id"), F.floor(F.col("doc_id") / 2).alias("chunk_id"))
    return context.distinct_pieces(rows)


@query("context_recent", "SELECT doc_id, list_reverse(list_reverse(string_split(text, ' '))[1:2]) AS recent FROM documents")
def context_recent(spark, d):
    """Of a text's words as pieces, the last two, or the one there is."""
    return documents(spark, d).select("doc_id", context.most_recent(F.split("content", " ")).alias("recent"))


@query("event_frames", "SELECT doc_id, 'event: ' || source || chr(10) || 'data: ' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '{\"n\":' || length(text) || ',\"lang\":\"' || lang || '\"}' END || chr(10) || chr(10) AS frame, CASE WHEN doc_id % 5 <> 0 THEN length(text) END AS n FROM documents")
def event_frames(spark, d):
    """Frames and what a client reads of them; every fifth has no data."""
    data = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.to_json(F.struct(F.length("content").cast("long").alias("n"), "lang")))
    rows = documents(spark, d).select("doc_id", answers.event_frame(F.col("source"), data).alias("frame"))
    return rows.withColumn("n", answers.frame_data(F.col("frame"), "n bigint")["n"])


@query("document_json", "SELECT doc_id, '{\"doc_id\":\"' || doc_id || '\",\"lang\":' || CASE WHEN lang = 'en' THEN 'null' ELSE '\"' || lang || '\"' END || ',\"source\":\"' || source || '\"}' AS json FROM documents")
def document_json(spark, d):
    rows = documents(spark, d).withColumn("lang", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))
    return rows.select("doc_id", answers.document_json("doc_id", "lang", "source").alias("json"))


@query("document_from_metadata", _D + "SELECT 'd' || doc_id AS vws_id, coalesce(type, '') AS type, link, '' AS create_date FROM docs")
def document_from_metadata(spark, d):
    rows = documents(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("ID"), F.col("type").alias("File Type"), F.col("link").alias("Document Link"))
    return metadata.to_document(rows).select("vws_id", "type", "link", "create_date")


@query("combine_workers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'second' END AS source FROM documents")
def combine_workers(spark, d):
    docs = documents(spark, d).select("doc_id", "source")
    return metadata.combine([docs.where("doc_id % 2 = 0"), docs.withColumn("source", F.lit("second"))], "doc_id")


@query("conversion_cascade", f"WITH i AS ({_ISSUES}) SELECT doc_id, CASE WHEN len(issues) = 0 THEN md5(text) WHEN doc_id % 2 = 0 THEN md5('Some good text that is long enough to be kept, ' || doc_id || '.' || chr(10) || 'With a second line of words.') ELSE md5('last ' || doc_id) END AS text FROM documents JOIN i USING (doc_id)")
def conversion_cascade(spark, d):
    """Whole texts as the cheapest version: those without issues stay, of the others the second version or the last."""
    good = F.concat(F.lit("Some good text that is long enough to be kept, "), "doc_id", F.lit(".\nWith a second line of words."))
    second = F.when(F.col("doc_id") % 2 == 0, good).otherwise(F.lit("[] [] []"))
    return documents(spark, d).select("doc_id", F.md5(text.first_good(F.col("content"), second, F.concat(F.lit("last "), "doc_id"))).alias("text"))


@query("abbrev_once", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' T (the)' ELSE text END AS t FROM documents) SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9]+', 0), lambda w: CASE WHEN w = 'the' AND NOT contains(t, 'T (the)') THEN 'T (the)' WHEN w = 'que' AND NOT contains(t, 'Q (que)') THEN 'Q (que)' ELSE w END), '') AS text FROM t")
def abbrev_once(spark, d):
    """Whole texts; every second one has a form already."""
    names = F.create_map(F.lit("the"), F.lit("T"), F.lit("que"), F.lit("Q"))
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat("content", F.lit(" T (the)"))).otherwise(F.col("content"))
    return documents(spark, d).select("doc_id", text.abbreviate_once(whole, names).alias("text"))


@query("source_description", "SELECT item_id, 'documents of src' || item_id % 20 AS description FROM benchmark")
def source_description(spark, d):
    sources = documents(spark, d).select(F.col("source").alias("name"), F.concat(F.lit("documents of "), "source").alias("description")).distinct()
    asked = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("name"))
    return filters.existing(asked, sources, "name").join(sources, "name").select("item_id", "description")


@query("safety_model")
def safety_model(spark, d):
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("content").alias("text"), F.col("quality").alias("label"))
    return training.safety_model(rows).transform(rows).select("doc_id", F.col("prediction").cast("int").alias("predicted"))
