"""Files of documents, metadata, training sets, logs and reports: written whole to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.catalog.corpus import _folder
from corpusforge.functions.answers import stamp
from corpusforge.operators import metadata as M
from corpusforge.plans import training
from corpusforge.sources import readers, writers
from corpusforge.sources.tables import DOCS_SQL, METADATA_SQL, documents, metadata, table

_D, _M = "WITH " + DOCS_SQL + " ", "WITH " + METADATA_SQL + " "


@query(
    "documents_file",
    _D + """SELECT uuid, doc_id::VARCHAR AS vws_id, create_date::VARCHAR AS create_date, type, link, 'a ' || doc_id AS first_attachment, 2 AS attachments, md5(content) AS content_md5
    FROM docs WHERE content IS NOT NULL AND doc_id % 19 <> 0""",
)
def documents_file(spark, d):
    """Documents with dates in three forms and lists as text, some without the required link: those are left out when read."""
    id_, day = F.col("doc_id").cast("string"), F.col("create_date")
    forms = F.when(F.col("doc_id") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("doc_id") % 3 == 1, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "d MMMM yyyy"))
    rows = documents(spark, d).select(
        "uuid", id_.alias("vws_id"), F.coalesce(forms, F.lit("nan")).alias("create_date"), "type", F.when(F.col("doc_id") % 19 != 0, F.col("link")).alias("link"),
        F.concat(F.lit("['a "), id_, F.lit("', 'b']")).alias("attachment_links"), "content",
    )
    at = _folder(spark, "documents")
    writers.documents(rows, at, "json")
    held = readers.documents(spark, at, lines=True)
    return held.select("uuid", "vws_id", F.col("create_date").cast("date").cast("string").alias("create_date"), "type", "link", F.col("attachment_links")[0].alias("first_attachment"), F.size("attachment_links").alias("attachments"), F.md5("content").alias("content_md5"))


@query("abbreviations_file", "SELECT r_name AS short, 'region ' || r_regionkey AS long FROM region")
def abbreviations_file(spark, d):
    """A dictionary as a file; the table of regions has a row for each part of the world."""
    at, rows = _folder(spark, "abbreviations"), table(spark, d, "region")
    pairs = F.map_from_entries(F.collect_list(F.struct("r_name", F.concat(F.lit("region "), "r_regionkey"))))
    rows.agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(at)
    return spark.range(1).select(F.explode(readers.abbreviation_map(readers.abbreviations(spark, at))).alias("short", "long"))


_MATTER = "' m \"' || \"ID\" || '\", x '"


@query(
    "metadata_file",
    _M + f"""SELECT "ID" AS id, {_MATTER} AS matter, "Family" AS family, "Document" AS document, CASE WHEN ord % 2 = 0 THEN 'Email' END AS file_type, "Document Link" AS link, besluit_id, ord % 3 = 0 AS available
    FROM metadata""",
)
def metadata_file(spark, d):
    """Metadata with quotes, commas, outer blanks and nulls in its cells."""
    rows = metadata(spark, d).select(
        "ID", F.concat(F.lit(' m "'), "ID", F.lit('", x ')).alias("Matter"), "Family", "Document", F.when(F.col("ord") % 2 == 0, "Email").alias("File Type"),
        F.lit(None).cast("string").alias("Datum"), "Document Link", "besluit_id", (F.col("ord") % 3 == 0).alias("available"),
    )
    at = _folder(spark, "metadata")
    writers.metadata(rows, at)
    held = readers.metadata(spark, at)
    return held.select(F.col("ID").alias("id"), F.col("Matter").alias("matter"), F.col("Family").alias("family"), F.col("Document").alias("document"), F.col("File Type").alias("file_type"), F.col("Document Link").alias("link"), "besluit_id", "available")


@query("inventories_file", 'SELECT \'i\' || s_suppkey AS "ID", s_name AS "Document", \'l\' || s_nationkey AS "Document Link" FROM supplier')
def inventories_file(spark, d):
    """Inventories as CSV, told by their headers, all columns as text."""
    at = _folder(spark, "inventories")
    writers.metadata(table(spark, d, "supplier").select(F.concat(F.lit("i"), "s_suppkey").alias("ID"), F.col("s_name").alias("Document"), F.concat(F.lit("l"), "s_nationkey").alias("Document Link")), at)
    return readers.inventories(spark, at)


@query(
    "safety_file",
    "SELECT 'question, ' || doc_id AS text, CASE WHEN toxic = 1 THEN 0 ELSE 1 END::INTEGER AS label FROM labels WHERE doc_id % 7 <> 0",
)
def safety_file(spark, d):
    """Headerless lines of text and label; labels vary in case and blanks, and lines with another label are left out."""
    label = F.when(F.col("doc_id") % 7 == 0, "maybe").when(F.col("toxic") == 1, "False ").otherwise(" true")
    at = _folder(spark, "safety")
    table(spark, d, "labels").select(F.concat(F.lit("question, "), "doc_id"), label).write.csv(at, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return readers.safety_lines(spark, at)


_PAIRS = "SELECT 'q' || conv_id || '-' || turn AS query, text AS chunk FROM conversations WHERE text IS NOT NULL"


def _pairs(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    return c.select(F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn").alias("query"), F.col("text").alias("chunk"))


@query("training_sets_file", _PAIRS)
def training_sets_file(spark, d):
    """Two sets; the one that bears the suffix already isn't written again."""
    at, pairs = _folder(spark, "sets"), _pairs(spark, d)
    writers.training_sets({"pairs": pairs, "older_cleaned": pairs.withColumn("query", F.lit("older"))}, at, "_cleaned")
    return readers.training_pairs(spark, f"{at}/*", lines=True)


@query("questions_file", "SELECT text AS query, 'c' || item_id AS chunk FROM benchmark WHERE item_id % 5 <> 0 AND text IS NOT NULL")
def questions_file(spark, d):
    """Questions and their chunks; items without a question are left out."""
    at = _folder(spark, "questions")
    table(spark, d, "benchmark").select(F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("query"), F.concat(F.lit("c"), "item_id").alias("chunk")).write.json(at)
    return readers.questions(spark, at, lines=True)


@query("valid_pairs", "SELECT conv_id, turn, role AS query, CASE WHEN turn % 4 = 1 THEN ' . ' ELSE text END AS chunk FROM conversations WHERE trim(role) <> '' AND trim(CASE WHEN turn % 4 = 1 THEN ' . ' ELSE text END) NOT IN ('', '.') AND conv_id % 3 <> 0")
def valid_pairs(spark, d):
    """Pairs with a question and a chunk that the judge's verdict declares valid."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("query"), F.when(F.col("turn") % 4 == 1, " . ").otherwise(F.col("text")).alias("chunk"))
    return training.valid_pairs(rows, F.col("conv_id") % 3 != 0)


@query("judge_log", "SELECT role AS stage, 'c' || conv_id || '-' || turn AS time, text AS prompt, length(text)::VARCHAR AS response FROM conversations")
def judge_log(spark, d):
    """Calls of a judge, in a folder for each stage, appended in two writes."""
    calls = table(spark, d, "conversations").select(F.col("role").alias("stage"), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("time"), F.col("text").alias("prompt"), F.length("text").cast("string").alias("response"), "turn")
    at = _folder(spark, "log")
    for first in (True, False):
        writers.log(calls.where((F.col("turn") == 0) == F.lit(first)).drop("turn"), at)
    return spark.read.schema("stage string, time string, prompt string, response string").json(at).select("stage", "time", "prompt", "response")


@query("chunk_previews", _D + "SELECT uuid AS doc_uuid, 0 AS pos, substr(content, 1, 200) AS preview, length(content)::INTEGER AS size FROM docs")
def chunk_previews(spark, d):
    """The beginning of each chunk, as a report shows it, with the size of the whole."""
    return writers.previews(documents(spark, d).select(F.col("uuid").alias("doc_uuid"), F.lit(0).alias("pos"), "content"))


@query("metadata_processable", _M + """SELECT "ID" AS id, "Family" AS family FROM metadata WHERE ord % 3 <> 0 AND ord <> 5""")
def metadata_processable(spark, d):
    """Rows whose file is there and that have a family."""
    rows = metadata(spark, d).select(F.col("ID").alias("id"), F.when(F.col("ord") != 5, F.col("Family")).alias("Family"), (F.col("ord") % 3 != 0).alias("available"))
    return M.processable(rows).select("id", F.col("Family").alias("family"))


@query("metadata_defaults", _M + """SELECT "ID" AS id, CASE WHEN ord = 1 THEN 'u' || "ID" END AS uuid, NULL::VARCHAR AS processed, 0 AS attachments FROM metadata""")
def metadata_defaults(spark, d):
    """Columns of progress and attachments are added where they are missing; a uuid that is there stays."""
    rows = metadata(spark, d).select(F.col("ID").alias("id"), F.when(F.col("ord") == 1, F.concat(F.lit("u"), "ID")).alias("uuid"))
    return M.with_defaults(rows).select("id", "uuid", "processed", F.size("attachment_ids").alias("attachments"))


@query("event_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def event_stamps(spark, d):
    return table(spark, d, "events").select("event_id", stamp(F.col("ts")).alias("stamp"))
