"""Identifiers, metadata, families, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.functions import ids
from corpusforge.operators import families, metadata
from corpusforge.sources.tables import DOCS_SQL, METADATA_SQL, documents, table
from corpusforge.sources.tables import metadata as metadata_rows

_D = "WITH " + DOCS_SQL + " "


@query("normalize_ids", "WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' 10-' || source || '-' || doc_id || ' ' WHEN 1 THEN source WHEN 2 THEN lang || '-' WHEN 3 THEN '--' || doc_id END AS x FROM documents) SELECT doc_id, coalesce(list_last(string_split(trim(x), '-')), '') AS a FROM x")
def normalize_ids(spark, d):
    m = F.col("doc_id") % 5
    x = F.when(m == 0, F.concat(F.lit(" 10-"), "source", F.lit("-"), "doc_id", F.lit(" "))).when(m == 1, F.col("source")).when(m == 2, F.concat("lang", F.lit("-"))).when(m == 3, F.concat(F.lit("--"), "doc_id"))
    return documents(spark, d).select("doc_id", ids.normalize_id(x).alias("a"))


@query("family_ids", "SELECT doc_id, regexp_replace(replace('00-' || doc_id || '-7', '-', ''), '^0+', '') AS family FROM documents")
def family_ids(spark, d):
    return documents(spark, d).select("doc_id", ids.family_id(F.concat(F.lit("00-"), "doc_id", F.lit("-7"))).alias("family"))


@query("derive_ids", "SELECT doc_id, source || '-' || doc_id AS derived FROM documents")
def derive_ids(spark, d):
    return documents(spark, d).select("doc_id", ids.derived_id(F.concat(F.lit("a-b-c-"), "source", F.lit("-"), "doc_id")).alias("derived"))


@query("uuid_hash", _D + """, h AS (SELECT doc_id, sha256('{"content_hash": "' || md5(substr(content, 1, 100)) || '", "link": "' || link || '", "title": "", "vws_id": ""}') AS s FROM docs)
    SELECT doc_id, concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), substr(s, 13, 4), substr(s, 17, 4), substr(s, 21, 12)) AS uuid FROM h""")
def uuid_hash(spark, d):
    return documents(spark, d).select("doc_id", ids.document_uuid(F.col("content"), F.col("link")).alias("uuid"))


@query("sanitize_filename", r"""SELECT doc_id, substr(regexp_replace(regexp_replace(source || ': a/b  ' || doc_id, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), 1, 96) || '.pdf' AS name FROM documents""")
def sanitize_filename(spark, d):
    return documents(spark, d).select("doc_id", ids.file_name(F.concat("source", F.lit(": a/b  "), "doc_id")).alias("name"))


@query("sanitize_ids", "SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda w: regexp_replace(trim(w), '[^A-Za-z0-9_-]', '', 'g')), lambda w: length(w) BETWEEN 1 AND 29) AS ids FROM documents")
def sanitize_ids(spark, d):
    """Every word of the whole texts as an id."""
    return documents(spark, d).select("doc_id", ids.sanitized_ids(F.split("content", " ")).alias("ids"))


_FAMILY = """, k AS (SELECT m.*, CASE WHEN h.head IS NOT NULL THEN f ELSE 'single_' || "ID" END AS family_key FROM
    (SELECT *, regexp_extract(trim("Family"), '([^-]*)$', 1) AS f, regexp_extract(trim("ID"), '([^-]*)$', 1) AS n FROM metadata) m
    LEFT JOIN (SELECT DISTINCT regexp_extract(trim("ID"), '([^-]*)$', 1) AS head FROM metadata) h ON m.f = h.head),
b AS (SELECT family_key, arg_min("ID", (n <> family_key, ord)) AS base_document, arg_min("Document Link", (n <> family_key, ord)) AS link FROM k GROUP BY 1),
r AS (SELECT k.*, b.base_document, b.link FROM k JOIN b USING (family_key)),
fam AS (SELECT family_key, any_value(base_document) AS base_document, any_value(link) AS link, coalesce(list("ID" ORDER BY ord, "ID") FILTER ("ID" <> base_document), []) AS attachment_ids,
    coalesce(list("Document" ORDER BY ord, "ID") FILTER ("ID" <> base_document), []) AS attachment_names,
    coalesce(arg_max(besluit_id, (ord, "ID")) FILTER ("ID" <> base_document), arg_min(besluit_id, (ord, "ID"))) AS besluit_id FROM r GROUP BY 1)"""


@query("family_map_tpch", "WITH " + METADATA_SQL + _FAMILY + " SELECT * FROM fam")
def family_map_tpch(spark, d):
    return families.family_map(metadata_rows(spark, d)).drop("attachment_links")


def _small(spark, d):
    """Documents as metadata: families of ten, the head the one whose id ends the family's."""
    docs = documents(spark, d)
    return docs.select(F.concat(F.lit("x-"), "doc_id").alias("ID"), F.concat(F.lit("x-"), (F.col("doc_id") / 10).cast("long") * 10).alias("Family"), F.concat(F.lit("Name "), "doc_id").alias("Document"), F.col("link").alias("Document Link"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("b"), "doc_id")).alias("besluit_id"), F.col("doc_id").alias("ord"), "content")


_SMALL = ", metadata AS (SELECT 'x-' || doc_id AS \"ID\", 'x-' || (doc_id // 10 * 10) AS \"Family\", 'Name ' || doc_id AS \"Document\", link AS \"Document Link\", CASE WHEN doc_id % 3 <> 0 THEN 'b' || doc_id END AS besluit_id, doc_id AS ord, content FROM docs)"


@query("family_members", "WITH " + METADATA_SQL + """, heads AS (SELECT DISTINCT regexp_extract("ID", '([^-]*)$', 1) AS head FROM metadata),
k AS (SELECT "ID" AS id, ord, CASE WHEN head IS NOT NULL THEN regexp_extract("Family", '([^-]*)$', 1) ELSE 'single_' || "ID" END AS family_key FROM metadata LEFT JOIN heads ON head = regexp_extract("Family", '([^-]*)$', 1))
SELECT family_key, row_number() OVER (PARTITION BY family_key ORDER BY ord, id) AS place, id FROM k""")
def family_members(spark, d):
    """A row for each member, numbered within its family."""
    from corpusforge.catalog.corpus import _folder

    def cut(df):
        at = _folder(spark, "members")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return families.family_members(metadata_rows(spark, d), cut=cut)


@query("family_map", _D + _SMALL + _FAMILY + " SELECT family_key, base_document, link, attachment_ids, attachment_names FROM fam")
def family_map(spark, d):
    return families.family_map(_small(spark, d)).select("family_key", "base_document", "link", "attachment_ids", "attachment_names")


@query("attachments_update", _D + _SMALL + _FAMILY + ' SELECT "ID", coalesce(attachment_ids, []) || [\'old\'] AS attachment_ids FROM metadata LEFT JOIN fam ON base_document = "ID"')
def attachments_update(spark, d):
    rows = _small(spark, d)
    have = rows.select("ID", F.array(F.lit("old")).alias("attachment_ids"), F.array().cast("array<string>").alias("attachment_names"), F.array().cast("array<string>").alias("attachment_links"))
    return families.update_attachments(have, families.family_map(rows)).select("ID", "attachment_ids")


@query("attachment_insert", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Head' || chr(10) || 'see Name ' || doc_id || ' here' || b || chr(10) || 'tail' ELSE 'Head' || chr(10) || 'tail' || b END AS text
    FROM (SELECT doc_id, chr(10) || chr(10) || chr(10) || 'Begin Attachment: x-' || doc_id || ', Name ' || doc_id || ', L' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'End Attachment: x-' || doc_id || ', Name ' || doc_id || ', L' || chr(10) AS b FROM documents)""")
def attachment_insert(spark, d):
    name = F.concat(F.lit("Name "), "doc_id")
    base = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Head\nsee "), name, F.lit(" here\ntail"))).otherwise(F.lit("Head\ntail"))
    return documents(spark, d).select("doc_id", families.insert_attachment(base, F.col("content"), F.concat(F.lit("x-"), "doc_id"), name, F.lit("L")).alias("text"))


@query("family_process")
def family_process(spark, d):
    rows = _small(spark, d)
    return families.process(families.family_map(rows), rows)


@query("metadata_merge_columns", "SELECT doc_id, CASE WHEN source = lang THEN source ELSE source || ', ' || lang END AS merged FROM documents")
def metadata_merge_columns(spark, d):
    return documents(spark, d).select("doc_id", metadata.merge_columns(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("source")).alias("merged"))


@query("metadata_available", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS available FROM documents")
def metadata_available(spark, d):
    docs = documents(spark, d)
    files = docs.where("doc_id % 3 = 0").select(F.concat("doc_id", F.lit(".pdf")).alias("name")).union(docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string")))
    return metadata.available(docs.select("doc_id", F.col("doc_id").cast("string").alias("ID")), files).select("doc_id", "available")


@query("metadata_find_files", "SELECT 'd-' || doc_id AS \"ID\", CASE WHEN doc_id % 2 = 0 THEN 'one/d-' || doc_id || '.pdf' ELSE 'two/' || doc_id || '.pdf' END AS path FROM documents")
def metadata_find_files(spark, d):
    docs = documents(spark, d)
    a = docs.where("doc_id % 2 = 0").select(F.lit(0).alias("folder_pos"), F.concat(F.lit("one/d-"), "doc_id", F.lit(".pdf")).alias("path"), F.concat(F.lit("d-"), "doc_id", F.lit(".pdf")).alias("name"))
    b = docs.select(F.lit(1).alias("folder_pos"), F.concat(F.lit("two/"), "doc_id", F.lit(".pdf")).alias("path"), F.concat("doc_id", F.lit(".pdf")).alias("name"))
    return metadata.resolve_files(docs.select(F.concat(F.lit("d-"), "doc_id").alias("ID"), F.lit("b1").alias("besluit_id")), a.union(b))


@query("metadata_unprocessed", _D + _SMALL + _FAMILY + ' SELECT family_key FROM fam JOIN metadata ON base_document = "ID" WHERE ord % 20 = 0')
def metadata_unprocessed(spark, d):
    rows = _small(spark, d).withColumn("uuid", F.when(F.col("ord") % 20 != 0, F.lit("u")).otherwise(F.when(F.col("ord") % 40 == 0, F.lit("NaN"))))
    return metadata.unprocessed(families.family_map(rows), rows).select("family_key")


@query("metadata_processed", "SELECT source AS \"ID\" FROM documents GROUP BY source HAVING bool_and(doc_id % 97 <> 0)")
def metadata_processed(spark, d):
    rows = documents(spark, d).select(F.col("source").alias("ID"), F.when(F.col("doc_id") % 97 != 0, F.col("source")).alias("uuid"), F.lit("yes").alias("processed"))
    return metadata.processed(rows, rows.select("uuid").distinct())


@query("metadata_project", _D + "SELECT 'd' || doc_id AS \"ID\", source AS \"Matter\", 'd' || doc_id AS \"Family\", lang AS \"Document\", type AS \"File Type\", link AS \"Document Link\", false AS available FROM docs")
def metadata_project(spark, d):
    id_ = F.concat(F.lit("d"), "doc_id")
    rows = documents(spark, d).select(id_.alias("document_id"), F.col("source").alias("besluit_id"), F.col("lang").alias("document_name"), F.col("type").alias("document_type"), F.col("create_date").cast("string").alias("document_date"), F.col("link").alias("document_url"))
    return metadata.project(rows).drop("Datum", "besluit_id")


@query("metadata_decision", _D + _SMALL + ' SELECT "ID", coalesce(besluit_id, "Family") AS besluit_id FROM metadata')
def metadata_decision(spark, d):
    return metadata.with_decision(_small(spark, d).withColumn("Matter", F.col("Family"))).select("ID", "besluit_id")


@query("split_by_family", "WITH f AS (SELECT source, (row_number() OVER (ORDER BY md5(source || '42'), source) - 1) % 4 AS worker FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CAST(worker AS INTEGER) AS worker FROM documents JOIN f USING (source)")
def split_by_family(spark, d):
    return families.split_by_family(documents(spark, d), 4, family_col="source").select("doc_id", "worker")


@query("split_even", "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) - 1 AS INTEGER) AS worker FROM documents")
def split_even(spark, d):
    return families.split_even(documents(spark, d).withColumn("ID", F.col("doc_id").cast("string")).select("ID", "doc_id"), 7, id_col="doc_id").select("doc_id", "worker")


@query("link_repair", _D + "SELECT doc_id AS vws_id, CASE WHEN doc_id % 3 = 0 THEN 'https://new.example.org/' || doc_id ELSE link END AS link, doc_id % 3 = 0 AS repaired FROM docs")
def link_repair(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("vws_id"), "link")
    new = docs.where("vws_id % 2 = 0 or vws_id % 3 = 0").select("vws_id", F.when(F.col("vws_id") % 3 == 0, F.concat(F.lit("https://new.example.org/"), "vws_id")).otherwise(F.col("link")).alias("new_link"), F.lit(0).alias("ord"))
    late = new.select("vws_id", F.lit("https://late.example.org").alias("new_link"), F.lit(1).alias("ord"))
    return metadata.repair_links(docs, new.union(late))


@query("link_repair_counts", "SELECT count(*) AS documents, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0) AS known, count(*) FILTER (doc_id % 3 = 0) AS repaired, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS right, count(*) FILTER (doc_id % 2 <> 0 AND doc_id % 3 <> 0) AS unknown, count(*) FILTER (doc_id % 5 = 0) AS unmatched FROM documents")
def link_repair_counts(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("vws_id"), "link")
    new = docs.where("vws_id % 2 = 0 or vws_id % 3 = 0").select("vws_id", F.when(F.col("vws_id") % 3 == 0, F.concat(F.lit("https://new.example.org/"), "vws_id")).otherwise(F.col("link")).alias("new_link"), F.lit(0).alias("ord"))
    strays = docs.where("vws_id % 5 = 0").select((-F.col("vws_id") - 1).alias("vws_id"), F.lit("x").alias("new_link"), F.lit(0).alias("ord"))
    inventory = new.union(strays)
    return metadata.repair_counts(metadata.repair_links(docs, inventory), inventory)


@query("rows_with_link", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def rows_with_link(spark, d):
    a, b = F.when(F.col("doc_id") % 3 == 0, "https://a.org").otherwise("nan"), F.when(F.col("doc_id") % 4 == 0, "https://b.org").otherwise("")
    return metadata.with_link(documents(spark, d).select("doc_id", a.alias("Source Link"), b.alias("Document Link")), "Source Link", "Document Link").select("doc_id")


@query("coalesce_links", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END AS link FROM documents")
def coalesce_links(spark, d):
    a = F.when(F.col("doc_id") % 4 == 0, "a").otherwise("nan")
    b = F.when(F.col("doc_id") % 2 == 0, "b").otherwise("")
    return documents(spark, d).select("doc_id", metadata.first_link(a, b, F.lit("c")).alias("link"))


@query("content_collisions", "SELECT doc_id, 'clash' AS what FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'fresh' FROM documents WHERE doc_id % 2 = 1")
def content_collisions(spark, d):
    docs = documents(spark, d).select("doc_id", "uuid", "content")
    new = docs.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    fresh, clash = metadata.collisions(docs.where("doc_id % 2 = 0"), new)
    return clash.select("doc_id", F.lit("clash").alias("what")).union(fresh.select("doc_id", F.lit("fresh")))


@query("metadata_union", "SELECT n_name AS name, n_regionkey AS region, NULL AS segment FROM nation UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
def metadata_union(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("only_families", "WITH " + METADATA_SQL + """ SELECT "ID", "Family" FROM metadata WHERE "Family" IN ('doc-1', 'doc-7', 'doc-32')""")
def only_families(spark, d):
    return metadata.only_families(metadata_rows(spark, d), ["doc-1", "doc-7", "doc-32"]).select("ID", "Family")


@query("first_of_id", "SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY lang")
def first_of_id(spark, d):
    return metadata.first_of_id(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars").select("lang", "doc_id")
