"""Tables of metadata: merging columns, availability, progress, repair, upserts and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.ids import is_missing, missing_to_null, normalize_id

TARGET = ("ID", "Matter", "Family", "Document", "File Type", "Datum", "Document Link", "besluit_id", "available")


def merge_columns(*columns: Column) -> Column:
    """Distinct values of columns of one name, joined by a comma; null without any."""
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*columns))), ", "), F.lit(""))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Adds the columns of progress and attachments where they are missing."""
    for name, kind in (("uuid", "string"), ("processed", "string"), ("attachment_names", "array<string>"), ("attachment_ids", "array<string>"), ("attachment_links", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind))
    return rows


def with_decision(rows: DataFrame) -> DataFrame:
    return rows.withColumn("besluit_id", F.coalesce(missing_to_null(F.col("besluit_id")), F.col("Matter")))


def available(rows: DataFrame, files: DataFrame, id_col: str = "ID", name_col: str = "name") -> DataFrame:
    """Adds available: some file has the id as its name, with or without an extension."""
    names = files.select(F.regexp_replace(name_col, r"\.[^.]*$", "").alias("_n")).union(files.select(F.col(name_col).alias("_n"))).distinct()
    return rows.join(names, F.col(id_col) == F.col("_n"), "left").withColumn("available", F.col("_n").isNotNull()).drop("_n")


def resolve_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """ID, path: the first match over search folders (files.folder_pos), then over the patterns of names."""
    id_, norm, besluit = F.col("ID"), normalize_id(F.col("ID")), F.col("besluit_id")
    patterns = F.array(*[x for base in (id_, norm, F.concat(besluit, F.lit("-"), id_), F.concat(besluit, F.lit("-"), norm)) for x in (F.concat(base, F.lit(".pdf")), base)])
    wanted = rows.select("ID", F.posexplode(patterns).alias("pattern", "name")).where("name is not null")
    return wanted.join(files, "name").groupBy("ID").agg(F.min_by("path", F.struct("folder_pos", "pattern")).alias("path"))


def processable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("available") & F.col("Family").isNotNull())


def unprocessed(families: DataFrame, rows: DataFrame) -> DataFrame:
    """Families whose head has no uuid yet."""
    heads = rows.groupBy("ID").agg(F.first("uuid").alias("uuid"))
    return families.join(heads, families["base_document"] == heads["ID"]).where(is_missing(F.col("uuid"))).drop("ID", "uuid")


def processed(rows: DataFrame, outputs: DataFrame, by: str = "ID") -> DataFrame:
    """Keys all of whose rows have a uuid and the flag, and whose output exists."""
    done = rows.groupBy(by).agg(F.bool_and(~is_missing(F.col("uuid")) & ~is_missing(F.col("processed"))).alias("done"), F.first("uuid").alias("uuid")).where("done")
    return done.join(outputs.select("uuid"), "uuid", "left_semi").select(by)


def project(rows: DataFrame, family_from: str = "document_id") -> DataFrame:
    """The target's nine columns of scraped rows; fails at once if one that it needs is missing."""
    source = {"ID": "document_id", "Matter": "besluit_id", "Family": family_from, "Document": "document_name", "File Type": "document_type", "Datum": "document_date", "Document Link": "document_url", "besluit_id": "besluit_id", "available": "available"}
    missing = sorted({v for k, v in source.items() if k != "available"} - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows if "available" in rows.columns else rows.withColumn("available", F.lit(False))
    return rows.select(*[F.col(v).alias(k) for k, v in source.items()])


def first_link(*columns: Column) -> Column:
    return F.coalesce(*[missing_to_null(c) for c in columns])


def with_link(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows that have a link in one of the columns."""
    return rows.where(first_link(*[F.col(f"`{c}`") for c in columns]).isNotNull())


def repair_counts(repaired: DataFrame, inventory: DataFrame, key: str = "vws_id") -> DataFrame:
    """One row of counters for what repair_links() gave: documents, those the inventory knows, those repaired, those whose link was
    right, and those it doesn't know; and the inventory's keys that no document has."""
    known = inventory.where(F.col("new_link").isNotNull()).select(key).distinct().withColumn("_known", F.lit(True))
    rows = repaired.join(known, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    counts = rows.agg(F.count("*").alias("documents"), F.count_if("_known").alias("known"), F.count_if("repaired").alias("repaired"), F.count_if(F.col("_known") & ~F.col("repaired")).alias("right"), F.count_if(~F.col("_known")).alias("unknown"))
    return counts.join(known.join(repaired, key, "left_anti").agg(F.count("*").alias("unmatched")))  # a row each


def repair_links(documents: DataFrame, inventory: DataFrame, key: str = "vws_id") -> DataFrame:
    """Adds repaired, and takes the inventory's link (its first of a key) where it has another one."""
    first = inventory.groupBy(key).agg(F.min_by("new_link", "ord").alias("new_link"))
    joined = documents.join(first, key, "left")
    change = F.col("new_link").isNotNull() & ~F.col("new_link").eqNullSafe(F.col("link"))
    return joined.select(key, F.when(change, F.col("new_link")).otherwise(F.col("link")).alias("link"), change.alias("repaired"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The union of both, the new row of a key where there is one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_batch")


def collisions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to write (of uuids that aren't there yet), and rows whose uuid is there with other content, which stay out."""
    known = old.select("uuid", F.md5("content").alias("held"))
    fresh = new.join(known, "uuid", "left_anti")
    clash = new.join(known, "uuid").where(F.md5("content") != F.col("held")).drop("held")
    return fresh, clash


def unmatched(scraped: DataFrame, reports: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Scraped rows with what existing reports add, and those that no report knows."""
    return scraped.join(reports, key, "left"), scraped.join(reports.select(key), key, "left_anti")


def combine(parts: list[DataFrame], key: str = "ID") -> DataFrame:
    """The results of several workers as one table, the columns by name, the first row of a key."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_part"))
    return out.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_part")


def to_document(rows: DataFrame) -> DataFrame:
    """Standard documents of rows of metadata and converted text; what is missing is empty."""
    empty = F.array().cast("array<string>")
    have = lambda name, other: F.coalesce(F.col(f"`{name}`"), other) if name in rows.columns else other
    text = F.lit("")
    return rows.select(
        have("uuid", F.lit(None).cast("string")).alias("uuid"), have("ID", text).alias("vws_id"), have("Datum", text).alias("create_date"), have("File Type", text).alias("type"),
        have("Document Link", text).alias("link"), have("attachment_links", empty).alias("attachment_links"), have("content", text).alias("content"),
    )


def only_families(rows: DataFrame, families: list[str], family_col: str = "Family") -> DataFrame:
    """The rows of the named families, for a trial run."""
    return rows.where(F.col(family_col).cast("string").isin(*map(str, families)))


def first_of_id(rows: DataFrame, key: str = "ID", order: str = "ord") -> DataFrame:
    """The first row of each id, by the given order; ties by all columns."""
    whole = F.struct(order, *[c for c in rows.columns if c != order])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns])
