"""Readers: document folders, sources, abbreviations, metadata, files, training and question files, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.dates import written_date
from corpusforge.schemas import BENCHMARK, DOCUMENT, METADATA, TRAINING_PAIR

def parse_date(c: Column) -> Column:
    """The date that a text writes, the month first in doubt; null for none."""
    return written_date(c)


def parse_list(c: Column) -> Column:
    """A list written as text, in JSON or with single quotes; empty if it is neither. It is never evaluated."""
    return F.coalesce(F.from_json(c, "array<string>"), F.from_json(F.translate(c, "'", '"'), "array<string>"), F.array().cast("array<string>"))


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of *.json files, one each, or one a line as the writer leaves them; those that don't parse or lack a required
    field are left out."""
    schema = DOCUMENT.replace("attachment_links array<string>", "attachment_links string") + ", _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    whole = F.col("_corrupt_record").isNull()
    for name in ("uuid", "vws_id", "content", "link"):
        whole = whole & F.col(name).isNotNull()
    return raw.where(whole).select("uuid", "vws_id", parse_date(F.col("create_date")).alias("create_date"), "type", "link", parse_list(F.col("attachment_links")).alias("attachment_links"), "content")


def sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All documents under root/<source>/docs with their source, and a row for each source with its description.txt."""
    schema = DOCUMENT.replace("attachment_links array<string>", "attachment_links string") + ", _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/docs/*.json").withColumn("source", F.regexp_extract(F.input_file_name(), r"/([^/]+)/docs/[^/]+$", 1))
    docs = raw.where(F.col("_corrupt_record").isNull() & F.col("uuid").isNotNull() & F.col("content").isNotNull())
    docs = docs.select("uuid", "vws_id", parse_date(F.col("create_date")).alias("create_date"), "type", "link", parse_list(F.col("attachment_links")).alias("attachment_links"), "content", "source")
    texts = spark.read.text(f"{root}/*/description.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/description\.txt$", 1).alias("name"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("description"))
    names = docs.select(F.col("source").alias("name")).distinct()
    return docs, names.join(texts, "name", "left").withColumn("description", F.coalesce("description", F.lit("")))


def abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    """A dictionary file, small by nature; empty on any error."""
    try:
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).first()
        return dict(row["m"]) if row and row["m"] else {}
    except Exception:  # the original goes on without abbreviations
        return {}


def abbreviation_map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else F.create_map().cast("map<string,string>")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """By a schema, not by guessing."""
    return spark.read.csv(path, header=True, schema=METADATA, multiLine=True, escape='"')


def inventories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def files(spark: SparkSession, *folders: str) -> DataFrame:
    """folder_pos, path, name, of the files under each folder; contents aren't read."""
    out = None
    for i, folder in enumerate(folders):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.lit(i).alias("folder_pos"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
        out = rows if out is None else out.union(rows)
    return out


def safety_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, label (1/0) of headerless text,label lines; other labels are left out."""
    rows = spark.read.csv(path, schema="text string, label string").select("text", F.lower(F.trim("label")).alias("label"))
    return rows.where(F.col("label").isin("true", "false")).select("text", (F.col("label") == "true").cast("int").alias("label"))


def training_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs of a list, or of an object's `pairs`; by lines, a pair each as the writer leaves them. A pair that lacks its question
    or its chunk ends the reading with an error."""
    pair = f"struct<{TRAINING_PAIR.replace(' string', ':string')}>"
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        found = text.select(F.from_json("value", pair).alias("p"))
    else:
        found = text.select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$.pairs"), f"array<{pair}>"), F.from_json("value", f"array<{pair}>"))).alias("p"))
    lacks = F.when(F.col("p.query").isNull() | F.col("p.chunk").isNull(), F.raise_error(F.lit("a training pair lacks its query or its chunk")))
    return found.select(F.coalesce(lacks.cast("string"), F.col("p.query")).alias("query"), F.col("p.chunk").alias("chunk"))


def questions(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    rows = spark.read.option("multiLine", not lines).schema("query string, chunk string").json(path).where("query is not null")
    return rows.limit(limit) if limit else rows


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(BENCHMARK).json(path)


def excel(spark: SparkSession, path: str) -> DataFrame:
    """An inventory as a spreadsheet, read on the driver: such files are small. Needs an Excel reader for pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str))
