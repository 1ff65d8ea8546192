"""Families of documents: a head and its attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.ids import normalize_id


def family_key(rows: DataFrame, id_col: str = "ID", family_col: str = "Family") -> DataFrame:
    """Adds family_key: the normal form of the family if some row has it as id, else single_<id>."""
    heads = rows.select(normalize_id(F.col(id_col)).alias("head")).distinct()
    named = rows.withColumn("_family", normalize_id(F.col(family_col)))
    joined = named.join(heads, F.col("_family") == F.col("head"), "left")
    return joined.withColumn("family_key", F.when(F.col("head").isNotNull(), F.col("_family")).otherwise(F.concat(F.lit("single_"), F.col(id_col)))).drop("head", "_family")


def family_members(rows: DataFrame, order: str = "ord", cut=None) -> DataFrame:
    """family_key, place (from 1), id: the members of every family, a row each, in order (then by id). However large a family is,
    no task sorts it: rows are dealt by ranges of family and order, numbered within a range, after what the ranges before hold of
    the family. cut writes the dealt rows and reads them again, so that a range stays what it was."""
    keyed = family_key(rows).select("family_key", F.col(order).alias("_order"), F.col("ID").alias("id"))
    dealt = keyed.repartitionByRange("family_key", "_order", "id").withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt) if cut else dealt
    sizes = dealt.groupBy("family_key", "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("family_key").orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("family_key", "_range").orderBy("_order", "id"))
    numbered = dealt.withColumn("_own", own).join(before, ["family_key", "_range"])
    return numbered.select("family_key", (F.col("_before") + F.col("_own")).alias("place"), "id")


def family_map(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each family: the head (the row whose id is the key, else the first), the other rows in order as attachments."""
    keyed = family_key(rows)
    is_head = normalize_id(F.col("ID")) == F.col("family_key")
    first = F.struct((~is_head).alias("h"), F.col(order).alias("o"))
    base = keyed.groupBy("family_key").agg(
        F.min_by("ID", first).alias("base_document"),
        F.min_by(F.col("Document Link"), first).alias("link"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ID").alias("id"), F.col("Document").alias("name"), F.col("Document Link").alias("link"), F.col("besluit_id").alias("besluit")))).alias("members"),
    )
    rest = F.filter("members", lambda m: m["id"] != F.col("base_document"))
    part = lambda name: F.transform(rest, lambda m: m[name])
    last = F.element_at(rest, -1)
    return base.select(
        "family_key", "base_document", "link", part("id").alias("attachment_ids"), part("name").alias("attachment_names"), part("link").alias("attachment_links"),
        F.when(F.size(rest) > 0, last["besluit"]).otherwise(F.element_at("members", 1)["besluit"]).alias("besluit_id"),
    )


def update_attachments(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Puts a family's attachments before those that its head's row has; matched by the normal form of the id."""
    new = families.select(F.col("base_document").alias("ID"), *[F.col(c).alias(f"_{c}") for c in ("attachment_ids", "attachment_names", "attachment_links")])
    joined = rows.join(new, "ID", "left")
    empty = F.array().cast("array<string>")
    for c in ("attachment_ids", "attachment_names", "attachment_links"):
        joined = joined.withColumn(c, F.concat(F.coalesce(f"_{c}", empty), F.coalesce(c, empty))).drop(f"_{c}")
    return joined


def insert_attachment(base: Column, content: Column, id_: Column, name: Column, link: Column) -> Column:
    """The attachment as a block after the line that first has its name, else at the end; an empty one changes nothing."""
    tag = F.concat(id_, F.lit(", "), name, F.lit(", "), link)
    block = F.concat(F.lit("\n\n\nBegin Attachment: "), tag, F.lit("\n\n"), content, F.lit("\n\nEnd Attachment: "), tag, F.lit("\n"))
    at = F.when(F.coalesce(name, F.lit("")) == "", 0).otherwise(F.position(name, base))
    end = F.position(F.lit("\n"), base, at)
    end = F.when(end == 0, F.length(base) + 1).otherwise(end)
    placed = F.when(at > 0, F.concat(F.substring(base, F.lit(1), end - 1), block, F.substring(base, end, F.length(base)))).otherwise(F.concat(base, block))
    return F.when(F.coalesce(content, F.lit("")) == "", base).otherwise(placed)


def combine(base: Column, attachments: Column) -> Column:
    """Folds attachments (array of struct id, name, link, content, in order) into a text; each sees the blocks before it."""
    return F.aggregate(attachments, base, lambda acc, a: insert_attachment(acc, a["content"], a["id"], a["name"], a["link"]))


def process(families: DataFrame, documents: DataFrame) -> DataFrame:
    """family_key, base_document, content: heads with their attachments' texts put in. A family without a head's text is left
    out, an attachment without one skipped; the first document of an id counts."""
    first = documents.groupBy("ID").agg(F.min_by("content", "ord").alias("content"), F.min_by("Document", "ord").alias("name"), F.min_by("Document Link", "ord").alias("link"))
    pieces = families.select("family_key", F.posexplode("attachment_ids").alias("pos", "ID")).join(first, "ID")
    gathered = pieces.groupBy("family_key").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("ID").alias("id"), "name", "link", "content"))).alias("attachments"))
    heads = families.join(first.select(F.col("ID").alias("base_document"), "content"), "base_document")
    none = F.array().cast("array<struct<pos:int,id:string,name:string,link:string,content:string>>")
    joined = heads.join(gathered, "family_key", "left").withColumn("attachments", F.coalesce("attachments", none))
    return joined.select("family_key", "base_document", combine(F.col("content"), F.col("attachments")).alias("content"))


def hash_numbers(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds number: the place (from 0) of each row in the order of a hash of its key, ties by the key.

    No task sees all rows: they are numbered in 65,536 buckets of the hash, and a bucket's rows follow those of the buckets before."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)))).withColumn("_b", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_own", own).join(before, "_b").withColumn("number", F.col("_before") + F.col("_own") - 1).drop("_h", "_b", "_own", "_before")


def split_by_family(rows: DataFrame, n: int, seed: str = "42", family_col: str = "Family") -> DataFrame:
    """Adds worker: families dealt in turn, in an order by hash; a family stays together."""
    dealt = hash_numbers(rows.select(family_col).distinct(), family_col, seed)
    dealt = dealt.select(F.col(family_col).alias("_family"), (F.col("number") % n).cast("int").alias("worker"))
    return rows.join(dealt, rows[family_col].eqNullSafe(F.col("_family")), "left").drop("_family")


def split_even(rows: DataFrame, n: int, id_col: str = "ID", seed: str = "42") -> DataFrame:
    """Adds worker: n parts of sizes that differ by one at most, the first ones larger, in an order by hash."""
    total = rows.count()
    small, larger = divmod(total, n)
    i, edge = F.col("number"), larger * (small + 1)
    part = F.when(i < edge, F.floor(i / (small + 1))).otherwise(larger + F.floor((i - edge) / max(small, 1)))
    return hash_numbers(rows, id_col, seed).withColumn("worker", part.cast("int")).drop("number")
