"""Identifiers: normal forms, deterministic uuids, chunk ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "nan", "na", "none")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def missing_to_null(c: Column) -> Column:
    return F.when(~is_missing(c), c)


def normalize_id(c: Column) -> Column:
    """What stands after the last dash; null is empty."""
    return F.coalesce(F.element_at(F.split(F.trim(c), "-"), -1), F.lit(""))


def family_id(c: Column) -> Column:
    """Without dashes and leading zeros."""
    return F.regexp_replace(F.replace(c, F.lit("-"), F.lit("")), "^0+", "")


def derived_id(c: Column) -> Column:
    """The parts from the third dash on."""
    parts = F.split(c, "-")
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "-")


def dashed(hex32: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def document_uuid(content: Column, link: Column) -> Column:
    """From the md5 of the first 100 characters and the link; the title and number in the hashed text are always empty."""
    head = F.md5(F.substring(F.coalesce(content, F.lit("")), 1, 100))
    quoted = F.regexp_replace(F.to_json(F.struct(F.coalesce(link, F.lit("")).alias("x"))), r'^\{"x":|\}$', "")
    text = F.concat(F.lit('{"content_hash": "'), head, F.lit('", "link": '), quoted, F.lit(', "title": "", "vws_id": ""}'))
    return dashed(F.substring(F.sha2(text, 256), 1, 32))


def chunk_id(uuid: Column, pos: Column) -> Column:
    """The low 46 bits of the uuid, shifted by 17, and the position."""
    low = F.conv(F.right(F.replace(uuid, F.lit("-"), F.lit("")), F.lit(12)), 16, 10).cast("bigint")
    return F.shiftleft(low.bitwiseAND(F.lit((1 << 46) - 1)), 17).bitwiseOR(pos.cast("bigint"))


def file_name(c: Column) -> Column:
    """A file name for any system: .pdf by default, signs that some forbid replaced, 100 characters at most."""
    extension = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)[^./](\.[^./]*)$", 1), F.lit("")), F.lit(""))
    name = F.substring(c, F.lit(1), F.length(c) - F.length(extension))
    extension = F.when(extension == "", ".pdf").otherwise(extension)
    name = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    name = F.regexp_replace(name, r"(?U)\s+", "_")
    return F.concat(F.substring(name, F.lit(1), 100 - F.length(extension)), extension)


def sanitized_ids(c: Column) -> Column:
    """An array of ids: trimmed, other than word signs and dashes gone, those of 1 to 29 signs kept."""
    made = F.transform(c, lambda x: F.regexp_replace(F.trim(x), r"[^\w-]", ""))
    return F.filter(made, lambda x: F.length(x).between(1, 29))
