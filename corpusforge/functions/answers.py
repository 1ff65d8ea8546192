"""Citations, context text, token estimates, escaping and packed links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = r"\[\d+(?:,\d+)*\]"

# Fixed value: tokens kept free beside a prompt.
PROMPT_MARGIN = 250


def citation_numbers(c: Column) -> Column:
    """The distinct numbers of [n] and [n,m], ascending."""
    groups = F.regexp_extract_all(c, F.lit(_GROUP), F.lit(0))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(F.regexp_replace(g, r"[\[\]]", ""), ","), lambda n: n.cast("bigint"))))
    return F.array_sort(F.array_distinct(numbers))


def renumber(c: Column) -> Column:
    """The text with citations numbered 1..k in the order of their old numbers."""
    numbers = citation_numbers(c)
    pieces = F.regexp_extract_all(c, F.lit(rf"{_GROUP}|[^\[]+|\["), F.lit(0))
    made = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(f"^{_GROUP}$"),
            F.concat(F.lit("["), F.array_join(F.transform(F.split(F.regexp_replace(p, r"[\[\]]", ""), ","), lambda n: F.array_position(numbers, n.cast("bigint")).cast("string")), ","), F.lit("]")),
        ).otherwise(p),
    )
    return F.array_join(made, "")


def cited_ids(c: Column, ids: Column) -> Column:
    """The ids in the order of the citations, each once; a number without an id is missing_chunk_n; without citations all ids."""
    numbers = citation_numbers(c)
    made = F.array_distinct(F.transform(numbers, lambda n: F.coalesce(F.when(n >= 1, F.try_element_at(ids, n.cast("int"))), F.concat(F.lit("missing_chunk_"), n.cast("string")))))
    return F.when(F.size(ids) == 0, ids).when(F.size(numbers) == 0, ids).otherwise(made)


def piece_text(kind: Column, source: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(kind, F.lit("")), F.lit(" "), F.coalesce(source, F.lit("")), F.lit("] "), content)


def numbered(pieces: Column) -> Column:
    """Context pieces as a block: [1] ..., [2] ..., parted by empty lines."""
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")


def tokens(c: Column) -> Column:
    """Estimated: a quarter of the characters."""
    return F.floor(F.length(c) / 4).cast("int")


def reserved_tokens(*prompts: str) -> int:
    """What the longer of the prompts takes of the context, and a margin."""
    return max((len(p) // 4 for p in prompts), default=0) + PROMPT_MARGIN


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def compress_ids(ids: Column) -> Column:
    return F.base64(F.encode(F.to_json(ids), "UTF-8"))


def decompress_ids(c: Column) -> Column:
    """The ids of a packed link; one that isn't packed is parted at commas."""
    packed = F.from_json(F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8"), "array<string>")
    return F.coalesce(packed, F.split(c, ","))


def event_frame(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def between_marks(c: Column, start: str, end: str) -> Column:
    """What stands between the first start mark and the last end mark, trimmed; the whole without both."""
    a = F.locate(start, c)
    b = F.length(c) - F.locate(end[::-1], F.reverse(c)) - len(end) + 2
    found = (a > 0) & (F.locate(end, c) > 0) & (b >= a + len(start))
    return F.trim(F.when(found, F.substring(c, a + len(start), b - a - len(start))).otherwise(c))


def verdict(c: Column) -> Column:
    """struct<valid, reason> of a reply whose first line holds JA and whose second gives the reason."""
    lines = F.split(c, "\n")
    return F.struct(F.contains(F.upper(lines[0]), F.lit("JA")).alias("valid"), F.nullif(F.trim(F.regexp_extract(c, r"REDEN:(.*)", 1)), F.lit("")).alias("reason"))


def trace_answer(line: Column) -> Column:
    """The answer in a line of the trace that carries one."""
    return F.get_json_object(F.regexp_extract(line, r"(\{.*\})", 1), "$.answer")


def falsy_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def document_json(*columns: str) -> Column:
    """A row as JSON: empty strings are null, ids are strings, dates ISO."""
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]), {"ignoreNullFields": "false"})


def frame_data(frame: Column, schema: str) -> Column:
    """The data of an event frame; null for an empty one or one that doesn't parse."""
    return F.from_json(F.regexp_extract(frame, r"(?m)^data: (.*)$", 1), schema)
