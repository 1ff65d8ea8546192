"""Cleaning, chunking, extraction, quality of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.functions import clean as C
from corpusforge.functions import text as X
from corpusforge.functions.answers import between_marks, escape_html
from corpusforge.functions.ids import chunk_id
from corpusforge.operators import chunking
from corpusforge.plans import evaluate
from corpusforge.sources.tables import DOCS_SQL, documents

_D = "WITH " + DOCS_SQL + " "


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_delete(expression: str, terms: list[str]) -> str:
    return reduce(lambda e, t: f"replace({e}, {_quote(t)}, '')", terms, expression)


def _made(spark, d):
    """Texts in which every rule has something to do, made of a document's words."""
    docs = documents(spark, d)
    made = F.concat(
        F.substring("content", 1, 120), F.lit(" (10)(2e) 5.1.2i\nubbel ()  [ ] {x} **bold** *it* _u_ `c`  \n\n \n\nDubbel  dubbel .. ... ,, , ! john@test.ni (jane@x.org) $@a.nl @ b.com a\tb 1.2a\n\n"), F.col("doc_id"), F.lit("\n\n\n"),
    )
    return docs.select("doc_id", "type", made.alias("t"))


_MADE = "m AS (SELECT doc_id, type, substr(content, 1, 120) || ' (10)(2e) 5.1.2i' || chr(10) || 'ubbel ()  [ ] {x} **bold** *it* _u_ `c`  ' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'Dubbel  dubbel .. ... ,, , ! john@test.ni (jane@x.org) $@a.nl @ b.com a' || chr(9) || 'b 1.2a' || chr(10) || chr(10) || doc_id || chr(10) || chr(10) || chr(10) AS t FROM docs)"


def _cleaned(name, step, expression):
    """A step over the whole texts and over the made ones."""

    @query(name, f"WITH {DOCS_SQL}, {_MADE} SELECT m.doc_id, {expression('content')} AS text, {expression('t')} AS made FROM docs JOIN m USING (doc_id)")
    def run(spark, d):
        docs = documents(spark, d).select("doc_id", "content")
        return _made(spark, d).join(docs, "doc_id").select("doc_id", step(F.col("content")).alias("text"), step(F.col("t")).alias("made"))


_W = r"[\s\x0b]"
_cleaned("clean_ground_terms", C.ground_terms, lambda e: _sql_delete(e, C.GROUND_TERMS))
_cleaned("clean_noise_terms", C.noise_terms, lambda e: _sql_delete(e, C.NOISE_TERMS))
_cleaned("clean_double_space", C.double_space, lambda e: f"regexp_replace({e}, '{_W}{{2,}}', ' ', 'g')")
_cleaned("clean_empty_brackets", C.empty_brackets, lambda e: reduce(lambda x, p: f"regexp_replace({x}, '{p}', '', 'g')", (rf"\({_W}*\)", rf"\[{_W}*\]", rf"\{{{_W}*\}}"), e))
_cleaned("clean_punctuation", C.punctuation, lambda e: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '\.{{3,}}', '...', 'g'), '\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g'), '{_W}+([.,;:!?])', '\1', 'g')")
_cleaned("clean_markdown", C.markdown_marks, lambda e: reduce(lambda x, p: rf"regexp_replace({x}, '{p}', '\1', 'g')", (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"_(.*?)_", r"`(.*?)`"), e))
_cleaned("clean_doubled_word", C.doubled_word, lambda e: rf"regexp_replace({e}, '(^|[^\p{{L}}\p{{N}}_])[dD][uU][bB][bB][eE][lL]{_W}+[dD][uU][bB][bB][eE][lL]($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g')")
_cleaned("pdf_text_clean", C.pdf_text, lambda e: rf"replace(regexp_replace(replace(regexp_replace(regexp_replace({e}, '\n{_W}*\n', chr(10) || '<PARAGRAPH_BREAK>' || chr(10), 'g'), ' +', ' ', 'g'), chr(9), ' '), '(\d+\.\d+[\p{{L}}\p{{N}}_]?)', ' \1 ', 'g'), '<PARAGRAPH_BREAK>', chr(10) || chr(10))")
_cleaned("html_escape", escape_html, lambda e: reduce(lambda x, p: f"replace({x}, {_quote(p[0])}, '{p[1]}')", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")), e))


def _newlines(e: str) -> str:
    c = rf"regexp_replace({e}, ' +(\n)', '\1', 'g')"
    core = f"rtrim({c}, chr(10))"
    return rf"(regexp_replace(regexp_replace({core}, '(\n[ \t]*){{2,}}', chr(10) || chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') || repeat(chr(10), least(length({c}) - length({core}), 2)))"


_cleaned("clean_newlines", C.excess_newlines, _newlines)
_SHORT = "array_to_string(list_transform(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+', 0), lambda w: CASE WHEN length(w) <= 2 AND regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]+') THEN '' ELSE w END), '')"
_cleaned("clean_short_words", C.short_words, lambda e: _SHORT.format(e=e))


def _emails(e: str) -> str:
    e = rf"regexp_replace({e}, '@([a-zA-Z0-9]+)\.ni\b', '@\1.nl', 'g')"
    e = rf"regexp_replace({e}, '[()*&^%$#@{{}}\[\]+]+(@[a-zA-Z0-9]+\.[a-zA-Z]{{2,}})', '\1', 'g')"
    e = rf"regexp_replace({e}, '[(\[{{]{_W}*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}){_W}*[)\]}}]+', '\1', 'g')"
    e = rf"regexp_replace({e}, '\p{{L}}+@', '@', 'g')"
    return rf"regexp_replace({e}, '@{_W}+([a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}})', '@\1', 'g')"


_cleaned("clean_email_headers", C.email_addresses, _emails)


@query("clean_email_typed", rf"WITH {DOCS_SQL}, m AS (SELECT doc_id, type, 'From: a b' || chr(10) || 'To: c' || chr(10) || content || chr(10) || 'Subject: s' || chr(10) || 'end' AS t FROM docs) SELECT doc_id, CASE WHEN lower(type) = 'email' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'From:.*?\n', '', 'g'), 'To:.*?\n', '', 'g'), 'Subject:.*?\n', '', 'g'), 'Date:.*?\n', '', 'g') ELSE t END AS text FROM m")
def clean_email_typed(spark, d):
    t = F.concat(F.lit("From: a b\nTo: c\n"), "content", F.lit("\nSubject: s\nend"))
    return documents(spark, d).select("doc_id", C.typed(t, F.col("type")).alias("text"))


@query("clean_brackets")
def clean_brackets(spark, d):
    """Whole texts, and the made ones."""
    rows = _made(spark, d).join(documents(spark, d).select("doc_id", "content"), "doc_id")
    return rows.select("doc_id", C.single_brackets(F.col("content")).alias("text"), C.single_brackets(F.col("t")).alias("made"))


@query("clean_full")
def clean_full(spark, d):
    return documents(spark, d).select("doc_id", C.clean(F.col("content"), F.col("type")).alias("text"))


@query("drop_short_documents", rf"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^{_W}+|{_W}+$', '', 'g')) >= 6")
def drop_short_documents(spark, d):
    return documents(spark, d).where(C.long_enough(F.col("content"))).select("doc_id")


_NAMES = {"the": "T", "que": "Q", "und": "U", "T": "term"}
_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(_NAMES.items())) + "}"
_RUNS = "regexp_extract_all({e}, '[A-Za-z0-9]+|[^A-Za-z0-9]+', 0)"


def _names():
    return F.create_map(*[F.lit(x) for kv in sorted(_NAMES.items()) for x in kv])


def _expand(e: str, form: str) -> str:
    return f"array_to_string(list_transform({_RUNS.format(e=e)}, lambda w: coalesce({form}, w)), '')"


_EXPAND, _ABBREVIATE = f"w || ' (' || ({_MAP})[w] || ')'", f"({_MAP})[w] || ' (' || w || ')'"


@query("abbrev_expand", f"SELECT doc_id, {_expand('text', _EXPAND)} AS text FROM documents")
def abbrev_expand(spark, d):
    return documents(spark, d).select("doc_id", X.expand(F.col("content"), _names()).alias("text"))


@query("abbrev_abbreviate", f"SELECT doc_id, {_expand('text', _ABBREVIATE)} AS text FROM documents")
def abbrev_abbreviate(spark, d):
    return documents(spark, d).select("doc_id", X.abbreviate(F.col("content"), _names()).alias("text"))


@query("abbrev_both", f"WITH e AS (SELECT doc_id, {_expand('text', _EXPAND)} AS t FROM documents) SELECT doc_id, {_expand('t', _ABBREVIATE)} AS text FROM e")
def abbrev_both(spark, d):
    return documents(spark, d).select("doc_id", X.both(F.col("content"), _names()).alias("text"))


_E0, _E1 = "chr(57344)", "chr(57345)"
_SENTENCES = rf"string_split(replace(regexp_replace(regexp_replace(regexp_replace(content, '([\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_].)({_W})', '\1' || {_E0} || '\2', 'g'), '([A-Z][a-z]\.)({_W})', '\1' || {_E0} || '\2', 'g'), '([.?!]){_W}', '\1' || {_E1}, 'g'), {_E0}, ''), {_E1})"


@query("sentence_split", _D + f"SELECT doc_id, {_SENTENCES} AS sentences FROM docs")
def sentence_split(spark, d):
    return documents(spark, d).select("doc_id", X.sentences(F.col("content")).alias("sentences"))


@query("sentence_context", _D + f", s AS (SELECT doc_id, {_SENTENCES} AS p FROM docs) SELECT doc_id, list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[greatest(i - 1, 1):i + 1], ' ')) AS context FROM s")
def sentence_context(spark, d):
    rows = documents(spark, d).select("doc_id", X.sentences(F.col("content")).alias("s"))
    return rows.select("doc_id", chunking.sentence_context(F.col("s")).alias("context"))


@query("chunk_naive")
def chunk_naive(spark, d):
    docs = documents(spark, d)
    return chunking.chunks(docs, chunking.naive(F.col("content"))).select("chunk_id", "doc_uuid", "pos", "content")


@query("chunk_semantic")
def chunk_semantic(spark, d):
    docs = documents(spark, d)
    return chunking.chunks(docs, chunking.semantic(F.col("content"))).select("chunk_id", "doc_uuid", "pos", "content")


@query("chunk_stats", _D + f", s AS (SELECT doc_id, length(unnest({_SENTENCES})) AS size FROM docs), n AS (SELECT count(DISTINCT doc_id) AS docs FROM s) SELECT count(*) AS chunks, round(count(*) / any_value(docs), 6) AS per_document, round(avg(size), 6) AS mean_size, round(stddev_samp(size), 4) AS std_size, min(size) AS min_size, max(size) AS max_size FROM s, n")
def chunk_stats(spark, d):
    """Of the chunker that takes each sentence as a chunk."""
    rows = documents(spark, d).select(F.lit("sentence").alias("chunker"), F.col("doc_id").alias("doc"), F.explode(X.sentences(F.col("content"))).alias("s"))
    made = chunking.statistics(rows.select("chunker", "doc", F.length("s").cast("long").alias("size")))
    return made.select("chunks", F.round("per_document", 6).alias("per_document"), F.round("mean_size", 6).alias("mean_size"), F.round("std_size", 4).alias("std_size"), "min_size", "max_size")


@query("chunk_ids", _D + "SELECT doc_id, i AS pos, (('0x' || right(replace(uuid, '-', ''), 12))::BIGINT & ((1::BIGINT << 46) - 1)) * 131072 + i AS chunk_id FROM docs, range(3) t(i)")
def chunk_ids(spark, d):
    docs = documents(spark, d).select("doc_id", "uuid", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("pos"))
    return docs.select("doc_id", "pos", chunk_id(F.col("uuid"), F.col("pos")).alias("chunk_id"))


_MAIL = "m AS (SELECT doc_id, 'Onderwerp: zaak ' || doc_id || ' van ' || source || '. Op ' || (doc_id % 31 + 1) || ' januari ' || (1990 + doc_id % 40) || ' en 2020-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) || '. From: x@' || source || '.nl to y@b.com, z@b.com cc w@c' || (doc_id % 5) || '.org ' || content AS t FROM docs)"


def _mail(spark, d):
    c = F.concat(
        F.lit("Onderwerp: zaak "), "doc_id", F.lit(" van "), "source", F.lit(". Op "), F.col("doc_id") % 31 + 1, F.lit(" januari "), F.col("doc_id") % 40 + 1990, F.lit(" en 2020-0"), F.col("doc_id") % 9 + 1, F.lit("-1"), F.col("doc_id") % 10,
        F.lit(". From: x@"), "source", F.lit(".nl to y@b.com, z@b.com cc w@c"), F.col("doc_id") % 5, F.lit(".org "), "content",
    )
    return documents(spark, d).select("doc_id", c.alias("t"))


@query("extract_dates", "WITH x AS (SELECT doc_id, make_date(1990 + doc_id % 40, 1, doc_id % 31 + 1) AS a, make_date(2020, doc_id % 9 + 1, 10 + doc_id % 10) AS b FROM documents) SELECT doc_id, CAST(least(CASE WHEN year(a) <= 2027 THEN a END, b) AS VARCHAR) AS first_date, CAST(greatest(CASE WHEN year(a) <= 2027 THEN a END, b) AS VARCHAR) AS last_date FROM x")
def extract_dates(spark, d):
    rows = _mail(spark, d).select("doc_id", X.mentioned_dates(F.col("t"), 2026).alias("m"))
    return rows.select("doc_id", F.col("m.first").cast("string").alias("first_date"), F.col("m.last").cast("string").alias("last_date"))


@query("extract_subject", "SELECT doc_id, 'zaak ' || doc_id || ' van ' || source AS subject FROM documents")
def extract_subject(spark, d):
    return _mail(spark, d).select("doc_id", X.subject(F.col("t")).alias("subject"))


def _domain_list(e: str) -> str:
    return rf"nullif(array_to_string(list_sort(list_distinct(regexp_extract_all({e}, '@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}', 0))), ', '), '')"


_HEADERS = f"WITH {DOCS_SQL}, {_MAIL}, l AS (SELECT doc_id, lower(t) AS t FROM m) SELECT doc_id, " + _domain_list(r"regexp_extract(t, '(?s)(from|van).*?(to|aan|cc|\z)', 0)") + " AS email_from, " + _domain_list("regexp_extract(t, '(?s)(to|aan).*?(cc)', 0)") + " AS email_to, " + _domain_list(r"regexp_extract(t, '(?s)(cc).*?(to|aan|from|van|\z)', 0)") + " AS email_cc FROM l"


@query("extract_email_domains", _HEADERS)
def extract_email_domains(spark, d):
    return _mail(spark, d).select("doc_id", X.email_headers(F.col("t")).alias("h")).select("doc_id", "h.*")


@query("doc_metadata", f"WITH h AS ({_HEADERS}), x AS (SELECT doc_id, source, make_date(1990 + doc_id % 40, 1, doc_id % 31 + 1) AS a, make_date(2020, doc_id % 9 + 1, 10 + doc_id % 10) AS b FROM documents) SELECT doc_id, 'zaak ' || doc_id || ' van ' || source AS subject, CAST(least(CASE WHEN year(a) <= 2027 THEN a END, b) AS VARCHAR) AS first_date, CAST(greatest(CASE WHEN year(a) <= 2027 THEN a END, b) AS VARCHAR) AS last_date, email_from, email_to, email_cc FROM x JOIN h USING (doc_id)")
def doc_metadata(spark, d):
    rows = _mail(spark, d).select("doc_id", X.mentioned_dates(F.col("t"), 2026).alias("m"), X.subject(F.col("t")).alias("subject"), X.email_headers(F.col("t")).alias("h"))
    return rows.select("doc_id", "subject", F.col("m.first").cast("string").alias("first_date"), F.col("m.last").cast("string").alias("last_date"), "h.*")


_ISSUES = r"""
WITH b AS (SELECT doc_id, text AS c, regexp_replace(text, '[\s\x0b]+', '', 'g') AS bare, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS joined,
    regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS stripped,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> '') AS lines,
    contains(text, '|') AND length(text) - length(replace(text, '|', '')) > (length(text) - length(replace(text, chr(10), ''))) * 0.5 AND contains(text, '-|-') AS is_table FROM documents),
t AS (SELECT *, CASE WHEN joined = '' THEN 0 ELSE len(string_split(joined, ' ')) END AS words, contains(lower(c), 'description:') AS described FROM b)
SELECT doc_id, list_filter([
    CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(c, '\n+', 0), lambda x: length(x))), 0) > 5 THEN 'excessive_newlines' END,
    CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(c, ' +', 0), lambda x: length(x))), 0) > 10 THEN 'excessive_spaces' END,
    CASE WHEN length(c) - length(replace(c, chr(9), '')) > 10 THEN 'excessive_tabs' END,
    CASE WHEN (2 * length(c) - length(replace(c, chr(10), '')) - length(replace(c, chr(9), ''))) / greatest(length(c), 1) > 0.3 AND NOT is_table THEN 'high_whitespace_ratio' END,
    CASE WHEN len(list_filter([['l l', '4'], ['rn', '5'], ['ii', '5'], ['0O', '4']], lambda p: (length(joined) - length(replace(joined, p[1], ''))) // length(p[1]) >= p[2]::INTEGER AND (length(joined) - length(replace(joined, p[1], ''))) // length(p[1]) / greatest(words, 1) > 0.1)) > 0 THEN 'potential_ocr_errors' END,
    CASE WHEN length(regexp_replace(bare, '[\p{L}\p{N}]', '', 'g')) / greatest(length(bare), 1) > 0.3 AND NOT is_table THEN 'high_special_char_ratio' END,
    CASE WHEN bare = '' THEN 'empty_content' END,
    CASE WHEN starts_with(stripped, '![') AND contains(lower(stripped), '/page') AND len(lines) <= 2 AND NOT described THEN 'image_only' END,
    CASE WHEN len(lines) < 2 AND len(list_filter(lines, lambda x: regexp_matches(x, '^(#|---|!\[|\|)'))) = 0 THEN 'single_line' END,
    CASE WHEN length(bare) < 50 AND NOT (described OR (contains(c, 'Image') AND contains(c, '/page/')) OR is_table OR starts_with(stripped, '![')) THEN 'very_short_content' END,
    CASE WHEN len(list_filter([['|', '4'], ['[]', '3'], ['{}', '3'], ['()', '3']], lambda p: (length(joined) - length(replace(joined, p[1], ''))) // length(p[1]) >= p[2]::INTEGER)) > 0 AND NOT is_table THEN 'ocr_artifacts' END
], lambda x: x IS NOT NULL) AS issues FROM t"""


@query("markdown_quality", _ISSUES)
def markdown_quality(spark, d):
    return documents(spark, d).select("doc_id", X.markdown_issues(F.col("content")).alias("issues"))


@query("between_marks", "SELECT doc_id, trim(CASE WHEN regexp_matches(text, '(?s)the.*and') THEN regexp_extract(text, '(?s)the(.*)and', 1) ELSE text END) AS text FROM documents")
def marks(spark, d):
    """Of whole texts, what stands between the first "the" and the last "and"."""
    return documents(spark, d).select("doc_id", between_marks(F.col("content"), "the", "and").alias("text"))


_CLEANED = f"regexp_replace({_sql_delete('text', C.GROUND_TERMS)}, '{_W}{{2,}}', ' ', 'g')"
_WORDS = rf"len(regexp_extract_all({{}}, '[^\s\x0b]+', 0))"


@query("cleaning_loss", f"WITH w AS (SELECT {_WORDS.format('text')} AS b, {_WORDS.format(_SHORT.format(e=_CLEANED))} AS a FROM documents) SELECT CAST(sum(b) AS BIGINT) AS words_before, CAST(sum(a) AS BIGINT) AS words_after, CAST(sum(b - a) AS BIGINT) AS removed, round(100.0::DOUBLE * sum(b - a) / sum(b), 4) AS percent, CAST(max(b - a) AS BIGINT) AS most_removed FROM w")
def cleaning_loss(spark, d):
    """Of the steps for ground terms, blanks and short words."""
    after = C.short_words(C.double_space(C.ground_terms(F.col("content"))))
    rows = documents(spark, d).select(C.word_count(F.col("content")).cast("long").alias("b"), C.word_count(after).cast("long").alias("a"))
    return evaluate.cleaning_loss(rows, "b", "a")


#: Forms that an order's date is written in, for Spark and for DuckDB; the month comes first where both could be meant.
_FORMS = [("yyyy-MM-dd", "%Y-%m-%d"), ("M/d/yyyy", "%-m/%-d/%Y"), ("d MMMM yyyy", "%-d %B %Y"), ("MMM d, yyyy", "%b %-d, %Y"), ("yyyyMMdd", "%Y%m%d"), ("'Created on' EEEE, d MMMM yyyy 'at 14:05'", "Created on %A, %-d %B %Y at 14:05"), ("MM-dd-yyyy HH:mm:ss'Z'", "%m-%d-%Y %H:%M:%SZ"), ("MMMM yyyy", "%B %Y")]


_K = f"o_orderkey % {len(_FORMS)}"


@query("written_dates", f"""WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders)
SELECT o_orderkey, CASE {_K} {" ".join(f"WHEN {k} THEN strftime(d, '{f}')" for k, (_, f) in enumerate(_FORMS))} END AS written,
    strftime(CASE {_K} WHEN {len(_FORMS) - 1} THEN date_trunc('month', d) WHEN 5 THEN d + INTERVAL '14 hours 5 minutes' ELSE d END, '%Y-%m-%d %H:%M') AS date FROM o""")
def written_dates(spark, d):
    """The dates of all orders, written in eight forms and read again."""
    from corpusforge.functions.dates import written_date
    from corpusforge.sources.tables import table

    form = F.element_at(F.array(*[F.date_format(F.date_trunc("day", "o_orderdate"), f) for f, _ in _FORMS]), (F.col("o_orderkey") % len(_FORMS) + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", form.alias("written"))
    return rows.select("o_orderkey", "written", F.date_format(written_date(F.col("written")), "yyyy-MM-dd HH:mm").alias("date"))
