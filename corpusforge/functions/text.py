"""Abbreviations, sentences, dates, subjects, e-mail headers, markdown quality: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.clean import once

# Names of months and their numbers.
MONTHS = {"januari": "01", "februari": "02", "maart": "03", "april": "04", "mei": "05", "juni": "06", "juli": "07", "augustus": "08", "september": "09", "oktober": "10", "november": "11", "december": "12"}


def word_runs(c: Column) -> Column:
    """The text as an array of runs, of letters A-Z and digits or of other signs, in turn."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))


def _rewrite(c: Column, form) -> Column:
    return F.array_join(F.transform(word_runs(c), form), "")


def abbreviate(c: Column, names: Column) -> Column:
    """Each word w of the map `names` becomes `names[w] (w)`."""
    return _rewrite(c, lambda w: F.coalesce(F.concat(F.try_element_at(names, w), F.lit(" ("), w, F.lit(")")), w))


def expand(c: Column, names: Column) -> Column:
    """Each word w of the map `names` becomes `w (names[w])`."""
    return _rewrite(c, lambda w: F.coalesce(F.concat(w, F.lit(" ("), F.try_element_at(names, w), F.lit(")")), w))


def both(c: Column, names: Column) -> Column:
    """Expands, then abbreviates what came out: words of the first pass are met again in the second."""
    return abbreviate(expand(c, names), names)


def abbreviate_once(c: Column, names: Column) -> Column:
    """Abbreviates a word unless the text has that form anywhere."""

    def form(w: Column) -> Column:
        new = F.concat(F.try_element_at(names, w), F.lit(" ("), w, F.lit(")"))
        return F.when(new.isNotNull() & ~F.contains(c, new), new).otherwise(w)

    return _rewrite(c, form)


#: After a full stop, question or exclamation mark, but for the like of `x.y.` and `Mr.`.
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s"


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END, -1)


def _dates(c: Column, pattern: str, order: str) -> Column:
    """Dates of a pattern of numbers in the order d, m, y given; ones that aren't in the calendar are left out."""
    groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)) for i in range(len(order))]
    names = dict(zip(order, range(len(order)), strict=True))

    def made(row: Column) -> Column:
        part = lambda x: row[str(names[x])]
        return F.try_to_timestamp(F.concat_ws("-", part("d") if "d" in names else F.lit("01"), part("m"), part("y")), F.lit("d-M-yyyy")).cast("date")

    zipped = F.arrays_zip(*[g.alias(str(i)) for i, g in enumerate(groups)])
    return F.transform(zipped, made)


#: Numbers of one to four digits, parted by a sign or a month's name: a date that a text mentions lies within such a run. The
#: lookahead is the cheapest test at a sign that isn't a digit; the possessive loop needs no stack, however long the run.
DATE_RUN = rf"(?U)(?=\d)\b\d{{1,4}}\b(?:(?:[-/. ]|\s+(?:{'|'.join(MONTHS)})\s+)\d{{1,4}}\b)++"


def mentioned_dates(c: Column, this_year: int) -> Column:
    """struct<first, last> of the dates that the text mentions, 1950 to next year; months without a day count only if there is no full date.
    The whole text is read once, for its runs of numbers; the months' names and the patterns of dates are looked for in these."""
    runs = F.array_join(F.regexp_extract_all(c, F.lit(DATE_RUN), F.lit(0)), ";")
    return once(once(once(runs, _numbered), lambda x: _mentioned(x, this_year)), lambda dates: F.struct(F.array_min(dates).alias("first"), F.array_max(dates).alias("last")))


def _numbered(c: Column) -> Column:
    """Days with a month's name become d-m-y."""
    for name, number in MONTHS.items():
        c = F.regexp_replace(c, rf"(?U)\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b", f"$1-{number}-$2")
    return c


def _mentioned(c: Column, this_year: int) -> Column:
    """The full dates; the months, if there are none."""
    sane = lambda dates: F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(1950, this_year + 1))
    full = sane(F.concat(_dates(c, r"(?U)\b(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})\b", "dmy"), _dates(c, r"(?U)\b(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})\b", "ymd")))
    months = sane(F.concat(_dates(c, r"(?U)\b(\d{1,2})[-/. ](\d{4})\b", "my"), _dates(c, r"(?U)\b(\d{4})[-/. ](\d{1,2})\b", "ym")))
    return once(full, lambda x: F.when(F.size(x) > 0, x).otherwise(months))


def subject(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?iu)(?:onderwerp|betreft|subject)[:;(?U:\s)]+([^\n.]{3,100})", 1)
    return F.nullif(F.trim(found), F.lit(""))


def _domains(section: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(section, F.lit(r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0))))
    return once(found, lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")))


def email_headers(c: Column) -> Column:
    """struct<email_from, email_to, email_cc>: the distinct domains between markers (plain substrings), sorted."""
    return once(F.lower(c), _headers)


def _headers(low: Column) -> Column:
    # if no cc follows the first to, none follows a later one: the end of the text ends the search, which would begin anew at each
    to = F.regexp_extract(low, r"(?s)(to|aan).*?(cc|\z)", 0)
    return F.struct(
        _domains(F.regexp_extract(low, r"(?s)(from|van).*?(to|aan|cc|\z)", 0)).alias("email_from"),
        once(to, lambda x: _domains(F.when(F.endswith(x, F.lit("cc")), x))).alias("email_to"),
        _domains(F.regexp_extract(low, r"(?s)(cc).*?(to|aan|from|van|\z)", 0)).alias("email_cc"),
    )


def _longest_run(c: Column, sign: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(f"{sign}+"), F.lit(0)), F.length)), F.lit(0))


def _times(c: Column, term: str) -> Column:
    """How often a term stands in the text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


# Signs of misread text and how often they may stand; leftovers of conversion and how often they may.
MISREAD = {"l l": 4, "rn": 5, "ii": 5, "0O": 4}
LEFTOVERS = {"|": 4, "[]": 3, "{}": 3, "()": 3}


def markdown_issues(c: Column) -> Column:
    """The names of what is wrong with converted text; empty if nothing is. The forms of the text that several tests read are
    bound to a lambda, so that each is made once."""
    joined = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")
    forms = F.struct(c.alias("text"), joined.alias("joined"), F.replace(joined, F.lit(" "), F.lit("")).alias("bare"))
    return F.transform(F.array(forms), lambda x: _issues(x["text"], x["joined"], x["bare"]))[0]


def _issues(c: Column, joined: Column, bare: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    table = F.contains(c, F.lit("|")) & (_times(c, "|") > _times(c, "\n") * 0.5) & F.contains(c, F.lit("-|-"))
    words = F.when(joined == "", 0).otherwise(F.size(F.split(joined, " ")))
    misread = F.lit(False)
    for term, most in MISREAD.items():
        n = _times(joined, term)
        misread = misread | ((n >= most) & (n / F.greatest(words, F.lit(1)) > 0.1))
    leftovers = F.lit(False)
    for term, most in LEFTOVERS.items():
        leftovers = leftovers | (_times(joined, term) >= most)
    special = F.length(F.regexp_replace(bare, r"[\p{L}\p{N}]", "")) / F.greatest(F.length(bare), F.lit(1))
    stripped = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    described = F.contains(F.lower(c), F.lit("description:"))
    begun = F.exists(lines, lambda x: x.startswith("#") | x.startswith("---") | x.startswith("![") | x.startswith("|"))
    tests = [
        ("excessive_newlines", _longest_run(c, "\n") > 5),
        ("excessive_spaces", _longest_run(c, " ") > 10),
        ("excessive_tabs", _times(c, "\t") > 10),
        ("high_whitespace_ratio", ((_times(c, "\n") + _times(c, "\t")) / F.greatest(F.length(c), F.lit(1)) > 0.3) & ~table),
        ("potential_ocr_errors", misread),
        ("high_special_char_ratio", (special > 0.3) & ~table),
        ("empty_content", bare == ""),
        ("image_only", stripped.startswith("![") & F.contains(F.lower(stripped), F.lit("/page")) & (F.size(lines) <= 2) & ~described),
        ("single_line", (F.size(lines) < 2) & ~begun),
        ("very_short_content", (F.length(bare) < 50) & ~(described | (F.contains(c, F.lit("Image")) & F.contains(c, F.lit("/page/"))) | table | stripped.startswith("!["))),
        ("ocr_artifacts", leftovers & ~table),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))


def first_good(*versions: Column) -> Column:
    """Of converted versions of a text, from the cheapest to the dearest, the first without issues; else the last there is."""
    good = [F.when(F.size(markdown_issues(v)) == 0, v) for v in versions]
    return F.coalesce(*good, *reversed(versions))
