"""What is read from the pages of a portal of decisions: hits of a search, sections of documents over several pages, and the table of
a decision's own facts. A page is parsed once, in Arrow batches; sections, numbers and counts are column operations."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.pages import _Page

# Headings of sections and the status of their documents, in order; the heading of a decision's facts; names of these.
SECTIONS = {"(Deels) openbaar gemaakt": "deels_openbaar", "Reeds openbaar": "reeds_openbaar"}
WITHOUT_SECTION = "deels_openbaar"
FACTS_HEADING = "Over dit besluit"
FACTS = {"Soort besluit": "kind", "Type besluit": "type", "Verantwoordelijk(en)": "responsible", "Periode": "period", "Datum besluit": "date", "Onderwerp": "subjects", "Omvang openbaarmaking": "size"}
_HIT = "struct<id: string, title: string, url: string, documents: int>"
_ROW = "struct<table: int, row: int, heading: string, number: string, name: string, link: string, date: string, type: string>"
_FACT = "struct<kind: string, type: string, responsible: string, period: string, date: string, subjects: array<string>, documents: int, pages: int>"


def result_pages(html: Column) -> Column:
    """The number of pages of results: the largest number that the mark of a page link ends with, 1 without such a mark. What a
    link's address says doesn't count."""
    marks = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?\bdata-e2e-name\s*=\s*["']?page-number-([^"'>\s]*)"""), F.lit(1))
    numbers = F.transform(marks, lambda m: F.regexp_extract(m, r"(\d+)$", 1).try_cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(1))


def _classes(page: _Page, at: int) -> list[str]:
    return (page.attributes[at].get("class") or "").split()


def _marked(page: _Page, at: int, tag: str, mark: str) -> int | None:
    return next((k for k in page.inside(at, (tag,)) if page.attributes[k].get("data-e2e-name") == mark), None)


def _number(text: str) -> int | None:
    found = re.search(r"\d+", text)
    return int(found[0]) if found else None


def _hits(html: str | None, url: str | None) -> list[dict]:
    page, out = _Page(html or ""), []
    for at in page.named("li"):
        if "woo-search-result" in _classes(page, at) and page.attributes[at].get("data-e2e-name") == "search-result":
            count, link = _marked(page, at, "li", "nr-of-documents"), _marked(page, at, "a", "main-link")
            href = page.attributes[link].get("href") if link is not None else None
            if count is not None and href is not None:
                out.append({"id": href.split("/")[-1], "title": page.text(link), "url": urljoin(url or "", href), "documents": _number(page.text(count)) or 0})
    return out


def hits(html: Column, url: Column) -> Column:
    """array of the hits of a page of results, in page order: id (the end of its address), title, url, number of documents (0 if
    its text has none). A hit without documents or without a main link isn't one."""

    @F.pandas_udf(f"array<{_HIT}>")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_hits(x, y) for x, y in zip(h, u, strict=True)])

    return run(html, url)


def _headed(page: _Page) -> list[tuple[int, str]]:
    """Tables of the portal's class, each with the nearest heading before it in page order."""
    out, heading = [], ""
    for at, tag in enumerate(page.tags):
        if tag == "h2":
            heading = page.text(at)
        elif tag == "table" and "woo-table" in _classes(page, at):
            out.append((at, heading))
    return out


def _first(page: _Page, at: int, tag: str) -> int | None:
    return next(iter(page.inside(at, (tag,))), None)


def _rows(html: str | None, url: str | None) -> list[dict]:
    page, out = _Page(html or ""), []
    for t, (table, heading) in enumerate(_headed(page)):
        kept = 0
        for row in page.inside(table, ("tr",)):
            cells = list(page.inside(row, ("td",)))
            if _first(page, row, "th") is not None or len(cells) < 3:
                continue
            link = next((k for k in page.inside(cells[2], ("a",)) if "woo-a" in _classes(page, k)), None)
            if link is None or page.attributes[link].get("href") is None:
                continue
            use, time = _first(page, cells[1], "use"), _first(page, cells[3], "time") if len(cells) > 3 else None
            icon = page.attributes[use].get("xlink:href") if use is not None else None
            out.append({
                "table": t, "row": kept, "heading": heading, "number": page.text(cells[0]), "name": page.text(link), "link": urljoin(url or "", page.attributes[link]["href"]),
                "date": page.attributes[time].get("datetime") if time is not None else None, "type": icon.split("#")[-1] if icon else "unknown",
            })
            kept += 1
    return out


def section_rows(pages: DataFrame, decision: str = "decision", number: str = "page", status: str = "status", html: str = "html", url: str = "url") -> DataFrame:
    """decision, status, place, number, name, link, date, type: the documents of decisions, from all pages of each.

    pages: decision, page (from 1), status (of the section that a page goes on with; null on first pages), html, url. On a first
    page a section is the first table under its heading; without headings of sections the first table that doesn't hold the
    decision's facts is taken. On a later page it is the first table. Headers, rows of under three cells and rows without a
    document's link don't count. place numbers the documents of a decision's section over its pages, from 1, without gaps; equal
    pages of one number stand one after another. A page without tables, or a null page, gives nothing."""

    @F.pandas_udf(f"array<{_ROW}>")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_rows(x, y) for x, y in zip(h, u, strict=True)])

    parsed = pages.select(F.col(decision).alias("decision"), F.col(number).alias("page"), F.col(status).alias("given"), run(F.col(html), F.col(url)).alias("r"))
    headed = lambda title: F.filter("r", lambda r: F.contains(r["heading"], F.lit(title)))
    first_of = lambda found: F.array_min(F.transform(found, lambda r: r["table"]))
    own = [F.struct(F.lit(s).alias("status"), headed(t).alias("rows")) for t, s in SECTIONS.items()]
    none = reduce(and_, [F.size(headed(t)) == 0 for t in SECTIONS])
    rest = F.array(F.struct(F.lit(WITHOUT_SECTION).alias("status"), F.filter("r", lambda r: r["heading"] != FACTS_HEADING).alias("rows")))
    later = F.array(F.struct(F.col("given").alias("status"), F.col("r").alias("rows")))
    parts = F.when(F.col("given").isNotNull(), later).when(none, rest).otherwise(F.array(*own))
    found = parsed.select("decision", "page", F.explode(parts).alias("s")).select("decision", "page", "s.status", F.filter("s.rows", lambda r: r["table"] == first_of(F.col("s.rows"))).alias("rows"))
    # a page's rows come after those of the pages before it: a count for each page, not the rows, is summed over the decision
    sized = found.where(F.size("rows") > 0).withColumn("n", F.size("rows"))
    before = F.sum("n").over(Window.partitionBy("decision", "status").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("before", F.coalesce(before, F.lit(0))).select("decision", "status", "before", F.posexplode("rows").alias("i", "x"))
    return placed.select("decision", "status", (F.col("before") + F.col("i") + 1).cast("long").alias("place"), "x.number", "x.name", "x.link", "x.date", "x.type")


def _facts(html: str | None) -> list[dict]:
    page = _Page(html or "")
    table = next((at for at, heading in _headed(page) if heading == FACTS_HEADING), None)
    if table is None:
        return []
    out: dict = {}
    for row in page.inside(table, ("tr",)):
        head, cell = _first(page, row, "th"), _first(page, row, "td")
        name = FACTS.get(page.text(head)) if head is not None and cell is not None else None
        if name == "date":
            time = _first(page, cell, "time")
            out[name] = page.attributes[time].get("datetime") if time is not None else None
        elif name == "subjects":
            out[name] = [page.text(a) for a in page.inside(cell, ("a",))]
        elif name == "size":
            count = _marked(page, cell, "span", "dossier-document-count")
            found = re.search(r"(\d+)\s*pagina", page.text(cell))
            out["documents"] = _number(page.text(count)) if count is not None else None
            out["pages"] = int(found[1]) if found else None
        elif name:
            out[name] = page.text(cell)
    return [{k: out.get(k) for k in ("kind", "type", "responsible", "period", "date", "subjects", "documents", "pages")}]


def decision_facts(html: Column) -> Column:
    """struct of a decision's facts, from the table under their heading; null if there is none. A fact that it lacks is null."""

    @F.pandas_udf(f"array<{_FACT}>")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([_facts(x) for x in h])

    return F.try_element_at(run(html), F.lit(1))
