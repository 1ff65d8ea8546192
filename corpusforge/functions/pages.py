"""What is read from web pages: links, tables, content areas. The standard parser, in Arrow batches."""

from __future__ import annotations

import json
from functools import reduce
from html.parser import HTMLParser
from operator import or_
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.urls import DOCUMENT_PATHS, PDF_MARKS, PDF_WORDS, host

# Words in a class that tell a content area; addresses that aren't converted; hosts with lenient rules.
CONTENT_WORDS = ["content", "article", "main", "body", "text", "detail", "document", "kamerstuk"]
SKIPPED = ["login", "search", "contact", "404", "error", "not found"]
LENIENT_HOSTS = ["overheid.nl", "rijksoverheid.nl", "tweedekamer.nl", "europa.eu"]
# Hosts whose buttons are known, their classes; words of links that may lead to a document.
BUTTON_HOSTS = ["rijksoverheid.nl", "overheid.nl"]
BUTTON_CLASSES = ["download-button", "document-download", "download"]
LEADING_WORDS = ["document", "pdf", "download", "view", "rapport", "report", "paper"]
LEADING_MARKS = ["doc", "pdf", "download", "view", "rapport", "report"]

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Elements in page order: tags, attributes, and where each one's descendants and texts end. An element's descendants follow it."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attributes: list[dict] = []
        self.texts: list[str] = []
        self.first_text: list[int] = []
        self.ends: dict[int, tuple[int, int]] = {}
        self.open: list[int] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.attributes.append(dict(attrs))
        self.first_text.append(len(self.texts))
        if tag in _VOID:
            self.ends[at] = (at + 1, len(self.texts))
        else:
            self.open.append(at)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[depth]] == tag:
                for at in self.open[depth:]:
                    self.ends[at] = (len(self.tags), len(self.texts))
                del self.open[depth:]
                break

    def handle_data(self, data: str) -> None:
        if self.open:
            self.texts.append(data)

    def _end(self, at: int) -> tuple[int, int]:
        return self.ends.get(at, (len(self.tags), len(self.texts)))

    def named(self, *tags: str) -> list[int]:
        return [at for at, tag in enumerate(self.tags) if tag in tags]

    def inside(self, at: int, tags: tuple[str, ...]) -> list[int]:
        return [k for k in range(at + 1, self._end(at)[0]) if self.tags[k] in tags]

    def whole_text(self, at: int) -> str:
        return "".join(self.texts[self.first_text[at] : self._end(at)[1]])

    def text(self, at: int) -> str:
        """Without the white space around each of its parts."""
        return "".join(x.strip() for x in self.texts[self.first_text[at] : self._end(at)[1]])


def _links(html: str | None, url: str | None) -> list[dict]:
    if not html:
        return []
    page = _Page(html)
    return [{"href": urljoin(url or "", page.attributes[i]["href"] or ""), "text": page.whole_text(i).strip()} for i in page.named("a") if "href" in page.attributes[i]]


def links(html: Column, url: Column) -> Column:
    """array<struct<href, text>> of a page's links, from its address, in page order."""

    @F.pandas_udf("array<struct<href: string, text: string>>")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_links(x, y) for x, y in zip(h, u, strict=True)])

    return run(html, url)


def _likely(url: str, text: str) -> bool:
    low, words = url.lower(), text.lower()
    return low.endswith(".pdf") or any(t in low for t in PDF_MARKS) or any(t in words for t in PDF_WORDS) or any(t in low for t in DOCUMENT_PATHS)


def _first_pdf(html: str | None, url: str | None) -> str | None:
    """The first likely link, by kinds of evidence in turn: its ending, class, title, label, text, an icon in it, its data; on sites
    of the government the classes of their buttons too, and then the file that a viewer shows."""
    if not html:
        return None
    page = _Page(html)
    has = lambda value, words: any(w in (value or "").lower() for w in words)
    kinds = [
        lambda i, a: (a.get("href") or "").lower().endswith(".pdf"),
        lambda i, a: has(a.get("class"), ("download", "btn-download", "pdf")),
        lambda i, a: has(a.get("title"), ("download", "pdf")),
        lambda i, a: has(a.get("aria-label"), ("download", "pdf")),
        lambda i, a: has(page.text(i), ("download", "pdf", "document")),
        lambda i, a: any(has(page.attributes[k].get("class"), ("pdf", "file", "document")) for k in page.inside(i, ("i",))),
        lambda i, a: a.get("data-format") == "pdf",
        lambda i, a: a.get("data-filetype") == "pdf",
    ]
    site = any(x in url_host(url) for x in BUTTON_HOSTS)
    if site:
        kinds.append(lambda i, a: has(a.get("class"), BUTTON_CLASSES) or a.get("data-decorator") == "download")
    anchors = [(i, page.attributes[i]) for i in page.named("a") if page.attributes[i].get("href")]
    for kind in kinds:
        for i, attributes in anchors:
            if kind(i, attributes):
                whole = urljoin(url or "", attributes["href"])
                if _likely(whole, page.whole_text(i)):
                    return whole
    viewer = next((page.attributes[i] for i in page.named("div") if "document-viewer" in (page.attributes[i].get("class") or "").split()), None) if site else None
    try:
        shown = json.loads(viewer["data-json"])["document"]["pdf"] if viewer else None
    except (KeyError, TypeError, ValueError):  # a viewer without a file, or with other data
        shown = None
    return urljoin(url or "", shown) if isinstance(shown, str) else None


def url_host(url: str | None) -> str:
    return (urlsplit(url or "").hostname or "").removeprefix("www.")


def candidate_links(links: Column, url: Column, n: int = 3) -> Column:
    """The addresses of the first n links (of links()) that may lead to a document, in page order: by words of their text or address, on
    the page's own host, each once. links() has resolved addresses, so a link within the page is told by its mark."""
    low, words = lambda x: F.lower(x["href"]), lambda x: F.lower(x["text"])
    any_of = lambda c, terms: reduce(or_, (F.contains(c, F.lit(t)) for t in terms))
    own = F.regexp_replace(url, "#.*$", "")
    fits = lambda x: (any_of(words(x), LEADING_WORDS) | any_of(low(x), LEADING_MARKS)) & ~any_of(low(x), ("login", "account", "javascript:")) & ~F.startswith(x["href"], F.concat(own, F.lit("#"))) & (host(x["href"]) == host(url))
    return F.slice(F.array_distinct(F.transform(F.filter(links, fits), lambda x: x["href"])), 1, n)


def first_pdf(html: Column, url: Column) -> Column:
    @F.pandas_udf("string")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_first_pdf(x, y) for x, y in zip(h, u, strict=True)])

    return run(html, url)


def _area(html: str | None) -> dict:
    empty = {"length": 0, "paragraphs": 0, "headings": False, "lists": False, "tables": False, "links": False, "found": False, "downloads": False}
    if not html:
        return empty
    page = _Page(html)
    areas = [i for i in page.named("article", "main", "div") if any(w in (page.attributes[i].get("class") or "").lower() for w in CONTENT_WORDS)]
    if not areas:
        return empty
    main = max(areas, key=lambda i: len(page.text(i)))
    buttons = (page.attributes[i] for i in page.named("a"))
    return {
        "length": len(page.text(main)), "paragraphs": sum(len(page.whole_text(k).split()) >= 10 for k in page.inside(main, ("p", "div", "section"))),
        "headings": bool(page.inside(main, ("h1", "h2", "h3", "h4", "h5", "h6"))), "lists": bool(page.inside(main, ("ul", "ol"))), "tables": bool(page.inside(main, ("table",))),
        "links": any("href" in page.attributes[k] for k in page.inside(main, ("a",))), "found": True,
        "downloads": any("m-button" in (a.get("class") or "").split() and "downloads/document" in (a.get("href") or "") for a in buttons),
    }


def content_area(html: Column) -> Column:
    """What the longest content area of a page holds."""

    @F.pandas_udf("struct<length: int, paragraphs: int, headings: boolean, lists: boolean, tables: boolean, links: boolean, found: boolean, downloads: boolean>")
    def run(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_area(x) for x in h], columns=["length", "paragraphs", "headings", "lists", "tables", "links", "found", "downloads"])

    return run(html)


def worth_converting(area: Column, url: Column) -> Column:
    low = F.lower(url)
    skipped, lenient = F.lit(False), F.lit(False)
    for w in SKIPPED:
        skipped = skipped | F.contains(low, F.lit(w))
    for w in LENIENT_HOSTS:
        lenient = lenient | F.contains(low, F.lit(w))
    structure = area["headings"] | area["lists"] | area["tables"] | area["links"]
    strict = (area["length"] >= 200) & (area["paragraphs"] >= 1) & structure
    return ~skipped & area["found"] & F.when(lenient, (area["length"] >= 100) | structure | area["downloads"]).otherwise(strict)


def _tables(html: str | None, url: str | None) -> list[dict]:
    if not html:
        return []
    page = _Page(html)
    out = []
    for t, table in enumerate(page.named("table")):
        for r, row in enumerate(page.inside(table, ("tr",))):
            links = [page.attributes[k].get("href") for k in page.inside(row, ("a",))]
            out.append({"table": t, "row": r, "cells": [" ".join(page.whole_text(c).split()) for c in page.inside(row, ("td",))], "link": urljoin(url or "", links[0]) if links and links[0] else None})
    return out


def table_rows(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page columns, table, row, cells, link: rows of the tables of a page, headers and rows of under three cells apart."""

    @F.pandas_udf("array<struct<table: int, row: int, cells: array<string>, link: string>>")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_tables(x, y) for x, y in zip(h, u, strict=True)])

    rows = pages.withColumn("_t", F.explode(run(F.col(html), F.col(url))))
    return rows.select(*[c for c in pages.columns if c != html], "_t.*").where(F.size("cells") >= 3)


def document_rows(rows: DataFrame) -> DataFrame:
    """number, name, link, date and type of rows of a table of documents."""
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    return rows.select("url", cell(1).alias("number"), cell(2).alias("name"), "link", cell(3).alias("date"), cell(4).alias("type"))


def key_values(rows: DataFrame, key: str, name: Column, value: Column) -> DataFrame:
    """A map of a two-column table for each key."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(name.alias("k"), value.alias("v"))))).alias("meta"))


def failures_by_host(links: DataFrame, url: str = "url") -> DataFrame:
    return links.groupBy(host(F.col(url)).alias("host")).agg(F.count("*").alias("failures"))


def outcomes(links: DataFrame) -> DataFrame:
    return links.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("successful", "failed", "skipped", "excluded")])


def first_success(links: DataFrame, key: str) -> DataFrame:
    """The first link of a row, in order, that could be fetched."""
    return links.where("ok").groupBy(key).agg(F.min_by("link", "pos").alias("link"))


def failed_links(links: DataFrame) -> DataFrame:
    """The rows of the file of failures: url and error, each url once, the first error by its text."""
    return links.where("outcome = 'failed'").groupBy("url").agg(F.min("error").alias("error"))


# Marks of the two links of a decision that aren't in its tables, and what their rows say.
DECISION_LINKS = {"download-inventory-file-link": ("inv", "inventarislijst", "xlsx", "inventory", "INV"), "main-document-detail-link": ("brief", "besluitbrief", "pdf", "besluitbrief", "BRIEF")}
_DECISION_ROW = "struct<document_id: string, document_name: string, document_url: string, document_type: string, inventory_number: string>"


def decision_links(html: Column, url: Column, decision: Column) -> Column:
    """array of rows for the inventory and the letter of a decision, as far as its page links them. The letter's link leads to its
    page, which is fetched elsewhere."""

    @F.pandas_udf(f"array<{_DECISION_ROW}>")
    def run(h: pd.Series, u: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_decision_links(x, y, z) for x, y, z in zip(h, u, d, strict=True)])

    return run(html, url, decision)


def _decision_links(html: str | None, url: str | None, decision: str | None) -> list[dict]:
    if not html:
        return []
    page, out = _Page(html), []
    for mark, (ending, name, kind, type_, number) in DECISION_LINKS.items():
        at = next((page.attributes[i] for i in page.named("a") if page.attributes[i].get("data-e2e-name") == mark), None)
        if at and "href" in at:
            out.append({"document_id": f"{decision}-{ending}", "document_name": f"{name}_{decision}.{kind}", "document_url": urljoin(url or "", at["href"] or ""), "document_type": type_, "inventory_number": number})
    return out
