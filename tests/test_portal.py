"""Pages of a portal: what counts as a mark, a hit, a section, a row and a fact, and what doesn't."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import portal


@pytest.mark.parametrize(("html", "pages"), [
    ('<a data-e2e-name="page-number-7" href="?page=1">7</a><a href="?page=99">x</a>', 7), ("<a data-e2e-name='page-number-12'>12</a><a data-e2e-name='page-number-3'>3</a>", 12),
    ('<a href="x" class="y" data-e2e-name = "page-number-next-4">4</a>', 4), ('<a data-e2e-name="page-number-next">n</a>', 1), ('<span data-e2e-name="page-number-9">9</span>', 1), ("?page=5", 1), ("", 1), (None, 1),
])
def test_result_pages(spark, html, pages):
    assert spark.createDataFrame([(html,)], "h string").select(portal.result_pages(F.col("h"))).first()[0] == pages


def hit(inner, name="search-result", kind="woo-search-result"):
    return f'<li class="{kind}" data-e2e-name="{name}">{inner}</li>'


def test_hits(spark):
    link, count = '<a data-e2e-name="main-link" href="/d/b7"> A <i>title</i> </a>', '<ul><li data-e2e-name="nr-of-documents">Aantal: 12 van 30</li></ul>'
    html = hit(link + count) + hit(link) + hit(count) + hit(link + count, name="x") + hit(link + count, kind="y") + hit(link.replace("/d/b7", "https://b.org/c8") + count.replace("12 van 30", "geen"), kind="a woo-search-result")
    rows = spark.createDataFrame([(html, "https://a.org/q?x=1"), (None, None), ("", "u")], "h string, u string").select(portal.hits(F.col("h"), F.col("u")).alias("r")).collect()
    assert [tuple(r) for r in rows[0]["r"]] == [("b7", "Atitle", "https://a.org/d/b7", 12), ("c8", "Atitle", "https://b.org/c8", 0)]
    assert rows[1]["r"] == rows[2]["r"] == []


def rows_of(*numbers):
    return '<table class="woo-table"><tr><th>n</th><td>1</td><td>2</td><td>3</td></tr>' + "".join(f'<tr><td>{n}</td><td></td><td><a class="woo-a" href="/{n}">D{n}</a></td></tr>' for n in numbers) + "</table>"


KIND = "decision string, page int, status string, html string, url string"


def placed(spark, pages):
    found = portal.section_rows(spark.createDataFrame(pages, KIND))
    return sorted((r["decision"], r["status"], r["place"], r["number"]) for r in found.collect())


def test_sections_over_pages(spark):
    """The first table under each heading; a facts table and a table of another heading don't count; pages out of order."""
    first = "<h2>Over dit besluit</h2>" + rows_of(0) + "<h2>Reeds openbaar</h2>" + rows_of(7) + rows_of(8) + "<h2>1. (Deels) openbaar gemaakt</h2>" + rows_of(1, 2) + "<h2>x</h2>" + rows_of(9)
    pages = [("d", 3, "deels_openbaar", rows_of(5), "u"), ("d", 1, None, first, "u"), ("d", 2, "deels_openbaar", rows_of(3, 4) + rows_of(99), "u"), ("d", 2, "reeds_openbaar", rows_of(), "u"), ("e", 1, None, None, None)]
    assert placed(spark, pages) == sorted([("d", "deels_openbaar", k, str(k)) for k in range(1, 6)] + [("d", "reeds_openbaar", 1, "7")])


def test_without_headings_of_sections(spark):
    facts = "<h2>Over dit besluit</h2>" + rows_of(0)
    assert placed(spark, [("d", 1, None, facts + "<h2>Documenten</h2>" + rows_of(1, 2) + rows_of(3), "u")]) == [("d", "deels_openbaar", 1, "1"), ("d", "deels_openbaar", 2, "2")]
    assert placed(spark, [("d", 1, None, rows_of(1), "u")]) == [("d", "deels_openbaar", 1, "1")]
    assert placed(spark, [("d", 1, None, facts, "u"), ("e", 1, None, "<p>none</p>", "u")]) == []
    assert placed(spark, []) == []


def test_rows_and_facts(spark):
    row = '<table class="woo-table big"><tr><td> 3 </td><td><svg><use xlink:href="/s.svg#pdf"></use></svg></td><td><a href="/x">x</a> <a class="b woo-a" href="d/3">A &amp; B</a></td><td><time datetime="2020-05-06">6 mei</time></td></tr></table>'
    (got,) = portal.section_rows(spark.createDataFrame([("d", 1, None, row, "https://a.org/p/q")], KIND)).collect()
    assert tuple(got) == ("d", "deels_openbaar", 1, "3", "A & B", "https://a.org/p/d/3", "2020-05-06", "pdf")
    facts = '<h2>Over dit besluit</h2><table class="woo-table"><tr><th>Type besluit</th><td> Deels </td></tr><tr><th>Datum besluit</th><td>onbekend</td></tr><tr><th>Omvang openbaarmaking</th><td>3 pagina</td></tr><tr><td>Periode</td></tr></table>'
    rows = spark.createDataFrame([(facts,), ("<h2>x</h2>" + row,), (None,)], "h string").select(portal.decision_facts(F.col("h")).alias("f")).collect()
    assert tuple(rows[0]["f"]) == (None, "Deels", None, None, None, None, None, 3) and rows[1]["f"] is None and rows[2]["f"] is None
