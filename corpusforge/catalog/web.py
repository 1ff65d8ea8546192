"""Web pages and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.catalog import query
from corpusforge.functions import pages as P
from corpusforge.functions import portal as R
from corpusforge.functions import urls as U
from corpusforge.sources.tables import table

_HOST = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"


def _any(expression: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expression}, '{t}')" for t in terms) + ")"


@query("url_domain", f"SELECT page_id, {_HOST} AS host FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query("url_excluded", "SELECT page_id, " + _any(_HOST, U.EXCLUDED_HOSTS) + " AS excluded, " + _any(_HOST.replace("(url,", "('https://www.youtube.com/' || page_id,"), U.EXCLUDED_HOSTS) + " AS video FROM pages")
def url_excluded(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_excluded(F.col("url")).alias("excluded"), U.is_excluded(F.concat(F.lit("https://www.youtube.com/"), "page_id")).alias("video"))


_LINK = "CASE page_id % 5 WHEN 0 THEN url || '/x.PDF' WHEN 1 THEN url || '&format=pdf' WHEN 2 THEN 'https://a.org/reports/' || page_id ELSE url END"
_TEXT = "CASE WHEN page_id % 7 = 0 THEN 'Download document' ELSE 'more' END"


def _link():
    m = F.col("page_id") % 5
    return F.when(m == 0, F.concat("url", F.lit("/x.PDF"))).when(m == 1, F.concat("url", F.lit("&format=pdf"))).when(m == 2, F.concat(F.lit("https://a.org/reports/"), "page_id")).otherwise(F.col("url"))


@query("url_pdf_likely", f"WITH l AS (SELECT page_id, lower({_LINK}) AS u, lower({_TEXT}) AS t FROM pages) SELECT page_id, ends_with(u, '.pdf') OR {_any('u', U.PDF_MARKS)} OR {_any('t', U.PDF_WORDS)} OR {_any('u', U.DOCUMENT_PATHS)} AS likely FROM l")
def url_pdf_likely(spark, d):
    text = F.when(F.col("page_id") % 7 == 0, "Download document").otherwise("more")
    return table(spark, d, "pages").select("page_id", U.likely_pdf(_link(), text).alias("likely"))


_TYPES = "[" + ", ".join(f"'{t}'" for t, _ in U.CONTENT_TYPES) + ", 'unknown']"
_CASE = "CASE " + " ".join(f"WHEN contains(ct, '{t}') THEN '{e}'" for t, e in U.CONTENT_TYPES) + " WHEN contains(u, '.') AND length(regexp_extract(u, '([^.]*)$', 1)) < 6 THEN lower(regexp_extract(u, '([^.]*)$', 1)) ELSE 'pdf' END"


@query("content_type_extension", f"WITH l AS (SELECT page_id, ({_TYPES})[page_id % {len(U.CONTENT_TYPES) + 1} + 1] || '; charset=utf-8' AS ct, CASE WHEN page_id % 2 = 0 THEN 'https://a.org/f.DOCX' ELSE url END AS u FROM pages) SELECT page_id, {_CASE} AS extension FROM l")
def content_type_extension(spark, d):
    kinds = F.array(*[F.lit(t) for t, _ in U.CONTENT_TYPES], F.lit("unknown"))
    kind = F.concat(F.element_at(kinds, (F.col("page_id") % (len(U.CONTENT_TYPES) + 1) + 1).cast("int")), F.lit("; charset=utf-8"))
    url = F.when(F.col("page_id") % 2 == 0, "https://a.org/f.DOCX").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.extension(kind, url).alias("extension"))


@query("failures_by_domain", f"SELECT {_HOST} AS host, count(*) AS failures FROM pages GROUP BY 1")
def failures_by_domain(spark, d):
    return P.failures_by_host(table(spark, d, "pages"))


@query("link_outcomes", "SELECT count(*) FILTER (page_id % 4 = 0) AS successful, count(*) FILTER (page_id % 4 = 1) AS failed, count(*) FILTER (page_id % 4 = 2) AS skipped, count(*) FILTER (page_id % 4 = 3) AS excluded FROM pages")
def link_outcomes(spark, d):
    names = F.array(*[F.lit(x) for x in ("successful", "failed", "skipped", "excluded")])
    return P.outcomes(table(spark, d, "pages").select(F.element_at(names, (F.col("page_id") % 4 + 1).cast("int")).alias("outcome")))


@query("split_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN [url, 'b' || page_id] WHEN 1 THEN [url] WHEN 2 THEN ['x', url, 'y'] ELSE [] END AS links FROM pages")
def split_links(spark, d):
    m = F.col("page_id") % 4
    field = F.when(m == 0, F.concat("url", F.lit("%20 |\n ; b"), "page_id")).when(m == 1, F.concat(F.lit("  "), "url", F.lit(" "))).when(m == 2, F.concat(F.lit("x;"), "url", F.lit("\ny"))).otherwise(F.lit(" | ; "))
    return table(spark, d, "pages").select("page_id", U.split_links(field).alias("links"))


@query("first_success", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'b' END AS link FROM pages")
def first_success(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.array("url", F.lit("b"), F.lit("c"))).alias("pos", "link"))
    return P.first_success(rows.withColumn("ok", (F.col("pos") > 0) | (F.col("page_id") % 3 == 0)), "page_id")


@query("numbers_in_text", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN CAST(page_id AS INTEGER) END AS number, CASE page_id % 3 WHEN 0 THEN (page_id % 10) || '.5 MB' WHEN 1 THEN page_id || ' KB' END AS size, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 90 + 1 AS INTEGER) END AS page_count FROM pages")
def numbers_in_text(spark, d):
    m, i = F.col("page_id") % 3, F.col("page_id")
    t = F.when(m == 0, F.concat(F.lit("Besluit "), i, F.lit(" ("), i % 10, F.lit(".5 MB, "), i % 90 + 1, F.lit(" pagina's)"))).when(m == 1, F.concat(F.lit("bijlage: "), i, F.lit(" KB"))).otherwise(F.lit("zonder getal"))
    return table(spark, d, "pages").select("page_id", U.first_number(t).alias("number"), U.file_size(t).alias("size"), U.page_count(t).alias("page_count"))


@query("page_links", r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, list_transform(h, lambda x: base || x) AS links FROM l""")
def page_links(spark, d):
    found = P.links(F.col("html"), F.col("url"))
    return table(spark, d, "pages").select("page_id", F.transform(found, lambda x: x["href"]).alias("links"))


_PDF = "'https://a.overheid.nl/reports/' || page_id"


@query("page_first_pdf", f"SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://a.overheid.nl/files/' || page_id || '.pdf' WHEN 7 THEN 'https://a.overheid.nl/v/' || page_id WHEN 6 THEN NULL ELSE {_PDF} END AS pdf FROM pages")
def page_first_pdf(spark, d):
    """Pages with another kind of evidence each: ending, class, title, label, icon, button of the site, none, viewer."""
    at = F.concat(F.lit("/reports/"), "page_id")
    marks = ['class="btn-download"', 'title="Download it"', 'aria-label="als pdf"', None, 'data-decorator="download"']
    links = [F.concat(F.lit('<a href="/files/'), "page_id", F.lit('.pdf">x</a>'))]
    links += [F.concat(F.lit(f"<a {m} href=\""), at, F.lit('">x</a>')) if m else F.concat(F.lit('<a href="'), at, F.lit('"><i class="icon-file"></i>x</a>')) for m in marks]
    links += [F.lit("<a>none</a>"), F.concat(F.lit("<div class=\"document-viewer\" data-json='{\"document\": {\"pdf\": \"/v/"), "page_id", F.lit("\"}}'></div>"))]
    body = F.element_at(F.array(*links), (F.col("page_id") % 8 + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit('<p><a href="/home">home</a>'), body, F.lit("</p>")).alias("html"))
    return rows.select("page_id", P.first_pdf(F.col("html"), F.lit("https://a.overheid.nl/x")).alias("pdf"))


@query("page_candidate_links", "SELECT page_id, list_slice(list_filter(['https://a.org/rapport/' || page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a.org/p/' || page_id END, 'https://a.org/view/1', 'https://a.org/doc/2'], lambda x: x IS NOT NULL), 1, 3) AS links FROM pages")
def page_candidate_links(spark, d):
    i = F.col("page_id")
    html = F.concat(F.lit('<a href="#doc">document</a><a href="/login/doc">x</a><a href="https://b.org/doc">x</a><a href="/rapport/'), i, F.lit('">x</a><a href="/p/'), i, F.lit('">'), F.when(i % 2 == 0, "Het Document").otherwise("meer"), F.lit('</a><a href="/view/1">x</a><a href="/rapport/'), i, F.lit('">y</a><a href="/doc/2">z</a>'))
    rows = table(spark, d, "pages").select("page_id", P.links(html, F.lit("https://a.org/x")).alias("l"))
    return rows.select("page_id", P.candidate_links(F.col("l"), F.lit("https://a.org/x")).alias("links"))


@query("failed_links_file", "SELECT url, min('status ' || (page_id % 5 + 400)) AS error FROM pages WHERE page_id % 4 = 1 GROUP BY url")
def failed_links_file(spark, d):
    """The file of failed links, written and read again."""
    from corpusforge.catalog.corpus import _folder
    from corpusforge.sources import writers

    outcome = F.element_at(F.array(*[F.lit(x) for x in ("successful", "failed", "skipped", "excluded")]), (F.col("page_id") % 4 + 1).cast("int"))
    at, rows = _folder(spark, "failed"), table(spark, d, "pages").select("url", outcome.alias("outcome"), F.concat(F.lit("status "), F.col("page_id") % 5 + 400).alias("error"))
    writers.metadata(P.failed_links(rows), at)
    return spark.read.schema("url string, error string").csv(at, header=True, escape='"')


@query("page_valid")
def page_valid(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", P.content_area(F.replace("html", F.lit("<article>"), F.lit('<article class="content">'))).alias("a"))
    return rows.select("page_id", P.worth_converting(F.col("a"), F.col("url")).alias("valid"))


def _decision(spark, d):
    rows = F.concat(
        F.lit("<table><tr><th>n</th></tr><tr><td>1</td><td>Doc "), "page_id", F.lit('</td><td><a href="/d/'), "page_id", F.lit('">x</a></td><td>brief</td></tr><tr><td>short</td></tr><tr><td>2</td><td>B</td><td>2020-01-01</td></tr></table>'),
    )
    return table(spark, d, "pages").select("page_id", F.lit("https://a.org/b").alias("url"), rows.alias("html"))


@query("page_table_rows", "SELECT page_id, 0 AS \"table\", 1 AS \"row\", ['1', 'Doc ' || page_id, 'x', 'brief'] AS cells, 'https://a.org/d/' || page_id AS link FROM pages UNION ALL SELECT page_id, 0, 3, ['2', 'B', '2020-01-01'], NULL FROM pages")
def page_table_rows(spark, d):
    return P.table_rows(_decision(spark, d)).drop("url")


@query("page_key_values", "SELECT page_id, 'https://a.org/b' AS url, ['Naam ' || page_id, CASE WHEN page_id % 2 = 0 THEN 'brief' ELSE 'nota' END] AS v FROM pages")
def page_key_values(spark, d):
    """A table of names and values, as a map of each page; the rows' order doesn't count."""
    kind = F.when(F.col("page_id") % 2 == 0, "brief").otherwise("nota")
    html = F.concat(F.lit("<table><tr><td>1</td><td>Soort</td><td>"), kind, F.lit("</td></tr><tr><td>2</td><td>Naam</td><td> Naam\n "), "page_id", F.lit("</td></tr><tr><td>kop</td></tr></table>"))
    rows = P.table_rows(table(spark, d, "pages").select("page_id", F.lit("https://a.org/b").alias("url"), html.alias("html"))).withColumn("key", F.struct("page_id", "url"))
    made = P.key_values(rows, "key", F.col("cells")[1], F.col("cells")[2])
    return made.select("key.page_id", "key.url", F.array(F.element_at("meta", "Naam"), F.element_at("meta", "Soort")).alias("v"))


@query("page_document_rows", "SELECT page_id, '1' AS number, 'Doc ' || page_id AS name FROM pages UNION ALL SELECT page_id, '2', 'B' FROM pages")
def page_document_rows(spark, d):
    rows = P.document_rows(P.table_rows(_decision(spark, d).withColumn("url", F.col("page_id").cast("string"))))
    return rows.select(F.col("url").cast("long").alias("page_id"), "number", "name")


@query("decision_links", """WITH r AS (SELECT page_id, unnest([1, 2]) AS k FROM pages) SELECT page_id, CASE k WHEN 1 THEN page_id || '-inv' ELSE page_id || '-brief' END AS document_id, CASE k WHEN 1 THEN 'inventarislijst_' || page_id || '.xlsx' ELSE 'besluitbrief_' || page_id || '.pdf' END AS document_name, CASE k WHEN 1 THEN 'https://a.org/inv/' || page_id ELSE 'https://a.org/b/' || page_id END AS document_url, CASE k WHEN 1 THEN 'INV' ELSE 'BRIEF' END AS inventory_number FROM r WHERE (k = 1 AND page_id % 3 <> 0) OR (k = 2 AND page_id % 2 = 0)""")
def decision_links(spark, d):
    i = F.col("page_id")
    inventory = F.when(i % 3 != 0, F.concat(F.lit('<a data-e2e-name="download-inventory-file-link" href="/inv/'), i, F.lit('">x</a>'))).otherwise('<a href="/inv/0">x</a>')
    letter = F.when(i % 2 == 0, F.concat(F.lit('<a href="/b/'), i, F.lit('" data-e2e-name="main-document-detail-link">y</a>'))).otherwise("")
    rows = table(spark, d, "pages").select("page_id", F.explode(P.decision_links(F.concat(letter, inventory), F.lit("https://a.org/z"), i.cast("string"))).alias("r"))
    return rows.select("page_id", "r.document_id", "r.document_name", "r.document_url", "r.inventory_number")


_SEARCH = """s AS (SELECT page_id, '<ul><li class="woo-search-result" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/besluit/b' || page_id || '"> Besluit <b>over</b> ' || page_id
    || '</a><ul><li data-e2e-name="nr-of-documents">' || CASE page_id % 3 WHEN 0 THEN page_id || ' documenten' WHEN 1 THEN 'geen' ELSE '' END || '</li></ul></li>'
    || '<li class="woo-search-result" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/besluit/none">without documents</a></li>'
    || '<li class="other" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/x">x</a><i data-e2e-name="nr-of-documents">3</i></li></ul>'
    || '<a href="?page=99">99</a><a data-e2e-name="page-number-2" href="?page=2">2</a><span data-e2e-name="page-number-77">77</span>'
    || CASE WHEN page_id % 2 = 0 THEN '<a class="p" data-e2e-name="page-number-' || (page_id % 40 + 3) || '" href="?page=5">last</a>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '' ELSE '<p>' || url || '</p>' END AS html FROM pages)"""


def _search(spark, d):
    """Pages of results: a hit, hits that aren't any, page links with marks, and addresses and elements that only look like them."""
    i = F.col("page_id")
    count = F.when(i % 3 == 0, F.concat(i, F.lit(" documenten"))).when(i % 3 == 1, "geen").otherwise("")
    last = F.when(i % 2 == 0, F.concat(F.lit('<a class="p" data-e2e-name="page-number-'), i % 40 + 3, F.lit('" href="?page=5">last</a>'))).otherwise("")
    html = F.concat(
        F.lit('<ul><li class="woo-search-result" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/besluit/b'), i, F.lit('"> Besluit <b>over</b> '), i,
        F.lit('</a><ul><li data-e2e-name="nr-of-documents">'), count, F.lit("</li></ul></li>"),
        F.lit('<li class="woo-search-result" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/besluit/none">without documents</a></li>'),
        F.lit('<li class="other" data-e2e-name="search-result"><a data-e2e-name="main-link" href="/x">x</a><i data-e2e-name="nr-of-documents">3</i></li></ul>'),
        F.lit('<a href="?page=99">99</a><a data-e2e-name="page-number-2" href="?page=2">2</a><span data-e2e-name="page-number-77">77</span>'), last, F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("<p>"), "url", F.lit("</p>"))),
    )
    return table(spark, d, "pages").select("page_id", html.alias("html"))


@query("result_pages", f"""WITH {_SEARCH} SELECT page_id, CAST(list_max(list_transform(regexp_extract_all(html, '<a [^>]*data-e2e-name="page-number-([0-9]+)"', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS pages FROM s UNION ALL SELECT page_id, 1 FROM pages""")
def result_pages(spark, d):
    """Of pages of results, and of pages without a mark."""
    marked = _search(spark, d).select("page_id", R.result_pages(F.col("html")).alias("pages"))
    return marked.union(table(spark, d, "pages").select("page_id", R.result_pages(F.col("html"))))


@query("result_hits", r"SELECT page_id, 'b' || page_id AS id, 'Besluitover' || page_id AS title, 'https://a.org/besluit/b' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS INTEGER) ELSE 0 END AS documents FROM pages")
def result_hits(spark, d):
    rows = _search(spark, d).select("page_id", F.explode(R.hits(F.col("html"), F.lit("https://a.org/zoek"))).alias("h"))
    return rows.select("page_id", "h.id", "h.title", "h.url", "h.documents")


def _section_page(i, first, n, links=True):
    """A table of documents numbered first to first + n - 1, after a header row, a short row and one without a link."""
    number = lambda k: F.concat(k.cast("string"))
    row = lambda k: F.concat(F.lit('<tr><td> '), number(k), F.lit('</td><td><svg><use xlink:href="/i.svg#'), F.when(k % 2 == 0, "pdf").otherwise("email"), F.lit('"/></svg></td><td><a class="woo-a" href="/dossier/'), i, F.lit("/"), number(k), F.lit('">Doc '), number(k), F.lit("</a></td>"), F.when(k % 3 == 0, F.lit('<td><time datetime="2020-01-02">2 januari</time></td>')).otherwise(""), F.lit("</tr>"))
    rows = F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), row), "")
    return F.concat(F.lit('<table class="woo-table"><tr><th>Nr</th><th></th><th>Naam</th></tr><tr><td>x</td><td>short</td></tr><tr><td>9</td><td></td><td><a href="/no">no class</a></td></tr>'), rows, F.lit("</table>"))


_FACTS_TABLE = '<h2 class="woo-h2">Over dit besluit</h2><table class="woo-table"><tr><th>Soort besluit</th><td> Woo-verzoek</td></tr><tr><th>Datum besluit</th><td><time datetime="2021-03-04">4 maart</time></td></tr><tr><th>Onderwerp</th><td><a>Een</a>, <a> Twee</a></td></tr><tr><th>Omvang openbaarmaking</th><td><span data-e2e-name="dossier-document-count">%s documenten</span>, 12 pagina\'s</td></tr><tr><th>Anders</th><td>x</td><td>y</td><td><a class="woo-a" href="/f">f</a></td></tr></table>'


def _facts_table(i):
    before, after = _FACTS_TABLE.split("%s")
    return F.concat(F.lit(before), i, F.lit(after))


def _decisions(spark, d):
    """Every page as a decision: with two sections, the first over three pages; every fourth without headings of sections."""
    i = F.col("page_id")
    plain = F.concat(_facts_table(i), F.lit("<h2>Documenten</h2>"), _section_page(i, 1, 3))
    whole = F.concat(_facts_table(i), F.lit("<h2>(Deels) openbaar gemaakt (7)</h2><p>"), F.lit("</p>"), _section_page(i, 1, 3), F.lit("<h2>Reeds openbaar</h2>"), _section_page(i, 50, 2), F.lit("<h2>Anders</h2>"), _section_page(i, 90, 2))
    page = lambda n, status, html: F.struct(F.lit(n).alias("page"), F.lit(status).cast("string").alias("status"), html.alias("html"))
    more = F.array(page(1, None, whole), page(3, "deels_openbaar", _section_page(i, 7, 1)), page(2, "deels_openbaar", F.concat(_section_page(i, 4, 3), _section_page(i, 70, 1))))
    rows = table(spark, d, "pages").select("page_id", F.explode(F.when(i % 4 == 0, F.array(page(1, None, plain))).otherwise(more)).alias("p"))
    return rows.select(i.alias("decision"), "p.page", "p.status", "p.html", F.lit("https://a.org/x").alias("url"))


@query("section_documents", """WITH r AS (SELECT page_id, 'deels_openbaar' AS status, unnest(range(1, CASE WHEN page_id % 4 = 0 THEN 4 ELSE 8 END)) AS k, 0 AS base FROM pages UNION ALL SELECT page_id, 'reeds_openbaar', unnest([50, 51]), 49 FROM pages WHERE page_id % 4 <> 0)
SELECT page_id AS decision, status, CAST(k - base AS BIGINT) AS place, CAST(k AS VARCHAR) AS number, 'Doc ' || k AS name, 'https://a.org/dossier/' || page_id || '/' || k AS link, CASE WHEN k % 3 = 0 THEN '2020-01-02' END AS date, CASE WHEN k % 2 = 0 THEN 'pdf' ELSE 'email' END AS type FROM r""")
def section_documents(spark, d):
    return R.section_rows(_decisions(spark, d))


@query("decision_facts", "SELECT page_id AS decision, 'Woo-verzoek' AS kind, '2021-03-04' AS date, ['Een', 'Twee'] AS subjects, CAST(page_id AS INTEGER) AS documents, 12 AS pages, CAST(NULL AS VARCHAR) AS period FROM pages")
def decision_facts(spark, d):
    rows = _decisions(spark, d).where("page = 1").select("decision", R.decision_facts(F.col("html")).alias("f"))
    return rows.select("decision", "f.kind", "f.date", "f.subjects", "f.documents", "f.pages", "f.period")
