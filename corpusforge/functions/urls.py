"""Web addresses: hosts, kinds of links, file extensions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that hold no documents.
EXCLUDED_HOSTS = [
    "facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com",
    "snapchat.com", "whatsapp.com", "telegram.org", "t.me", "google.com", "google.nl", "bing.com", "yahoo.com", "duckduckgo.com", "baidu.com", "yandex.com",
    "spotify.com", "apple.com", "amazon.com", "netflix.com", "microsoft.com", "office.com", "live.com", "outlook.com", "npostart.nl", "geenstijl.nl", "nporadio1.nl",
]
# Content types, in the order in which they are looked for, and their extensions.
CONTENT_TYPES = [
    ("application/pdf", "pdf"), ("application/msword", "doc"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ("application/vnd.ms-excel", "xls"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"), ("application/vnd.ms-powerpoint", "ppt"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"), ("text/plain", "txt"), ("text/csv", "csv"), ("application/json", "json"),
    ("application/xml", "xml"), ("text/xml", "xml"), ("image/jpeg", "jpg"), ("image/png", "png"), ("image/gif", "gif"), ("image/tiff", "tiff"),
    ("application/zip", "zip"), ("application/x-rar-compressed", "rar"), ("application/gzip", "gz"),
]
# What in an address, or in a link's text, tells a PDF; and paths where documents lie.
PDF_MARKS = ["/pdf/", "pdf=", "format=pdf", "type=pdf", "download=pdf"]
PDF_WORDS = ["pdf", "download document", "download report"]
DOCUMENT_PATHS = ["/documents/", "/publications/", "/reports/", "/files/"]


def host(url: Column) -> Column:
    """The authority of an address, without a leading www."""
    return F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("")), r"^www\.", "")


def _has_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def is_excluded(url: Column) -> Column:
    return _has_any(host(url), EXCLUDED_HOSTS)


def likely_pdf(url: Column, text: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".pdf") | _has_any(low, PDF_MARKS) | F.coalesce(_has_any(F.lower(text), PDF_WORDS), F.lit(False)) | _has_any(low, DOCUMENT_PATHS)


def extension(content_type: Column, url: Column) -> Column:
    """By content type; else the address's own ending if it is shorter than six signs; else pdf."""
    ending = F.lower(F.element_at(F.split(url, r"\."), -1))
    out = F.when(F.contains(url, F.lit(".")) & (F.length(ending) < 6), ending).otherwise("pdf")
    for term, name in reversed(CONTENT_TYPES):
        out = F.when(F.contains(content_type, F.lit(term)), name).otherwise(out)
    return out


def split_links(c: Column) -> Column:
    """A field of links, parted by bars, semicolons or line ends, without empty ones and %20 at their ends."""
    parts = F.transform(F.split(c, r"[|;\n]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(%20)+$", "")))
    return F.filter(parts, lambda x: x != "")


def absolute(href: Column, base: Column) -> Column:
    """A link from the page's address; only links that aren't whole go through Python."""

    @F.pandas_udf("string")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([urljoin(y, x) if x is not None and y is not None else None for x, y in zip(h, b, strict=True)])

    return F.when(href.rlike("^https?://"), href).otherwise(run(href, base))


def html_to_pdf(url: Column) -> Column:
    return F.regexp_replace(url, r"\.html$", ".pdf")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")


def file_size(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?\s*[KMG]B)", 1), F.lit(""))


def page_count(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)(\d+)\s*pagina", 1), F.lit("")).cast("int")
