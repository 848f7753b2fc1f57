"""Report rows and links from a table of stored web pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.helpers import ColumnOrName, as_col, collapse_spaces, let
from reportloom.functions.text import clean_text, nfkd

_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# All named entities, as one literal that is parsed once.
_NAMES = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})


def without_scripts(html: ColumnOrName) -> Column:
    """Markup without comments, scripts and style sheets."""
    text = F.regexp_replace(as_col(html), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def _entity(name: Column) -> Column:
    """The text of an entity; unknown names and numbers stay as they are."""
    digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
    number = digits.try_cast("int")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    named = F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), name)
    known = F.when(F.startswith(name, F.lit("#")), F.when(valid, char)).otherwise(named)
    # A blank that must not break is a blank here.
    return F.replace(F.coalesce(known, F.concat(F.lit("&"), name, F.lit(";"))), F.lit("\u00a0"), F.lit(" "))


def unescape(text: Column) -> Column:
    """Named and numeric entities as text, each decoded once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), _entity)
    parts = F.zip_with(F.split(text, _ENTITY, -1), found, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def _plain_path(path: Column) -> Column:
    """A path from the root without its "." and ".." steps."""
    none = F.array().cast("array<string>")
    steps = F.aggregate(F.split(path, "/", -1), none, lambda kept, step: (
        F.when(step == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        .when(step == ".", kept).otherwise(F.concat(kept, F.array(step)))
    ))
    ending = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(steps, "/"), ending)


def absolute_url(href: Column, base: Column) -> Column:
    """The address a link leads to from the page ``base``."""
    link = F.trim(unescape(href))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(page, "^(.*/)", 1), F.lit("")), F.lit("/"))
    path = F.regexp_extract(link, "^([^?#]*)", 1)
    rest = F.substring(link, F.length(path) + 1, F.length(link))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, page, link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("/")), F.concat(site, _plain_path(path), rest))
        .otherwise(F.concat(site, _plain_path(F.concat(folder, path)), rest))
    )


def inner_text(fragment: Column) -> Column:
    """Text of a markup fragment, its parts separated by one space."""
    return collapse_spaces(unescape(F.regexp_replace(fragment, "<[^>]*>", " ")))


def first_heading(html: Column) -> Column:
    heading = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return let(inner_text(heading), lambda h: F.when(h != "", h).otherwise(inner_text(title)))


# A paragraph ends at its end tag, the next paragraph or the end of the block.
_BLOCK = r"(?is)<(?:p|table)\b[^>]*>(.*?)(?=</p\s*>|</table\s*>|<p\b|<table\b|</article|</div|\z)"


def paragraph_text(html: Column) -> Column:
    """All paragraphs and tables, separated by an empty line."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_BLOCK), 1), inner_text)
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


def page_links(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per link: position, absolute URL, text, attachment type."""
    markup = without_scripts(html)
    anchors = F.transform(
        F.regexp_extract_all(markup, F.lit(r"(?is)(<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?)</a\s*>"), 1),
        lambda a: F.struct(
            F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
            inner_text(a).alias("link_text"),
        ),
    )
    rows = pages.select(key, F.col(url).alias("_url"), F.posexplode(anchors).alias("pos", "a"))
    href = F.col("a.href")
    absolute = absolute_url(href, F.col("_url"))
    response = F.lower("a.link_text").rlike("response|reply")
    return rows.select(
        key, "pos", absolute.alias("link_url"), F.col("a.link_text").alias("link_text"),
        F.when(response, "response").otherwise("report").alias("link_type"),
        F.lower(href).rlike(r"\.pdf$").alias("is_pdf"),
    )


def pages_to_reports(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Title, URL, paragraph text and linked attachments of every page."""
    markup = pages.withColumn("_m", without_scripts(html))
    anchors = F.filter(
        F.transform(
            F.regexp_extract_all("_m", F.lit(r"(?is)(<a\b[^>]*>.*?)</a\s*>"), 1),
            lambda a: F.struct(
                F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
                inner_text(a).alias("text"),
            ),
        ),
        lambda a: F.lower(a["href"]).rlike(r"\.pdf$"),
    )
    attachments = F.transform(anchors, lambda a, i: F.struct(
        (i + 1).alias("pos"),
        F.when(a["text"] != "", a["text"])
        .otherwise(F.concat(F.lit("PDF_"), i + 1)).alias("name"),
        F.lit(None).cast("string").alias("content"),
        a["href"].alias("path"),
        F.when(F.lower(a["text"]).rlike("response|reply"), "response")
        .otherwise("report").alias("type"),
    ))
    staged = markup.select(
        F.col(key).alias("record_id"),
        nfkd(first_heading(F.col("_m"))).alias("_title"),
        F.col(url).alias("url"),
        nfkd(paragraph_text(F.col("_m"))).alias("_body"),
        attachments.alias("pdfs"),
    )
    return staged.select(
        "record_id", clean_text("_title", normalise=False).alias("title"), "url",
        clean_text("_body", normalise=False).alias("content"), "pdfs",
    )
