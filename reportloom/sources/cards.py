"""Cards of listing pages: nested markup as a table of tags with their depth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.helpers import collapse_spaces
from reportloom.functions.text import clean_text
from reportloom.sources.pages import absolute_url, unescape, without_scripts

Element = tuple[str, str | None]  # tag and class; None stands for any class
PAGE = ["_key", "_url", "_digest"]
_NO_END = 2**31 - 1


def markup_events(pages: DataFrame, tags: list[str], html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Texts and the tags of the given names, in order; a start tag knows the place where its element ends.

    Depth is counted per name, so that other tags left open do no harm. At one depth start and end tags
    take turns. An element that is never closed ends with the page. Repeated rows give their events once.
    Pages are dealt out by digest before they are cut up, and everything after that stays in place.
    """
    once = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), without_scripts(html).alias("_m"))
    once = once.groupBy("_key", "_url", F.sha2("_m", 256).alias("_digest")).agg(F.first("_m").alias("_m"))
    pieces = F.regexp_extract_all("_m", F.lit(r"(?s)<[A-Za-z/!?][^>]*>|<|[^<]+"), 0)
    cut = once.select(*PAGE, F.posexplode(pieces).alias("pos", "piece")).withColumn(
        "tag", F.lower(F.regexp_extract("piece", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    )
    step = F.when(F.col("tag") == "", 0).when(F.col("piece").startswith("</"), -1).otherwise(1)
    text = (F.col("tag") == "") & ~F.col("piece").rlike("^<[!?/]")
    kept = cut.withColumn("step", step).filter(F.col("tag").isin(tags) | text)
    in_order = Window.partitionBy(*PAGE).orderBy("pos")
    depth = F.coalesce(*[
        F.when(F.col("tag") == t, F.sum(F.when(F.col("tag") == t, F.col("step")).otherwise(0)).over(in_order)) for t in tags
    ])
    placed = kept.withColumn("depth", depth + F.when(F.col("step") < 0, 1).otherwise(0))
    following = F.lead("pos").over(Window.partitionBy(*PAGE, "tag", "depth").orderBy("pos"))
    return placed.withColumn("end", F.when(F.col("step") == 1, F.coalesce(following, F.lit(_NO_END))))


def _attribute(name: str) -> Column:
    return F.regexp_extract("piece", rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _is(element: Element) -> Column:
    tag, wanted = element
    start = (F.col("step") == 1) & (F.col("tag") == tag)
    return start if wanted is None else start & F.array_contains(F.split(_attribute("class"), r"\s+"), wanted)


def listing_cards(
    pages: DataFrame, outer: Element = ("ul", "search__list"), card: Element = ("div", "card"), title: Element = ("h3", "card__title"),
    fields: Mapping[str, Element] | None = None, html: str = "html", url: str = "url", key: str = "page_id",
) -> DataFrame:
    """One row per card inside the first ``outer`` element of a page: key, card (from 1), title, url, record_id and the fields.

    The title is the text of the first link in the first title of the card, the URL where it leads, record_id
    the number behind "record-id-" in it (else NULL). A field is the text of the first such element of the card, NULL without
    one; an element inside another of its kind belongs to that. Cards inside cards are cards. Cards without a linked title, pages without markup or without cards give no
    rows; repeated pages give theirs once; other columns are left behind.
    """
    fields = dict(fields or {})
    elements = {"title": ("a", None), **fields}  # what texts are gathered from
    tags = sorted({e[0] for e in (outer, card, title, *elements.values())})
    ahead = Window.partitionBy(*PAGE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    col, none = F.col, F.lit(None)

    events = markup_events(pages, tags, html, url, key)
    marks = {"_outer": F.min(F.when(_is(outer), F.struct("pos", "end"))).over(Window.partitionBy(*PAGE))}
    for name, element in elements.items():
        nested = F.coalesce(F.max(F.when(_is(element), col("end"))).over(before) > col("pos"), F.lit(False))
        href = _attribute("href") if name == "title" else none.cast("string")
        usable = _is(element) & (col("piece").rlike(r"(?is)\shref\s*=") if name == "title" else ~nested)
        marks[f"_at_{name}"] = F.when(usable, F.struct("pos", "end", href.alias("href")))
    marked = events.withColumns(marks)
    # The element that a text lies in, and the one that comes next.
    marked = marked.withColumns({f"_in_{n}": F.last(f"_at_{n}", ignorenulls=True).over(before) for n in elements})
    marked = marked.withColumns({f"_next_{n}": F.last(f"_at_{n}", ignorenulls=True).over(ahead) for n in elements})
    own = col("_at_title") if title[0] == "a" else F.when(col("_next_title.pos") < col("end"), col("_next_title"))
    marked = marked.withColumn("_link", F.when(_is(title), F.struct("pos", own.alias("link"))))
    marked = marked.withColumn("_next_link", F.last("_link", ignorenulls=True).over(ahead))
    inside = (col("pos") > col("_outer.pos")) & (col("pos") < col("_outer.end"))
    linked = F.when(col("_next_link.pos") < col("end"), col("_next_link.link"))
    found = marked.withColumn("_next_title", linked)

    def part(name: str) -> Column:
        """A text with the element it lies in, or a card with its element."""
        holder, wanted = col(f"_in_{name}"), col(f"_next_{name}")
        piece = F.struct(col("pos").alias("pos"), col("piece").alias("piece"))
        owner = F.struct(col("pos").alias("pos"), wanted["href"].alias("href"))
        return F.when((col("tag") == "") & (col("pos") < holder["end"]), F.struct(
            F.lit(name).alias("field"), holder["pos"].alias("at"), piece.alias("piece"), none.cast("struct<pos:int,href:string>").alias("owner"),
        )).when(_is(card) & inside & (wanted["pos"] < col("end")), F.struct(
            F.lit(name).alias("field"), wanted["pos"].alias("at"), none.cast("struct<pos:int,piece:string>").alias("piece"), owner.alias("owner"),
        ))

    parts = found.select(*PAGE, F.explode(F.array_compact(F.array(*map(part, elements)))).alias("p")).select(*PAGE, "p.*")
    gathered = parts.groupBy(*PAGE, "field", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["piece"]), "").alias("text"),
        F.collect_list("owner").alias("owners"),
    )
    rows = gathered.select(*PAGE, "field", "text", F.explode("owners").alias("owner"))
    cards = rows.groupBy(*PAGE, col("owner.pos").alias("at")).agg(
        F.max("owner.href").alias("href"), F.count_if(col("field") == "title").alias("titles"),
        *[F.max(F.when(col("field") == n, col("text"))).alias(f"_text_{n}") for n in elements],
    ).filter("titles > 0")
    leads_to = absolute_url(col("href"), col("_url"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("at"))
    out = cards.select(
        col("_key").alias(key), number.alias("card"), collapse_spaces(clean_text(unescape(col("_text_title")))).alias("title"), leads_to.alias("url"),
        *[F.when(col(f"_text_{n}").isNotNull(), clean_text(unescape(col(f"_text_{n}")))).alias(n) for n in fields],
    )
    record = F.nullif(F.regexp_extract("url", r"record-id-(\d+)", 1), F.lit(""))
    return out.select(key, "card", "title", "url", record.alias("record_id"), *fields)
