"""Metadata and section extraction as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.constants import (
    CONCERN_ENDS, CONCERN_HEADINGS, RESPONSE_PHRASES, RESPONSE_TITLE_WORDS,
    STANDARD_CATEGORIES, WINDOW_ENDS, WINDOW_HEADINGS,
)
from reportloom.functions.helpers import (
    WS, ColumnOrName, as_col, blank, collapse_spaces, extract, let, strip,
)
from reportloom.functions.text import clean_text, match_category, nfkd

# The date layouts of a report, tried in this order.
DATE_PATTERNS = [
    r"(?i)Date of report:?\s*(\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]+\s+\d{4})",
    r"(?i)Date of report:?\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?i)DATED this (\d{1,2}(?:st|nd|rd|th)?\s+day of [A-Za-z]+\s+\d{4})",
    r"(?i)Date:?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})",
]


def _date(value: Column, *formats: str) -> Column:
    """First format that fits, else NULL (never an error)."""
    tries = [F.try_to_date(value, f) for f in formats]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def _written_date(value: Column) -> Column:
    text = F.regexp_replace(value, r"(?<=\d)(?:st|nd|rd|th)", "")
    text = collapse_spaces(F.replace(text, F.lit("day of "), F.lit("")))
    return let(text, lambda t: _date(t, "d MMMM yyyy", "d MMM yyyy"))


def extract_date(content: ColumnOrName) -> Column:
    """Report date: the first layout whose text is a valid date."""
    found = []
    for pattern in DATE_PATTERNS:
        raw = extract(content, pattern)
        found.append(_date(raw, "d/M/yyyy") if "/" in pattern else _written_date(raw))
    return F.coalesce(*found)


# Labels in front of the fields of a report, the stretch of its categories and their separators.
REFERENCE = r"Ref(?:erence)?:?\s*([-\d]+)"
DECEASED, CORONER, AREA = "Deceased name", "Coroner(?:'?s)? name", "Coroner(?:'?s)? Area"
CATEGORIES = r"(?is)Category:?\s*(.+?)(?=This report is being sent to:|\z)"
BULLETS = "[\u2022\u00b7\u22c5\u2023\u2043\u25aa\u25ab\u2013\u2014-]"


def extract_ref(content: ColumnOrName) -> Column:
    return extract(content, REFERENCE)


def _labelled(content: ColumnOrName, label: str, normalise: bool) -> Column:
    raw = extract(content, rf"{label}:?\s*([^\n]+)")
    return F.when(raw.isNotNull(), clean_text(raw, normalise))


def extract_deceased_name(content: ColumnOrName, normalise: bool = True) -> Column:
    return _labelled(content, DECEASED, normalise)


def extract_coroner_name(content: ColumnOrName, normalise: bool = True) -> Column:
    return _labelled(content, CORONER, normalise)


def extract_coroner_area(content: ColumnOrName, normalise: bool = True) -> Column:
    return _labelled(content, AREA, normalise)


def category_text(content: ColumnOrName) -> Column:
    """The text after "Category:", with every separator turned into a pipe."""
    raw = extract(content, CATEGORIES)
    text = strip(raw)
    text = F.regexp_replace(text, rf"{WS}*[,;]{WS}*", "|")
    text = F.regexp_replace(text, f"{BULLETS}{WS}*", "|")
    return F.regexp_replace(text, f"{WS}{{2,}}|\n+", "|")


def split_categories(
    text: ColumnOrName, standards: Sequence[str] = STANDARD_CATEGORIES
) -> Column:
    """Standard categories of a ``category_text``, in order, without repeats."""

    def tidy(item: Column) -> Column:
        item = clean_text(item, normalise=False)
        item = F.replace(item, F.lit("&nbsp;"), F.lit(""))
        item = F.regexp_replace(item, r"(?id)\s*This report.*$", "")
        return F.regexp_replace(item, "[|,;]", "")

    items = F.filter(F.transform(F.split(as_col(text), r"\|"), tidy), lambda i: ~blank(i))
    matched = F.transform(items, lambda i: match_category(i, standards, normalise=False))

    def first_wins(names: Column) -> Column:
        lowered = F.transform(names, F.lower)
        return let(lowered, lambda low: F.filter(
            names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1
        ))

    return F.coalesce(let(matched, first_wins), F.array().cast("array<string>"))


def extract_categories(df: DataFrame, content: str = "content", normalise: bool = True) -> DataFrame:
    """Add ``categories``; the raw text is normalised in a column of its own."""
    raw = category_text(content)
    staged = df.withColumn("_category_text", nfkd(raw) if normalise else raw)
    return staged.withColumn("categories", split_categories("_category_text")).drop("_category_text")


def _found_from(needle: str, haystack: Column, start: Column) -> Column:
    """Position of ``needle`` at or after ``start``, NULL if absent."""
    return F.nullif(F.call_function("locate", F.lit(needle), haystack, start), F.lit(0))


def extract_concerns(
    content: ColumnOrName,
    headings: Sequence[str] = CONCERN_HEADINGS,
    ends: Sequence[str] = CONCERN_ENDS,
    mode: str = "section",
    window: int | None = None,
) -> Column:
    """Concern section of a report, '' if it has none.

    ``section``: white space collapsed, cut at the earliest end phrase and after
    the last full stop. ``window``: text as it is, up to the end phrase or, if
    there is none, to its end or ``window`` characters.
    """
    raw = F.coalesce(as_col(content), F.lit(""))
    text = collapse_spaces(raw) if mode == "section" else raw

    def section(body: Column, lower: Column) -> Column:
        def after(heading: str) -> Column:
            at = F.instr(lower, heading.lower())
            return F.when(at > 0, at + len(heading))

        start = F.coalesce(*[after(h) for h in headings])
        if mode == "section":
            start = let(start, lambda s: s + F.when(F.substr(body, s, F.lit(1)) == ":", 1).otherwise(0))

        def cut(s: Column) -> Column:
            stop = F.least(*[_found_from(e.lower(), lower, s) for e in ends])
            if mode == "section":
                stop = F.coalesce(stop, F.length(body) + 1)
                found = strip(F.substr(body, s, stop - s))
                return F.regexp_replace(found, r"(?s)\.[^.]*\z", ".")
            rest = F.length(body) + 1 - s if window is None else F.lit(window)
            return strip(F.substr(body, s, F.coalesce(stop - s, rest)))

        return F.coalesce(let(start, lambda s: F.when(s.isNotNull(), cut(s))), F.lit(""))

    return let(text, lambda body: let(F.lower(body), lambda lower: section(body, lower)))


def extract_concerns_window(content: ColumnOrName, window: int | None = None) -> Column:
    return extract_concerns(content, WINDOW_HEADINGS, WINDOW_ENDS, "window", window)


def process_reports(df: DataFrame, content: str = "content", normalise: bool = True) -> DataFrame:
    """All extracted fields of every report; they replace existing columns."""
    return extract_categories(df, content, normalise).withColumns({
        "date_of_report": extract_date(content),
        "ref": extract_ref(content),
        "deceased_name": extract_deceased_name(content, normalise),
        "coroner_name": extract_coroner_name(content, normalise),
        "coroner_area": extract_coroner_area(content, normalise),
        "extracted_concerns": extract_concerns(content),
    })


# Layouts accepted when a date column holds free text.
FREE_DATE_FORMATS = [
    "yyyy-MM-dd", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "MMM d, yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss",
]


def parse_date_any(value: ColumnOrName) -> Column:
    """``dd/MM/yyyy`` first, then the other layouts without ordinals."""
    text = strip(value)
    plain = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)", "$1")
    return F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), _date(text, "d/M/yyyy")
    ).otherwise(_date(plain, *FREE_DATE_FORMATS))


def report_year(value: ColumnOrName) -> Column:
    """Year of a date column."""
    return F.year(as_col(value))


def report_year_text(value: ColumnOrName) -> Column:
    """Year of a text column holding ``dd/mm/yyyy`` anywhere."""
    return F.try_to_number(
        F.nullif(F.regexp_extract(as_col(value), r"\d{1,2}/\d{1,2}/(\d{4})", 1), F.lit("")),
        F.lit("9999"),
    ).cast("int")


_YEAR = r"(?U)\b(?:19|20)\d{2}\b"


def _year_of(text: Column) -> Column:
    return text.try_cast("int")


def backfill_year(
    df: DataFrame,
    date_columns: Sequence[str] = (),
    title: str = "title",
    content: str = "content",
    current_year: int | None = None,
) -> DataFrame:
    """Fill a missing ``year`` from other dates, the title or the content.

    The most frequent year of the content is found inside the row (at most a few
    hundred different years fit the pattern), so nothing is shuffled.
    """
    limit = current_year or date.today().year
    others = [report_year_text(F.col(c).cast("string")) for c in date_columns]
    other = F.coalesce(*others, F.lit(None)) if others else F.lit(None).cast("int")
    from_title = _year_of(extract(title, _YEAR, 0))
    full_date = extract(content, r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]((?:19|20)\d{2})\b", 1)
    in_date = _year_of(full_date)
    years = F.transform(
        F.regexp_extract_all(F.col(content), F.lit(_YEAR), 0), lambda y: y.try_cast("int")
    )

    def most_common(found: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(found),
            lambda y, i: F.struct(
                F.size(F.filter(found, lambda f: f == y)).alias("n"),
                (-i).alias("order"),
                y.alias("year"),
            ),
        )
        best = F.array_max(ranked)["year"]
        plausible = F.array_max(F.filter(found, lambda y: y <= limit))
        return F.when(best > limit, F.coalesce(plausible, best)).otherwise(best)

    in_content = let(years, most_common)
    steps = [
        (other, "other_date_column"),
        (from_title, "extracted_from_title"),
        (in_date, "date_in_content"),
        (in_content, "year_in_content"),
    ]
    staged = df.withColumns({f"_y{i}": value for i, (value, _) in enumerate(steps)})
    missing = F.col("year").isNull()
    source = F.coalesce(
        *[F.when(F.col(f"_y{i}").isNotNull(), name) for i, (_, name) in enumerate(steps)]
    )
    filled = F.coalesce(F.col("year"), *[F.col(f"_y{i}") for i in range(len(steps))])
    return staged.withColumns({
        "year_source": F.when(missing, source),
        "year": filled,
    }).drop(*[f"_y{i}" for i in range(len(steps))])


def fill_content_from_attachment(df: DataFrame) -> DataFrame:
    """Blank content takes the text of the first attachment, if it has any."""
    first = F.get(F.col("pdfs"), F.lit(0))["content"]
    use = blank("content") & ~blank(first)
    return df.withColumns({
        "content_source": F.when(use, F.lit("attachment_1")),
        "content": F.when(use, first).otherwise(F.col("content")),
    })


def concerns_missing(column: ColumnOrName = "extracted_concerns") -> Column:
    c = as_col(column)
    return blank(c) | (F.length(c) < 20)


def missing_concerns(df: DataFrame, column: str = "extracted_concerns") -> DataFrame:
    return df.filter(concerns_missing(column))


def fill_concerns_from_attachments(df: DataFrame) -> DataFrame:
    """Missing concerns come from the first attachment that states some."""
    found = F.filter(
        F.transform(
            F.col("pdfs"),
            lambda p, i: F.struct(
                (i + 1).alias("pos"), extract_concerns(p["content"]).alias("text")
            ),
        ),
        lambda c: F.length(c["text"]) > 20,
    )
    staged = df.withColumn(
        "_found", F.when(concerns_missing(), F.get(found, F.lit(0)))
    )
    return staged.withColumns({
        "extracted_concerns": F.coalesce(F.col("_found.text"), F.col("extracted_concerns")),
        "concern_source": F.when(
            F.col("_found").isNotNull(), F.concat(F.lit("attachment_"), F.col("_found.pos"))
        ),
    }).drop("_found")


def is_response(
    pdfs: ColumnOrName | None = "pdfs", title: ColumnOrName = "title", content: ColumnOrName = "content"
) -> Column:
    """True if attachments, title or content mark the row as a response."""
    heading = F.lower(F.coalesce(as_col(title), F.lit("")))
    body = F.lower(F.coalesce(as_col(content), F.lit("")))
    hit = F.lit(False)
    if pdfs is not None:
        hit = F.coalesce(
            F.exists(as_col(pdfs), lambda p: F.coalesce(
                F.lower(p["name"]).rlike("response|reply"), F.lit(False)
            ) | F.coalesce(F.lower(p["type"]) == "response", F.lit(False))),
            F.lit(False),
        )
    for word in RESPONSE_TITLE_WORDS:
        hit = hit | F.contains(heading, F.lit(word))
    return hit | body.rlike("|".join(RESPONSE_PHRASES))


# Date layouts inside a letter, tried in this order per line.
LETTER_DATES = [
    (r"(?i)Date:\s*(.*)", 1),
    (r"(?iU)\b\d{1,2}\s+\w+\s+\d{4}\b", 0),
    (r"(?iU)\b\w{3},\s+\d{1,2}\s+\w+\s+\d{4}\b", 0),
    (r"(?iU)\b\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4}\b", 0),
    (r"(?iU)\b\w{3},\s+\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4}\b", 0),
]
LETTER_SUBJECT = r"(?i)^(?:re |subject:|re:)"
LETTER_TO = r"(?i)^to[: ]"
LETTER_DEAR = r"(?i)^(?:dear\b|(?:mr|mrs|ms|miss|mx)[: ])"
LETTER_SENDER = r"(?i)[\d,]|inc|corp|company|llc|ltd|trust|agency|service"


def letter_fields(
    df: DataFrame, text: str = "text", label_lines: int | None = None,
    date_lines: int | None = None, sender_lines: int | None = 10,
) -> DataFrame:
    """Subject, date, year, sender, addressee, body and status of a letter."""
    lines = F.filter(
        F.transform(F.split(F.col(text), r"\R|[\u001c-\u001e]"), strip), lambda l: l != ""
    )

    def head(limit: int | None) -> Column:
        return F.col("_lines") if limit is None else F.slice(F.col("_lines"), 1, limit)

    def first_at(test) -> Column:
        hits = F.filter(
            F.transform(head(label_lines), lambda l, i: F.when(test(l), i)), lambda i: i.isNotNull()
        )
        return F.get(hits, F.lit(0))

    def line_date(line: Column) -> Column:
        return F.coalesce(*[
            F.when(line.rlike(p), F.regexp_extract(line, p, g)) for p, g in LETTER_DATES
        ], F.lit(""))

    raw_date = F.get(
        F.filter(F.transform(head(date_lines), line_date), lambda d: d != ""),
        F.lit(0),
    )
    staged = df.withColumn("_lines", lines).withColumns({
        "_raw": F.regexp_replace(raw_date, r"(\d{1,2})(?:st|nd|rd|th)", "$1"),
        "_title_at": first_at(lambda l: l.rlike(LETTER_SUBJECT)),
        "_to_at": first_at(lambda l: l.rlike(LETTER_TO) | l.rlike(LETTER_DEAR)),
    }).withColumns({
        "_date": F.try_to_date(collapse_spaces("_raw"), "d MMMM yyyy"),
        "_to_line": F.get(F.col("_lines"), F.col("_to_at")),
    })
    salutation = F.when(
        F.col("_to_line").rlike(LETTER_TO), F.regexp_replace("_to_line", r"(?i)^to\s+", "")
    ).otherwise(F.regexp_replace("_to_line", r"(?i)^dear\s+", ""))
    sender = F.filter(head(sender_lines), lambda l: l.rlike(LETTER_SENDER))
    body_at = F.coalesce(F.col("_to_at"), F.col("_title_at"), F.lit(-1)) + 2
    return staged.withColumns({
        "subject": F.coalesce(F.get(F.col("_lines"), F.col("_title_at")), F.lit("")),
        "date_of_report": F.coalesce(F.date_format("_date", "dd/MM/yyyy"), strip("_raw")),
        "year": F.coalesce(
            F.year("_date"), extract("_raw", r"(?U)\b(20\d{2}|19\d{2})\b").try_cast("int")
        ),
        "sender_address": F.array_join(sender, " "),
        "addressee": strip(
            F.regexp_replace(F.coalesce(salutation, F.lit("")), "[,;:]+$", "")
        ),
        "body": F.array_join(
            F.slice(F.col("_lines"), body_at + 1, F.greatest(F.size("_lines"), F.lit(1))), "\n"
        ),
        "status": F.when(F.col("_raw").isNull(), "failed").otherwise("success"),
    }).drop("_lines", "_raw", "_title_at", "_to_at", "_date", "_to_line")


def local_report(df: DataFrame, filename: str = "filename", text: str = "content") -> DataFrame:
    """Report row of a file without a stored page."""
    return df.withColumns({
        "report_type": F.when(
            F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("response to")), "Response"
        ).otherwise("Report"),
        "title": F.replace(F.col(filename), F.lit(".pdf"), F.lit("")),
        "url": F.lit("Local File Only"),
    })


# Section and label patterns of a report body.
SECTION_PATTERNS = {
    "circumstances": r"(?is)CIRCUMSTANCES OF (?:THE )?DEATH\s*(.*?)(?=CORONER|\z)",
    "concerns": r"(?is)CORONER'?S CONCERNS\s*(.*?)(?=MATTERS|\z)",
    "actions": r"(?is)(?:MATTERS|ACTION) OF CONCERN\s*(.*?)(?=\n\n|\z)",
    "response": r"(?is)(?:In response to|Following)\s*(.*?)(?=\n\n|\z)",
}
LABEL_PATTERNS = {
    "ref": r"Ref(?:erence)?:\s*([-\d]+)",
    "date": r"Date of report:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
    "deceased": r"Deceased name:\s*([^\n]+)",
    "coroner": r"Coroner(?:'?s)? name:\s*([^\n]+)",
    "area": r"Coroner(?:'?s)? [Aa]rea:\s*([^\n]+)",
    "category": r"Category:\s*([^\n]+)",
}


def section_struct(content: ColumnOrName, pattern: str) -> Column:
    """struct<content, source, start, end> of the first match, else NULL."""
    text = as_col(content)
    start = F.regexp_instr(text, F.lit(pattern))
    source = F.regexp_extract(text, pattern, 0)
    return F.when(text.rlike(pattern), F.struct(
        strip(F.regexp_extract(text, pattern, 1)).alias("content"),
        source.alias("source"),
        (start - 1).alias("start"),
        (start - 1 + F.length(source)).alias("end"),
    ))


def extract_sections(df: DataFrame, content: str = "content") -> DataFrame:
    sections = {n: section_struct(content, p) for n, p in SECTION_PATTERNS.items()}
    labels = {f"label_{n}": strip(extract(content, p)) for n, p in LABEL_PATTERNS.items()}
    return df.withColumns({**sections, **labels})


def document_summary(
    df: DataFrame, content: str = "content", section_chars: int | None = None, brief_chars: int | None = None
) -> DataFrame:
    """Two summaries made of the found sections, with a confidence.

    Sections are given whole unless a number of characters is asked for.
    """
    names = ["circumstances", "concerns", "actions"]
    found = extract_sections(df, content)

    def part(name: str, label: str, chars: int | None) -> Column:
        text = F.col(f"{name}.content")
        if chars is not None:
            text = F.concat(F.substring(text, 1, chars), F.lit("..."))
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(label), text))

    facts = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    opening = F.when(
        F.col("label_ref").isNotNull() & F.col("label_date").isNotNull(),
        F.concat(
            F.lit("Prevention of Future Deaths report "), "label_ref",
            F.lit(" dated "), "label_date",
        ),
    )
    person = F.when(
        F.col("label_deceased").isNotNull(),
        F.concat(F.lit("regarding the death of "), "label_deceased"),
    )
    return found.withColumns({
        "extractive": F.concat_ws("\n\n", *[part(n, f"{n.upper()}:\n", section_chars) for n in names]),
        "abstractive": F.concat_ws(
            " ", opening, person, *[part(n, f"\n{n.title()}: ", brief_chars) for n in names]
        ),
        "confidence": F.round(facts / 3, 4),
    })
