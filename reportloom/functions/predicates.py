"""Row predicates and filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.constants import EXPLICIT_NEGATIONS, IMPLICIT_NEGATIONS
from reportloom.functions.extract import is_response
from reportloom.functions.helpers import ColumnOrName, as_col, blank, literal_array, strip
from reportloom.functions.text import apostrophe_tokens, lemma


def _clean(values: Sequence[str]) -> list[str]:
    return [str(v).lower().strip() for v in values]


def _never_null(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def date_between(column: ColumnOrName, first: date | str, last: date | str) -> Column:
    return as_col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def year_between(column: ColumnOrName, first: int, last: int) -> Column:
    c = as_col(column)
    return c == first if first == last else c.between(first, last)


def name_in(column: ColumnOrName, choices: Sequence[str]) -> Column:
    """Exact match after lower/trim; no choice means no restriction."""
    if not choices:
        return F.lit(True)
    return _never_null(F.lower(strip(column)).isin(*_clean(choices)))


def value_in(column: ColumnOrName, choices: Sequence) -> Column:
    if not choices:
        return F.lit(True)
    return _never_null(as_col(column).isin(*choices))


def any_category(column: ColumnOrName, choices: Sequence[str]) -> Column:
    if not choices:
        return F.lit(True)
    lowered = F.transform(as_col(column), lambda c: F.lower(strip(c)))
    return _never_null(F.arrays_overlap(lowered, literal_array(_clean(choices))))


def category_text_contains(column: ColumnOrName, choices: Sequence[str]) -> Column:
    """Case-sensitive substring test on a text column."""
    hit = F.lit(False)
    for choice in choices:
        hit = hit | F.contains(as_col(column), F.lit(choice))
    return _never_null(hit) if choices else F.lit(True)


def any_category_partial(column: ColumnOrName, choices: Sequence[str], is_text: bool = False) -> Column:
    """Containment in either direction; comma text is split first."""
    categories = F.split(as_col(column), ",") if is_text else as_col(column)

    def matches(category: Column) -> Column:
        c = F.lower(strip(category))
        hit = F.lit(False)
        for choice in _clean(choices):
            hit = hit | F.contains(c, F.lit(choice)) | F.contains(F.lit(choice), c)
        return hit

    return _never_null(F.exists(categories, matches))


def partial_match(column: ColumnOrName, choices: Sequence[str]) -> Column:
    """Value contains a choice or a choice contains the value.

    A NULL value counts as '', which every choice contains.
    """
    value = F.lower(F.coalesce(as_col(column), F.lit("")))
    hit = F.lit(False)
    for choice in _clean(choices):
        hit = hit | F.contains(value, F.lit(choice)) | F.contains(F.lit(choice), value)
    return hit if choices else F.lit(True)


def document_type(types: Sequence[str], **columns) -> Column:
    wanted = set(types)
    if wanted & {"Report", "Response"} in ({"Report", "Response"}, set()):
        return F.lit(True)
    response = is_response(**columns)
    return response if "Response" in wanted else ~response


def keyword_search(column: ColumnOrName, query: str) -> Column:
    """Substring search; " and " takes precedence over " or "."""
    if not query:
        return F.lit(False)
    text = F.lower(F.coalesce(as_col(column), F.lit("")))
    lowered = query.lower()

    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    if " and " in lowered:
        hit = F.lit(True)
        for word in filter(None, (w.strip() for w in lowered.split(" and "))):
            hit = hit & has(word)
    elif " or " in lowered:
        hit = F.lit(False)
        for word in filter(None, (w.strip() for w in lowered.split(" or "))):
            hit = hit | has(word)
    else:
        hit = has(lowered.strip())
    return hit & (text != "")


def has_concerns(column: ColumnOrName = "extracted_concerns") -> Column:
    return ~blank(column) & (F.length(as_col(column)) > 20)


def dashboard_filter(
    annotations: DataFrame,
    framework: str | None = None,
    years: tuple[int, int] | None = None,
    areas: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    confidence: Sequence[str] | None = None,
) -> DataFrame:
    kept = annotations
    if framework:
        kept = kept.filter(F.col("framework") == framework)
    if years:
        kept = kept.filter(year_between("year", *years))
    if areas is not None:
        kept = kept.filter(value_in("coroner_area", areas) if areas else F.lit(False))
    if names is not None:
        kept = kept.filter(value_in("coroner_name", names) if names else F.lit(False))
    if confidence is not None:
        kept = kept.filter(value_in("confidence", confidence) if confidence else F.lit(False))
    return kept


def contains_negation(
    sentence: ColumnOrName,
    words: Sequence[str] = (*EXPLICIT_NEGATIONS, *IMPLICIT_NEGATIONS),
) -> Column:
    """True if a token, or its singular form, is in the word list."""
    found = apostrophe_tokens(sentence)
    listed = literal_array(sorted(set(words)))
    return _never_null(
        F.arrays_overlap(found, listed) | F.arrays_overlap(F.transform(found, lemma), listed)
    )


def has_label(column: ColumnOrName) -> Column:
    return ~blank(column)
