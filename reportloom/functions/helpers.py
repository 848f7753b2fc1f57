"""Small column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# Blank characters: ASCII white space plus the Unicode separators.
WS = r"[\s\u0085\p{Z}]"
# One word character (letter, digit or underscore in any script).
WORD = r"[\p{L}\p{N}_]"

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def strip(value: ColumnOrName) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(as_col(value), f"^{WS}+|{WS}+$", "")


def collapse_spaces(value: ColumnOrName) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(as_col(value), f"{WS}+", " "))


def drop_all(value: Column, patterns: Iterable[str], replacement: str = "") -> Column:
    """Apply ``regexp_replace`` for each pattern in order."""
    for pattern in patterns:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def extract(value: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL (not '') when there is no match."""
    return F.nullif(F.regexp_extract(as_col(value), pattern, group), F.lit(""))


def words_of(value: ColumnOrName) -> Column:
    """Blank-separated words, without empty strings."""
    return F.filter(F.split(as_col(value), f"{WS}+"), lambda w: w != "")


def word_count(value: ColumnOrName) -> Column:
    return F.coalesce(F.size(words_of(F.coalesce(as_col(value), F.lit("")))), F.lit(0))


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def cut_at_first(value: Column, markers: Iterable[str], haystack: Column | None = None) -> Column:
    """Text before the earliest marker; ``haystack`` is searched if given."""
    searched = value if haystack is None else haystack
    positions = [F.nullif(F.instr(searched, m), F.lit(0)) for m in markers]
    first = F.least(*positions) if len(positions) > 1 else positions[0]
    return let(first, lambda p: F.when(p.isNull(), value).otherwise(
        F.substring(value, F.lit(1), p - 1)))


def blank(value: ColumnOrName) -> Column:
    """True for NULL or only-blank text."""
    return F.coalesce(strip(value), F.lit("")) == ""
