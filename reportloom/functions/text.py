"""Text cleaning as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reportloom.functions.constants import (
    AREA_ENDS, BOILERPLATE, CATEGORY_ENDS, CHARACTER_FIXES, DOMAIN_STOP_WORDS,
    ENGLISH_STOP_WORDS, STANDARD_CATEGORIES,
)
from reportloom.functions.helpers import (
    WORD, WS, ColumnOrName, as_col, collapse_spaces, cut_at_first, drop_all,
    extract, let, literal_array, strip, word_count, words_of,
)

MONTHS = (
    "january|february|march|april|may|june|july|august|"
    "september|october|november|december"
)


@F.arrow_udf(T.StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    # The one Python step: Spark has no Unicode normalisation function.
    return pc.utf8_normalize(texts, form="NFKD")


def nfkd(value: ColumnOrName) -> Column:
    return _nfkd(as_col(value))


def clean_text(value: ColumnOrName, normalise: bool = True) -> Column:
    """Fix wrong decodings, strip tags and unprintable characters.

    ``normalise=False`` leaves out the NFKD step for text known to be ASCII.
    """
    text = F.coalesce(as_col(value), F.lit(""))
    for wrong, right in CHARACTER_FIXES:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    if normalise:
        text = nfkd(text)
    text = F.regexp_replace(text, "<[^>]+>", "")
    text = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^\n ]]", " ")
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, "\n+", "\n")
    return strip(text)


# What is taken out of texts for modelling, and the labels around the name of a deceased person.
MODELING_NOISE = [
    r"(?U)http\S+|www\S+",
    r"(?U)\S+@\S+",
    r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    rf"(?U)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\s+\d{{4}}\b",
    r"(?U)\b\d{1,2}:\d{2}\b",
    r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?U)\b(?:ref|reference|case)(?:\s+no)?\.?\s*[-:\s]?\s*\w+[-\d]+\b",
    r"(?U)\b(?:regulation|paragraph|section|subsection|article)\s+\d+\b",
    r"(?U)\b(?:coroner|inquest|hearing|evidence|witness|statement|report|dated|signed)\b",
]
# What a text must hold for the pattern of the same place to be found in it; None: a digit.
MODELING_HINTS = [
    ["http", "www"], ["@"], None, None, [":"], ["/"], ["ref", "case"], ["regulation", "paragraph", "section", "article"],
    ["coroner", "inquest", "hearing", "evidence", "witness", "statement", "report", "dated", "signed"],
]
NAME_LABELS = [
    r"(?i)^deceased name:?\s*",
    r"(?i)^coroner'?s?\s*(?:name)?:?\s*",
    r"(?i)^deceased person:?\s*",
    r"(?i)^name of deceased:?\s*",
    r"(?id)\s*(?:coroner|ref|reference).*$",
    r"(?d)\s*\(.*\)$",
]


def _may_hold(text: Column, hints: Sequence[str] | None) -> Column:
    if hints is None:
        return F.rlike(text, F.lit(r"\p{Nd}"))
    return reduce(Column.__or__, [F.contains(text, F.lit(h)) for h in hints])


def clean_text_for_modeling(value: ColumnOrName) -> Column:
    """Lower-case letters only, words over two characters, else ''."""
    text = F.lower(F.coalesce(as_col(value), F.lit("")))
    for pattern, hints in zip(MODELING_NOISE, MODELING_HINTS, strict=True):
        text = let(text, lambda t: F.when(_may_hold(t, hints), F.regexp_replace(t, pattern, "")).otherwise(t))  # noqa: B023
    text = F.regexp_replace(text, "[^a-z]+", " ")
    kept = F.filter(F.split(text, " "), lambda w: F.length(w) > 2)
    return let(kept, lambda w: F.when(F.size(w) >= 3, F.array_join(w, " ")).otherwise(""))


def clean_deceased_name(value: ColumnOrName) -> Column:
    """Remove labels, anything from a coroner/reference label on, end brackets."""
    name = strip(value)
    name = drop_all(name, NAME_LABELS)
    return collapse_spaces(name)


# Titles in front of a name, honours behind it.
NAME_TITLES = (
    r"Dr\.?|Doctor|Mr\.?|Mrs\.?|Ms\.?|Miss\.?|Prof\.?|Professor|Sir|Dame|HM|HM\s+Senior|"
    r"Hon\.?|Honorable|Justice|Judge|QC|KC"
)
NAME_HONOURS = r"QC|KC|Esq\.?|Jr\.?|Sr\.?"


def clean_coroner_name(value: ColumnOrName) -> Column:
    """Bare person name without titles, honours, brackets or job label."""
    name = strip(value)
    name = F.regexp_replace(name, rf"(?i)^(?:(?:{NAME_TITLES})\s+)+", "")
    name = F.regexp_replace(name, rf"(?i)\s+(?:{NAME_HONOURS})$", "")
    name = F.regexp_replace(name, r"\([^)\n]*\)", "")
    name = F.regexp_replace(name, r"[;:,.]$", "")
    name = F.regexp_replace(collapse_spaces(name), r"(?i)^(?:Dr\s+){2,}", "")
    return strip(F.regexp_replace(name, r"(?i)\s*Coroner.*$", ""))


def clean_coroner_area(value: ColumnOrName) -> Column:
    """Lower-case area name, cut where the next label starts."""
    area = F.lower(as_col(value))
    area = F.translate(area, "()[]-", "     ")
    area = F.replace(area, F.lit("&"), F.lit(" and "))
    area = F.regexp_replace(area, r"(?U)\bthe\b", " ")
    area = F.regexp_replace(area, f"{WS}+", " ")
    area = F.regexp_replace(area, r"(?U)\bisle of scilly\b", "isles of scilly")
    area = F.regexp_replace(area, r"(?U)\beast riding of yorkshire\b", "east riding")
    area = F.regexp_replace(area, r"(?U)\bcity of kingston upon hull\b", "kingston upon hull")
    area = let(area, lambda a: cut_at_first(a, [*AREA_ENDS, "|"]))
    area = F.regexp_replace(area, "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return collapse_spaces(area)


def _clean_one_category(value: Column) -> Column:
    text = let(value, lambda v: cut_at_first(v, CATEGORY_ENDS, haystack=F.lower(v)))
    text = strip(F.regexp_replace(text, r"\([^)\n]*\)", ""))
    return strip(F.regexp_replace(text, rf"{WS}*&{WS}*", " and "))


def clean_categories(value: ColumnOrName, is_array: bool = True) -> Column:
    """Cut trailing "this report ..." text from each category."""
    column = as_col(value)
    return F.transform(column, _clean_one_category) if is_array else _clean_one_category(column)


def normalize_category(value: ColumnOrName) -> Column:
    text = collapse_spaces(F.lower(F.coalesce(as_col(value), F.lit(""))))
    text = F.regexp_replace(text, CATEGORY_SEPARATORS, " ")
    return collapse_spaces(text)


# Separators that normalising a category turns into blanks.
CATEGORY_SEPARATORS = "[,;|\u2022\u00b7\u22c5\u2023\u2043\u25aa\u25ab\u2013\u2014-]"


def _standard_key(name: str) -> str:
    return " ".join(re.sub(CATEGORY_SEPARATORS, " ", name.lower()).split())


def match_category(
    value: ColumnOrName, standards: Sequence[str] = STANDARD_CATEGORIES, normalise: bool = True
) -> Column:
    """Standard name: exact match, else first containment, else unchanged.

    The keys of the standard names are constants; per row only the value's own
    key is computed. ``normalise=False`` compares in lower case only.
    """
    keys = [_standard_key(s) if normalise else s.lower() for s in standards]
    candidates = F.array(*[
        F.struct(F.lit(s).alias("name"), F.lit(k).alias("key")) for s, k in zip(standards, keys)
    ])

    def pick(needle: Column) -> Column:
        exact = F.filter(candidates, lambda c: c["key"] == needle)
        part = F.filter(
            candidates,
            lambda c: F.contains(c["key"], needle) | F.contains(needle, c["key"]),
        )
        found = F.coalesce(F.get(exact, F.lit(0))["name"], F.get(part, F.lit(0))["name"], as_col(value))
        # Every name contains an empty key; a value of separators only stays as it is.
        return F.when(needle == "", as_col(value)).otherwise(found)

    own = normalize_category(value) if normalise else F.lower(as_col(value))
    return F.when(as_col(value) != "", let(own, pick))


def clean_text_basic(value: ColumnOrName) -> Column:
    """Lower case without tags, links, addresses, punctuation or digits."""
    text = F.lower(F.coalesce(as_col(value), F.lit("")))
    text = drop_all(text, [
        r"(?d)<.*?>",
        r"(?U)http\S+|www\S+",
        r"(?U)\S+@\S+",
        r"[^\p{L}\p{N}_\s']",
        r"\p{Nd}+",
    ], " ")
    return collapse_spaces(text)


def remove_boilerplate(value: ColumnOrName, phrases: Sequence[str] = BOILERPLATE) -> Column:
    """Delete each listed phrase, in list order."""
    text = as_col(value)
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return collapse_spaces(text)


def remove_stopwords(
    value: ColumnOrName,
    stop_words: Sequence[str] = (*ENGLISH_STOP_WORDS, *DOMAIN_STOP_WORDS),
) -> Column:
    """Blank-separated words that are not in the list, in order, with repeats."""
    words = words_of(value)
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop_words)), " ")


def lemma(word: Column) -> Column:
    """Singular form by suffix rules; stands in for a dictionary lemmatiser."""
    return (
        F.when(word.rlike("(?:ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:ch|sh|s|x|z)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def lemmatize_tokens(value: ColumnOrName) -> Column:
    return F.array_join(F.transform(words_of(value), lemma), " ")


def preprocess_text(
    value: ColumnOrName,
    phrases: Sequence[str] = BOILERPLATE,
    stop_words: Sequence[str] = (*ENGLISH_STOP_WORDS, *DOMAIN_STOP_WORDS),
) -> Column:
    text = remove_boilerplate(clean_text_basic(value), phrases)
    return lemmatize_tokens(remove_stopwords(text, stop_words))


def preprocess_corpus(df: DataFrame, text: str = "content", **options) -> DataFrame:
    """Processed text with word counts and the reduction in percent."""
    processed = df.withColumn("processed", preprocess_text(text, **options))
    counted = processed.withColumns({
        "original_words": word_count(text),
        "processed_words": word_count("processed"),
    })
    share = F.try_divide(F.col("processed_words").cast("double"), F.col("original_words"))
    return counted.withColumn(
        "reduction_pct", F.coalesce(F.round((1 - share) * 100, 2), F.lit(0.0))
    )


def preprocess_summary(preprocessed: DataFrame) -> DataFrame:
    return preprocessed.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("processed") == "").alias("empty_documents"),
        F.round(F.avg("reduction_pct"), 2).alias("avg_reduction_pct"),
    )


def slugify(value: ColumnOrName) -> Column:
    slug = F.lower(as_col(value))
    slug = F.regexp_replace(slug, r"[^\p{L}\p{N}_\s-]", "")
    slug = F.regexp_replace(slug, r"[\s_]+", "-")
    slug = F.regexp_replace(slug, "-{2,}", "-")
    return F.regexp_replace(slug, "^-+|-+$", "")


# Words and numbers after which a file name holds no person name.
SLUG_STOPS = (
    r"\bPREVENTION\b|\bREGULATION\b|\bACTION\b|\bFUTURE\b|\bDEATHS?\b|\bREPORT\b|\d{4}"
)


def slug_from_filename(value: ColumnOrName) -> Column:
    """Name slug of a report file: official pattern, stop words, whole name."""
    stem = F.regexp_replace(as_col(value), r"^(\.*[^.].*)\.[^.]*$", "$1")
    official = extract(stem, r"(?i)^(.*?)-?prevention-of-future-deaths?-report", 1)
    stopped = F.regexp_extract(stem, rf"(?iU)^(.*?)(?:{SLUG_STOPS})", 1)
    return F.coalesce(
        slugify(official),
        F.when(strip(stopped) != "", slugify(strip(stopped))),
        slugify(stem),
    )


def combine_document_text(
    title: ColumnOrName = "title", content: ColumnOrName = "content", pdfs: ColumnOrName = "pdfs"
) -> Column:
    return F.concat_ws(
        " ", as_col(title), as_col(content), F.transform(as_col(pdfs), lambda p: p["content"])
    )


def document_identifier(
    title: ColumnOrName = "title", ref: ColumnOrName = "ref", name: ColumnOrName = "deceased_name"
) -> Column:
    parts = [strip(F.coalesce(as_col(c), F.lit(""))) for c in (title, ref, name)]
    return F.concat_ws("_", *parts)


def format_date_uk(value: ColumnOrName) -> Column:
    return F.coalesce(F.date_format(as_col(value), "dd/MM/yyyy"), F.lit(""))


def confidence_label(score: ColumnOrName, high: float = 0.7, medium: float = 0.5) -> Column:
    s = as_col(score)
    return F.when(s >= high, "High").when(s >= medium, "Medium").otherwise("Low")


# A sentence ends after . ! or ? where blanks and a capital letter follow.
_SENTENCE_GAP = r"((?<=[.!?])(?U:\s)+)(?=[A-Z])"
_MARK = "\u0001"


def sentence_spans(value: ColumnOrName) -> Column:
    """array<struct<sentence_idx, start, end, sentence>> with 0-based offsets."""
    text = F.translate(as_col(value), _MARK, " ")
    pieces = F.split(F.regexp_replace(text, _SENTENCE_GAP, f"$1{_MARK}"), _MARK)

    def build(parts: Column) -> Column:
        starts = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts")),
            lambda acc, p: F.struct(
                (acc["pos"] + F.length(p)).alias("pos"),
                F.concat(acc["starts"], F.array(acc["pos"])).alias("starts"),
            ),
        )["starts"]
        last = F.size(parts) - 1
        return let(starts, lambda at: F.transform(parts, lambda p, i: let(
            F.when(i == last, p).otherwise(F.regexp_replace(p, r"(?U)\s+$", "")),
            lambda s: F.struct(
                i.alias("sentence_idx"),
                F.get(at, i).alias("start"),
                (F.get(at, i) + F.length(s)).alias("end"),
                s.alias("sentence"),
            ),
        )))

    return F.filter(let(pieces, build), lambda s: strip(s["sentence"]) != "")


def split_sentences(df: DataFrame, text: str = "content", keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """One row per sentence with its offsets in the original text."""
    spans = df.select(*keep, F.inline(sentence_spans(text)))
    return spans.select(*keep, "sentence_idx", "start", "end", "sentence")


def tokens(value: ColumnOrName, min_chars: int = 2) -> Column:
    """Lower-case word tokens of at least ``min_chars`` characters."""
    return F.regexp_extract_all(F.lower(as_col(value)), F.lit(f"{WORD}{{{min_chars},}}"), 0)


def apostrophe_tokens(value: ColumnOrName) -> Column:
    """Lower-case words that keep inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(as_col(value)), F.lit(rf"{WORD}+(?:['-]{WORD}+)*"), 0)
