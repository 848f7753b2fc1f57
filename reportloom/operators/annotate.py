"""Theme annotation: keyword matches, scores and the annotation table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.helpers import WORD, word_count
from reportloom.functions.text import confidence_label, lemma, split_sentences
from reportloom.operators.dashboard import NO_THEME
from reportloom.operators.search import occurrences
from reportloom.operators.small import top_n_per_group, with_each
from reportloom.session import materialize

THEME = ["framework", "theme_idx", "theme"]
METADATA = ["title", "coroner_name", "coroner_area", "year", "date_of_report"]


def singular(keyword: Column) -> Column:
    """The keyword with its last word in the singular, without "ing" or "ed"."""
    last = F.regexp_replace(lemma(F.regexp_extract(keyword, rf"({WORD}+)$", 1)), "(?:ing|ed)$", "")
    return F.concat(F.regexp_replace(keyword, rf"{WORD}+$", ""), last)


def expand_keywords(frameworks: DataFrame, form: Callable[[Column], Column] = singular) -> DataFrame:
    """Add one derived form of each keyword, such as ``functions.stem.stem``; distinct per theme."""
    both = frameworks.select(
        *THEME, "kw_idx", F.inline(F.array(
            F.struct(F.lit(0).alias("derived"), F.col("keyword").alias("keyword")),
            F.struct(F.lit(1).alias("derived"), form(F.col("keyword")).alias("keyword")),
        ))
    )
    first = both.groupBy(*THEME, "keyword").agg(
        F.min(F.struct("derived", "kw_idx")).alias("first")
    )
    place = F.row_number().over(Window.partitionBy(*THEME).orderBy("first", "keyword"))
    return first.withColumn("kw_idx", place - 1).drop("first")


def _escaped(keyword: Column) -> Column:
    return F.regexp_replace(keyword, r"([^\p{L}\p{N}_\s])", r"\\$1")


def _whole_word(keyword: Column) -> Column:
    return F.concat(F.lit(f"(?<!{WORD})"), _escaped(keyword), F.lit(f"(?!{WORD})"))


def sentence_matches(sentences: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Sentence × keyword, whole word, lower case, keywords of 3+ characters.

    Every distinct word of a sentence is looked up as the first word of a
    keyword (equi-join); only those candidates are verified with a pattern.
    The keywords travel to the sentences, so no copy of a sentence per word is ever shuffled.
    """
    dim = frameworks.filter(F.length("keyword") >= 3).select(
        *THEME, "kw_idx", "keyword", F.lower("keyword").alias("_kw")
    ).withColumns({
        "_first": F.regexp_extract("_kw", f"{WORD}+", 0),
        "_pattern": _whole_word(F.col("_kw")),
    }).filter(F.col("_first") != "")
    lower = F.lower("sentence")
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"{WORD}+"), 0))
    probe = sentences.select("*", F.explode(words).alias("_first"))
    found = probe.join(F.broadcast(dim), "_first").filter(
        (F.col("_kw") == F.col("_first")) | F.rlike(F.lower("sentence"), F.col("_pattern"))
    )
    return found.drop("_first", "_kw", "_pattern")


def keyword_spans(sentences: DataFrame, frameworks: DataFrame) -> DataFrame:
    """One row per report, theme and matching sentence with its keywords."""
    hits = sentence_matches(sentences, frameworks)
    grouped = hits.groupBy("record_id", *THEME, "sentence_idx", "start", "end").agg(
        F.sort_array(F.collect_set(F.struct("kw_idx", "keyword"))).alias("kw"),
        F.first("sentence").alias("sentence"),
    )
    return grouped.select(
        "record_id", *THEME, "start", "end",
        F.array_join(F.transform("kw", lambda k: k["keyword"]), ", ").alias("keywords"),
        "kw", "sentence",
        F.concat_ws("_", "framework", "theme").alias("theme_key"),
    )


def theme_keywords(spans: DataFrame) -> DataFrame:
    """Distinct keywords per report and theme, in order of first appearance."""
    firsts = spans.select("record_id", *THEME, "start", F.inline("kw")).groupBy(
        "record_id", *THEME, "keyword"
    ).agg(F.min(F.struct("start", "kw_idx")).alias("first"))
    return firsts.groupBy("record_id", *THEME).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first", "keyword"))), lambda k: k["keyword"]
        ).alias("keyword_list"),
    ).withColumn("keyword_count", F.size("keyword_list"))


def context_windows(df: DataFrame, text: str = "content", keyword: str = "keyword", size: int = 100) -> DataFrame:
    """Text around the first occurrence of a keyword; the keyword if absent."""
    at = F.instr(F.lower(text), F.lower(keyword))
    start = F.greatest(at - size, F.lit(1))
    window = F.substr(text, start, at - start + F.length(keyword) + size)
    return df.withColumn("context", F.when(at > 0, window).otherwise(F.col(keyword)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one of them is zero."""
    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    return F.coalesce(F.try_divide(dot, norm), F.lit(0.0))


def all_theme_similarity(doc_vectors: DataFrame, theme_vectors: DataFrame) -> DataFrame:
    """Cosine of every document with every theme of a small framework table."""
    pairs = with_each(doc_vectors, theme_vectors, *THEME, "theme_vector")
    return pairs.select(
        "record_id", *THEME, cosine(F.col("vector"), F.col("theme_vector")).alias("similarity")
    )


def semantic_similarity(
    pairs: DataFrame,
    doc_vectors: DataFrame,
    theme_vectors: DataFrame,
    context_vectors: DataFrame | None = None,
) -> DataFrame:
    """Max of document·theme and context·theme cosine, for the given pairs only.

    ``context_vectors`` holds ``(record_id, keyword, vector)``; a theme uses those
    of its own matched keywords.
    """
    themes = theme_vectors.select("framework", "theme", "theme_vector")
    scored = (
        pairs.join(doc_vectors, "record_id", "left").join(themes, ["framework", "theme"], "left")
        .withColumn("semantic_similarity", cosine(F.col("vector"), F.col("theme_vector")))
        .drop("vector", "theme_vector")
    )
    if context_vectors is None:
        return scored
    contexts = (
        pairs.select("record_id", "framework", "theme", F.explode("keyword_list").alias("keyword"))
        .join(context_vectors.select("record_id", "keyword", "vector"), ["record_id", "keyword"])
        .join(themes, ["framework", "theme"])
        .groupBy("record_id", "framework", "theme")
        .agg(F.max(cosine(F.col("vector"), F.col("theme_vector"))).alias("_context"))
    )
    return scored.join(contexts, ["record_id", "framework", "theme"], "left").withColumn(
        "semantic_similarity", F.greatest("semantic_similarity", F.coalesce("_context", F.lit(0.0)))
    ).drop("_context")


def tfidf_similarity(pairs: DataFrame, doc_weights: DataFrame, theme_weights: DataFrame) -> DataFrame:
    """Fallback without vectors: cosine of unit-length term weights."""
    terms = theme_weights.select("framework", "theme", "term", F.col("weight").alias("_tw"))
    docs = doc_weights.select("record_id", "term", "weight")
    dots = (
        pairs.select("record_id", "framework", "theme").join(terms, ["framework", "theme"])
        .join(docs, ["record_id", "term"])
        .groupBy("record_id", "framework", "theme")
        .agg(F.sum(F.col("weight") * F.col("_tw")).alias("_dot"))
    )
    return pairs.join(dots, ["record_id", "framework", "theme"], "left").withColumn(
        "semantic_similarity", F.coalesce("_dot", F.lit(0.0))
    ).drop("_dot")


def combined_score(
    similarity: Column, keywords: Column, words: Column,
    keyword_weight: float = 0.3, semantic_weight: float = 0.7,
) -> Column:
    """Keyword density (full at one keyword per 1000 words) and similarity."""
    density = F.coalesce(
        F.least(F.lit(1.0), F.try_divide(keywords * 1000.0, words.cast("double"))), F.lit(1.0)
    )
    return density * keyword_weight + similarity * semantic_weight


def select_themes(scored: DataFrame, per_framework: int = 5, high_score: float = 0.75) -> DataFrame:
    """Best themes per report and framework that add a keyword or score high.

    At most ``per_framework`` themes are left per group when they are folded.
    """
    best = top_n_per_group(
        scored, ["record_id", "framework"], per_framework,
        F.desc("combined_score"), F.asc("theme_idx"), rank="theme_rank",
    )
    payload = [c for c in best.columns if c not in ("record_id", "framework", "theme_rank")]
    groups = best.groupBy("record_id", "framework").agg(
        F.sort_array(F.collect_list(F.struct("theme_rank", *payload))).alias("themes")
    )
    kept = F.aggregate(
        "themes",
        F.struct(
            F.array().cast("array<string>").alias("used"), F.array().cast("array<int>").alias("ranks")
        ),
        lambda acc, t: F.when(
            (F.size(F.array_except(t["keyword_list"], acc["used"])) > 0)
            | (t["combined_score"] > high_score),
            F.struct(
                F.array_union(acc["used"], t["keyword_list"]).alias("used"),
                F.concat(acc["ranks"], F.array(t["theme_rank"])).alias("ranks"),
            ),
        ).otherwise(acc),
        lambda acc: acc["ranks"],
    )
    chosen = groups.withColumn("_kept", kept).withColumn(
        "themes", F.filter("themes", lambda t: F.array_contains("_kept", t["theme_rank"]))
    )
    return chosen.select("record_id", "framework", F.inline("themes"))


def score_themes(
    reports: DataFrame, spans: DataFrame, doc_vectors: DataFrame, theme_vectors: DataFrame,
    threshold: float = 0.65, text: str = "content", context_vectors: DataFrame | None = None,
) -> DataFrame:
    """Scored themes at or above the threshold, before the selection."""
    words = reports.select("record_id", word_count(text).alias("words"))
    candidates = theme_keywords(spans).join(words, "record_id")
    scored = semantic_similarity(candidates, doc_vectors, theme_vectors, context_vectors)
    score = combined_score(F.col("semantic_similarity"), F.col("keyword_count"), F.col("words"))
    return scored.withColumn("_score", score).filter(F.col("_score") >= threshold).select(
        "record_id", *THEME, "keyword_list", "keyword_count",
        F.round("semantic_similarity", 3).alias("semantic_similarity"),
        F.round("_score", 3).alias("combined_score"),
    )


def annotate(
    reports: DataFrame, frameworks: DataFrame, doc_vectors: DataFrame, theme_vectors: DataFrame,
    threshold: float = 0.65, text: str = "content", context_vectors: DataFrame | None = None,
) -> DataFrame:
    """The annotation table of a report table."""
    sentences = split_sentences(reports, text)
    # Few sentences match; their table is read by every later step.
    spans = materialize(keyword_spans(sentences, frameworks), "spans")
    scored = score_themes(
        reports, spans, doc_vectors, theme_vectors, threshold, text, context_vectors
    )
    return annotation_table(select_themes(scored), spans, reports)


def annotation_table(themes: DataFrame, spans: DataFrame, reports: DataFrame) -> DataFrame:
    """Selected themes with their sentences and the report's metadata."""
    sentences = spans.groupBy("record_id", "framework", "theme").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("start", "sentence"))), lambda s: s["sentence"]
        ), "; ").alias("matched_sentences")
    )
    present = [c for c in METADATA if c in reports.columns]
    joined = themes.join(sentences, ["record_id", "framework", "theme"], "left").join(
        reports.select("record_id", *present), "record_id"
    )
    return joined.select(
        "record_id", *[c for c in present if c == "title"], "framework", "theme",
        confidence_label("combined_score").alias("confidence"),
        "combined_score", "semantic_similarity",
        F.array_join("keyword_list", ", ").alias("matched_keywords"),
        F.coalesce("matched_sentences", F.lit("")).alias("matched_sentences"),
        *[c for c in present if c != "title"],
    )


def with_placeholders(annotations: DataFrame, reports: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Add a "No Themes Detected" row where a framework found nothing."""
    names = frameworks.select("framework").distinct()
    expected = with_each(reports.select("record_id"), names, "framework")
    found = annotations.select("record_id", "framework")
    empty = expected.join(found, ["record_id", "framework"], "left_anti").select(
        "record_id", "framework", F.lit(NO_THEME).alias("theme"),
        F.lit(0.0).alias("combined_score"), F.lit("").alias("matched_keywords"),
    )
    return annotations.unionByName(empty, allowMissingColumns=True)


def substring_matches(reports: DataFrame, frameworks: DataFrame, text: str = "content") -> DataFrame:
    """Keywords contained anywhere in a report, without word boundary; empty keywords are left out."""
    dim = frameworks.select(*THEME, "kw_idx", F.lower("keyword").alias("keyword"))
    found = occurrences(reports, dim, text, once=True).select("record_id", "keyword")
    return found.join(dim, "keyword").select("record_id", *THEME, "kw_idx", "keyword")
