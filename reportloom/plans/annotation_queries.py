"""Theme annotation, span and classification queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.functions.stem import IRREGULAR, STEP_2, STEP_3, STEP_4, stem
from reportloom.functions.text import split_sentences
from reportloom.operators import annotate as N, classify as C, contexts as T, dashboard as D, evaluate as V, spans as S
from reportloom.operators.vectors import document_count, projected, term_counts, tfidf, tfidf_weights, vocabulary
from reportloom.plans.registry import query
from reportloom.plans.tables import (
    DOCS_SQL, EVAL_SQL, FRAMEWORKS_SQL, VECTORS_SQL, doc_vectors, docs, eval_rows, frameworks,
    table, theme_vectors,
)
from reportloom.plans.text_queries import SENTENCES_SQL, sql_list
from reportloom.session import materialize

_HITS = f"""WITH {SENTENCES_SQL}, {FRAMEWORKS_SQL},
    hits AS (SELECT record_id, sentence_idx, "start", "end", sentence, framework, theme_idx, theme, kw_idx, keyword
      FROM sent JOIN fw ON contains(lower(sentence), keyword)
      WHERE regexp_matches(lower(sentence), '(^|[^\\p{{L}}\\p{{N}}_])' || keyword || '($|[^\\p{{L}}\\p{{N}}_])')),
    spans AS (SELECT record_id, framework, theme_idx, theme, framework || '_' || theme AS theme_key, "start", "end", sentence,
        string_agg(keyword, ', ' ORDER BY kw_idx) AS keywords FROM hits GROUP BY ALL)"""
_SCORES = f"""{_HITS}, {VECTORS_SQL},
    firsts AS (SELECT record_id, framework, theme_idx, theme, keyword, min(("start", kw_idx)) AS f FROM hits GROUP BY ALL),
    kws AS (SELECT record_id, framework, theme_idx, theme, count(*) AS keyword_count, string_agg(keyword, ', ' ORDER BY f) AS matched_keywords
      FROM firsts GROUP BY ALL),
    words AS (SELECT doc_id AS record_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents),
    scored AS (SELECT k.*, list_cosine_similarity(dv.v, tv.v) AS sim,
        0.3 * least(1.0, keyword_count * 1000.0 / words) + 0.7 * list_cosine_similarity(dv.v, tv.v) AS score
      FROM kws k JOIN words USING (record_id) JOIN dv ON dv.record_id = k.record_id JOIN tv ON tv.framework = k.framework AND tv.theme = k.theme),
    kept AS (SELECT record_id, framework, theme, matched_keywords, keyword_count, round(sim, 3) AS semantic_similarity, round(score, 3) AS combined_score
      FROM scored WHERE score >= 0.3)"""
THRESHOLD = 0.30


def _spans(spark, d):
    return N.keyword_spans(split_sentences(docs(spark, d)), frameworks(spark))


def _scored(spark, d):
    r = docs(spark, d)
    return N.score_themes(r, materialize(_spans(spark, d), "spans"), doc_vectors(spark, d), theme_vectors(spark, d), THRESHOLD)


def _annotations(spark, d):
    return N.annotate(docs(spark, d), frameworks(spark), doc_vectors(spark, d), theme_vectors(spark, d), THRESHOLD)


@query("j4_keyword_sentences", f"{_HITS} SELECT record_id, sentence_idx, theme, keyword FROM hits")
def _(spark, d):
    hits = N.sentence_matches(split_sentences(docs(spark, d)), frameworks(spark))
    return hits.select("record_id", "sentence_idx", "theme", "keyword")


@query("j5_theme_similarity", f"""
    WITH {VECTORS_SQL} SELECT record_id, framework, theme, round(list_cosine_similarity(dv.v, tv.v), 4) AS similarity FROM dv CROSS JOIN tv
""")
def _(spark, d):
    pairs = N.all_theme_similarity(doc_vectors(spark, d), theme_vectors(spark, d))
    return pairs.select("record_id", "framework", "theme", F.round("similarity", 4).alias("similarity"))


def _part_keywords(spark, d):
    """A brand is a framework, a type of part a theme, its part names the keywords."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_brand").alias("framework"), F.col("p_type").alias("theme"), F.lower("p_name").alias("keyword")
    ).distinct()
    order = Window.partitionBy("framework", "theme").orderBy("keyword")
    return parts.withColumns({"theme_idx": F.lit(0), "kw_idx": F.row_number().over(order) - 1})


@query("n1_expand_keywords", """
    WITH fw AS (SELECT p_brand AS framework, p_type AS theme, lower(p_name) AS keyword,
      row_number() OVER (PARTITION BY p_brand, p_type ORDER BY lower(p_name)) - 1 AS kw_idx FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part)), k AS (
      SELECT framework, theme, 0 AS derived, kw_idx, keyword FROM fw UNION ALL
      SELECT framework, theme, 1, kw_idx, regexp_replace(regexp_replace(keyword, '(ing|ed)$', ''), 's$', '') FROM fw),
    f AS (SELECT framework, theme, keyword, min((derived, kw_idx)) AS f FROM k GROUP BY ALL)
    SELECT framework, theme, keyword, (row_number() OVER (PARTITION BY framework, theme ORDER BY f) - 1)::INT AS kw_idx FROM f
""")
def _(spark, d):
    return N.expand_keywords(_part_keywords(spark, d)).drop("theme_idx")


# The steps of the stemmer over a table s0 with the columns word and w, by their published description.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M1 = f"^({_C})?{_V}{_C}"
_CVC = f"^({_C}[aeiouy][^aeiouwxyY]|[aeiou][^aeiou])$"


def _ending_sql(endings: dict[str, str], tables: str) -> str:
    """One step that replaces the longest of the endings behind a measure of one."""
    listed = "|".join(endings)
    places = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in endings.items()) + "}"
    before, after = tables.split()
    return f"""{after} AS (SELECT word, CASE WHEN e <> '' AND regexp_matches(h, '{_M1}') THEN h || {places}[e] ELSE w END AS w
      FROM (SELECT *, regexp_extract(w, '^(.*?)({listed})$', 1) AS h, regexp_extract(w, '^(.*?)({listed})$', 2) AS e FROM {before}))"""


STEM_SQL = f"""
    s1 AS (SELECT word, CASE WHEN length(w) = 4 AND w LIKE '%ies' THEN w[:-2] WHEN w LIKE '%sses' OR w LIKE '%ies' THEN w[:-3]
      WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS w FROM s0),
    h2 AS (SELECT *, regexp_extract(w, '^(.*)(ed|ing)$', 1) AS h FROM s1),
    s2 AS (SELECT word, CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN w[:-2] ELSE w[:-3] END
      WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches(w[:-4], '{_M1}') THEN w[:-2] ELSE w END
      WHEN NOT regexp_matches(h, '[aeiou]|.y') THEN w
      WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e'
      WHEN length(h) > 1 AND h[-1] = h[-2] AND NOT regexp_matches(h, '[aeiouylsz]$') THEN h[:-2]
      WHEN regexp_matches(h, '{_CVC}') THEN h || 'e' ELSE h END AS w FROM h2),
    s3 AS (SELECT word, regexp_replace(w, '^(.+[^aeiouy])y$', '\\1i') AS w FROM s2),
    s4 AS (SELECT word, CASE WHEN w LIKE '%alli' AND regexp_matches(w[:-5], '{_M1}') THEN w[:-3] ELSE w END AS w FROM s3),
    {_ending_sql(STEP_2, "s4 s5")},
    s6 AS (SELECT word, CASE WHEN w LIKE '%logi' AND regexp_matches(w[:-4], '{_M1}') THEN w[:-2] ELSE w END AS w FROM s5),
    {_ending_sql(STEP_3, "s6 s7")},
    h8 AS (SELECT *, CASE WHEN regexp_matches(w, '[st]ion$') THEN w[:-4] ELSE regexp_extract(w, '^(.*?)({"|".join(STEP_4)})$', 1) END AS h FROM s7),
    s8 AS (SELECT word, CASE WHEN regexp_matches(h, '{_M1}{_V}{_C}') THEN h ELSE w END AS w FROM h8),
    s9 AS (SELECT word, CASE WHEN w LIKE '%e' AND (regexp_matches(w[:-2], '{_M1}{_V}{_C}')
      OR regexp_matches(w[:-2], '{_M1}({_V})?$') AND NOT regexp_matches(w[:-2], '{_CVC}')) THEN w[:-2] ELSE w END AS w FROM s8),
    s10 AS (SELECT word, CASE WHEN w LIKE '%ll' AND regexp_matches(w[:-2], '{_M1}{_V}{_C}') THEN w[:-2] ELSE w END AS w FROM s9),
    stems AS (SELECT word, coalesce(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in IRREGULAR.items())}}}[word],
      CASE WHEN length(word) <= 2 THEN word ELSE lower(w) END) AS stem FROM s10)
"""


@query("n1_stem_keywords", f"""
    WITH fw AS (SELECT p_brand AS framework, p_type AS theme, lower(p_name) AS keyword,
      row_number() OVER (PARTITION BY p_brand, p_type ORDER BY lower(p_name)) - 1 AS kw_idx FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part)),
    s0 AS (SELECT DISTINCT keyword AS word, regexp_replace(keyword, '^y', 'Y') AS w FROM fw), {STEM_SQL},
    k AS (SELECT framework, theme, 0 AS derived, kw_idx, keyword FROM fw UNION ALL
      SELECT framework, theme, 1, kw_idx, stem FROM fw JOIN stems ON word = keyword),
    f AS (SELECT framework, theme, keyword, min((derived, kw_idx)) AS f FROM k GROUP BY ALL)
    SELECT framework, theme, keyword, (row_number() OVER (PARTITION BY framework, theme ORDER BY f, keyword) - 1)::INT AS kw_idx FROM f
""")
def _(spark, d):
    return N.expand_keywords(_part_keywords(spark, d), stem).drop("theme_idx")


@query("n1_word_stems", f"""
    WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
    n AS (SELECT word, count(*) AS n FROM words GROUP BY 1),
    s0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM n), {STEM_SQL}
    SELECT stem, count(*) AS forms, sum(n)::BIGINT AS occurrences, min(word) AS first_form FROM stems JOIN n USING (word) GROUP BY 1
""")
def _(spark, d):
    """Words of all documents by their stem; every distinct word is stemmed once."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    counted = table(spark, d, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.groupBy(stem("word").alias("stem")).agg(
        F.count("*").alias("forms"), F.sum("n").alias("occurrences"), F.min("word").alias("first_form")
    )


@query("n2_keyword_spans", f'{_HITS} SELECT record_id, theme_key, "start", "end", keywords, sentence FROM spans')
def _(spark, d):
    return _spans(spark, d).select("record_id", "theme_key", "start", "end", "keywords", "sentence")


@query("n3_context_window", f"""
    WITH {DOCS_SQL}, p AS (SELECT record_id, content, instr(lower(content), 'attion') AS pos FROM docs)
    SELECT record_id, CASE WHEN pos > 0 THEN substring(content, greatest(pos - 200, 1)::INT, (pos - greatest(pos - 200, 1) + 206)::INT) ELSE 'attion' END AS context FROM p
""")
def _(spark, d):
    r = docs(spark, d).select("record_id", "content", F.lit("attion").alias("keyword"))
    return N.context_windows(r, size=200).select("record_id", "context")


@query("n4_semantic_similarity", f"{_SCORES} SELECT record_id, framework, theme, round(sim, 4) AS similarity FROM scored")
def _(spark, d):
    pairs = N.theme_keywords(_spans(spark, d)).select("record_id", *N.THEME)
    scored = N.semantic_similarity(pairs, doc_vectors(spark, d), theme_vectors(spark, d))
    return scored.select("record_id", "framework", "theme", F.round("semantic_similarity", 4).alias("similarity"))


# Fallback score without vectors: rows and bounds are property-tested.
@query("n4_tfidf_similarity")
def _(spark, d):
    r = docs(spark, d)
    fw = frameworks(spark)
    described = fw.groupBy("framework", "theme").agg(F.concat_ws(
        " ", F.first("theme"), F.array_join(F.sort_array(F.collect_list("keyword")), " ")
    ).alias("content"))
    theme_docs = described.withColumn("record_id", -F.abs(F.xxhash64("framework", "theme")))
    corpus = r.select("record_id", "content").unionByName(theme_docs.select("record_id", "content"))
    weights = tfidf(corpus)
    theme_weights = weights.join(theme_docs.select("record_id", "framework", "theme"), "record_id")
    pairs = N.theme_keywords(_spans(spark, d)).select("record_id", "framework", "theme")
    return N.tfidf_similarity(pairs, weights, theme_weights)


def _terms_sql(rows: str, text: str, *keys: str) -> str:
    """Weights at unit length of the terms of ``text``, by document frequencies ``df`` of the corpus."""
    names = ", ".join(keys)
    return f"""SELECT {names}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {names})) AS weight FROM (
      SELECT {names}, term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM (
        SELECT {names}, term, count(*) AS tf FROM (SELECT {names}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {rows})
        WHERE NOT list_contains({sql_list(ENGLISH_STOP_WORDS)}, term) GROUP BY ALL) LEFT JOIN df USING (term) CROSS JOIN nd)"""


def _contexts(spark, d):
    """Themes of the reports, contexts of their keywords, and the weights of contexts, themes and documents."""
    r, fw = docs(spark, d), frameworks(spark)
    spans = materialize(_spans(spark, d), "spans")
    counts = materialize(term_counts(r), "counts")
    n_docs = document_count(r)
    vocab = materialize(vocabulary(counts, n_docs), "vocabulary")
    contexts = materialize(T.keyword_contexts(spans, r), "contexts")
    described = fw.groupBy("framework", "theme").agg(F.concat_ws(
        " ", F.first("theme"), F.array_join(F.sort_array(F.collect_list("keyword")), " ")).alias("content"))
    described = described.withColumn("name", F.to_json(F.struct("framework", "theme")))
    themes = T.corpus_weights(described, vocab, n_docs, "content", "name")
    weights = T.corpus_weights(contexts, vocab, n_docs, "context", "context_id")
    return N.theme_keywords(spans), contexts, weights, described, themes, tfidf_weights(counts.join(vocab, "term"))


@query("n4_context_similarity", f"""
    {_HITS}, nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
    df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents) GROUP BY 1),
    keys AS MATERIALIZED (SELECT DISTINCT record_id, framework, theme, keyword FROM hits),
    found AS (SELECT record_id, keyword, text, instr(lower(text), keyword) AS pos FROM (SELECT DISTINCT record_id, keyword FROM keys) JOIN documents ON doc_id = record_id),
    ctx AS (SELECT record_id, keyword, CASE WHEN pos > 0 THEN substring(text, greatest(pos - {T.SIZE}, 1), pos - greatest(pos - {T.SIZE}, 1) + length(keyword) + {T.SIZE}) ELSE keyword END AS context FROM found),
    described AS (SELECT framework, theme, theme || ' ' || string_agg(keyword, ' ') AS content FROM fw GROUP BY framework, theme),
    cw AS MATERIALIZED ({_terms_sql("ctx", "context", "record_id", "keyword")}),
    tw AS MATERIALIZED ({_terms_sql("described", "content", "framework", "theme")}),
    dots AS (SELECT record_id, framework, theme, keyword, sum(cw.weight * tw.weight) AS dot FROM keys JOIN cw USING (record_id, keyword) JOIN tw USING (framework, theme, term) GROUP BY ALL)
    SELECT record_id, framework, theme, round(coalesce(max(dot), 0), 4) AS similarity FROM keys LEFT JOIN dots USING (record_id, framework, theme, keyword) GROUP BY 1, 2, 3
""")
def _(spark, d):
    pairs, contexts, weights, described, themes, _ = _contexts(spark, d)
    named = themes.join(described.select("name", "framework", "theme"), "name")
    placed = contexts.select("context_id", "record_id", "keyword").join(weights, "context_id")
    found = T.context_similarity(pairs, placed, named)
    return found.select("record_id", "framework", "theme", F.round("context_similarity", 4).alias("similarity"))


# The larger of document and context similarity, on projections; a test holds it against exact weights.
@query("n4_projected_similarity")
def _(spark, d):
    pairs, contexts, weights, described, themes, own = _contexts(spark, d)
    theme = described.join(projected(themes, key="name"), "name").select("framework", "theme", F.col("vector").alias("theme_vector"))
    scored = N.semantic_similarity(pairs, projected(own), theme, T.context_vectors(contexts, weights))
    return scored.select("record_id", "framework", "theme", F.round("semantic_similarity", 4).alias("similarity"))


@query("n5_combined_score", f"{_SCORES} SELECT record_id, framework, theme, keyword_count, round(score, 4) AS score FROM scored")
def _(spark, d):
    r = docs(spark, d)
    words = r.select("record_id", N.word_count("content").alias("words"))
    pairs = N.theme_keywords(_spans(spark, d)).join(words, "record_id")
    scored = N.semantic_similarity(pairs, doc_vectors(spark, d), theme_vectors(spark, d))
    score = N.combined_score(F.col("semantic_similarity"), F.col("keyword_count"), F.col("words"))
    return scored.select("record_id", "framework", "theme", F.col("keyword_count").cast("long").alias("keyword_count"), F.round(score, 4).alias("score"))


@query("n6_scored_themes", f"{_SCORES} SELECT record_id, framework, theme, keyword_count, semantic_similarity, combined_score FROM kept")
def _(spark, d):
    return _scored(spark, d).select(
        "record_id", "framework", "theme", F.col("keyword_count").cast("long").alias("keyword_count"),
        "semantic_similarity", "combined_score",
    )


# No theme of the test framework shares a keyword with another theme of its
# framework, so the selection keeps all of the at most three themes.
@query("n6_selected_themes", f"{_SCORES} SELECT record_id, framework, theme, matched_keywords, combined_score FROM kept")
def _(spark, d):
    return N.select_themes(_scored(spark, d)).select(
        "record_id", "framework", "theme", F.array_join("keyword_list", ", ").alias("matched_keywords"), "combined_score"
    )


@query("n7_annotation_table", f"""
    {_SCORES}, {DOCS_SQL}, s AS (SELECT record_id, framework, theme, string_agg(sentence, '; ' ORDER BY "start") AS matched_sentences FROM spans GROUP BY ALL)
    SELECT k.record_id, title, k.framework, k.theme, CASE WHEN combined_score >= 0.7 THEN 'High' WHEN combined_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence,
      combined_score, semantic_similarity, matched_keywords, matched_sentences, coroner_area, "year", date_of_report
    FROM kept k JOIN s USING (record_id, framework, theme) JOIN docs ON docs.record_id = k.record_id
""")
def _(spark, d):
    return _annotations(spark, d)


@query("n8_placeholders", f"""
    {_SCORES}, k AS MATERIALIZED (SELECT record_id, framework, theme, combined_score FROM kept),
    f AS (SELECT DISTINCT framework FROM fw)
    SELECT * FROM k
    UNION ALL SELECT doc_id, f.framework, 'No Themes Detected', 0.0 FROM documents CROSS JOIN f
    LEFT JOIN k ON k.record_id = doc_id AND k.framework = f.framework WHERE k.record_id IS NULL
""")
def _(spark, d):
    found = _scored(spark, d).select("record_id", "framework", "theme", "combined_score")
    all_rows = N.with_placeholders(found, docs(spark, d), frameworks(spark))
    return all_rows.select("record_id", "framework", "theme", "combined_score")


@query("d4_document_heatmap", f"""
    {_SCORES}, {DOCS_SQL}, a AS (SELECT k.*, "year", k.framework || ': ' || theme AS ft FROM kept k JOIN docs USING (record_id)),
    tot AS (SELECT "year", count(DISTINCT record_id) AS total FROM a GROUP BY 1),
    c AS (SELECT "year", framework, ft, count(DISTINCT record_id) AS n FROM a GROUP BY 1, 2, 3)
    SELECT c."year", framework, ft AS framework_theme, n, total, round(n * 100.0 / total, 1)::DOUBLE AS percentage FROM c JOIN tot ON tot."year" = c."year"
""")
def _(spark, d):
    return D.framework_heatmap(_annotations(spark, d)).drop("theme_rank", "theme_total")


_PART_WORDS_SQL = "SELECT DISTINCT p_type AS framework, 'part' AS theme, unnest(string_split(lower(p_name), ' ')) AS keyword FROM part"


def _part_words(spark, d):
    """A type of part is a framework whose keywords are the words of its names."""
    words = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_type").alias("framework"), F.lit("part").alias("theme"), F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")
    ).distinct()
    return words.withColumns({"theme_idx": F.lit(0), "kw_idx": F.lit(0)})


@query("n9_substring_matches", f"""
    WITH {FRAMEWORKS_SQL}, k AS (SELECT framework, theme, keyword FROM fw UNION ALL {_PART_WORDS_SQL})
    SELECT doc_id AS record_id, framework, theme, keyword FROM documents JOIN k ON contains(lower(text), keyword)
""")
def _(spark, d):
    every = frameworks(spark).unionByName(_part_words(spark, d))
    return N.substring_matches(docs(spark, d), every).select("record_id", "framework", "theme", "keyword")


@query("n14_keyword_occurrences", f"""
    WITH {FRAMEWORKS_SQL}, k AS (SELECT keyword FROM fw UNION SELECT keyword FROM ({_PART_WORDS_SQL}) UNION SELECT lower(p_name) FROM part UNION SELECT 'rere'),
    p AS (SELECT doc_id, text, lower(text) AS t, keyword FROM documents JOIN k ON contains(lower(text), keyword)),
    c AS (SELECT doc_id, text, keyword, unnest(s) AS piece, unnest(range(len(s))) AS i FROM (SELECT doc_id, text, keyword, string_split(t, keyword) AS s FROM p)),
    o AS (SELECT doc_id, text, keyword, i, (sum(length(piece) + length(keyword)) OVER (PARTITION BY doc_id, keyword ORDER BY i) - length(keyword))::INT AS pos,
      max(i) OVER (PARTITION BY doc_id, keyword) AS last FROM c)
    SELECT doc_id AS record_id, pos AS "start", pos + length(keyword)::INT AS "end", substring(text, pos + 1, length(keyword)) AS matched FROM o WHERE i < last AND keyword <> 'rere'
    UNION ALL
    SELECT doc_id, i::INT, i::INT + 4, substring(text, i::INT + 1, 4) FROM (SELECT doc_id, text, unnest(range(length(text))) AS i FROM p WHERE keyword = 'rere')
    WHERE lower(substring(text, i::INT + 1, 4)) = 'rere'
""")
def _(spark, d):
    # Every keyword of the frameworks, all part names and their words, and one that overlaps itself.
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("keyword"))
    kw = frameworks(spark).select("keyword").unionByName(_part_words(spark, d).select("keyword")).unionByName(names)
    return S.keyword_occurrences(docs(spark, d), kw.unionByName(spark.createDataFrame([("rere",)], "keyword string")))


@query("w4_merge_spans", f"""
    {_HITS}, o AS (SELECT *, max("end") OVER (PARTITION BY record_id ORDER BY "start", "end", theme_key, keywords ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY "start", "end", theme_key, keywords) AS island FROM o)
    SELECT record_id, min("start") AS "start", max("end") AS "end", string_agg(theme_key, ' + ' ORDER BY "start", "end", theme_key, keywords) AS theme_key,
      string_agg(keywords, ' + ' ORDER BY "start", "end", theme_key, keywords) AS keywords FROM i GROUP BY record_id, island
""")
def _(spark, d):
    return S.merge_spans(_spans(spark, d)).select("record_id", "start", "end", "theme_key", "keywords")


@query("w5_select_themes")
def _(spark, d):
    # Expanded keywords overlap inside a theme only; low scores leave overlaps out.
    return N.select_themes(_scored(spark, d), per_framework=2).select(
        "record_id", "framework", "theme", "combined_score"
    )


# Removing the brackets again gives the text back: checked here by its length.
@query("n10_highlight", f"""
    {_HITS}, o AS (SELECT record_id, "start", max("end") OVER (PARTITION BY record_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT record_id, "start", "end" FROM spans)),
    c AS (SELECT record_id, count(*) FILTER (reach IS NULL OR "start" > reach) AS n FROM o GROUP BY 1)
    SELECT doc_id AS record_id, (length(text) + 2 * coalesce(n, 0))::INT AS n_chars FROM documents LEFT JOIN c ON record_id = doc_id
""")
def _(spark, d):
    r = docs(spark, d)
    marked = S.highlight(r, S.merge_spans(_spans(spark, d)))
    return marked.select("record_id", F.length("highlighted").alias("n_chars"))


# --- sentence classification ------------------------------------------------

def _training(spark, d):
    rows = eval_rows(spark, d)
    return rows.select("record_id", "text", F.col("lang").alias("label"))


def _split(df):
    """Two halves by hash, so each document is on one side for good."""
    half = F.pmod(F.xxhash64("record_id"), F.lit(2))
    return df.withColumn("_half", half)


@query("n11_classify_sentences")
def _(spark, d):
    model = C.train_classifier(C.prepare_labels(_training(spark, d))[0], features=1 << 12, iterations=10)
    return C.classify_sentences(model, docs(spark, d).select("record_id", "title", "content", "year"))


@query("n12_label_preparation", f"""
    WITH {EVAL_SQL}, t AS (SELECT record_id, lower(trim(human)) AS label FROM raw WHERE trim(human) <> '' AND lang = 'en'),
    x AS (SELECT record_id, predicted AS label FROM raw WHERE lang <> 'en')
    SELECT record_id, label FROM x WHERE label IN (SELECT label FROM t)
""")
def _(spark, d):
    rows = eval_rows(spark, d)
    train = rows.filter("lang = 'en'").select("record_id", F.col("human").alias("label"))
    test = rows.filter("lang <> 'en'").select("record_id", F.concat(F.lit(" "), F.upper("predicted")).alias("label"))
    return C.prepare_labels(train, test)[1].select("record_id", "label")


@query("n12_train_and_evaluate")
def _(spark, d):
    halves = _split(_training(spark, d))
    train, test = C.prepare_labels(halves.filter("_half = 0"), halves.filter("_half = 1"))
    model = C.train_classifier(train, features=1 << 12, iterations=10)
    return C.evaluate_classifier(model, test)


@query("n13_append_corrections", f"""
    WITH {EVAL_SQL} SELECT text, lang AS label FROM raw UNION ALL SELECT text, 'poor' FROM raw WHERE lang = 'fr'
""")
def _(spark, d):
    rows = eval_rows(spark, d)
    corrections = rows.filter("lang IN ('fr', 'de')").select(
        "record_id", F.when(F.col("lang") == "fr", "POOR").otherwise("No Theme").alias("selected"))
    predicted = rows.select("record_id", "predicted", F.col("text").alias("sentence"))
    return C.append_corrections(_training(spark, d), V.apply_corrections(predicted, corrections))
