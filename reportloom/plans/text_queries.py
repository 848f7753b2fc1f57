"""Cleaning and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import extract as X, text as T
from reportloom.functions.constants import BOILERPLATE, CHARACTER_FIXES, ENGLISH_STOP_WORDS
from reportloom.plans.registry import query
from reportloom.plans.tables import (
    ATTACH_SQL, DOCS_SQL, REPORTS_SQL, attachment_reports, docs, reports, table,
    uk_ordinal,
)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_replace(expression: str, pairs) -> str:
    for old, new in pairs:
        old, new = (v.replace("'", "''") for v in (old, new))
        expression = f"replace({expression}, '{old}', '{new}')"
    return expression


def sql_drop(expression: str, patterns, to: str = "") -> str:
    for p in patterns:
        p = p.replace("'", "''")
        expression = f"regexp_replace({expression}, '{p}', '{to}', 'g')"
    return expression


# --- text cleaning ----------------------------------------------------------

_CLEAN = sql_drop(sql_replace("text", CHARACTER_FIXES), ["<[^>]+>"])
_CLEAN = f"regexp_replace(strip_accents({_CLEAN}), '[\\x00-\\x09\\x0b-\\x1f\\x7f]', ' ', 'g')"
_CLEAN = sql_drop(sql_drop(_CLEAN, [" +"], " "), [r"\n+"], "\n")
_CLEAN = f"regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g')"


# The cleaned text is compared without combining marks, which the other engine
# cannot split off by NFKD.
@query("t1_clean_text", f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def _(spark, d):
    cleaned = T.clean_text("content")
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"), cleaned.alias("clean")
    ).withColumn("clean", F.regexp_replace("clean", r"\p{M}", ""))


MODEL_PATTERNS = [
    r"http\S+|www\S+",
    r"\S+@\S+",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{T.MONTHS})\s+\d{{4}}\b",
    r"\b\d{1,2}:\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b(?:ref|reference|case)(?:\s+no)?\.?\s*[-:\s]?\s*\w+[-\d]+\b",
    r"\b(?:regulation|paragraph|section|subsection|article)\s+\d+\b",
    r"\b(?:coroner|inquest|hearing|evidence|witness|statement|report|dated|signed)\b",
]


def sql_model_text(column: str) -> str:
    base = f"regexp_replace({sql_drop(f'lower({column})', MODEL_PATTERNS)}, '[^a-z]+', ' ', 'g')"
    kept = f"list_filter(string_split({base}, ' '), lambda w: length(w) > 2)"
    return f"CASE WHEN len({kept}) >= 3 THEN array_to_string({kept}, ' ') ELSE '' END"


@query("t2_clean_text_for_modeling", f"SELECT doc_id, {sql_model_text('text')} AS clean FROM documents")
def _(spark, d):
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"), T.clean_text_for_modeling("content").alias("clean")
    )


@query("t3_clean_deceased_name", "SELECT c_custkey, c_name AS name FROM customer")
def _(spark, d):
    dirty = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("Deceased Name: "), "c_name", F.lit("  Coroner A. Smith")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" name of deceased "), "c_name", F.lit(" Ref 2020-1")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat("c_name", F.lit(" (aged 50)")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Deceased person: "), "c_name", F.lit(" ")))
        .otherwise(F.col("c_name"))
    )
    return table(spark, d, "customer").select("c_custkey", T.clean_deceased_name(dirty).alias("name"))


@query("t4_clean_coroner_name", "SELECT c_custkey, c_name AS name FROM customer")
def _(spark, d):
    dirty = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("Dr Dr. "), "c_name", F.lit(" QC")))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Mrs "), "c_name", F.lit(" Esq.")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("HM Judge "), "c_name", F.lit(" (Assistant)")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Professor  "), "c_name", F.lit(" Coroner for East")))
        .otherwise(F.concat("c_name", F.lit(";")))
    )
    return table(spark, d, "customer").select("c_custkey", T.clean_coroner_name(dirty).alias("name"))


@query("t5_clean_coroner_area", """
    SELECT s_suppkey, lower(n_name) || ' city and district' AS area
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def _(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    dirty = F.when(F.col("s_acctbal") > 0, F.concat(
        F.lit("The "), "n_name", F.lit(" (City) & District | Category: Other")
    )).otherwise(F.concat(F.lit("- "), "n_name", F.lit(" [CITY] and the-District This Report is being sent to: X")))
    return joined.select("s_suppkey", T.clean_coroner_area(dirty).alias("area"))


@query("t6_clean_categories", """
    SELECT p_partkey, p_type || ' and ' || p_name || '|' || p_brand AS categories FROM part
""")
def _(spark, d):
    dirty = F.array(
        F.concat("p_type", F.lit(" & "), "p_name", F.lit(" (old) This report is being sent to: X")),
        F.concat("p_brand", F.lit(" These reports are done")),
    )
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(T.clean_categories(dirty), "|").alias("categories")
    )


@query("t7_normalize_category", """
    SELECT p_partkey, lower(p_type) || ' ' || p_name || ' related' AS category FROM part
""")
def _(spark, d):
    dirty = F.concat("p_type", F.lit(" -  "), "p_name", F.lit(";  Related "))
    return table(spark, d, "part").select("p_partkey", T.normalize_category(dirty).alias("category"))


@query("t8_match_category", """
    SELECT c_custkey, CASE c_mktsegment
      WHEN 'AUTOMOBILE' THEN 'Road Highways Safety related deaths'
      WHEN 'BUILDING' THEN 'Railway related deaths'
      WHEN 'FURNITURE' THEN 'Product related deaths'
      WHEN 'HOUSEHOLD' THEN 'Suicide from 2015'
      ELSE 'Unlisted matter' END AS category FROM customer
""")
def _(spark, d):
    raw = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "ROAD  highways safety related deaths")
        .when(F.col("c_mktsegment") == "BUILDING", "railway")
        .when(F.col("c_mktsegment") == "FURNITURE", "all product related deaths, please")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Suicide - from 2015")
        .otherwise("Unlisted matter")
    )
    return table(spark, d, "customer").select("c_custkey", T.match_category(raw).alias("category"))


def sql_basic(column: str) -> str:
    text = sql_drop(f"lower({column})", ["<.*?>", r"http\S+|www\S+", r"\S+@\S+", r"[^\p{L}\p{N}_\s']", r"\p{Nd}+"], " ")
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


@query("t9_clean_text_basic", f"SELECT doc_id, {sql_basic('text')} AS clean FROM documents")
def _(spark, d):
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"), T.clean_text_basic("content").alias("clean")
    )


PHRASES = ["of the", "in the", "and the"]
_BOILED = sql_replace(sql_basic("text"), [(p, " ") for p in PHRASES])
_BOILED = f"trim(regexp_replace({_BOILED}, '\\s+', ' ', 'g'))"


@query("t10_remove_boilerplate", f"SELECT doc_id, {_BOILED} AS clean FROM documents")
def _(spark, d):
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"),
        T.remove_boilerplate(T.clean_text_basic("content"), PHRASES).alias("clean"),
    )


def sql_stop(expression: str, words) -> str:
    return (
        f"array_to_string(list_filter(string_split({expression}, ' '), "
        f"lambda w: w <> '' AND NOT list_contains({sql_list(words)}, w)), ' ')"
    )


@query("t11_remove_stopwords", f"SELECT doc_id, {sql_stop(sql_basic('text'), ENGLISH_STOP_WORDS)} AS clean FROM documents")
def _(spark, d):
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"),
        T.remove_stopwords(T.clean_text_basic("content"), ENGLISH_STOP_WORDS).alias("clean"),
    )


SQL_LEMMA = (
    "CASE WHEN regexp_matches(w, '(ss|us|is)$') OR length(w) < 4 THEN w "
    "WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') "
    "WHEN regexp_matches(w, '(ch|sh|s|x|z)es$') THEN regexp_replace(w, 'es$', '') "
    "ELSE regexp_replace(w, 's$', '') END"
)


def sql_lemmas(expression: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(string_split({expression}, ' '), "
        f"lambda w: w <> ''), lambda w: {SQL_LEMMA}), ' ')"
    )


@query("t12_lemmatize_tokens", f"SELECT doc_id, {sql_lemmas(sql_basic('text'))} AS clean FROM documents")
def _(spark, d):
    return docs(spark, d).select(
        F.col("record_id").alias("doc_id"),
        T.lemmatize_tokens(T.clean_text_basic("content")).alias("clean"),
    )


_ALL_STOPS = [*ENGLISH_STOP_WORDS, *T.DOMAIN_STOP_WORDS]
_FULL = sql_lemmas(sql_stop(
    f"trim(regexp_replace({sql_replace(sql_basic('text'), [(p, ' ') for p in BOILERPLATE])}, '\\s+', ' ', 'g'))",
    _ALL_STOPS,
))
_PRE = f"""
    pre AS (
      SELECT doc_id, processed, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS original_words,
        len(list_filter(string_split(processed, ' '), lambda w: w <> '')) AS processed_words
      FROM (SELECT doc_id, text, {_FULL} AS processed FROM documents)),
    red AS (SELECT *, coalesce(round((1 - processed_words::DOUBLE / nullif(original_words, 0)) * 100, 2), 0) AS reduction_pct FROM pre)
"""


@query("t13_preprocess_corpus", f"WITH {_PRE} SELECT doc_id, original_words, processed_words, reduction_pct FROM red")
def _(spark, d):
    rows = docs(spark, d).withColumnRenamed("record_id", "doc_id")
    return T.preprocess_corpus(rows).select("doc_id", "original_words", "processed_words", "reduction_pct")


@query("t13_preprocess_summary", f"""
    WITH {_PRE} SELECT count(*) AS documents, count(*) FILTER (processed = '') AS empty_documents,
      round(avg(reduction_pct), 2) AS avg_reduction_pct FROM red
""")
def _(spark, d):
    return T.preprocess_summary(T.preprocess_corpus(docs(spark, d)))


@query("t14_slug_from_filename", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part")
def _(spark, d):
    name = F.initcap("p_name")
    file = (
        F.when(F.col("p_type") == "STANDARD", F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-Prevention-of-future-deaths-report-2020-0001.pdf")))
        .when(F.col("p_type") == "ECONOMY", F.concat(name, F.lit(" REGULATION 28 REPORT.pdf")))
        .when(F.col("p_type") == "LARGE", F.concat(name, F.lit(" 2021-0007 final.pdf")))
        .when(F.col("p_type") == "PROMO", F.concat(name, F.lit("__.docx")))
        .otherwise(F.concat(name, F.lit("!.pdf")))
    )
    return table(spark, d, "part").select("p_partkey", T.slug_from_filename(file).alias("slug"))


@query("t15_combine_document_text", f"""
    WITH {ATTACH_SQL}
    SELECT record_id, 'Case ' || record_id
      || coalesce(' ' || max(CASE WHEN role = 'system' THEN text END), '')
      || ' ' || string_agg(content, ' ' ORDER BY pos) AS combined
    FROM att GROUP BY record_id
""")
def _(spark, d):
    return attachment_reports(spark, d).select("record_id", T.combine_document_text().alias("combined"))


@query("t16_document_identifier", f"""
    WITH {REPORTS_SQL} SELECT record_id, title || '_' || ref || '_' || deceased_name AS identifier FROM facts
""")
def _(spark, d):
    r = reports(spark, d)
    return r.select("record_id", T.document_identifier("title", "fact_ref", "c_name").alias("identifier"))


@query("t17_format_date_uk", f"""
    WITH {REPORTS_SQL} SELECT record_id, coalesce(strftime(date_of_report, '%d/%m/%Y'), '') AS uk_date FROM facts
""")
def _(spark, d):
    r = reports(spark, d)
    return r.select("record_id", T.format_date_uk(X.extract_date("content")).alias("uk_date"))


@query("t18_confidence_label", """
    SELECT doc_id, CASE WHEN n_chars / 4000.0 >= 0.7 THEN 'High' WHEN n_chars / 4000.0 >= 0.5 THEN 'Medium' ELSE 'Low' END AS live_label,
      CASE WHEN n_chars / 4000.0 >= 0.8 THEN 'High' WHEN n_chars / 4000.0 >= 0.65 THEN 'Medium' ELSE 'Low' END AS strict_label
    FROM documents
""")
def _(spark, d):
    score = F.col("n_chars") / 4000.0
    return table(spark, d, "documents").select(
        "doc_id", T.confidence_label(score).alias("live_label"),
        T.confidence_label(score, 0.8, 0.65).alias("strict_label"),
    )


SENTENCES_SQL = r"""
pieces AS (
  SELECT doc_id, idx, piece, length(piece) AS n, max(idx) OVER (PARTITION BY doc_id) AS last_idx
  FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS idx FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents))
),
sent AS (
  SELECT record_id, sentence_idx, "start", "start" + length(sentence) AS "end", sentence FROM (
    SELECT doc_id AS record_id, idx::INT AS sentence_idx,
      (coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS "start",
      CASE WHEN idx = last_idx THEN piece ELSE regexp_replace(piece, '\s+$', '') END AS sentence
    FROM pieces) WHERE trim(sentence) <> ''
)"""


@query("t19_split_sentences", f'WITH {SENTENCES_SQL} SELECT record_id, sentence_idx, "start", "end", sentence FROM sent')
def _(spark, d):
    return T.split_sentences(docs(spark, d))


# --- metadata extraction ----------------------------------------------------

@query("m1_extract_date", f"WITH {REPORTS_SQL} SELECT record_id, date_of_report FROM facts")
def _(spark, d):
    return reports(spark, d).select("record_id", X.extract_date("content").alias("date_of_report"))


@query("m2_extract_fields", f"WITH {REPORTS_SQL} SELECT record_id, ref, deceased_name, coroner_name, coroner_area FROM facts")
def _(spark, d):
    return reports(spark, d).select(
        "record_id", X.extract_ref("content").alias("ref"),
        X.extract_deceased_name("content").alias("deceased_name"),
        X.extract_coroner_name("content").alias("coroner_name"),
        X.extract_coroner_area("content").alias("coroner_area"),
    )


@query("m3_extract_categories", f"WITH {REPORTS_SQL} SELECT record_id, categories FROM facts")
def _(spark, d):
    return X.extract_categories(reports(spark, d)).select(
        "record_id", F.array_join("categories", "|").alias("categories")
    )


@query("m4_extract_concerns", f"WITH {REPORTS_SQL} SELECT record_id, extracted_concerns FROM facts")
def _(spark, d):
    return reports(spark, d).select("record_id", X.extract_concerns("content").alias("extracted_concerns"))


@query("m5_process_reports", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, title, date_of_report, ref, deceased_name, coroner_name, coroner_area, categories, extracted_concerns FROM facts
""")
def _(spark, d):
    raw = reports(spark, d).select("record_id", "title", "content")
    return X.process_reports(raw).withColumn("categories", F.array_join("categories", "|")).drop("content")


@query("m6_parse_date_any", f"""
    WITH {REPORTS_SQL} SELECT record_id, CASE WHEN c_mktsegment <> 'FURNITURE' THEN full_date END AS parsed FROM facts
""")
def _(spark, d):
    day = F.col("fact_date")
    text = (
        F.when(F.col("c_mktsegment") == "FURNITURE", "not known")
        .when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, " dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "dd-MM-yyyy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.date_format(day, "d MMM yyyy"))
        .otherwise(F.concat(F.dayofmonth(day).cast("string"), F.lit("th"), F.date_format(day, " MMMM yyyy")))
    )
    return reports(spark, d).select("record_id", X.parse_date_any(text).alias("parsed"))


@query("m7_report_year", f"""
    WITH {REPORTS_SQL} SELECT record_id, year(date_of_report)::INT AS from_date, year(full_date)::INT AS from_text FROM facts
""")
def _(spark, d):
    return reports(spark, d).select(
        "record_id", X.report_year(X.extract_date("content")).alias("from_date"),
        X.report_year_text(F.date_format("fact_date", "dd/MM/yyyy")).alias("from_text"),
    )


@query("m8_backfill_year", f"""
    WITH {REPORTS_SQL}, t AS (
      SELECT *, nullif(regexp_extract(title, '\\b(19|20)\\d\\d\\b', 0), '')::INT AS title_year FROM facts)
    SELECT record_id,
      CASE WHEN date_of_report IS NOT NULL THEN year(date_of_report)::INT
           WHEN title_year IS NOT NULL THEN title_year ELSE year(full_date)::INT END AS "year",
      CASE WHEN date_of_report IS NOT NULL THEN NULL
           WHEN title_year IS NOT NULL THEN 'extracted_from_title' ELSE 'year_in_content' END AS year_source
    FROM t
""")
def _(spark, d):
    r = reports(spark, d).withColumn("year", X.report_year(X.extract_date("content")))
    return X.backfill_year(r, current_year=2025).select("record_id", "year", "year_source")


_FILLED = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.[^.]*$', '.')"


@query("m9_fill_content", f"""
    WITH {ATTACH_SQL}, c AS (
      SELECT record_id, max(CASE WHEN role = 'system' THEN text END) AS own, arg_min(content, pos) AS first FROM att GROUP BY 1)
    SELECT record_id, coalesce(own, first) AS content, CASE WHEN own IS NULL THEN 'attachment_1' END AS content_source FROM c
""")
def _(spark, d):
    return X.fill_content_from_attachment(attachment_reports(spark, d)).select(
        "record_id", "content", "content_source"
    )


@query("m10_fill_concerns", f"""
    WITH {ATTACH_SQL}, c AS (
      SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS i, role, {_FILLED} AS t FROM att),
    f AS (SELECT record_id, min(i) AS i FROM c WHERE role = 'assistant' AND length(t) > 20 GROUP BY 1)
    SELECT r.record_id, c.t AS extracted_concerns, 'attachment_' || c.i AS concern_source
    FROM (SELECT DISTINCT record_id FROM att) r
    LEFT JOIN f ON r.record_id = f.record_id LEFT JOIN c ON c.record_id = f.record_id AND c.i = f.i
""")
def _(spark, d):
    return X.fill_concerns_from_attachments(attachment_reports(spark, d)).select(
        "record_id", "extracted_concerns", "concern_source"
    )


@query("m11_missing_concerns", f"""
    WITH {REPORTS_SQL} SELECT record_id FROM facts WHERE length(extracted_concerns) < 20
""")
def _(spark, d):
    r = reports(spark, d).withColumn("extracted_concerns", X.extract_concerns("content"))
    return X.missing_concerns(r).select("record_id")


@query("m12_is_response", f"""
    WITH {REPORTS_SQL}, {ATTACH_SQL}
    SELECT 'order' AS kind, record_id, o_orderstatus = 'F' AS is_response FROM facts
    UNION ALL
    SELECT 'case', record_id, bool_or(role = 'assistant') FROM att GROUP BY record_id
""")
def _(spark, d):
    by_title = reports(spark, d).select(
        F.lit("order").alias("kind"), "record_id", X.is_response(pdfs=None).alias("is_response")
    )
    by_file = attachment_reports(spark, d).select(
        F.lit("case").alias("kind"), "record_id", X.is_response(content=F.lit("")).alias("is_response")
    )
    return by_title.unionByName(by_file)


@query("m13_letter_fields", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, CASE WHEN o_orderstatus = 'O' THEN 'Re: ' || title ELSE '' END AS subject,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL
           WHEN c_mktsegment = 'BUILDING' THEN 'spring of ' || year(full_date)
           ELSE strftime(full_date, '%d/%m/%Y') END AS date_of_report,
      CASE WHEN c_mktsegment <> 'FURNITURE' THEN year(full_date)::INT END AS "year",
      'Trust Agency 1 High Street' AS sender_address, deceased_name AS addressee,
      'Second line' || chr(10) || 'Third line' AS body,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 'failed' ELSE 'success' END AS status
    FROM facts
""")
def _(spark, d):
    r = reports(spark, d)
    day = F.col("fact_date")
    stated = (
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit(None))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Date: spring of "), F.year(day)))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Dated "), F.concat(uk_ordinal(F.dayofmonth(day)), F.date_format(day, " MMMM yyyy"))))
        .otherwise(F.concat(F.lit("DATE:  "), F.date_format(day, "d MMMM yyyy")))
    )
    pad = F.lit("\n \n".join(["filler", "filler", "filler", "filler", "filler", "filler", "filler", "filler"]))
    letter = F.concat_ws(
        "\n", F.lit(" Trust Agency "), F.lit("1 High Street"), pad,
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Re: "), "title")), stated,
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("To "), "c_name", F.lit(":")))
        .otherwise(F.concat(F.lit("Dear "), "c_name", F.lit(","))),
        F.lit("First line"), F.lit("Second line"), F.lit("Third line"),
    )
    return X.letter_fields(r.select("record_id", letter.alias("text"))).drop("text")


@query("m14_local_report", f"""
    WITH {REPORTS_SQL} SELECT record_id, title AS title, 'Local File Only' AS url,
      CASE WHEN o_orderstatus = 'F' THEN 'Response' ELSE 'Report' END AS report_type FROM facts
""")
def _(spark, d):
    r = reports(spark, d).select(
        "record_id", F.concat("title", F.lit(".pdf")).alias("filename"), F.col("title").alias("content")
    )
    return X.local_report(r).select("record_id", "title", "url", "report_type")


def _sectioned(spark, d):
    return reports(spark, d).select("record_id", "title", F.concat(
        F.lit("Ref: "), "fact_ref", F.lit("\nDate of report: "), F.date_format("fact_date", "dd/MM/yyyy"),
        F.lit("\nCIRCUMSTANCES OF THE DEATH\n"), "n_name",
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" CORONER'S CONCERNS "), "o_orderpriority")).otherwise(""),
        F.lit(" MATTERS OF CONCERN "), "c_name", F.lit("\n\nend"),
    ).alias("content"))


# Position and source of a section are property-tested, its text is compared.
@query("m15_extract_sections", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, CASE WHEN o_orderstatus = 'P' THEN coroner_area || ' MATTERS OF CONCERN ' || deceased_name || chr(10) || chr(10) || 'end' ELSE coroner_area END AS circumstances,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS concerns, deceased_name AS actions, ref AS label_ref
    FROM facts
""")
def _(spark, d):
    found = X.extract_sections(_sectioned(spark, d))
    return found.select(
        "record_id", F.col("circumstances.content").alias("circumstances"),
        F.col("concerns.content").alias("concerns"), F.col("actions.content").alias("actions"), "label_ref",
    )


@query("m16_document_summary", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.6667 END::DOUBLE AS confidence,
      'Prevention of Future Deaths report ' || ref || ' dated ' || strftime(full_date, '%d/%m/%Y') AS opening
    FROM facts
""")
def _(spark, d):
    found = X.document_summary(_sectioned(spark, d))
    return found.select("record_id", "confidence", F.trim(F.substring_index("abstractive", "\n", 1)).alias("opening"))


@query("m17_extract_concerns_window", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE ': ' || o_orderpriority || ' issue was found. More follows' END AS concerns FROM facts
""")
def _(spark, d):
    return reports(spark, d).select("record_id", X.extract_concerns_window("content").alias("concerns"))
