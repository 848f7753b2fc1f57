"""Sources, filters, joins, profile and ordering queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql.types import ArrayType

from reportloom.functions import extract as X, predicates as P, text as T
from reportloom.operators import dedup, profile as A
from reportloom.operators.merge import merge_reports
from reportloom.plans.registry import query
from reportloom.plans.tables import (
    ATTACH_SQL, DOCS_SQL, EVAL_SQL, REPORTS_SQL, attachment_reports, docs, eval_rows,
    reports, table,
)
from reportloom.plans.text_queries import SENTENCES_SQL, SQL_LEMMA, sql_list
from reportloom.schema import ATTACHMENT, reduced_view
from reportloom.session import scratch_path
from reportloom.sources import files, pages
from reportloom.sources.cards import listing_cards


def extracted(spark, d):
    """Order reports with every field taken from their text."""
    raw = reports(spark, d).select("record_id", "ingest_seq", "title", "content")
    return X.process_reports(raw).withColumn("year", F.year("date_of_report"))


@query("flagship_area_by_year", f"""
    WITH {REPORTS_SQL}, c AS (
      SELECT lower(coroner_area) AS area, year(date_of_report)::INT AS "year", count(*) AS n
      FROM facts WHERE date_of_report BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' GROUP BY 1, 2)
    SELECT area, "year", n, round(n * 100.0 / sum(n) OVER (PARTITION BY "year"), 2) AS share_pct FROM c
""")
def _(spark, d):
    # The years are cut after the count: a filter on the extracted date would be
    # pushed into the scan side and extract every date twice.
    found = reports(spark, d).select(
        X.extract_date("content").alias("day"), X.extract_coroner_area("content").alias("area")
    )
    counts = found.groupBy(
        T.clean_coroner_area("area").alias("area"), F.year("day").alias("year")
    ).agg(F.count("*").alias("n")).filter(P.year_between("year", 1995, 2000))
    total = F.sum("n").over(Window.partitionBy("year"))
    return counts.withColumn("share_pct", F.round(F.try_divide(F.col("n") * 100.0, total), 2))


# --- sources and sinks ------------------------------------------------------

@query("s1_read_reports_csv", f"""
    WITH {DOCS_SQL} SELECT record_id::VARCHAR AS record_id, title, length(content) AS n FROM docs
""")
def _(spark, d):
    path = scratch_path(spark, "reports_csv")
    source = docs(spark, d).select("record_id", "title", "content")
    source.write.options(header=True, escape='"', quote='"').csv(path)
    return files.read_reports_csv(spark, path).select("record_id", "title", F.length("content").alias("n"))


@query("s2_stack_files", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, title, NULL AS priority, 'first.csv' AS source_file FROM facts
    UNION ALL SELECT record_id, title, o_orderpriority, 'second.csv' FROM facts WHERE o_orderstatus = 'F'
""")
def _(spark, d):
    r = reports(spark, d)
    parts = {
        "first.csv": r.select("record_id", "title"),
        "second.csv": r.filter("o_orderstatus = 'F'").select(
            "record_id", "title", F.col("o_orderpriority").alias("priority")
        ),
    }
    read = {}
    for name, part in parts.items():
        path = scratch_path(spark, "reports_csv")
        part.write.options(header=True, escape='"', quote='"').csv(path)
        # Each part is a folder of files with names of its own; their columns differ.
        read[name] = files.read_report_folder(spark, path, part.schema).drop("source_file")
    return files.stack_files(read)


def _framework_files(spark, raw):
    """One JSON file per brand, of which there are a few dozen, by the brand's name."""
    path = scratch_path(spark, "frameworks")
    place = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    raw.select("value", place.alias("place")).repartition("place").write.partitionBy("place").text(path)
    names = raw.select("p_brand", place.alias("place")).collect()
    return {r.p_brand: f"{path}/place={r.place}" for r in names}


@query("s3_read_frameworks", """
    SELECT p_brand AS framework, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS theme_idx,
      p_type AS theme, p_name AS keyword
    FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part)
""")
def _(spark, d):
    themes = table(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("name")).agg(
        F.sort_array(F.collect_set("p_name")).alias("keywords")
    )
    # A framework is a list of themes as one JSON text; parts have a few brands.
    raw = themes.groupBy("p_brand").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("name", "keywords")))).alias("value")
    )
    return files.read_frameworks(spark, _framework_files(spark, raw))[0].drop("kw_idx")


@query("s3_framework_rejects", """
    SELECT DISTINCT p_brand AS framework, p_type AS theme, substr(p_name, 1, 2) AS keyword,
      'keyword under three characters' AS reason FROM part
""")
def _(spark, d):
    # Keywords cut to two characters must all come back as rejects.
    themes = table(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("name")).agg(
        F.sort_array(F.collect_set(F.substring("p_name", 1, 2))).alias("keywords")
    )
    raw = themes.groupBy("p_brand").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("name", "keywords")))).alias("value")
    )
    rejects = files.read_frameworks(spark, _framework_files(spark, raw))[1]
    return rejects.select("framework", "theme", "keyword", "reason")


@query("s4_pack_attachments", f"""
    WITH {ATTACH_SQL}
    SELECT record_id, count(*) AS n, string_agg(pos + 1 || ':' || name || ':' || type, ',' ORDER BY pos) AS packed
    FROM att GROUP BY record_id
""")
def _(spark, d):
    reports_in = attachment_reports(spark, d)
    most = reports_in.agg(F.max(F.size("pdfs"))).first()[0] or 0  # columns of the widest report
    one = [F.get("pdfs", F.lit(i)) for i in range(most)]
    parts = {"Name": "name", "Content": "content", "Path": "path", "Type": "type"}
    wide = reports_in.select("record_id", *[
        one[i][field].alias(f"PDF_{i + 1}_{part}") for i in range(most) for part, field in parts.items()
    ])
    item = F.transform("pdfs", lambda p: F.concat_ws(":", p["pos"].cast("string"), p["name"], p["type"]))
    return files.pack_attachments(wide).select(
        "record_id", F.size("pdfs").cast("long").alias("n"), F.array_join(item, ",").alias("packed")
    )


_LINKS = r"""regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
  '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a\s*>')"""


@query("s5_pages_to_reports", f"""
    SELECT page_id AS record_id, url,
      length(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '\\s', '', 'g')) > 0 AS has_title,
      contains(html, '<p>') AS has_text, 0 AS n_pdfs
    FROM pages
""")
def _(spark, d):
    r = pages.pages_to_reports(table(spark, d, "pages"))
    return r.select(
        "record_id", "url", (F.length("title") > 0).alias("has_title"),
        (F.length("content") > 0).alias("has_text"), F.size("pdfs").alias("n_pdfs"),
    )


@query("s5_page_text")
def _(spark, d):
    return pages.pages_to_reports(table(spark, d, "pages")).select("record_id", "title", "content")


@query("s5_listing_cards", r"""
    WITH m AS (SELECT DISTINCT page_id, url, regexp_extract(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
        '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<nav\b[^>]*>(.*?)</nav\s*>', 1) AS nav FROM pages),
    i AS (SELECT page_id, url, unnest(l) AS item, unnest(range(len(l))) AS pos
      FROM (SELECT page_id, url, regexp_extract_all(nav, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1) AS l FROM m)),
    a AS (SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]+)', 1) AS site,
        regexp_extract(item, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href,
        regexp_extract(item, '(?is)<a\b[^>]*\bhref[^>]*>(.*?)</a\s*>', 1) AS body FROM i WHERE regexp_matches(item, '(?i)<a\b[^>]*\bhref'))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS card,
      regexp_replace(strip_accents(replace(replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '[^!-~]', '', 'g') AS title,
      CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS url
    FROM a
""")
def _(spark, d):
    """The entries of the first navigation list of every page as cards; titles without accents, as SQL can't decompose them."""
    found = listing_cards(table(spark, d, "pages"), ("nav", None), ("li", None), ("a", None))
    return found.select("page_id", "card", F.regexp_replace("title", "[^!-~]", "").alias("title"), "url")


@query("s6_page_links", f"""
    WITH a AS (SELECT page_id, url, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, {_LINKS} AS l FROM pages)),
    h AS (SELECT page_id, pos::INT AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) AS site,
      regexp_extract(link, '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS href, lower(link) AS body FROM a)
    SELECT page_id, pos, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href
        WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS link_url,
      CASE WHEN regexp_matches(body, '>[^<]*(response|reply)') THEN 'response' ELSE 'report' END AS link_type,
      regexp_matches(lower(href), '\\.pdf$') AS is_pdf
    FROM h
""")
def _(spark, d):
    return pages.page_links(table(spark, d, "pages")).drop("link_text")


@query("s7_write_reports_csv", f"""
    WITH {REPORTS_SQL} SELECT record_id::VARCHAR AS record_id, strftime(date_of_report, '%d/%m/%Y') AS date_of_report,
      title FROM facts
""")
def _(spark, d):
    path = scratch_path(spark, "export_csv")
    r = extracted(spark, d).select("record_id", "date_of_report", "title", "categories")
    files.write_reports_csv(r, path)
    back = files.read_reports_csv(spark, path)
    return back.select("record_id", "date_of_report", "title")


@query("s8_reduced_view", f"""
    WITH {REPORTS_SQL} SELECT title, date_of_report, ref, deceased_name, coroner_area FROM facts
""")
def _(spark, d):
    r = extracted(spark, d).drop("coroner_name", "categories", "extracted_concerns", "content", "year")
    return reduced_view(r)


@query("s11_attachment_manifest", f"""
    WITH {ATTACH_SQL}, f AS (
      SELECT path, record_id, row_number() OVER (PARTITION BY path ORDER BY record_id, pos) AS rn FROM att)
    SELECT path, 'R-' || record_id || '_Jo_ _A_' || '_2020' AS folder,
      'R-' || record_id || '_Jo_ _A_' || '_2020' || '/' || split_part(path, '/', 4) AS archive_path
    FROM f WHERE rn = 1
""")
def _(spark, d):
    a = attachment_reports(spark, d).withColumns({
        "ref": F.concat(F.lit("R-"), "record_id"), "deceased_name": F.lit("Jo? <A>"), "year": F.lit(2020),
    })
    return files.attachment_manifest(a)


# --- filters ----------------------------------------------------------------

def _ids(df):
    return df.select("record_id")


@query("f1_date_range", f"WITH {DOCS_SQL} SELECT record_id FROM docs WHERE date_of_report BETWEEN DATE '2016-03-01' AND DATE '2019-09-30'")
def _(spark, d):
    return _ids(docs(spark, d).filter(P.date_between("date_of_report", "2016-03-01", "2019-09-30")))


@query("f2_year_range", f"""
    WITH {DOCS_SQL} SELECT record_id, 'range' AS kind FROM docs WHERE "year" BETWEEN 2016 AND 2018
    UNION ALL SELECT record_id, 'single' FROM docs WHERE "year" = 2020
""")
def _(spark, d):
    r = docs(spark, d)
    return r.filter(P.year_between("year", 2016, 2018)).select("record_id", F.lit("range").alias("kind")).unionByName(
        r.filter(P.year_between("year", 2020, 2020)).select("record_id", F.lit("single").alias("kind")))


@query("f3_area_filter", f"WITH {DOCS_SQL} SELECT record_id FROM docs WHERE coroner_area IN ('src1', 'src7')")
def _(spark, d):
    return _ids(docs(spark, d).filter(P.name_in("coroner_area", [" SRC1", "src7 "])))


@query("f4_coroner_filter", f"""
    WITH {REPORTS_SQL} SELECT record_id FROM facts WHERE coroner_name IN ('Dr Customer#000000007', 'Dr Customer#000000011')
""")
def _(spark, d):
    return _ids(extracted(spark, d).filter(
        P.name_in("coroner_name", ["dr customer#000000007", " Dr Customer#000000011"])))


@query("f5_category_any", f"WITH {DOCS_SQL} SELECT record_id FROM docs WHERE list_has_any(categories, ['fr', 'long'])")
def _(spark, d):
    return _ids(docs(spark, d).filter(P.any_category("categories", ["FR ", "long"])))


@query("f6_category_text", f"WITH {REPORTS_SQL} SELECT record_id FROM facts WHERE contains(categories, 'Railway') OR contains(categories, 'Other')")
def _(spark, d):
    r = extracted(spark, d).withColumn("categories", F.array_join("categories", "|"))
    return _ids(r.filter(P.category_text_contains("categories", ["Railway", "Other"])))


@query("f7_document_type", f"""
    WITH {REPORTS_SQL} SELECT record_id, 'Response' AS kind FROM facts WHERE o_orderstatus = 'F'
    UNION ALL SELECT record_id, 'Report' FROM facts WHERE o_orderstatus <> 'F'
""")
def _(spark, d):
    r = reports(spark, d)
    kept = [r.filter(P.document_type([k], pdfs=None)).select("record_id", F.lit(k).alias("kind")) for k in ("Response", "Report")]
    return kept[0].unionByName(kept[1])


@query("f8_keyword_search", f"""
    WITH {DOCS_SQL}, t AS (SELECT record_id, lower(content) AS c FROM docs)
    SELECT record_id, contains(c, 'attion') AND contains(c, 'of the') AS both_words,
      contains(c, 'attion') OR contains(c, 'queaux') AS either_word, contains(c, 'thanedble') AS one_word FROM t
""")
def _(spark, d):
    return docs(spark, d).select(
        "record_id", P.keyword_search("content", "Attion AND of the").alias("both_words"),
        P.keyword_search("content", "attion or QUEAUX").alias("either_word"),
        P.keyword_search("content", " thanedble ").alias("one_word"),
    )


@query("f9_has_concerns", f"WITH {REPORTS_SQL} SELECT record_id FROM facts WHERE length(extracted_concerns) > 20")
def _(spark, d):
    r = reports(spark, d).withColumn("extracted_concerns", X.extract_concerns("content"))
    return _ids(r.filter(P.has_concerns()))


@query("f10_ref_filter", f"""
    WITH {REPORTS_SQL} SELECT record_id FROM facts WHERE ref IN ('1998-0000', '1997-0001', '1996-0100')
      OR deceased_name = 'Customer#000000003'
""")
def _(spark, d):
    r = reports(spark, d).withColumns({"ref": X.extract_ref("content"), "name": X.extract_deceased_name("content")})
    return _ids(r.filter(
        P.value_in("ref", ["1998-0000", "1997-0001", "1996-0100"]) | P.value_in("name", ["Customer#000000003"])))


@query("f11_partial_match", f"""
    WITH {DOCS_SQL} SELECT record_id FROM docs WHERE contains(coroner_area, 'src1') OR contains('source src3', coroner_area)
""")
def _(spark, d):
    return _ids(docs(spark, d).filter(P.partial_match("coroner_area", ["SRC1", "source src3"])))


@query("f13_negation_filter", f"""
    WITH {SENTENCES_SQL}, w AS (
      SELECT record_id, sentence_idx, list_transform(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+(?:[''-][\\p{{L}}\\p{{N}}_]+)*'), lambda x: x) AS ws FROM sent)
    SELECT record_id, sentence_idx FROM w WHERE list_has_any(ws, {sql_list(["thanedble", "attion", "tion"])})
      OR list_has_any(list_transform(ws, lambda w: {SQL_LEMMA}), {sql_list(["thanedble", "attion", "tion"])})
""")
def _(spark, d):
    s = T.split_sentences(docs(spark, d))
    return s.filter(P.contains_negation("sentence", ["thanedble", "attion", "tion"])).select("record_id", "sentence_idx")


@query("f14_has_label", f"WITH {EVAL_SQL} SELECT record_id FROM ev")
def _(spark, d):
    return _ids(eval_rows(spark, d).filter(P.has_label("human")))


@query("f15_category_partial", f"""
    WITH {DOCS_SQL} SELECT record_id FROM docs WHERE len(list_filter(categories, lambda c: contains(c, 'ng') OR contains('french', c))) > 0
""")
def _(spark, d):
    return _ids(docs(spark, d).filter(P.any_category_partial("categories", ["NG", "French"])))


# --- joins ------------------------------------------------------------------

@query("j1_year_totals", f"""
    WITH {DOCS_SQL} SELECT record_id, "year", count(*) OVER (PARTITION BY "year") AS year_total FROM docs
""")
def _(spark, d):
    r = docs(spark, d).select("record_id", "year")
    return r.join(r.groupBy("year").agg(F.count("*").alias("year_total")), "year", "left")


@query("j2_top_area_rows", f"""
    WITH {DOCS_SQL} SELECT record_id, coroner_area FROM docs WHERE coroner_area IN (
      SELECT coroner_area FROM docs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
""")
def _(spark, d):
    r = docs(spark, d).select("record_id", "coroner_area")
    return r.join(A.top_areas(r, 3).select("coroner_area"), "coroner_area", "left_semi")


def duplicated(spark, d):
    """Reports with urgent ones a second time, as a later file; some refs missing."""
    r = reports(spark, d).select(
        "record_id", "ingest_seq", "title", "o_orderpriority",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("fact_ref")).alias("ref"),
        F.concat(F.lit("/report/"), "fact_ref").alias("url"), F.lit("a.csv").alias("source_file"),
    )
    again = r.filter("o_orderpriority = '1-URGENT'").withColumns({
        "ingest_seq": F.col("ingest_seq") + 1_000_000_000, "source_file": F.lit("b.csv"),
    })
    return r.unionByName(again)


_DUP = f"""{REPORTS_SQL}, r AS (
      SELECT record_id, ingest_seq, title, o_orderpriority, CASE WHEN c_mktsegment <> 'MACHINERY' THEN ref END AS ref,
        '/report/' || ref AS url, 'a.csv' AS source_file FROM facts),
    dup AS (SELECT * FROM r UNION ALL
      SELECT record_id, ingest_seq + 1000000000, title, o_orderpriority, ref, url, 'b.csv' FROM r WHERE o_orderpriority = '1-URGENT')"""


@query("j8_new_reports", f"""
    WITH {_DUP}, f AS (SELECT *, row_number() OVER (PARTITION BY title, url ORDER BY ingest_seq) AS rn FROM dup)
    SELECT record_id, source_file FROM f WHERE rn = 1 AND NOT (o_orderpriority IN ('2-HIGH', '3-MEDIUM'))
""")
def _(spark, d):
    batch = duplicated(spark, d)
    seen = reports(spark, d).filter("o_orderpriority IN ('2-HIGH', '3-MEDIUM')").select(
        "title", F.concat(F.lit("/report/"), "fact_ref").alias("url")
    )
    return dedup.new_reports(batch, seen).select("record_id", "source_file")


@query("w1_deduplicate", f"""
    WITH {_DUP}, a AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ingest_seq) AS rn FROM dup),
    b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingest_seq) AS rn2 FROM a WHERE rn = 1)
    SELECT record_id, ref, source_file FROM b WHERE rn2 = 1
""")
def _(spark, d):
    return dedup.deduplicate_reports(duplicated(spark, d), ["ref"]).select("record_id", "ref", "source_file")


@query("w1_deduplicate_keep_null", f"""
    WITH {_DUP}, a AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ingest_seq) AS rn FROM dup)
    SELECT record_id, ref, source_file FROM a WHERE rn = 1 OR ref IS NULL
""")
def _(spark, d):
    return dedup.keep_first(duplicated(spark, d), ["ref"], keep_null_keys=True).select("record_id", "ref", "source_file")


# --- merge step ---------------------------------------------------------------

@query("merge_reports", f"""
    WITH {REPORTS_SQL} SELECT record_id, title, 'a.csv' AS source_file, date_of_report, ref, deceased_name,
      deceased_name AS coroner_name, lower(coroner_area) AS coroner_area, categories, extracted_concerns,
      CASE WHEN o_orderstatus = 'O' THEN 'attachment_1' END AS content_source FROM facts
""")
def _(spark, d):
    # Open orders state their text in an attachment; urgent ones come again in a later file.
    r = reports(spark, d)
    blank_row = F.col("o_orderstatus") == "O"
    pdf = F.struct(
        F.lit(1).alias("pos"), F.lit("letter.pdf").alias("name"), F.col("content").alias("content"),
        F.lit("/files/letter.pdf").alias("path"), F.lit("report").alias("type"),
    ).cast(ATTACHMENT)
    first = r.select(
        "record_id", "ingest_seq", "title", "o_orderpriority",
        F.when(blank_row, " ").otherwise(F.col("content")).alias("content"),
        F.when(blank_row, F.array(pdf)).otherwise(F.array().cast(ArrayType(ATTACHMENT))).alias("pdfs"),
    )
    again = first.filter("o_orderpriority = '1-URGENT'").withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000)
    merged = merge_reports({"a.csv": first.drop("o_orderpriority"), "b.csv": again.drop("o_orderpriority")})
    return merged.select(
        "record_id", "title", "source_file", "date_of_report", "ref", "deceased_name", "coroner_name", "coroner_area",
        F.array_join("categories", "|").alias("categories"), "extracted_concerns", "content_source",
    )


# --- corpus profile ---------------------------------------------------------

_TRUTH = f"WITH {REPORTS_SQL}, r AS (SELECT * FROM facts)"


@query("a1_completeness", f"""
    {_TRUTH}, s AS (SELECT round(avg(CASE WHEN date_of_report IS NOT NULL THEN 100.0 ELSE 0 END), 4) AS p FROM r)
    SELECT * FROM (SELECT unnest(['Title', 'Content', 'Date of Report', 'Deceased Name', 'Coroner Name', 'Coroner Area', 'Categories']) AS field,
      unnest([100.0::DOUBLE, 100.0, p, 100.0, 100.0, 100.0, 100.0]) AS completeness_pct FROM s)
""")
def _(spark, d):
    return A.completeness(extracted(spark, d)).withColumn("completeness_pct", F.round("completeness_pct", 4))


@query("a2_consistency", f"""
    {_TRUTH}, s AS (SELECT round(avg(CASE WHEN date_of_report IS NOT NULL THEN 100.0 ELSE 0 END), 4) AS p,
      round(avg(CASE WHEN length(title) >= 10 THEN 100.0 ELSE 0 END), 4) AS t FROM r)
    SELECT * FROM (SELECT unnest(['Title Format', 'Content Length', 'Date Format', 'Categories Format']) AS metric,
      unnest([t, 100.0::DOUBLE, p, 100.0]) AS consistency_pct FROM s)
""")
def _(spark, d):
    return A.consistency(extracted(spark, d)).withColumn("consistency_pct", F.round("consistency_pct", 4))


@query("a3_attachment_coverage", f"""
    WITH {ATTACH_SQL}, c AS (SELECT record_id, count(*) AS n FROM att GROUP BY 1),
    s AS (SELECT round(avg(CASE WHEN n > 0 THEN 100.0 ELSE 0 END), 4) AS a, round(avg(CASE WHEN n > 1 THEN 100.0 ELSE 0 END), 4) AS b FROM c)
    SELECT * FROM (SELECT unnest(['Reports with PDFs', 'Reports with Multiple PDFs']) AS metric, unnest([a, b]) AS coverage_pct FROM s)
""")
def _(spark, d):
    return A.attachment_coverage(attachment_reports(spark, d)).withColumn("coverage_pct", F.round("coverage_pct", 4))


def _with_attachments(spark, d):
    return extracted(spark, d).withColumn("pdfs", F.when(
        F.size("categories") > 1, F.array(F.struct(
            F.lit(1).alias("pos"), F.lit("a").alias("name"), F.lit("x").alias("content"),
            F.col("ref").alias("path"), F.lit("report").alias("type")))
    ))


_QUALITY = f"""{_TRUTH}, s AS (
      SELECT avg(CASE WHEN date_of_report IS NOT NULL THEN 100.0 ELSE 0 END) AS p,
        avg(CASE WHEN length(title) >= 10 THEN 100.0 ELSE 0 END) AS t,
        avg(CASE WHEN c_mktsegment = 'FURNITURE' THEN 100.0 ELSE 0 END) AS f FROM r)"""


@query("a4_quality_issues", f"""
    {_QUALITY}
    SELECT 'completeness' AS area, 'Date of Report' AS metric, round(p, 4) AS pct FROM s WHERE p < 95
    UNION ALL SELECT 'consistency', 'Title Format', round(t, 4) FROM s WHERE t < 90
    UNION ALL SELECT 'consistency', 'Date Format', round(p, 4) FROM s WHERE p < 90
    UNION ALL SELECT 'coverage', 'Reports with PDFs', round(f, 4) FROM s WHERE f < 90
""")
def _(spark, d):
    return A.quality_issues(_with_attachments(spark, d)).withColumn("pct", F.round("pct", 4))


@query("a4_quality_summary", f"""
    {_QUALITY} SELECT round((600 + p) / 7, 4) AS avg_completeness, round((200 + p + t) / 4, 4) AS avg_consistency,
      round(f, 4) AS pdf_coverage FROM s
""")
def _(spark, d):
    s = A.quality_summary(_with_attachments(spark, d))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


@query("a5_validate_data", f"""
    WITH {_DUP} SELECT count(*) AS row_count, count(*) - count(DISTINCT (title, coalesce(ref, '?'))) AS duplicates,
      1.0::DOUBLE AS quality_score, 'duplicates' AS warnings, true AS is_valid FROM dup
""")
def _(spark, d):
    r = duplicated(spark, d).withColumn("content", F.col("url"))
    return A.validate_data(r).select("row_count", "duplicates", "quality_score", "warnings", "is_valid")


@query("a6_category_counts", f"""
    WITH {REPORTS_SQL} SELECT category, count(*) AS n FROM (SELECT unnest(string_split(categories, '|')) AS category FROM facts) GROUP BY 1
""")
def _(spark, d):
    return A.category_counts(X.extract_categories(reports(spark, d)))


@query("a7_top_areas", f"WITH {REPORTS_SQL} SELECT coroner_area, count(*) AS n FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return A.top_areas(reports(spark, d).select(X.extract_coroner_area("content").alias("coroner_area")))


@query("a8_monthly_timeline", """
    WITH e AS (SELECT o_orderdate::DATE AS d FROM orders),
    c AS (SELECT date_trunc('month', d)::DATE AS month, count(*) AS n FROM e GROUP BY 1)
    SELECT s.month, coalesce(n, 0) AS n FROM (
      SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM c) s LEFT JOIN c ON s.month = c.month
""")
def _(spark, d):
    o = table(spark, d, "orders")
    return A.monthly_timeline(o.select(F.to_date("o_orderdate").alias("date_of_report")))


def _dated(spark, d):
    return reports(spark, d).select(X.extract_date("content").alias("date_of_report"))


@query("a9_month_labels", f"""
    WITH {REPORTS_SQL} SELECT date_trunc('month', date_of_report)::DATE AS month, strftime(date_trunc('month', date_of_report), '%B %Y') AS month_year,
      count(*) AS n FROM facts WHERE date_of_report IS NOT NULL GROUP BY 1, 2
""")
def _(spark, d):
    return A.month_label_counts(_dated(spark, d))


@query("a10_year_counts", f"""
    WITH {REPORTS_SQL} SELECT year(date_of_report)::INT AS "year", count(*) AS n FROM facts WHERE date_of_report IS NOT NULL GROUP BY 1
""")
def _(spark, d):
    return A.year_counts(_dated(spark, d))


@query("a11_seasonality", f"""
    WITH {REPORTS_SQL}, c AS (SELECT month(date_of_report) AS m, count(*) AS n FROM facts GROUP BY 1)
    SELECT r.m::INT AS month_no, coalesce(n, 0) AS n FROM range(1, 13) r(m) LEFT JOIN c ON c.m = r.m
""")
def _(spark, d):
    return A.seasonality(_dated(spark, d))


@query("a12_changed_counts", f"""
    WITH {REPORTS_SQL} SELECT 'coroner_name' AS field, count(*) AS changed FROM facts
    UNION ALL SELECT 'coroner_area', count(*) FROM facts UNION ALL SELECT 'deceased_name', 0 FROM (SELECT 1)
""")
def _(spark, d):
    r = extracted(spark, d)
    return A.changed_counts(r, {
        "coroner_name": ("coroner_name", T.clean_coroner_name("coroner_name")),
        "coroner_area": ("coroner_area", T.clean_coroner_area("coroner_area")),
        "deceased_name": ("deceased_name", T.clean_deceased_name("deceased_name")),
    })


# --- sorts, limits, unions --------------------------------------------------

@query("o1_sort_reports", f"WITH {REPORTS_SQL} SELECT record_id, date_of_report FROM facts ORDER BY 2, 1")
def _(spark, d):
    r = reports(spark, d).select("record_id", X.extract_date("content").alias("date_of_report"))
    return A.sort_reports(r)


@query("o2_top_customers", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return A.top_n(counts, 10, "n", "o_custkey")


@query("o3_union_by_name", """
    SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer
""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return files.union_by_name(s, c)


@query("o4_option_lists", f"""
    WITH {DOCS_SQL} SELECT DISTINCT coroner_area AS option, 'area' AS kind FROM docs
    UNION ALL SELECT DISTINCT unnest(categories), 'category' FROM docs
""")
def _(spark, d):
    r = docs(spark, d)
    return A.option_list(r, "coroner_area").withColumn("kind", F.lit("area")).unionByName(
        A.option_list(r, "categories", explode=True).withColumn("kind", F.lit("category")))
