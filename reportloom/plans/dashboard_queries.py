"""Annotation dashboard and annotator evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import predicates as P
from reportloom.operators import dashboard as D, evaluate as V
from reportloom.plans.registry import query
from reportloom.plans.tables import ANNOTATIONS_SQL, EVAL_SQL, eval_rows, line_annotations

A = f"WITH {ANNOTATIONS_SQL}"
TOP = """
    top{n} AS (SELECT theme, row_number() OVER (ORDER BY count(*) DESC, theme) AS theme_rank
      FROM ann GROUP BY theme QUALIFY theme_rank <= {n})"""


def top(n: int) -> str:
    return TOP.format(n=n)


@query("f12_dashboard_filter", f"""
    {A} SELECT record_id, theme FROM ann WHERE framework = 'Alpha' AND "year" BETWEEN 1997 AND 1999
      AND coroner_area IN ('NATION_1', 'NATION_2', 'NATION_3') AND confidence IN ('High', 'Low')
""")
def _(spark, d):
    kept = P.dashboard_filter(
        line_annotations(spark, d), framework="Alpha", years=(1997, 1999),
        areas=["NATION_1", "NATION_2", "NATION_3"], confidence=["High", "Low"],
    )
    return kept.select("record_id", "theme")


@query("d1_overview", f"""
    {A} SELECT count(*) AS n_rows, count(DISTINCT theme) AS themes, count(DISTINCT coroner_area) AS areas,
      count(DISTINCT "year") AS years FROM ann
""")
def _(spark, d):
    return D.overview(line_annotations(spark, d))


@query("d2_framework_counts", f"{A} SELECT framework, count(*) AS n FROM ann GROUP BY 1")
def _(spark, d):
    return D.framework_counts(line_annotations(spark, d))


@query("d3_theme_counts", f"{A} SELECT framework, theme, count(*) AS n FROM ann GROUP BY 1, 2")
def _(spark, d):
    return D.theme_counts(line_annotations(spark, d))


_HEAT = f"""{A}, r AS (SELECT *, framework || ': ' || theme AS framework_theme FROM ann WHERE "year" IS NOT NULL),
    tot AS (SELECT "year", count(DISTINCT record_id) AS total FROM r GROUP BY 1),
    cnt AS (SELECT "year", framework, framework_theme, count(DISTINCT record_id) AS n FROM r GROUP BY 1, 2, 3),
    best AS (SELECT framework, framework_theme, sum(n)::BIGINT AS theme_total,
        row_number() OVER (PARTITION BY framework ORDER BY sum(n) DESC, framework_theme)::INT AS theme_rank
      FROM cnt GROUP BY 1, 2 QUALIFY theme_rank <= 5),
    heat AS (SELECT cnt.framework, cnt.framework_theme, theme_rank, theme_total, cnt."year", n, total,
      round(n * 100.0 / total, 1)::DOUBLE AS percentage
      FROM cnt JOIN best USING (framework, framework_theme) JOIN tot ON cnt."year" = tot."year")"""


@query("d4_framework_heatmap", f"{_HEAT} SELECT * FROM heat")
def _(spark, d):
    return D.framework_heatmap(line_annotations(spark, d))


_YEARS = list(range(1995, 2002))


@query("d4_heatmap_pivot", f"""
    {_HEAT} SELECT framework, framework_theme, theme_rank, {", ".join(
        f'coalesce(max(CASE WHEN "year" = {y} THEN percentage END), 0) AS "{y}"' for y in _YEARS)}
    FROM heat GROUP BY 1, 2, 3
""")
def _(spark, d):
    return D.heatmap_pivot(D.framework_heatmap(line_annotations(spark, d)), _YEARS)


@query("d5_top_themes", f"{A} SELECT theme, count(*) AS n FROM ann GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return D.top_themes(line_annotations(spark, d), 10)


@query("d6_theme_confidence", f"""
    {A}, {top(10)} SELECT theme, confidence, count(*) AS n FROM ann WHERE theme IN (SELECT theme FROM top10) GROUP BY 1, 2
""")
def _(spark, d):
    return D.theme_confidence(line_annotations(spark, d), 10)


@query("d7_confidence_crosstab", f"""
    {A} SELECT theme, count(*) FILTER (confidence = 'High') AS "High", count(*) FILTER (confidence = 'Medium') AS "Medium",
      count(*) FILTER (confidence = 'Low') AS "Low", count(*) AS total FROM ann GROUP BY 1 ORDER BY total DESC, theme LIMIT 10
""")
def _(spark, d):
    return D.theme_confidence_crosstab(line_annotations(spark, d), 10)


@query("d8_top_themes_per_framework", f"""
    {A} SELECT framework, theme, count(*) AS n, row_number() OVER (PARTITION BY framework ORDER BY count(*) DESC, theme)::INT AS rank
    FROM ann GROUP BY 1, 2 QUALIFY rank <= 15
""")
def _(spark, d):
    return D.top_themes_per_framework(line_annotations(spark, d), 15)


@query("d9_theme_trend", f"""
    {A}, {top(8)} SELECT "year", theme, count(*) AS n FROM ann WHERE "year" IS NOT NULL AND theme IN (SELECT theme FROM top8) GROUP BY 1, 2
""")
def _(spark, d):
    return D.theme_trend(line_annotations(spark, d), 8)


@query("d10_theme_prevalence", f"""
    {A}, {top(8)}, c AS (SELECT "year", theme, count(*) AS n FROM ann WHERE "year" IS NOT NULL AND theme IN (SELECT theme FROM top8) GROUP BY 1, 2)
    SELECT "year", theme, n, round(n * 100.0 / sum(n) OVER (PARTITION BY "year"), 2)::DOUBLE AS prevalence_pct FROM c
""")
def _(spark, d):
    return D.theme_prevalence(line_annotations(spark, d), 8)


@query("d11_top_areas", f"""
    {A} SELECT coroner_area, count(*) AS n FROM ann WHERE coroner_area IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def _(spark, d):
    return D.top_annotation_areas(line_annotations(spark, d), 10)


_GRID = f"""{A}, {top(8)},
    areas AS (SELECT coroner_area, count(*) AS area_total, row_number() OVER (ORDER BY count(*) DESC, coroner_area)::INT AS area_rank
      FROM ann WHERE coroner_area IS NOT NULL GROUP BY 1 QUALIFY area_rank <= 10),
    c AS (SELECT coroner_area, theme, count(*) AS n FROM ann GROUP BY 1, 2),
    grid AS (SELECT a.coroner_area, area_rank, t.theme, theme_rank::INT AS theme_rank, coalesce(n, 0) AS n, area_total,
      round(coalesce(n, 0) * 100.0 / area_total, 1)::DOUBLE AS percentage
      FROM areas a CROSS JOIN top8 t LEFT JOIN c ON c.coroner_area = a.coroner_area AND c.theme = t.theme)"""


@query("d12_area_theme_grid", f"{_GRID} SELECT * FROM grid")
def _(spark, d):
    return D.area_theme_grid(line_annotations(spark, d))


@query("d13_area_profile", f"{_GRID} SELECT * FROM grid WHERE area_rank <= 3 AND theme_rank <= 6")
def _(spark, d):
    return D.area_profile(D.area_theme_grid(line_annotations(spark, d)), 3, 6)


_PAIRS = f"""{A}, {top(10)},
    p AS (SELECT DISTINCT record_id, theme FROM ann),
    nn AS (SELECT count(DISTINCT record_id)::DOUBLE AS n FROM p),
    s AS (SELECT theme, count(*) AS n FROM p GROUP BY 1),
    pr AS (SELECT a.theme AS theme_a, b.theme AS theme_b, count(*) AS n FROM p a JOIN p b ON a.record_id = b.record_id GROUP BY 1, 2),
    corr AS (SELECT a.theme AS theme_a, b.theme AS theme_b, a.theme_rank::INT AS rank_a, b.theme_rank::INT AS rank_b, coalesce(pr.n, 0) AS n,
      round((nn.n * coalesce(pr.n, 0) - sa.n * sb.n) / (sqrt(sa.n * (nn.n - sa.n)) * sqrt(sb.n * (nn.n - sb.n))), 4) AS correlation
      FROM top10 a CROSS JOIN top10 b CROSS JOIN nn JOIN s sa ON sa.theme = a.theme JOIN s sb ON sb.theme = b.theme
      LEFT JOIN pr ON pr.theme_a = a.theme AND pr.theme_b = b.theme)"""


@query("d14_theme_correlation", f"{_PAIRS} SELECT * FROM corr")
def _(spark, d):
    return D.theme_correlation(line_annotations(spark, d), 10)


# The orders spread themes evenly, so the edges appear near zero correlation.
@query("d15_correlation_edges", f"{_PAIRS} SELECT theme_a, theme_b, correlation AS weight FROM corr WHERE rank_a < rank_b AND correlation >= 0.0")
def _(spark, d):
    return D.correlation_edges(D.theme_correlation(line_annotations(spark, d), 10), 0.0)


@query("d15_correlation_degrees", f"""
    {_PAIRS}, g AS (SELECT theme_a AS theme, rank_a, count(*) FILTER (rank_a <> rank_b AND correlation >= 0.0) AS degree FROM corr GROUP BY 1, 2)
    SELECT theme, degree, row_number() OVER (ORDER BY degree DESC, rank_a) = 1 AND degree > 0 AS is_hub FROM g
""")
def _(spark, d):
    return D.correlation_degrees(D.theme_correlation(line_annotations(spark, d), 10), 0.0)


@query("d15_network_threshold", f"""
    {_PAIRS}, m AS (SELECT max(correlation) AS strongest FROM corr WHERE rank_a < rank_b)
    SELECT strongest, list_max(list_filter([0.6, 0.2, 0.0, -0.1], lambda t: strongest >= t))::DOUBLE AS threshold FROM m
""")
def _(spark, d):
    corr = D.theme_correlation(line_annotations(spark, d), 10)
    return D.network_threshold(corr, [0.6, 0.2, 0.0, -0.1])


_GROUP = {"Person": "Person", "Communication and Culture": "Communication", "External": "External",
          "Human Error": "Human Error", "Jobs/Task": "Jobs/Task", "Weather": "Other"}


@query("d16_theme_groups", f"""
    {A} SELECT DISTINCT theme, split_part(theme, ' - ', 1) AS prefix,
      CASE split_part(theme, ' - ', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GROUP.items())} END AS theme_group FROM ann
""")
def _(spark, d):
    themes = line_annotations(spark, d).select("theme").distinct()
    return themes.select("theme", D.theme_prefix("theme").alias("prefix"), D.theme_group("theme").alias("theme_group"))


@query("d17_co_occurrence", f"{_PAIRS} SELECT theme_a, theme_b, n FROM corr")
def _(spark, d):
    return D.co_occurrence(line_annotations(spark, d), 10)


@query("d17_co_occurrence_by_framework", f"""
    {A}, p AS (SELECT DISTINCT record_id, framework || ': ' || theme AS theme FROM ann),
    t AS (SELECT theme FROM (SELECT framework || ': ' || theme AS theme FROM ann) GROUP BY 1 ORDER BY count(*) DESC, theme LIMIT 10),
    pr AS (SELECT a.theme AS theme_a, b.theme AS theme_b, count(*) AS n FROM p a JOIN p b ON a.record_id = b.record_id GROUP BY 1, 2),
    g AS (SELECT a.theme AS theme_a, b.theme AS theme_b, coalesce(n, 0) AS n FROM t a JOIN t b ON a.theme <> b.theme
      LEFT JOIN pr ON pr.theme_a = a.theme AND pr.theme_b = b.theme)
    SELECT split_part(theme_a, ':', 1) AS framework, theme_a, theme_b, n, (sum(n) OVER (PARTITION BY theme_a))::BIGINT AS total FROM g
""")
def _(spark, d):
    return D.co_occurrence_by_framework(line_annotations(spark, d), 10)


@query("j6_theme_pairs", f"""
    {A}, t AS (SELECT theme FROM ann GROUP BY 1 ORDER BY count(*) DESC, theme LIMIT 10),
    p AS (SELECT DISTINCT record_id, theme FROM ann WHERE theme IN (SELECT theme FROM t))
    SELECT a.theme AS theme_a, b.theme AS theme_b, count(*) AS n FROM p a JOIN p b ON a.record_id = b.record_id GROUP BY 1, 2
""")
def _(spark, d):
    a = line_annotations(spark, d)
    return D.theme_pairs(D.theme_set_counts(a, D.top_themes(a, 10).select("theme"))).withColumn("n", F.col("n").cast("long"))


@query("j7_zero_filled_grid", f"{_GRID} SELECT coroner_area, theme, n FROM grid")
def _(spark, d):
    return D.area_theme_grid(line_annotations(spark, d)).select("coroner_area", "theme", "n")


def _stacked(keys: str, other: str) -> str:
    return f"""
    {A}, r AS (SELECT *, framework || ': ' || theme AS framework_theme FROM ann WHERE coroner_area IS NOT NULL),
    tot AS (SELECT coroner_area, count(DISTINCT record_id) AS total_cases FROM r GROUP BY 1),
    c AS (SELECT coroner_area, {keys}, count(DISTINCT record_id) AS n,
      row_number() OVER (PARTITION BY coroner_area ORDER BY count(DISTINCT record_id) DESC, {keys}) AS rn FROM r GROUP BY coroner_area, {keys})
    SELECT coroner_area, {other}, sum(n)::BIGINT AS n, total_cases FROM c JOIN tot USING (coroner_area) GROUP BY ALL
    """


@query("d18_stacked_areas", _stacked("framework_theme", "CASE WHEN rn > 5 THEN 'Other Themes' ELSE framework_theme END AS framework_theme"))
def _(spark, d):
    return D.stacked_area_profile(line_annotations(spark, d))


@query("d19_stacked_areas_by_framework", _stacked(
    "theme, framework",
    "CASE WHEN rn > 5 THEN 'Other Themes' ELSE theme END AS theme, CASE WHEN rn > 5 THEN 'Other' ELSE framework END AS framework"))
def _(spark, d):
    return D.stacked_area_profile(line_annotations(spark, d), by=("theme", "framework"))


@query("d20_multi_area_comparison", f"""
    {A}, cases AS (SELECT coroner_area, count(DISTINCT record_id) AS total_cases FROM ann WHERE coroner_area IS NOT NULL GROUP BY 1 HAVING count(DISTINCT record_id) >= 100),
    t AS (SELECT theme FROM ann WHERE coroner_area IN (SELECT coroner_area FROM cases) GROUP BY 1 ORDER BY count(DISTINCT record_id) DESC, theme LIMIT 10),
    c AS (SELECT coroner_area, theme, count(DISTINCT record_id) AS n FROM ann GROUP BY 1, 2)
    SELECT cases.coroner_area, t.theme, coalesce(n, 0) AS n, total_cases, round(coalesce(n, 0) * 100.0 / total_cases, 1)::DOUBLE AS percentage
    FROM cases CROSS JOIN t LEFT JOIN c ON c.coroner_area = cases.coroner_area AND c.theme = t.theme
""")
def _(spark, d):
    return D.multi_area_comparison(line_annotations(spark, d), 100, 10)


@query("d21_mean_scores", f"""
    {A} SELECT framework, theme, round(avg(combined_score), 4) AS mean_score FROM ann GROUP BY 1, 2 ORDER BY mean_score DESC, framework, theme LIMIT 10
""")
def _(spark, d):
    return D.mean_scores(line_annotations(spark, d), 10)


@query("d22_score_histogram", f"""
    {A}, c AS (SELECT CASE WHEN combined_score < 0 THEN -1 WHEN combined_score > 1 THEN 20 ELSE least(floor(round(combined_score / 0.05, 6))::INT, 19) END AS bin, count(*) AS n FROM ann WHERE combined_score IS NOT NULL GROUP BY 1)
    SELECT r.b::INT AS bin, CASE WHEN r.b >= 0 THEN round(r.b * 0.05, 4)::DOUBLE END AS bin_start, coalesce(n, 0) AS n FROM range(-1, 21) r(b) LEFT JOIN c ON c.bin = r.b
""")
def _(spark, d):
    return D.score_histogram(line_annotations(spark, d))


@query("d23_report_theme_list", f"""
    {A} SELECT record_id, string_agg(framework || ':' || theme || ':' || confidence, '|' ORDER BY framework, -combined_score, theme) AS themes FROM ann GROUP BY 1
""")
def _(spark, d):
    lists = D.report_theme_list(line_annotations(spark, d))
    return lists.select("record_id", F.array_join(F.transform(
        "themes", lambda t: F.concat_ws(":", t["framework"], t["theme"], t["confidence"])), "|").alias("themes"))


@query("d24_report_summary", f"""
    {A} SELECT record_id, count(*) AS theme_count, array_to_string(list_sort(list(DISTINCT framework)), ', ') AS frameworks FROM ann GROUP BY 1
""")
def _(spark, d):
    return D.report_summary(line_annotations(spark, d))


@query("w2_top_per_group", f"""
    {A}, c AS (SELECT coroner_area, theme, count(*) AS n FROM ann WHERE coroner_area IS NOT NULL GROUP BY 1, 2)
    SELECT coroner_area, theme, n, row_number() OVER (PARTITION BY coroner_area ORDER BY n DESC, theme)::INT AS rank FROM c QUALIFY rank <= 3
""")
def _(spark, d):
    counts = D._counts(line_annotations(spark, d), "coroner_area", "theme")
    return D.top_n_per_group(counts, "coroner_area", 3, F.desc("n"), F.asc("theme"))


@query("w3_partition_share", f"""
    {A}, c AS (SELECT framework, confidence, count(*) AS n FROM ann GROUP BY 1, 2)
    SELECT framework, confidence, n, round(n * 100.0 / sum(n) OVER (PARTITION BY framework), 2)::DOUBLE AS share_pct FROM c
""")
def _(spark, d):
    counts = D._counts(line_annotations(spark, d), "framework", "confidence")
    total = F.sum("n").over(D.Window.partitionBy("framework"))
    return counts.withColumn("share_pct", F.round(F.try_divide(F.col("n") * 100.0, total), 2))


# --- annotator evaluation ---------------------------------------------------

E = f"WITH {EVAL_SQL}"
_CONF = f"""{E}, c AS (SELECT predicted, human, count(*) AS n FROM ev GROUP BY 1, 2),
    l AS (SELECT DISTINCT unnest([predicted, human]) AS label FROM c),
    m AS (SELECT predicted, human, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT label, label, 0 FROM l) GROUP BY 1, 2)"""


@query("v1_confusion", f"{_CONF} SELECT * FROM m")
def _(spark, d):
    return V.confusion(eval_rows(spark, d))


@query("v2_confusion_normalised", f"""
    {_CONF} SELECT predicted, human, coalesce(round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY predicted), 0), 4), 0) AS share FROM m
""")
def _(spark, d):
    return V.confusion_normalised(eval_rows(spark, d))


_PER = f"""{E}, x AS (SELECT lower(predicted) AS p, lower(human) AS h FROM ev),
    l AS (SELECT DISTINCT unnest([p, h]) AS label FROM x),
    per AS (SELECT label, count(*) FILTER (p = label AND h = label) AS tp, count(*) FILTER (p = label AND h <> label) AS fp,
      count(*) FILTER (h = label AND p <> label) AS fn FROM l CROSS JOIN x GROUP BY 1)"""


@query("v3_theme_metrics", f"""
    {_PER} SELECT label, tp, fp, fn, coalesce(round(tp::DOUBLE / nullif(tp + fp, 0), 2), 0) AS precision,
      coalesce(round(tp::DOUBLE / nullif(tp + fn, 0), 2), 0) AS recall FROM per
""")
def _(spark, d):
    return V.theme_metrics(eval_rows(spark, d))


@query("v4_precision_by_label", f"""
    {_PER} SELECT t.human AS theme, coalesce(round(tp::DOUBLE / nullif(tp + fp, 0) * 100, 2), 0) AS precision_pct
    FROM (SELECT DISTINCT human FROM ev) t JOIN per ON per.label = lower(t.human)
""")
def _(spark, d):
    return V.precision_by_human_label(eval_rows(spark, d))


@query("v5_mistaken_for", f"""
    {E}, c AS (SELECT lower(predicted) AS predicted, human, count(*) AS n FROM ev WHERE lower(predicted) <> lower(human) GROUP BY 1, 2)
    SELECT predicted, human, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY predicted) * 100, 2) AS pct FROM c
""")
def _(spark, d):
    return V.mistaken_for(eval_rows(spark, d))


@query("v6_missed_as", f"""
    {E}, c AS (SELECT lower(human) AS human, predicted, count(*) AS n FROM ev WHERE lower(predicted) <> lower(human) GROUP BY 1, 2)
    SELECT human, predicted, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY human) * 100, 2) AS pct FROM c
""")
def _(spark, d):
    return V.missed_as(eval_rows(spark, d))


@query("v7_overall_precision", f"""
    {E} SELECT count(*) AS n, round(avg(CASE WHEN human = predicted THEN 1.0 ELSE 0 END), 2) AS overall_precision FROM ev
""")
def _(spark, d):
    return V.overall_precision(eval_rows(spark, d))


_REPORT = f"""{E}, rep AS (SELECT title,
      coalesce(array_to_string(list_sort(list(DISTINCT human) FILTER (human = predicted)), ', '), '') AS correct_themes,
      coalesce(array_to_string(list_sort(list(DISTINCT human) FILTER (human <> predicted)), ', '), '') AS incorrect_themes,
      round(avg(CASE WHEN human = predicted THEN 1.0 ELSE 0 END), 2) AS report_precision FROM ev GROUP BY 1)"""


@query("v8_report_precision", f"{_REPORT} SELECT * FROM rep")
def _(spark, d):
    return V.report_precision(eval_rows(spark, d))


@query("v9_average_precision", f"{_REPORT} SELECT count(*) AS reports, round(avg(report_precision), 2) AS average_precision FROM rep")
def _(spark, d):
    return V.average_report_precision(eval_rows(spark, d))


@query("v10_apply_corrections", f"""
    {E} SELECT record_id, predicted, CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN ''
      WHEN lang = 'fr' THEN predicted ELSE 'poor' END AS human FROM raw
""")
def _(spark, d):
    rows = eval_rows(spark, d)
    corrections = rows.filter("lang <> 'es'").select("record_id", F.when(F.col("lang") == "de", "No Theme")
        .when(F.col("lang") == "fr", F.col("predicted")).otherwise("POOR").alias("selected"))
    return V.apply_corrections(rows.select("record_id", "predicted"), corrections)


@query("v11_accuracy_f1", f"""
    {_PER} SELECT sum(tp + fn)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(tp + fn), 4) AS accuracy,
      round(sum(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 4)::DOUBLE AS weighted_f1 FROM per
""")
def _(spark, d):
    return V.accuracy_and_f1(eval_rows(spark, d))
