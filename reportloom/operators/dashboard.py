"""Aggregations over the annotation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.constants import THEME_GROUPS
from reportloom.operators.small import top_n, top_n_per_group, with_each

NO_THEME = "No Themes Detected"


def framework_theme() -> Column:
    return F.concat(F.col("framework"), F.lit(": "), F.col("theme"))


def _known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return _known(df, *keys).groupBy(*keys).agg(F.count("*").alias("n"))


def _cases(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Distinct reports per key."""
    return _known(df, *keys).groupBy(*keys).agg(F.count_distinct("record_id").alias(name))


def overview(annotations: DataFrame) -> DataFrame:
    return annotations.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("theme").alias("themes"),
        F.count_distinct("coroner_area").alias("areas"),
        F.count_distinct("year").alias("years"),
    )


def framework_counts(annotations: DataFrame) -> DataFrame:
    return _counts(annotations, "framework")


def theme_counts(annotations: DataFrame) -> DataFrame:
    """Rows per framework and theme."""
    return _counts(annotations, "framework", "theme")


def framework_heatmap(annotations: DataFrame, n: int = 5) -> DataFrame:
    """Share of each year's reports that carry a theme, top themes per framework."""
    rows = _known(annotations, "year", "framework", "theme").filter(F.col("theme") != NO_THEME)
    rows = rows.withColumn("framework_theme", framework_theme())
    per_year = _cases(rows, "year", name="total")
    counts = _cases(rows, "year", "framework", "framework_theme")
    totals = counts.groupBy("framework", "framework_theme").agg(F.sum("n").alias("theme_total"))
    best = top_n_per_group(
        totals, "framework", n, F.desc("theme_total"), F.asc("framework_theme"), rank="theme_rank"
    ).drop("framework")
    share = F.try_divide(F.col("n") * 100.0, F.col("total"))
    return (
        counts.join(best, "framework_theme").join(per_year, "year")
        .select(
            "framework", "framework_theme", "theme_rank", "theme_total", "year", "n", "total",
            F.round(share, 1).alias("percentage"),
        )
    )


def heatmap_pivot(heatmap: DataFrame, years: Sequence[int], value: str = "percentage") -> DataFrame:
    """Wide form: one column per given year, 0 where a theme has no report."""
    return (
        heatmap.groupBy("framework", "framework_theme", "theme_rank")
        .pivot("year", list(years)).agg(F.first(value))
        .na.fill(0)
        .orderBy("framework", "theme_rank")
    )


def top_themes(annotations: DataFrame, n: int = 10, rank: str | None = None) -> DataFrame:
    return top_n(_counts(annotations, "theme"), n, "n", "theme", rank)


def theme_confidence(annotations: DataFrame, n: int = 10) -> DataFrame:
    """Rows per theme and confidence for the largest themes."""
    return _counts(annotations, "theme", "confidence").join(
        top_themes(annotations, n).select("theme"), "theme", "left_semi"
    )


def theme_confidence_crosstab(annotations: DataFrame, n: int = 10) -> DataFrame:
    wide = (
        _known(annotations, "theme", "confidence").groupBy("theme")
        .pivot("confidence", ["High", "Medium", "Low"]).agg(F.count("theme"))
        .na.fill(0)
    )
    total = F.col("High") + F.col("Medium") + F.col("Low")
    return top_n(wide.withColumn("total", total), n, "total", "theme")


def top_themes_per_framework(annotations: DataFrame, n: int = 15) -> DataFrame:
    return top_n_per_group(
        theme_counts(annotations), "framework", n, F.desc("n"), F.asc("theme")
    )


def theme_trend(annotations: DataFrame, n: int = 8) -> DataFrame:
    return _counts(annotations, "year", "theme").join(
        top_themes(annotations, n).select("theme"), "theme", "left_semi"
    )


def theme_prevalence(annotations: DataFrame, n: int = 8) -> DataFrame:
    """Share of each top theme among the top themes' rows of the year."""
    trend = theme_trend(annotations, n)
    year_total = F.sum("n").over(Window.partitionBy("year"))
    return trend.withColumn(
        "prevalence_pct", F.round(F.try_divide(F.col("n") * 100.0, year_total), 2)
    )


def top_annotation_areas(annotations: DataFrame, n: int = 10, rank: str | None = None) -> DataFrame:
    return top_n(_counts(annotations, "coroner_area"), n, "n", "coroner_area", rank)


def area_theme_grid(annotations: DataFrame, areas: int = 10, themes: int = 8) -> DataFrame:
    """Zero-filled top areas × top themes with the share of the area's rows."""
    area_dim = top_annotation_areas(annotations, areas, "area_rank").withColumnRenamed("n", "area_total")
    theme_dim = top_themes(annotations, themes, "theme_rank")
    grid = with_each(area_dim, theme_dim, "theme_rank", "theme")
    counts = _counts(annotations, "coroner_area", "theme")
    share = F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, F.col("area_total"))
    return grid.join(counts, ["coroner_area", "theme"], "left").select(
        "coroner_area", "area_rank", "theme", "theme_rank",
        F.coalesce("n", F.lit(0)).alias("n"), "area_total",
        F.round(share, 1).alias("percentage"),
    )


def area_profile(grid: DataFrame, areas: Sequence[str] | int = 3, themes: int = 8) -> DataFrame:
    """Grid rows of chosen (or the first) areas and the first themes."""
    chosen = (
        F.col("area_rank") <= areas if isinstance(areas, int) else F.col("coroner_area").isin(*areas)
    )
    return grid.filter(chosen & (F.col("theme_rank") <= themes))


def theme_set_counts(annotations: DataFrame, themes: DataFrame) -> DataFrame:
    """How many reports carry each combination of the given few themes.

    Reports collapse to their theme combination before any pair is formed, so
    pairs are built per distinct combination and weighted by its count. Reports
    with none of the themes are counted under the empty combination.
    """
    listed = themes.select("theme", F.lit(True).alias("_top"))
    present = F.coalesce(F.col("combined_score"), F.lit(1.0)) > 0
    flagged = annotations.select("record_id", "theme", present.alias("_present")).join(
        listed, "theme", "left"
    )
    chosen = F.when(F.col("_top") & F.col("_present"), F.col("theme"))
    sets = flagged.groupBy("record_id").agg(F.sort_array(F.collect_set(chosen)).alias("themes"))
    return sets.groupBy("themes").agg(F.count("*").alias("reports"))


def theme_pairs(set_counts: DataFrame) -> DataFrame:
    """Reports per ordered theme pair, the diagonal included."""
    left = set_counts.select("themes", "reports", F.explode("themes").alias("theme_a"))
    pairs = left.select("theme_a", F.explode("themes").alias("theme_b"), "reports")
    return pairs.groupBy("theme_a", "theme_b").agg(F.sum("reports").alias("n"))


def _theme_grid(themes: DataFrame) -> DataFrame:
    """All ordered pairs of the top themes, built from one short list."""
    packed = themes.agg(F.collect_list(F.struct("theme_rank", "theme")).alias("dim"))
    left = packed.select("dim", F.inline("dim").alias("rank_a", "theme_a"))
    return left.select("rank_a", "theme_a", F.inline("dim").alias("rank_b", "theme_b"))


def theme_correlation(annotations: DataFrame, n: int = 10) -> DataFrame:
    """Pearson correlation of theme presence over reports (phi), top themes.

    NULL where a theme is in every report or in none.
    """
    themes = top_themes(annotations, n, "theme_rank").select("theme", "theme_rank")
    # At most 2^n combinations and n^2 cells reach the unpartitioned windows.
    everything = Window.partitionBy()
    sets = theme_set_counts(annotations, themes).withColumn(
        "total", F.sum("reports").over(everything)
    )
    first = sets.select("themes", "reports", "total", F.explode("themes").alias("theme_a"))
    pairs = first.select("theme_a", F.explode("themes").alias("theme_b"), "reports", "total").groupBy(
        "theme_a", "theme_b"
    ).agg(F.sum("reports").alias("n"), F.max("total").alias("total"))
    cells = _theme_grid(themes).join(pairs, ["theme_a", "theme_b"], "left").na.fill(0, ["n"])
    own = F.when(F.col("theme_a") == F.col("theme_b"), F.col("n"))
    both = cells.withColumns({
        "reports": F.max("total").over(everything).cast("double"),
        "n_a": F.max(own).over(Window.partitionBy("theme_a")),
        "n_b": F.max(own).over(Window.partitionBy("theme_b")),
    })
    total, a, b = F.col("reports"), F.col("n_a"), F.col("n_b")
    spread = F.sqrt(a * (total - a)) * F.sqrt(b * (total - b))
    phi = F.try_divide(total * F.col("n") - a * b, spread)
    return both.select(
        "theme_a", "theme_b", "rank_a", "rank_b", "n", F.round(phi, 4).alias("correlation")
    )


def correlation_edges(correlation: DataFrame, threshold: float) -> DataFrame:
    return correlation.filter(
        (F.col("rank_a") < F.col("rank_b")) & (F.col("correlation") >= threshold)
    ).select("theme_a", "theme_b", F.col("correlation").alias("weight"))


def correlation_degrees(correlation: DataFrame, threshold: float) -> DataFrame:
    """Degree per theme; the hub is the first theme of the highest degree."""
    linked = (F.col("correlation") >= threshold) & (F.col("rank_a") != F.col("rank_b"))
    degrees = correlation.groupBy("theme_a", "rank_a").agg(
        F.count_if(linked).alias("degree")
    )
    # One row per top theme.
    first = F.row_number().over(Window.orderBy(F.desc("degree"), F.asc("rank_a")))
    return degrees.select(
        F.col("theme_a").alias("theme"), "degree",
        ((first == 1) & (F.col("degree") > 0)).alias("is_hub"),
    )


def network_threshold(
    correlation: DataFrame, thresholds: Sequence[float] = (0.6, 0.5, 0.4, 0.3, 0.2)
) -> DataFrame:
    """Highest listed threshold at which the network has an edge."""
    strongest = F.max(F.when(F.col("rank_a") < F.col("rank_b"), F.col("correlation")))
    steps = F.filter(
        F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("strongest") >= t
    )
    return correlation.agg(strongest.alias("strongest")).select(
        "strongest", F.array_max(steps).alias("threshold")
    )


def theme_group(theme: str | Column, groups: dict[str, str] = THEME_GROUPS) -> Column:
    """Group of a theme: the text before the first hyphen, through the aliases."""
    value = F.col(theme) if isinstance(theme, str) else theme
    head = F.trim(F.substring_index(value, "-", 1))
    key = F.lower(F.when(F.contains(value, F.lit("-")), head).otherwise(value))
    aliases = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), F.lit("Other"))


def theme_prefix(theme: str | Column) -> Column:
    """Text before the first hyphen, else "Other"."""
    value = F.col(theme) if isinstance(theme, str) else theme
    return F.when(
        F.contains(value, F.lit("-")), F.trim(F.substring_index(value, "-", 1))
    ).otherwise("Other")


def co_occurrence(annotations: DataFrame, n: int = 10) -> DataFrame:
    """Reports per pair of top themes; the diagonal is the theme's own count."""
    themes = top_themes(annotations, n, "theme_rank").select("theme", "theme_rank")
    pairs = theme_pairs(theme_set_counts(annotations, themes))
    return _theme_grid(themes).join(pairs, ["theme_a", "theme_b"], "left").select(
        "theme_a", "theme_b", F.coalesce("n", F.lit(0)).alias("n")
    )


def co_occurrence_by_framework(annotations: DataFrame, n: int = 10) -> DataFrame:
    """Without diagonal, ordered by framework and total co-occurrence."""
    named = annotations.withColumn("theme", framework_theme())
    pairs = co_occurrence(named, n).filter(F.col("theme_a") != F.col("theme_b"))
    totals = pairs.groupBy("theme_a").agg(F.sum("n").alias("total"))
    framework = F.substring_index("theme_a", ":", 1)
    return pairs.join(totals, "theme_a").select(
        framework.alias("framework"), "theme_a", "theme_b", "n", "total"
    )


def stacked_area_profile(
    annotations: DataFrame, by: Sequence[str] = ("framework_theme",), n: int = 5
) -> DataFrame:
    """Distinct cases per area: its top themes and the rest as "Other Themes"."""
    rows = annotations.withColumn("framework_theme", framework_theme())
    cases = _cases(rows, "coroner_area", name="total_cases")
    counts = _cases(rows, "coroner_area", *by)
    order = [F.desc("n"), *[F.asc(c) for c in by]]
    rank = F.row_number().over(Window.partitionBy("coroner_area").orderBy(*order))
    ranked = counts.withColumn("rank", rank)
    other = F.col("rank") > n
    labels = {c: F.when(other, "Other" if c == "framework" else "Other Themes").otherwise(F.col(c)) for c in by}
    folded = ranked.groupBy(
        "coroner_area", *[value.alias(c) for c, value in labels.items()]
    ).agg(F.sum("n").alias("n"))
    return folded.join(cases, "coroner_area")


def multi_area_comparison(annotations: DataFrame, min_cases: int = 1, n: int = 10) -> DataFrame:
    """Cases and percentage per area and overall top theme, zero-filled."""
    cases = _cases(annotations, "coroner_area", name="total_cases").filter(
        F.col("total_cases") >= min_cases
    )
    chosen = annotations.join(cases.select("coroner_area"), "coroner_area", "left_semi")
    themes = top_n(_cases(chosen, "theme"), n, "n", "theme", "theme_rank")
    counts = _cases(annotations, "coroner_area", "theme")
    share = F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, F.col("total_cases"))
    return (
        with_each(cases, themes, "theme_rank", "theme")
        .join(counts, ["coroner_area", "theme"], "left")
        .select(
            "coroner_area", "theme", F.coalesce("n", F.lit(0)).alias("n"), "total_cases",
            F.round(share, 1).alias("percentage"),
        )
    )


def comparison_pivot(comparison: DataFrame, themes: Sequence[str], value: str = "percentage") -> DataFrame:
    return comparison.groupBy("coroner_area", "total_cases").pivot("theme", list(themes)).agg(F.first(value))


def mean_scores(annotations: DataFrame, n: int = 10) -> DataFrame:
    means = _known(annotations, "framework", "theme").groupBy("framework", "theme").agg(
        F.round(F.avg("combined_score"), 4).alias("mean_score")
    )
    return means.orderBy(F.desc("mean_score"), "framework", "theme").limit(n)


def score_histogram(annotations: DataFrame, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows per score bin over a fixed range, empty bins included.

    Bin -1 holds lower scores, bin ``bins`` higher ones.
    """
    width = (high - low) / bins
    position = F.floor(F.round((F.col("combined_score") - low) / width, 6)).cast("int")
    score = F.col("combined_score")
    place = F.when(score < low, -1).when(score > high, bins).otherwise(F.least(position, F.lit(bins - 1)))
    counts = annotations.filter(score.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    spine = annotations.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", F.when(F.col("bin") >= 0, F.round(F.lit(low) + F.col("bin") * width, 4)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def report_theme_list(annotations: DataFrame) -> DataFrame:
    """Themes of each report ordered by framework, then score."""
    item = F.struct(
        F.col("framework"), (-F.col("combined_score")).alias("neg_score"), F.col("theme"),
        F.col("combined_score"), F.col("confidence"),
    )
    ordered = annotations.groupBy("record_id").agg(F.sort_array(F.collect_list(item)).alias("themes"))
    return ordered.withColumn("themes", F.transform("themes", lambda t: t.dropFields("neg_score")))


def report_summary(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("record_id").agg(
        F.count("*").alias("theme_count"),
        F.array_join(F.sort_array(F.collect_set("framework")), ", ").alias("frameworks"),
    )
