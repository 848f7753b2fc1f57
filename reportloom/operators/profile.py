"""Corpus profile: completeness, consistency, counts over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.operators.small import top_n
from reportloom.schema import require_columns

# Display names of the checked fields.
COMPLETENESS_FIELDS = {
    "Title": "title",
    "Content": "content",
    "Date of Report": "date_of_report",
    "Deceased Name": "deceased_name",
    "Coroner Name": "coroner_name",
    "Coroner Area": "coroner_area",
    "Categories": "categories",
}


def percent(test: Column) -> Column:
    """Share of rows in percent for which ``test`` is true."""
    return F.avg(F.when(F.coalesce(test, F.lit(False)), 100.0).otherwise(0.0))


def _unpivot(df: DataFrame, measures: Mapping[str, Column], label: str, value: str) -> DataFrame:
    """One aggregation for all measures, then one row per measure."""
    row = df.agg(F.array(*[
        F.struct(F.lit(name).alias(label), measure.alias(value))
        for name, measure in measures.items()
    ]).alias("m"))
    return row.select(F.inline("m"))


def _completeness(df: DataFrame) -> dict[str, Column]:
    def filled(column: str) -> Column:
        if column not in df.columns:
            return F.lit(False)
        if column == "categories":
            return F.size(column) > 0
        return F.col(column).isNotNull()

    return {name: percent(filled(c)) for name, c in COMPLETENESS_FIELDS.items()}


def _consistency() -> dict[str, Column]:
    return {
        "Title Format": percent(F.length("title") >= 10),
        "Content Length": percent(F.length("content") >= 100),
        "Date Format": percent(F.col("date_of_report").isNotNull()),
        "Categories Format": percent(F.col("categories").isNotNull()),
    }


def _coverage() -> dict[str, Column]:
    stored = F.size(F.filter("pdfs", lambda p: p["path"].isNotNull()))
    return {
        "Reports with PDFs": percent(stored > 0),
        "Reports with Multiple PDFs": percent(stored > 1),
    }


def completeness(df: DataFrame) -> DataFrame:
    return _unpivot(df, _completeness(df), "field", "completeness_pct")


def consistency(df: DataFrame) -> DataFrame:
    return _unpivot(df, _consistency(), "metric", "consistency_pct")


def attachment_coverage(df: DataFrame) -> DataFrame:
    return _unpivot(df, _coverage(), "metric", "coverage_pct")


def _quality_rows(df: DataFrame) -> DataFrame:
    groups = [("completeness", _completeness(df)), ("consistency", _consistency()), ("coverage", _coverage())]
    return _unpivot(
        df,
        {f"{group}|{name}": m for group, measures in groups for name, m in measures.items()},
        "key", "pct",
    ).select(
        F.substring_index("key", "|", 1).alias("area"),
        F.substring_index("key", "|", -1).alias("metric"),
        "pct",
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """Metrics below their limits: 95 complete, 90 consistent, 90 covered."""
    return _quality_rows(df).filter(
        ((F.col("area") == "completeness") & (F.col("pct") < 95))
        | ((F.col("area") == "consistency") & (F.col("pct") < 90))
        | ((F.col("metric") == "Reports with PDFs") & (F.col("pct") < 90))
    )


def quality_summary(df: DataFrame) -> DataFrame:
    rows = _quality_rows(df)
    return rows.agg(
        F.avg(F.when(F.col("area") == "completeness", F.col("pct"))).alias("avg_completeness"),
        F.avg(F.when(F.col("area") == "consistency", F.col("pct"))).alias("avg_consistency"),
        F.max(F.when(F.col("metric") == "Reports with PDFs", F.col("pct"))).alias("pdf_coverage"),
    )


def validate_data(df: DataFrame, required: Sequence[str] = ("title", "content")) -> DataFrame:
    """One row: size, completeness score, duplicate count and warnings."""
    require_columns(df, required)
    share = {c: F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)) for c in
             ("title", "content", "date_of_report") if c in df.columns}
    score = sum(share.values(), F.lit(0.0)) / len(share)
    duplicates = (
        F.count("*") - F.count_distinct(F.struct("title", "ref"))
        if "ref" in df.columns else F.lit(0)
    )
    limits = {"title": 0.9, "content": 0.8, "date_of_report": 0.7}
    stats = df.agg(
        F.count("*").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        *[value.alias(f"{c}_share") for c, value in share.items()],
        score.alias("quality_score"),
        duplicates.alias("duplicates"),
    )
    warnings = [F.when(F.col(f"{c}_share") < limits[c], F.lit(f"{c} incomplete")) for c in share]
    warnings.append(F.when(F.col("duplicates") > 0, F.lit("duplicates")))
    return stats.withColumns({
        "warnings": F.concat_ws(", ", *warnings),
        "is_valid": F.col("row_count") > 0,
    })


def category_counts(df: DataFrame) -> DataFrame:
    return (
        df.select(F.explode("categories").alias("category"))
        .filter(F.col("category").isNotNull())
        .groupBy("category").agg(F.count("*").alias("n"))
    )


def top_areas(df: DataFrame, n: int = 20) -> DataFrame:
    counts = df.filter(F.col("coroner_area").isNotNull()).groupBy("coroner_area").agg(
        F.count("*").alias("n")
    )
    return top_n(counts, n, "n", "coroner_area")


def _per_period(df: DataFrame, period: Column) -> DataFrame:
    """Rows per period. Undated rows leave after the count, so a date that is
    itself an extraction is computed once per row."""
    counts = df.groupBy(period).agg(F.count("*").alias("n"))
    return counts.filter(F.col(counts.columns[0]).isNotNull())


def monthly_timeline(df: DataFrame) -> DataFrame:
    """Reports per month; months without reports count 0."""
    month = F.trunc("date_of_report", "MM").cast("date")
    counts = _per_period(df, month.alias("month"))
    spine = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month")
    )
    return spine.join(counts, "month", "left").select(
        "month", F.coalesce("n", F.lit(0)).alias("n")
    )


def month_label_counts(df: DataFrame) -> DataFrame:
    """Counts per "March 2020" label, with the month for sorting."""
    counts = _per_period(df, F.trunc("date_of_report", "MM").cast("date").alias("month"))
    return counts.select("month", F.date_format("month", "MMMM yyyy").alias("month_year"), "n")


def year_counts(df: DataFrame) -> DataFrame:
    return _per_period(df, F.year("date_of_report").alias("year"))


def seasonality(df: DataFrame) -> DataFrame:
    """Reports per month of the year, always twelve rows."""
    row = df.agg(*[
        F.count_if(F.month("date_of_report") == m).alias(f"m{m}") for m in range(1, 13)
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("month_no"), F.col(f"m{m}").alias("n")) for m in range(1, 13)
    ])))


def changed_counts(df: DataFrame, pairs: Mapping[str, tuple[str | Column, str | Column]]) -> DataFrame:
    """How many values differ between an old and a new column, null-safe."""
    def differs(old, new) -> Column:
        old = F.col(old) if isinstance(old, str) else old
        new = F.col(new) if isinstance(new, str) else new
        return F.count_if(~old.eqNullSafe(new))

    return _unpivot(df, {n: differs(*p) for n, p in pairs.items()}, "field", "changed")


def option_list(df: DataFrame, column: str, explode: bool = False) -> DataFrame:
    """Sorted distinct values of a column (array elements if ``explode``)."""
    value = F.explode(column) if explode else F.col(column)
    return df.select(value.alias("option")).filter(F.col("option").isNotNull()).distinct().orderBy("option")


def sort_reports(df: DataFrame, descending: bool = False) -> DataFrame:
    day = F.col("date_of_report")
    return df.orderBy(day.desc_nulls_last() if descending else day.asc_nulls_last(), "record_id")
