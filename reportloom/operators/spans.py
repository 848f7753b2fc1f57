"""Keyword positions, span merging and highlighted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.operators.search import occurrences


def merge_spans(spans: DataFrame) -> DataFrame:
    """Join touching or overlapping spans of a report (next.start <= end).

    Theme keys and keywords are joined in span order with " + "; the first
    sentence and the first theme of a merged span lead.
    """
    order = ["start", "end", "theme_key", "keywords"]
    by_report = Window.partitionBy("record_id").orderBy(*order)
    reach = F.max("end").over(by_report.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = F.sum("_opens").over(by_report.rowsBetween(Window.unboundedPreceding, 0))
    numbered = spans.withColumn("_opens", opens).withColumn("_island", island)
    members = F.sort_array(F.collect_list(F.struct(*order, "sentence")))
    merged = numbered.groupBy("record_id", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), members.alias("m")
    )
    return merged.select(
        "record_id", "start", "end",
        F.array_join(F.transform("m", lambda x: x["theme_key"]), " + ").alias("theme_key"),
        F.array_join(F.transform("m", lambda x: x["keywords"]), " + ").alias("keywords"),
        F.get("m", F.lit(0))["theme_key"].alias("first_theme"),
        F.get("m", F.lit(0))["sentence"].alias("sentence"),
    )


def highlight(reports: DataFrame, merged: DataFrame, text: str = "content", markup: bool = False) -> DataFrame:
    """Report text with every merged span wrapped in brackets or a span tag."""
    lists = merged.groupBy("record_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "theme_key", "keywords"))).alias("spans")
    )
    body = F.col(text)

    def wrap(s: Column) -> Column:
        inner = F.substr(body, s["start"] + 1, s["end"] - s["start"])
        if not markup:
            return F.concat(F.lit("["), inner, F.lit("]"))
        return F.concat(
            F.lit('<span title="Theme: '), s["theme_key"], F.lit("\nKeywords: "), s["keywords"],
            F.lit('">'), inner, F.lit("</span>"),
        )

    # Merged spans are in order and apart, so each piece begins where the span before it ends.
    last = F.get("spans", F.size("spans") - 1)["end"]
    before = F.slice(F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"])), F.lit(1), F.size("spans"))
    pieces = F.zip_with(before, "spans", lambda at, s: F.concat(F.substr(body, at + 1, s["start"] - at), wrap(s)))
    built = F.concat(F.array_join(pieces, ""), F.substr(body, last + 1, F.length(body)))
    joined = reports.select("record_id", text).join(lists, "record_id", "left")
    return joined.select(
        "record_id", F.when(F.col("spans").isNull(), body).otherwise(built).alias("highlighted")
    )


def keyword_occurrences(reports: DataFrame, keywords: DataFrame, text: str = "content") -> DataFrame:
    """All occurrences of each keyword, no word boundary, overlaps allowed."""
    return occurrences(reports, keywords, text).select(
        "record_id", "start", (F.col("start") + F.length("keyword")).alias("end"), "matched"
    )
