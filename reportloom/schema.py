"""Fixed schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

ATTACHMENT = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("type", T.StringType()),
])

REPORTS = T.StructType([
    T.StructField("record_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("date_of_report", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("year_source", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("deceased_name", T.StringType()),
    T.StructField("coroner_name", T.StringType()),
    T.StructField("coroner_area", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("extracted_concerns", T.StringType()),
    T.StructField("concern_source", T.StringType()),
    T.StructField("content_source", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField("pdfs", T.ArrayType(ATTACHMENT)),
])

# A framework file: a list of themes, each a name with its keywords.
FRAMEWORK_FILE = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
]))

ESSENTIAL = [
    "title", "url", "content", "date_of_report", "ref", "deceased_name",
    "coroner_name", "coroner_area", "categories", "year", "extracted_concerns",
    "report_id", "death_type",
]


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def add_missing_as_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks, as NULL."""
    absent = [f for f in schema.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})


def reduced_view(df: DataFrame, essential: Iterable[str] = ESSENTIAL) -> DataFrame:
    """Keep the essential columns that exist (all columns if none does)."""
    kept = [name for name in essential if name in df.columns]
    return df.select(*kept) if kept else df
