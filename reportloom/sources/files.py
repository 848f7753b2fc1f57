"""Reading and writing report files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reportloom.functions.helpers import blank, strip
from reportloom.functions.text import format_date_uk
from reportloom.schema import ATTACHMENT, FRAMEWORK_FILE


def read_reports_csv(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV with quoted line breaks; rows that are empty throughout are dropped.

    Without a schema every column is text, so the file is read once only.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"', quote='"')
    frame = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return frame.dropna(how="all")


def stack_files(frames: dict[str, DataFrame]) -> DataFrame:
    """Append named frames; union of columns, origin in ``source_file``."""
    named = [df.withColumn("source_file", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_report_folder(spark: SparkSession, paths, schema: T.StructType | str | None = None) -> DataFrame:
    """Several report CSV files as one table with their file name."""
    frame = read_reports_csv(spark, paths, schema)
    return frame.withColumn("source_file", F.col("_metadata.file_name"))


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_frameworks(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Keyword table and reject table from framework JSON files, by name."""
    raw = []
    for name, path in paths.items():
        body = spark.read.text(path, wholetext=True)
        raw.append(body.select(
            F.lit(name).alias("framework"), F.from_json("value", FRAMEWORK_FILE).alias("themes")
        ))
    return framework_tables(reduce(DataFrame.unionByName, raw))


def framework_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(framework, themes array)`` → keyword dimension and rejected entries.

    A theme needs a name and keywords; a keyword needs three characters.
    """
    themes = raw.select("framework", F.posexplode_outer("themes").alias("theme_idx", "t"))
    bad_theme = F.col("t.name").isNull() | F.col("t.keywords").isNull()
    keywords = themes.filter(~bad_theme).select(
        "framework", "theme_idx", F.col("t.name").alias("theme"),
        F.posexplode("t.keywords").alias("kw_idx", "keyword"),
    )
    short = F.coalesce(F.length("keyword"), F.lit(0)) < 3
    rejects = themes.filter(bad_theme).select(
        "framework", "theme_idx", F.col("t.name").alias("theme"),
        F.lit(None).cast("string").alias("keyword"),
        F.lit("theme without name or keywords").alias("reason"),
    ).unionByName(keywords.filter(short).select(
        "framework", "theme_idx", "theme", "keyword",
        F.lit("keyword under three characters").alias("reason"),
    ))
    return keywords.filter(~short), rejects


def pack_attachments(df: DataFrame) -> DataFrame:
    """Fold the numbered ``PDF_i_*`` columns into one array of structs."""

    def field(i: int, part: str) -> Column:
        name = f"PDF_{i}_{part}"
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    numbers = (re.fullmatch(r"PDF_(\d+)_Name", c) for c in df.columns)
    present = sorted(int(m[1]) for m in numbers if m)
    structs = [
        F.struct(
            F.lit(i).alias("pos"), field(i, "Name").alias("name"),
            field(i, "Content").alias("content"), field(i, "Path").alias("path"),
            field(i, "Type").alias("type"),
        ).cast(ATTACHMENT)
        for i in present
    ]
    packed = F.filter(F.array(*structs), lambda p: p["name"].isNotNull()) if structs else F.array()
    wide = [c for c in df.columns if re.fullmatch(r"PDF_\d+_(Name|Content|Path|Type)", c)]
    return df.withColumn("pdfs", packed.cast(T.ArrayType(ATTACHMENT))).drop(*wide)


def export_view(df: DataFrame) -> DataFrame:
    """Flat form for CSV: UK dates, arrays and structs as JSON text."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            columns.append(format_date_uk(field.name).alias(field.name))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            columns.append(F.to_json(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def write_reports_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    export_view(df).write.options(header=True, escape='"', quote='"').mode(mode).csv(path)


def write_reports(df: DataFrame, path: str, mode: str = "error", by: Sequence[str] = ("year",)) -> None:
    """Native sink: Parquet, partitioned so that year filters prune folders."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_json_lines(exported: DataFrame, path: str, mode: str = "error") -> None:
    """The ``json`` texts of an export as files of one object a line; rows without one are not written."""
    exported.filter("json is not null").select(F.col("json").alias("value")).write.mode(mode).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects of such files; a field that an object lacks is null."""
    return spark.read.schema(schema).json(path)


def case_folder(
    ref: str = "ref", name: str = "deceased_name", year: str = "year", record_id: str = "record_id"
) -> Column:
    """Folder name of a case: reference, safe name, year."""
    safe = F.regexp_replace(F.col(name), r'[<>:"/\\|?*]', "_")
    parts = F.concat_ws("_", F.col(ref), strip(safe))
    none = F.col(ref).isNull() & F.col(name).isNull()
    folder = F.when(none, F.concat(F.lit("report_"), F.col(record_id))).otherwise(parts)
    return F.concat_ws("_", folder, F.col(year))


def attachment_manifest(df: DataFrame) -> DataFrame:
    """One row per distinct attachment path with its place in the archive.

    The first report (by ``ingest_seq``) keeps a path that several reports list.
    The aggregate keeps one candidate per path on every map task, so a path that
    many reports share is not collected anywhere.
    """
    rows = df.select(
        case_folder().alias("folder"), "ingest_seq", F.inline("pdfs")
    ).filter(~blank("path"))
    first = rows.groupBy("path").agg(
        F.min(F.struct("ingest_seq", "pos", "folder")).alias("first")
    )
    file_name = F.element_at(F.split("path", "/"), -1)
    return first.select(
        "path", F.col("first.folder").alias("folder"),
        F.concat_ws("/", F.col("first.folder"), file_name).alias("archive_path"),
    )
