"""First-wins deduplication and seen-set difference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def keep_first(
    df: DataFrame, keys: Sequence[str], order: str = "ingest_seq", keep_null_keys: bool = False
) -> DataFrame:
    """First row per key by ``order``; NULL keys equal each other.

    The rank filter is applied on the map side before the shuffle, so a key
    shared by a third of the rows sends one row per task.
    ``keep_null_keys`` leaves rows whose keys are all NULL alone.
    """
    ranked = Window.partitionBy(*keys).orderBy(order)

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(ranked)).filter("_rn = 1").drop("_rn")

    if not keep_null_keys:
        return first(df)
    no_key = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in keys])
    return first(df.filter(~no_key)).unionByName(df.filter(no_key))


def deduplicate_reports(
    df: DataFrame, keys: Sequence[str] = (), record_id: str = "record_id", order: str = "ingest_seq"
) -> DataFrame:
    """Dedup on the chosen keys, then always on the record id."""
    present = [k for k in keys if k in df.columns]
    first = keep_first(df, present, order) if present else df
    return keep_first(first, [record_id], order) if record_id in df.columns else first


def new_reports(
    batch: DataFrame, seen: DataFrame, keys: Sequence[str] = ("title", "url"), order: str = "ingest_seq"
) -> DataFrame:
    """Rows of ``batch`` whose keys were not seen before, once each."""
    fresh = keep_first(batch, keys, order)
    known = seen.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return fresh.join(known, same, "left_anti")
