"""Dense numbers for the terms of a corpus, without hashing and without a vocabulary on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reportloom.session import materialize

PLACE_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in its lower 33 bits


def number_terms(terms: DataFrame, term: str = "term", name: str = "term_id") -> DataFrame:
    """``(term, term_id)``: 0, 1, 2, ... in the order of the terms' bytes, whatever the partitioning.

    Terms are made distinct with partial aggregation and dealt out by range; every partition
    numbers its sorted terms, and the sizes of the partitions before it are added. Only one
    size a partition is broadcast. A null term gets no number.
    """
    distinct = terms.select(F.col(term).alias("_term")).filter("_term is not null").distinct()
    placed = distinct.repartitionByRange("_term").sortWithinPartitions("_term").select(
        "_term", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).alias("_place"),
    )
    # Written, so that every reader sees the same places, also after a lost executor.
    placed = materialize(placed, "dictionary")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(
        F.col("_term").alias(term), (F.col("_start") + F.col("_place")).alias(name)
    )
