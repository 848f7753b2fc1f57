"""Helpers for dimension tables of known, small size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Largest dimension (frameworks, labels, top-N lists) that may travel as one value.
MAX_DIMENSION_ROWS = 200_000


def as_array(dim: DataFrame, *columns: str, max_rows: int = MAX_DIMENSION_ROWS) -> Column:
    """The rows of a small dimension as one sorted array (scalar subquery).

    The size is checked while the query runs: a larger table raises an error
    instead of being copied to every task.
    """
    packed = dim.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")
    )
    too_many = F.raise_error(F.lit(f"dimension exceeds {max_rows} rows"))
    return packed.select(
        F.when(F.col("n") <= max_rows, F.col("rows")).otherwise(too_many).alias("rows")
    ).scalar()


def with_each(df: DataFrame, dim: DataFrame, *columns: str, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """Every row of ``df`` with every row of a small dimension (zero-filled grids)."""
    staged = df.withColumn("_dim", as_array(dim, *columns, max_rows=max_rows))
    return staged.select(*df.columns, F.inline("_dim"))


def top_n(counts: DataFrame, n: int, by: str, name: str, rank: str | None = None) -> DataFrame:
    """The ``n`` largest rows; ties are broken by name."""
    best = counts.orderBy(F.desc(by), F.asc(name)).limit(n)
    if rank is None:
        return best
    # At most n rows reach this window.
    order = Window.orderBy(F.desc(by), F.asc(name))
    return best.withColumn(rank, F.row_number().over(order))


def top_n_per_group(df: DataFrame, group, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps n per group on the map side."""
    keys = [group] if isinstance(group, str) else list(group)
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= n)
