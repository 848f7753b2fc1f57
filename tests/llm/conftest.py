import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import COLUMNS, EDGE  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with more columns, whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("_row", "__row", "_d", "_h", "_text_hash", "kept", "base", "weak", "grp", "text_sha256", "label", "spans", "node", "words", "n_words", "start"):
        df = df.withColumn(name, F.lit("other"))
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
