"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = 8, app: str = "reportloom", **conf) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("REPORTLOOM_DRIVER_MEMORY", "12g"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    Only a local master may fall back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    shared = tempfile.mkdtemp(prefix="reportloom-")
    spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs run inside; what was set before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# What a finished write has shuffled is not needed again: what follows reads the files.
WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def large_rows(spark: SparkSession, rows: int = 4, size: int = 8 << 20):
    """Settings for rows of some megabytes: few of them are read at once or travel to Python in one batch."""
    return settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def materialize(df, name: str, **options):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a table that several jobs reuse; unlike a cached block
    the files outlive lost executors. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, WRITES):
        df.write.mode("error").options(compression="zstd", **options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discard(written) -> None:
    """Delete the files of a table made by ``materialize`` that nobody reads any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize_buckets(df, name: str, buckets: int, column: str):
    """Like ``materialize``, dealt into buckets by ``column``, so that joins and groups by it need not shuffle the table again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    made = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with settings(spark, WRITES):
        df.write.mode("error").format("parquet").bucketBy(buckets, column).options(path=path, compression="zstd").saveAsTable(made)
    return spark.read.table(made)
