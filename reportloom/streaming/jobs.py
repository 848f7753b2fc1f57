"""Incremental ingest as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reportloom.functions.extract import process_reports


def report_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 5,
    file_format: str = "parquet", pattern: str | None = None,
) -> DataFrame:
    """Files of a folder as a stream, a few per batch."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def ingest(
    stream: DataFrame, target: str, checkpoint: str,
    process: Callable[[DataFrame], DataFrame] = process_reports,
) -> StreamingQuery:
    """Process each batch and write it below ``target``, one folder per batch.

    A batch that is run again after a failure replaces its own folder, so no row
    is written twice. Rows of a batch are dealt out to all tasks, so a few large files are no few long tasks.
    """
    def save(batch: DataFrame, number: int) -> None:
        tasks = 2 * batch.sparkSession.sparkContext.defaultParallelism
        process(batch.repartition(tasks)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def deduplicate_stream(
    stream: DataFrame, keys: Sequence[str] = ("title", "url"), time: str = "ts", delay: str | None = None
) -> DataFrame:
    """First row per key across batches.

    Without ``delay`` every key is remembered, as a seen-set over the whole run;
    with it keys are forgotten once the watermark has passed them.
    """
    if delay is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(frame: DataFrame, time: str = "ts", width: str = "7 days", delay: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per tumbling window; the same expression runs on batch and stream."""
    marked = frame.withWatermark(time, delay) if frame.isStreaming else frame
    counted = marked.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n"
    )


# --- windows that close, late rows, and a ledger of batches

LEDGER = "batch int, rows long, late long, last timestamp, digest string"


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """One row per batch: number of rows, of late rows, latest time, and a digest of the content."""
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def _digest(rows: DataFrame) -> Column:
    """Sum of row hashes: the order of rows does not matter, repeated rows do."""
    return F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).cast("decimal(38,0)")).cast("string"), F.lit(""))


def _closed_at(ledger: DataFrame, delay: str) -> Column:
    """The time up to which windows are closed; null before the first row with a time."""
    return F.timestamp_micros(ledger.agg(F.unix_micros(F.max("last"))).scalar()) - F.expr(f"INTERVAL {delay}")


def count_windows(
    stream: DataFrame, target: str, checkpoint: str, time: str = "ts", width: str = "7 days", delay: str = "1 day",
    keys: Sequence[str] = (),
) -> StreamingQuery:
    """Counts per tumbling window below ``target``, late rows in a table of their own, and a ledger of batches.

    A window is closed once a row ``delay`` past its end was seen in an earlier batch. A row of a closed window is
    late, as is a row without a time: it goes to ``late`` whole and changes no count. Every batch adds its own
    partial counts, so state is one row per batch, window and key. The ledger row is written last. A batch without one
    is run again from the start; a batch that has one and the same content is passed over. Other content
    under a known number means that the target belongs to another checkpoint, which is an error.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], LEDGER).drop("batch").write.mode("ignore").parquet(f"{target}/ledger/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger = read_ledger(session, target)
        batch = batch.persist()
        try:
            digest = batch.agg(_digest(batch).alias("digest")).first()["digest"]
            known = ledger.filter(F.col("batch") == number).first()
            if known is not None:
                if known["digest"] != digest:
                    raise ValueError(f"batch {number} of {target} has other content; the target belongs to another checkpoint")
                return
            closed = _closed_at(ledger.filter(F.col("batch") < number), delay)
            timed = batch.filter(F.col(time).isNotNull()).select(F.window(time, width).alias("_window"), "*")
            open_rows = timed.filter(F.coalesce(F.col("_window.end") > closed, F.lit(True)))
            late = timed.filter(F.col("_window.end") <= closed).drop("_window").unionByName(batch.filter(F.col(time).isNull()))
            counts = open_rows.groupBy("_window", *keys).agg(F.count("*").alias("n"))
            late.write.mode("overwrite").parquet(f"{target}/late/batch={number}")
            counts.select(
                F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, "n"
            ).write.mode("overwrite").parquet(f"{target}/counts/batch={number}")
            n_late = session.read.parquet(f"{target}/late/batch={number}").agg(F.count("*")).scalar()
            batch.agg(
                F.count("*").alias("rows"), n_late.alias("late"), F.max(time).cast("timestamp").alias("last"),
                F.lit(digest).alias("digest"),
            ).write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def window_counts(spark: SparkSession, target: str, delay: str = "1 day", keys: Sequence[str] = ()) -> DataFrame:
    """Counts of all windows that ``count_windows`` has seen; the counts of closed ones are final."""
    counts = spark.read.parquet(f"{target}/counts").groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))
    return counts.withColumn("closed", F.coalesce(F.col("window_end") <= _closed_at(read_ledger(spark, target), delay), F.lit(False)))


def late_rows(spark: SparkSession, target: str) -> DataFrame:
    """The late rows of all batches, each with its batch."""
    return spark.read.parquet(f"{target}/late")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the data available now; read back what it wrote.

    ``append`` writes files. ``complete`` and ``update`` results replace the table
    per batch, so the last batch holds the whole aggregate in ``complete`` mode.
    """
    spark = stream.sparkSession
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)
