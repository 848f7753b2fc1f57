"""Stream queries: each runs over the data at hand and returns its output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions.extract import process_reports
from reportloom.plans.registry import query
from reportloom.plans.tables import REPORTS_SQL, reports, table
from reportloom.session import scratch_path
from reportloom.streaming import jobs


def _stream(spark, d, name, files_per_batch=5):
    schema = table(spark, d, name).schema
    return jobs.report_stream(spark, d, schema, files_per_batch, pattern=f"{name}.parquet")


@query("r1_incremental_ingest", f"""
    WITH {REPORTS_SQL}
    SELECT record_id, title, date_of_report, ref, deceased_name, coroner_name, coroner_area, categories, extracted_concerns FROM facts
""")
def _(spark, d):
    # The reports arrive as a dozen files, a few of them per batch.
    source, target = scratch_path(spark, "incoming"), scratch_path(spark, "ingest")
    arriving = reports(spark, d).select("record_id", "title", "content")
    arriving.repartition(12, "record_id").write.parquet(source)
    stream = jobs.report_stream(spark, source, arriving.schema, files_per_batch=5)
    jobs.ingest(stream, target, scratch_path(spark, "ingest_state"), process_reports).awaitTermination()
    found = spark.read.parquet(target).withColumn("categories", F.array_join("categories", "|"))
    return found.select(
        "record_id", "title", "date_of_report", "ref", "deceased_name", "coroner_name", "coroner_area",
        "categories", "extracted_concerns",
    )


@query("r2_deduplicate_stream", "SELECT DISTINCT event_type AS title, user_id AS url FROM events")
def _(spark, d):
    stream = _stream(spark, d, "events").select(
        F.col("event_type").alias("title"), F.col("user_id").alias("url"), F.col("ts").cast("timestamp").alias("ts")
    )
    # Keys are forgotten a year after they were last seen; the table covers less.
    kept = jobs.deduplicate_stream(stream, delay="365 days").select("title", "url")
    return jobs.run_to_table(kept, scratch_path(spark, "dedup"), scratch_path(spark, "dedup_state"))


_WEEK = "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')"


@query("r3_windowed_counts", """
    SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start,
      time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') + INTERVAL '7 days' AS window_end, event_type, count(*) AS n
    FROM events GROUP BY ALL
""")
def _(spark, d):
    # The table stores times without a zone; watermarks need the zoned type (UTC). Open windows count too.
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = jobs.windowed_counts(events, "ts", "7 days", "1 day", ["event_type"])
    found = jobs.run_to_table(counts, scratch_path(spark, "counts"), scratch_path(spark, "counts_state"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# Events arrive in three parts, errors after all others; each part is a run of its own from the same checkpoint.
_ARRIVED = f"""arrived AS (SELECT *, {_WEEK} AS window_start, CASE WHEN event_type = 'error' THEN 2
      ELSE event_id * 2 // (SELECT max(event_id) + 1 FROM events) END AS part FROM events),
    marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '1 day' AS closed
      FROM arrived GROUP BY part),
    judged AS (SELECT arrived.*, coalesce(window_start + INTERVAL '7 days' <= closed, false) AS late FROM arrived JOIN marks USING (part))"""


def _arrivals(spark, d):
    """Runs the parts one after the other; the folder of counts, late rows and ledger."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    after = events.agg(F.max("event_id") + 1).scalar()
    part = F.when(F.col("event_type") == "error", 2).otherwise(F.floor(F.col("event_id") * 2 / after))
    parts = events.withColumn("part", part)
    source, target, state = (scratch_path(spark, name) for name in ("arriving", "windows", "windows_state"))
    for number in range(3):
        parts.filter(F.col("part") == number).drop("part").write.mode("append").parquet(source)
        stream = jobs.report_stream(spark, source, events.schema, files_per_batch=1_000_000)
        jobs.count_windows(stream, target, state, keys=["event_type"]).awaitTermination()
    return target


@query("r3_closed_windows", f"""
    WITH {_ARRIVED} SELECT window_start, event_type, count(*) AS n,
      window_start + INTERVAL '7 days' <= (SELECT max(ts) - INTERVAL '1 day' FROM events) AS closed
    FROM judged WHERE NOT late GROUP BY 1, 2
""")
def _(spark, d):
    found = jobs.window_counts(spark, _arrivals(spark, d), keys=["event_type"])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "closed")


@query("r3_late_rows", f"WITH {_ARRIVED} SELECT event_id, user_id, event_type FROM judged WHERE late")
def _(spark, d):
    return jobs.late_rows(spark, _arrivals(spark, d)).select("event_id", "user_id", "event_type")


@query("r1_batch_ledger", f"""
    WITH {_ARRIVED} SELECT part::INT AS batch, count(*) AS rows, sum(late::INT)::BIGINT AS late FROM judged GROUP BY 1
""")
def _(spark, d):
    return jobs.read_ledger(spark, _arrivals(spark, d)).select("batch", "rows", "late")
