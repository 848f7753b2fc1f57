from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reportloom.streaming import jobs

SCHEMA = "id int, ts timestamp, kind string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(spark, tmp_path, rows=None, state="state"):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    if rows is not None:
        typed = [(i, None if day is None else START + timedelta(days=day), kind) for i, day, kind in rows]
        spark.createDataFrame(typed, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.report_stream(spark, source, SCHEMA, files_per_batch=100)
    jobs.count_windows(stream, target, str(tmp_path / state), width="2 days", delay="1 day", keys=["kind"]).awaitTermination()
    return target


def counts(spark, target):
    found = jobs.window_counts(spark, target, "1 day", ["kind"])
    day = F.datediff("window_start", F.lit(START.date()))
    return {(r.day, r.kind): (r.n, r.closed) for r in found.withColumn("day", day).collect()}


def test_late_rows_and_restart(spark, tmp_path):
    """Counts of closed windows stay, rows for them are kept apart; a run from the same checkpoint goes on."""
    target = run(spark, tmp_path, [(1, 0.1, "a"), (2, 0.2, "a"), (3, 4.5, "b"), (4, None, "a")])
    first = counts(spark, target)
    low = min(day for day, _ in first)
    assert first[low, "a"] == (2, True) and not first[max(d for d, _ in first), "b"][1]
    assert [r.id for r in jobs.late_rows(spark, target).collect()] == [4]
    # A new run from the same checkpoint: one row of a closed window, one of the open one, a repeated row.
    target = run(spark, tmp_path, [(5, 0.3, "a"), (6, 4.6, "b"), (6, 4.6, "b")])
    second = counts(spark, target)
    assert second[low, "a"] == (2, True)
    assert sum(n for n, _ in second.values()) == 5
    assert sorted((r.id, r.batch) for r in jobs.late_rows(spark, target).collect()) == [(4, 0), (5, 1)]
    ledger = [(r.batch, r.rows, r.late) for r in jobs.read_ledger(spark, target).orderBy("batch").collect()]
    assert ledger == [(0, 4, 1), (1, 3, 1)]
    # Nothing new: nothing changes.
    assert counts(spark, run(spark, tmp_path)) == second


def test_repeated_batch_is_passed_over(spark, tmp_path):
    """A lost checkpoint replays the same rows under the same number: recognised and not counted twice."""
    rows = [(1, 0.1, "a"), (2, 3.5, "b")]
    target = run(spark, tmp_path, rows)
    before = counts(spark, target)
    assert counts(spark, run(spark, tmp_path, state="other")) == before
    assert jobs.read_ledger(spark, target).count() == 1
    with pytest.raises(Exception, match="another checkpoint"):
        run(spark, tmp_path, [(3, 9.0, "c")], state="third")
    assert counts(spark, target) == before


def test_batch_without_ledger_row_is_run_again(spark, tmp_path):
    """Files of a batch that never reached the ledger are replaced."""
    target = str(tmp_path / "out")
    junk = spark.createDataFrame([(START, START, "a", 99)], "window_start timestamp, window_end timestamp, kind string, n long")
    junk.write.parquet(f"{target}/counts/batch=0")
    run(spark, tmp_path, [(1, 0.1, "a")])
    assert [n for n, _ in counts(spark, target).values()] == [1]


def test_empty_batch_and_rows_without_time(spark, tmp_path):
    target = run(spark, tmp_path, [(1, None, None), (2, None, "a")])
    assert counts(spark, target) == {}
    assert jobs.late_rows(spark, target).count() == 2
    target = run(spark, tmp_path, [(3, 0.5, None)])
    assert [(k, v) for (_, k), v in counts(spark, target).items()] == [(None, (1, False))]
