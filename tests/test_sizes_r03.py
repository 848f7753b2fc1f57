"""What queries move and whether they count all of their input."""

import random

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from reportloom.functions.text import split_sentences
from reportloom.operators import annotate as N, cluster as K, topics as O
from reportloom.streaming import jobs


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_not_shuffled_for_their_words(spark):
    docs = spark.createDataFrame([(1, "A word of the house. An end here."), (2, None), (2, "Of the word.")], "record_id int, content string")
    fw = spark.createDataFrame([("F", 0, "T", 0, "of the"), ("F", 0, "T", 1, "end")], "framework string, theme_idx int, theme string, kw_idx int, keyword string")
    found = N.sentence_matches(split_sentences(docs), fw)
    assert sorted((r.record_id, r.keyword) for r in found.collect()) == [(1, "end"), (1, "of the"), (2, "of the")]
    assert "Exchange hashpartitioning" not in executed(found)


def test_windows_that_are_still_open_are_counted(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-03 12:00:00' + to_days(d) AS ts, 7::BIGINT AS user_id, 'click' AS event_type
      FROM (VALUES (1, 0), (2, 0), (3, 40), (4, 41)) t(i, d)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, queries()["r3_windowed_counts"](spark, str(tmp_path)).collect()))
    assert sum(r[-1] for r in got) == 4
    assert got == sorted(con.sql(oracle_sql()["r3_windowed_counts"]).fetchall())


def test_a_budget_is_cut_inside_parts_of_a_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9), rng.randint(0, 40)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, id int, n int, score int")
    order = (F.desc("score"), F.asc("id"))
    near = K._leading(df.withColumn("_len", F.col("n")).filter("n > 0"), "g", 20, *order)
    assert near.count() < len(rows) - sum(n == 0 for _, _, n, _ in rows)
    for budget in (0, 20, 500):
        wanted = set()
        for g in "ab":
            total = 0
            for _, i, n, _ in sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: (-r[3], r[1])):
                total += n
                if total > budget:
                    break
                wanted.add(i)
        assert {r.id for r in K.within_budget(df, "g", F.col("n"), budget, *order).collect()} == wanted


def test_keys_with_several_labels_keep_their_lengths(spark):
    weights = spark.createDataFrame(
        [(1, "x", 0.6), (1, "y", 0.8), (2, "x", 1.0), (3, "z", 1.0), (4, "y", 1.0)], "record_id int, term string, weight double")
    labels = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "b")], "record_id int, cluster string")
    placed = K.members(weights, labels)
    assert sorted((r.record_id, r.times) for r in placed.collect()) == [(1, 2)] * 4 + [(2, 1), (3, 1), (4, 1)]
    own, stats, dots = K._distances(placed, K.centroids(placed, labels), labels, "record_id")
    assert sorted((r.record_id, round(r.own, 9)) for r in own.collect()) == [(1, 1.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 0.0)]
    assert {(r.record_id, r.other): round(r.dot, 6) for r in dots.collect() if r.record_id == 1} == {
        (1, "a"): round(0.6 * 1.2 / 3 + 0.8 * 2.6 / 3, 6), (1, "b"): 0.2}
    assert {r.documents for r in K.cluster_quality(weights, labels).collect()} == {6}


def test_counts_of_topics_stay_where_they_are(spark):
    rows = [(i, " ".join(f"word{chr(97 + (i * j) % 23)}" for j in range(12))) for i in range(40)] + [(3, "worda wordzz"), (None, "wordb wordyy")]
    texts = spark.createDataFrame(rows, "record_id int, clean string")
    shards = O._shard_numbers(spark, 3)
    assert spark.createDataFrame([(s,) for s in shards], "shard long").repartition(3, "shard").selectExpr("spark_partition_id() AS p").distinct().count() == 3
    blocks = O.count_blocks(texts, "record_id", shards, (), block_rows=60)
    assert blocks.count() > 3
    keys = [r.k for r in blocks.select(F.explode("docs").alias("k")).collect()]
    assert sorted(keys) == list(range(40))  # a key of two texts is one document, a text without one is none
    assert {r.t for r in blocks.select(F.explode("new").alias("t")).collect()} == {w for k, t in rows if k is not None for w in t.split()}
    right = spark.createDataFrame([(s, 0, 0, 1.0) for s in shards], "shard long, place long, term_id long, p0 double")
    grouped = blocks.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lambda a, b: a.select(["shard"]), "shard long")
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the weights, not the blocks


def test_all_tasks_work_on_a_batch_of_one_file(spark, tmp_path):
    arriving = spark.range(1000).selectExpr("id AS record_id", "concat('Report ', id) AS title", "'Ref: 2020-0001' AS content")
    arriving.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.report_stream(spark, f"{tmp_path}/in", arriving.schema)
    jobs.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda b: b.withColumn("_task", F.spark_partition_id())).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 1000 and found.select("record_id").distinct().count() == 1000
    assert found.select("_task").distinct().count() >= spark.sparkContext.defaultParallelism
