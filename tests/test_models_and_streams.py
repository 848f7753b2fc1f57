import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportloom.functions.extract import process_reports
from reportloom.operators import classify as C, cluster as K, topics as O, vectors as X
from reportloom.sources import files, pages
from reportloom.streaming import jobs


@pytest.fixture(scope="module")
def topics_corpus(spark):
    themes = [["ship", "boat", "harbour", "sailor", "anchor"], ["bread", "oven", "flour", "baker", "yeast"], ["piano", "violin", "concert", "melody", "organ"]]
    rows = [
        (i, f"Doc {i}", " ".join(themes[i % 3][(i + j) % 5] for j in range(4 + i % 4)) + f" extra{'xyz'[i % 3]}", None)
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "record_id long, title string, content string, date_of_report date")


def test_clustering_finds_the_groups(spark, topics_corpus):
    labels, metrics = K.cluster_documents(topics_corpus, min_df=1)
    best = metrics.filter("chosen").first()
    assert best["clusters"] == 3 and best["eligible"]
    groups = labels.withColumn("g", F.col("record_id") % 3).groupBy("cluster").agg(F.count_distinct("g").alias("n")).collect()
    assert all(r["n"] == 1 for r in groups)


@pytest.mark.parametrize("weighting", ["bm25", "tfidf"])
def test_projections_keep_dot_products(spark, topics_corpus, weighting):
    """Every term has directions of its own: close dot products, exact for a single term."""
    weights = X.tfidf(topics_corpus) if weighting == "tfidf" else X.unit_length(X.bm25(topics_corpus))
    vectors = {r.record_id: np.array(r.vector) for r in X.projected(weights, 1024).collect()}
    table = {}
    for r in weights.collect():
        table.setdefault(r.record_id, {})[r.term] = r.weight
    assert vectors.keys() == table.keys()
    for i in vectors:
        for j in vectors:
            exact = sum(w * table[j].get(t, 0.0) for t, w in table[i].items())
            assert vectors[i] @ vectors[j] == pytest.approx(exact, abs=0.2)
    single = spark.createDataFrame([(1, "aa", 1.0)], "record_id long, term string, weight double")
    assert np.linalg.norm(X.projected(single, 70).first().vector) == pytest.approx(1.0)


def test_topic_steps_equal_numpy(spark, topics_corpus):
    """The objective rises; weights and shares equal EM on a dense matrix, for one shard and for many."""
    k, steps, alpha, beta = 3, 3, 0.1, 0.01
    model = O.fit_topics(topics_corpus, k, iterations=steps, alpha=alpha, beta=beta, shard_rows=40)
    docs = {r.record_id: r.clean.split() for r in model.documents.collect()}
    words = sorted({w for ws in docs.values() for w in ws if len(w) > 1})
    tf = np.array([[ws.count(w) for w in words] for ws in docs.values()], float)
    phi = O.start_weights(np.arange(len(words)), k, 42)
    phi /= phi.sum(axis=0)
    theta = np.full((len(docs), k), 1 / k)
    for _ in range(steps):
        for turn in range(4):
            r = theta[:, None, :] * phi[None]
            r = tf[:, :, None] * r / r.sum(axis=2, keepdims=True)
            if turn < 3:
                theta = r.sum(axis=1) + alpha
                theta /= theta.sum(axis=1, keepdims=True)
        phi = r.sum(axis=0) + beta
        phi /= phi.sum(axis=0)
    got = {(r.topic, r.word): r.weight for r in model.words.collect()}
    assert got == {(t, w): pytest.approx(phi[i, t], rel=1e-9) for i, w in enumerate(words) for t in range(k)}
    shares = {(r.record_id, r.topic): r.share for r in model.shares.collect()}
    assert shares == {(d, t): pytest.approx(theta[i, t], rel=1e-9) for i, d in enumerate(docs) for t in range(k)}
    fit = [r.objective for r in model.fit.orderBy("step").collect()]
    assert len(fit) == steps and all(a < b for a, b in zip(fit, fit[1:]))


def test_cohesion_counts_copies(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "aa bb"), (4, "cc dd")], "record_id long, content string")
    labels = docs.select("record_id", F.lit(0).alias("cluster"))
    got = K.cohesion(X.tfidf(docs), labels).first()
    assert got["cohesion"] == pytest.approx((9 + 1) / 16)


def test_summary_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([("c", 1, "x" * 6), ("c", 2, "y" * 5), ("c", 3, "z")], "g string, rank int, s string")
    got = K.within_budget(rows, "g", F.length("s"), 10, F.asc("rank"))
    assert [r["rank"] for r in got.collect()] == [1]


def test_topics(spark, topics_corpus):
    model = O.fit_topics(topics_corpus, 3, iterations=5)
    sums = model.shares.groupBy("record_id").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0, abs=1e-6) for r in sums)
    assert len(sums) == topics_corpus.select("content").distinct().count()
    assert model.top_words(4).groupBy("topic").count().filter("count = 4").count() == 3
    insights = O.topic_insights(model, topics_corpus).collect()
    assert len(insights) == 3 and all(0 <= r["prevalence"] <= 100 for r in insights)
    exported = [json.loads(r["json"]) for r in O.topic_export(model, 2).collect()]
    assert all(len(t["words"]) == 2 and t["mean_share"] > 0 for t in exported)
    for r in O.word_network(model.words, 10, 0.5, 1).collect():
        assert 0 <= r["density"] <= 1 and r["degree"] >= 1


def test_number_of_topics_is_kept(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta word{'abcd'[i]}") for i in range(4)], "record_id long, content string")
    assert O.fit_topics(docs, 9, iterations=2).words.select("topic").distinct().count() == 9


def test_classifier_learns_and_keeps_unlabelled_rows(spark):
    rows = [(i, "water pipe leak" if i % 2 else "fire smoke heat", " Wet " if i % 2 else "HOT") for i in range(40)]
    train, test = C.prepare_labels(
        spark.createDataFrame(rows, "id int, text string, label string"),
        spark.createDataFrame([(1, "smoke", "hot"), (2, "pipe", "unseen")], "id int, text string, label string"))
    assert test.count() == 1
    assert [tuple(r) for r in C.label_index(train).collect()] == [(0, "hot"), (1, "wet")]
    model = C.train_classifier(train, features=256)
    assert C.evaluate_classifier(model, train).first()["accuracy"] == 1.0
    reports = spark.createDataFrame([(1, "t", "No water in the pipe leak. Fine day."), (2, "u", None)], "record_id int, title string, content string")
    got = C.classify_sentences(model, reports, threshold=0.5).collect()
    assert [(r["record_id"], r["theme"]) for r in got] == [(1, "wet")]


def test_ingest_equals_batch_and_reruns_add_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, f"Ref: 2020-{i:04d}\nDate: {1 + i % 28} March 2020") for i in range(40)]
    pages_in = spark.createDataFrame(rows, "record_id int, content string")
    pages_in.repartition(8).write.parquet(source)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        stream = jobs.report_stream(spark, source, pages_in.schema, files_per_batch=3)
        jobs.ingest(stream, target, state).awaitTermination()
    got = spark.read.parquet(target)
    assert got.select("batch").distinct().count() > 1
    expected = process_reports(pages_in).select("record_id", "ref", "date_of_report")
    assert sorted(map(tuple, got.select("record_id", "ref", "date_of_report").collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("delay", [None, "10 days"])
def test_stream_dedup_and_windows_equal_batch(spark, tmp_path, delay):
    source = str(tmp_path / "in")
    rows = spark.range(300).select(
        F.concat(F.lit("t"), F.col("id") % 20).alias("title"), (F.col("id") % 3).alias("url"),
        F.timestamp_seconds(1_600_000_000 + F.col("id") * 3600).alias("ts"))
    rows.orderBy("ts").repartitionByRange(6, "ts").write.parquet(source)
    stream = jobs.report_stream(spark, source, rows.schema, files_per_batch=2)
    kept = jobs.deduplicate_stream(stream, delay=delay).select("title", "url")
    got = jobs.run_to_table(kept, str(tmp_path / "d"), str(tmp_path / "ds"))
    assert got.count() == rows.select("title", "url").distinct().count()
    counted = jobs.run_to_table(
        jobs.windowed_counts(jobs.report_stream(spark, source, rows.schema, 2), width="2 days"),
        str(tmp_path / "w"), str(tmp_path / "ws"), "complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, jobs.windowed_counts(rows, width="2 days").collect()))


def test_csv_round_trip_and_frameworks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('title,content\n"A ""q""","line\nbreak"\n,\nB,x\n')
    got = files.read_report_folder(spark, [str(path)])
    assert sorted((r["title"], r["content"], r["source_file"]) for r in got.dropna(subset=["title"]).collect()) == [
        ('A "q"', "line\nbreak", "a.csv"), ("B", "x", "a.csv")]
    assert files.read_reports_csv(spark, str(path)).count() == 2
    frame = spark.createDataFrame([(1, ["a", "b"])], "i int, categories array<string>").withColumn("d", F.to_date(F.lit("2020-03-05")))
    files.write_reports_csv(frame, str(tmp_path / "out"))
    assert files.read_reports_csv(spark, str(tmp_path / "out")).first().asDict() == {"i": "1", "categories": '["a","b"]', "d": "05/03/2020"}
    (tmp_path / "f.json").write_text(json.dumps([{"name": "T", "keywords": ["abc", "no"]}, {"name": "bad"}]))
    good, bad = files.read_frameworks(spark, {"F": str(tmp_path / "f.json")})
    assert [(r["theme"], r["keyword"]) for r in good.collect()] == [("T", "abc")]
    assert bad.count() == 2
    files.write_reports(frame.withColumn("year", F.lit(2020)), str(tmp_path / "p"))
    assert os.path.isdir(tmp_path / "p" / "year=2020")


def test_page_with_attachments(spark):
    html = ('<html><title>T</title><script>var a="<p>no</p>";</script><h1>Head &amp; <b>line</b></h1>'
            '<p>One <i>two</i></p><table><tr><td>c1</td><td>c2</td></tr></table>'
            '<a href="/f/Reply.pdf">The reply</a><a href="x/main.pdf"></a><a href="https://o.org/p">other</a></html>')
    df = spark.createDataFrame([(1, "https://s.org/page", html)], "page_id int, url string, html string")
    row = pages.pages_to_reports(df).first()
    assert row["title"] == "Head & line" and row["content"] == "One two\nc1 c2"
    assert [(p["name"], p["path"], p["type"]) for p in row["pdfs"]] == [
        ("The reply", "/f/Reply.pdf", "response"), ("PDF_2", "x/main.pdf", "report")]
    links = [(r["link_url"], r["link_type"], r["is_pdf"]) for r in pages.page_links(df).orderBy("pos").collect()]
    assert links == [("https://s.org/f/Reply.pdf", "response", True), ("https://s.org/x/main.pdf", "report", True), ("https://o.org/p", "report", False)]


def test_manifest_keeps_the_first_report_of_a_path(spark):
    pdf = "array<struct<pos:int,name:string,content:string,path:string,type:string>>"
    rows = [(1, 2, "R1", "A/B", 2020, [(1, "n", "c", "/x/a.pdf", "report")]), (2, 1, None, None, None, [(1, "n", "c", "/x/a.pdf", "report"), (2, "n", "c", " ", "report")])]
    df = spark.createDataFrame(rows, f"record_id int, ingest_seq int, ref string, deceased_name string, year int, pdfs {pdf}")
    assert [tuple(r) for r in files.attachment_manifest(df).collect()] == [("/x/a.pdf", "report_2", "report_2/a.pdf")]
    first = files.attachment_manifest(df.filter("record_id = 1")).first()
    assert first["archive_path"] == "R1_A_B_2020/a.pdf"
