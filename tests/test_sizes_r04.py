"""What steps leave on disk and hold in memory at once."""

import pytest
from pyspark.sql import functions as F

from reportloom import session as S
from reportloom.llm import decontamination as D
from reportloom.operators import blocks as B, cluster as K, topics as O, vectors as X


def held_shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_a_written_table_leaves_no_shuffle_behind(spark):
    sums = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    before = held_shuffles(spark)
    made = S.materialize(sums, "sums")
    assert held_shuffles(spark) <= before
    assert made.agg(F.sum("n")).first()[0] == sum(range(5000)) == sums.agg(F.sum("n")).first()[0]
    S.discard(made)
    assert not spark._jvm.java.io.File(made.scratch_path).exists()


def test_settings_hold_inside_only(spark):
    size, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(size), spark.conf.get(rows)
    try:
        with S.large_rows(spark, 3, 1 << 20):
            assert (spark.conf.get(size), spark.conf.get(rows)) == (str(1 << 20), "3")
            raise ValueError
    except ValueError:
        pass
    assert (spark.conf.get(size), spark.conf.get(rows)) == before


def test_few_segments_are_read_at_once(spark, monkeypatch):
    """Segments are rows of megabytes; a batch of all segments of a file grew with the file."""
    monkeypatch.setattr(D, "SLICE", 200)
    seen, real = {}, D.materialize

    def counted(df, name, **options):
        seen[name] = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), options
        return real(df, name, **options)

    monkeypatch.setattr(D, "materialize", counted)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(200)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", " ".join(f"w{(5 * j) % 97}" for j in range(12)))], "item_id string, text string")
    rows = D.decontaminate(docs, bench).collect()
    assert int(seen["matches"][0]) <= 8 and int(seen["matches"][1]) <= 16 << 20 and int(seen["positional-index"][1]) <= 16 << 20
    assert int(seen["positional-index"][2]["parquet.block.size"]) <= 32 << 20
    assert len(rows) == 200 and {r.doc_id for r in rows if r.contaminated} >= {5}


def test_shards_of_topics_are_bounded_and_steps_leave_no_tables(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"word{chr(97 + (i * j) % 23)}" for j in range(12))) for i in range(40)], "record_id int, content string")
    monkeypatch.setattr(S, "scratch_root", lambda spark: str(tmp_path))
    whole = O.fit_topics(docs, 2, iterations=3)
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("topic-s")]) <= 1
    monkeypatch.setattr(O, "SHARD_CHARS", (16_000_000, 300))
    made, numbers = [], O._shard_numbers
    monkeypatch.setattr(O, "_shard_numbers", lambda spark, n: made.append(n) or numbers(spark, n))
    parts = O.fit_topics(docs, 2, iterations=3)
    assert made[0] > 5 and O.SHARD_ROWS <= 250_000
    weights = [{(r.topic, r.word): round(r.weight, 9) for r in m.words.collect()} for m in (whole, parts)]
    assert weights[0] == weights[1] and len(weights[0]) > 10
    fits = [[round(r.objective, 6) for r in m.fit.orderBy("step").collect()] for m in (whole, parts)]
    assert fits[0] == fits[1] == sorted(fits[0]) and len(fits[0]) == 3


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_describe_clusters_like_long_weights(spark, monkeypatch, odd):
    """Keys that repeat or are null, several or no labels of a key, texts without a term; blocks of few words, one cluster at once."""
    rows = [(i, " ".join(f"w{'abc'[i % 3]}{(i * j) % 11}" for j in range(3 + i % 9))) for i in range(60)] + [(60, ""), (61, None), (62, "the of")]
    labels = [(i, "xyz"[i % 3]) for i in range(63)]
    if odd:
        rows += [(3, "wa1 wa1 more"), (5, rows[5][1]), (None, "wa1 wb2 nobody"), (None, "wb2")]
        labels += [(4, "y"), (4, "y"), (7, None), (8, "v"), (None, "x"), (99, "x")]
        labels = labels[:30] + labels[31:]
    docs = spark.createDataFrame(rows, "record_id int, content string").repartition(3)
    labels = spark.createDataFrame(labels, "record_id int, cluster string")
    monkeypatch.setattr(B, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(B, "PART_CLUSTERS", 1)
    monkeypatch.setattr(B, "MOST_CELLS", 30)
    long, blocks = S.materialize(X.tfidf(docs), "weights"), B.tfidf_blocks(docs)
    assert blocks.table.count() > 5
    for describe in (K.cluster_terms, K.representative_documents, K.cohesion, K.silhouette, K.cluster_quality):
        found = [sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in describe(w, labels).collect()), key=repr) for w in (long, blocks)]
        assert found[0] == found[1] and found[0], describe.__name__


def test_only_terms_and_labels_of_blocks_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"one two three four word{i % 5}") for i in range(50)], "record_id int, content string")
    labels = docs.selectExpr("record_id", "record_id % 3 AS cluster")
    placed = K.members(B.tfidf_blocks(docs), labels)
    with S.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = placed.table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "weight" not in plan


def test_a_summary_ranks_sentences_without_moving_their_words(spark, monkeypatch):
    """Keys that repeat, several, null or no labels; scores as counted in plain Python, one table of texts and no row per sentence and term."""
    import math
    import re
    from collections import Counter

    rows = [(1, "Alpha beta beta. Gamma ran. Ran again"), (2, "Alpha gamma. Delta delta epsilon"), (2, "Beta alpha. Zeta"), (3, "Theta iota. Of the."), (4, "Alpha"), (5, None), (None, "Lost words")]
    labels = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 1), (4, None), (9, 1)]
    docs, given = spark.createDataFrame(rows, "record_id int, content string"), spark.createDataFrame(labels, "record_id int, cluster int")
    monkeypatch.setattr(B, "BLOCK_TOKENS", 4)
    written, real = [], K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, name, **o: written.append((name, df.columns)) or real(df, name, **o))
    found = [(r.cluster, r.record_id, r.sentence, round(r.score, 8)) for r in K.extractive_summary(docs, given, 1000, stop_words=["of", "the"]).collect()]
    assert written and all("term" not in columns for _, columns in written) and sum("sentence" in columns for _, columns in written) == 1

    sentences = [(c, k, i, s) for k, t in rows for l, c in labels if k == l and t for i, s in enumerate(re.split(r"(?<=[.])\s+(?=[A-Z])", t))]
    tf, df, score = {}, Counter(), {}
    for c, k, i, s in sentences:
        tf.setdefault((c, k, i), Counter()).update(w for w in re.findall(r"\w{2,}", s.lower()) if w not in ("of", "the"))
    for (c, _, _), terms in tf.items():
        df.update((c, t) for t in terms)
    n, width = Counter(c for c, *_ in sentences), Counter(c for c, _ in df)
    for (c, k, i), terms in tf.items():
        w = [m * (math.log((n[c] + 1) / (df[c, t] + 1)) + 1) for t, m in terms.items()]
        score[c, k, i] = sum(w) / math.sqrt(sum(x * x for x in w)) / width[c] if w and c is not None else 0.0
    assert sorted(found, key=repr) == sorted(((c, k, s, round(score[c, k, i], 8)) for c, k, i, s in sentences), key=repr)
