import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators import annotate as N, cluster as K, dashboard as D, dedup, evaluate as V, profile as A, spans as S, vectors as X
from reportloom.operators.small import as_array, with_each


def test_keep_first_null_keys_and_ties(spark):
    rows = [(1, "a", 3), (2, "a", 1), (3, None, 2), (4, None, 5), (5, "b", 4)]
    df = spark.createDataFrame(rows, "record_id int, ref string, ingest_seq int")
    assert {r["record_id"] for r in dedup.keep_first(df, ["ref"]).collect()} == {2, 3, 5}
    assert {r["record_id"] for r in dedup.keep_first(df, ["ref"], keep_null_keys=True).collect()} == {2, 3, 4, 5}
    once = dedup.deduplicate_reports(df, ["ref"])
    assert sorted(map(tuple, dedup.deduplicate_reports(once, ["ref"]).collect())) == sorted(map(tuple, once.collect()))


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("ref"), F.col("id").alias("ingest_seq"))
    plan = dedup.keep_first(df, ["ref"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dimension_bound_is_enforced(spark):
    dim = spark.range(20)
    with pytest.raises(Exception, match="dimension exceeds"):
        spark.range(1).select(as_array(dim, "id", max_rows=10)).collect()
    assert with_each(spark.range(3).toDF("a"), dim, "id").count() == 60


def annotations(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = {(r, f"F{t % 2}", f"T{t}") for r in range(n) for t in rng.sample(range(8), rng.randint(1, 5))}
    full = [(r, f, t, 0.5, f"A{r % 7}", 2000 + r % 4, "High") for r, f, t in sorted(rows)]
    return spark.createDataFrame(
        full, "record_id int, framework string, theme string, combined_score double, coroner_area string, year int, confidence string")


def test_theme_correlation_is_pearson(spark):
    a = annotations(spark)
    data = a.select("record_id", "theme").collect()
    present = {}
    for r in data:
        present.setdefault(r["record_id"], set()).add(r["theme"])
    n = len(present)

    def pearson(x, y):
        xs = [x in s for s in present.values()]
        ys = [y in s for s in present.values()]
        mx, my = sum(xs) / n, sum(ys) / n
        cov = sum((p - mx) * (q - my) for p, q in zip(xs, ys))
        return cov / math.sqrt(sum((p - mx) ** 2 for p in xs) * sum((q - my) ** 2 for q in ys))

    got = D.theme_correlation(a, 5).collect()
    assert len(got) == 25
    for r in got:
        assert r["correlation"] == pytest.approx(pearson(r["theme_a"], r["theme_b"]), abs=1e-4)


def test_theme_in_every_report_has_no_correlation(spark):
    rows = [(i, "F", t, 0.5) for i in range(4) for t in ("all", f"t{i % 2}")]
    a = spark.createDataFrame(rows, "record_id int, framework string, theme string, combined_score double")
    got = {(r["theme_a"], r["theme_b"]): r["correlation"] for r in D.theme_correlation(a).collect()}
    assert got[("all", "t0")] is None and got[("all", "all")] is None
    assert got[("t0", "t1")] == -1.0


def test_dashboard_properties(spark):
    a = annotations(spark)
    co = {(r["theme_a"], r["theme_b"]): r["n"] for r in D.co_occurrence(a, 8).collect()}
    counts = {r["theme"]: r["n"] for r in D.top_themes(a, 8).collect()}
    assert all(co[(t, t)] == n for t, n in counts.items())
    assert all(co[(x, y)] == co[(y, x)] for x, y in co)
    per_year = D.theme_prevalence(a, 8).groupBy("year").agg(F.sum("prevalence_pct").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100, abs=0.1) for r in per_year)
    stacked = D.stacked_area_profile(a, n=3).groupBy("coroner_area").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    cases = {r["coroner_area"]: r["n"] for r in a.groupBy("coroner_area").agg(F.count("*").alias("n")).collect()}
    assert all(r["n"] == cases[r["coroner_area"]] and r["rows"] <= 4 for r in stacked)
    wide = D.comparison_pivot(D.multi_area_comparison(a, 1, 3), ["T0", "T1"])
    assert wide.columns == ["coroner_area", "total_cases", "T0", "T1"]
    assert D.score_histogram(a).agg(F.sum("n")).first()[0] == a.count()
    far = a.sparkSession.createDataFrame([(1.2,), (-0.1,), (0.5,), (None,)], "combined_score double")
    assert {r["bin"]: r["n"] for r in D.score_histogram(far).filter("n > 0").collect()} == {20: 1, -1: 1, 10: 1}


def test_theme_groups_ignore_case(spark):
    df = spark.createDataFrame([("Local Working Conditions - x",), ("External",), ("Odd - y",)], "theme string")
    assert [r[0] for r in df.select(D.theme_group("theme")).collect()] == ["Internal", "External", "Other"]


def test_no_cartesian_product_in_grids(spark):
    a = annotations(spark, 50)
    for df in (D.area_theme_grid(a), D.theme_correlation(a), D.multi_area_comparison(a)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_evaluation(spark):
    rows = [("r", "A", "a"), ("r", "B", "B"), ("s", "A", "B"), ("s", " ", "C"), ("s", None, "C"), ("s", "never", "A")]
    df = spark.createDataFrame(rows, "title string, human string, predicted string")
    m = {r["label"]: r for r in V.theme_metrics(df).collect()}
    assert (m["a"]["precision"], m["a"]["recall"]) == (0.5, 0.5)
    assert (m["never"]["precision"], m["never"]["recall"]) == (0.0, 0.0)
    confusion = V.confusion(df)
    assert confusion.agg(F.sum("n")).first()[0] == 4
    assert confusion.filter("predicted = human").count() == len({"A", "a", "B", "never"})
    assert {r["title"]: r["correct_themes"] for r in V.report_precision(df).collect()} == {"r": "B", "s": ""}


def test_corrections(spark):
    p = spark.createDataFrame([(1, "X"), (2, "X"), (3, "X"), (4, "X")], "record_id int, predicted string")
    c = spark.createDataFrame([(1, "No Theme"), (2, "X"), (3, "Other")], "record_id int, selected string")
    got = {r["record_id"]: r["human"] for r in V.apply_corrections(p, c).collect()}
    assert got == {1: "", 2: "X", 3: "other", 4: None}


def test_merge_spans(spark):
    rows = [(1, 0, 10, "a", "k1", "s1"), (1, 2, 5, "b", "k2", "s2"), (1, 10, 12, "c", "k3", "s3"), (1, 13, 20, "d", "k4", "s4"), (2, 0, 1, "e", "k", "s")]
    df = spark.createDataFrame(rows, "record_id int, start int, end int, theme_key string, keywords string, sentence string")
    got = sorted(tuple(r) for r in S.merge_spans(df).collect())
    assert got == [(1, 0, 12, "a + b + c", "k1 + k2 + k3", "a", "s1"), (1, 13, 20, "d", "k4", "d", "s4"), (2, 0, 1, "e", "k", "e", "s")]
    text = spark.createDataFrame([(1, "0123456789abcdefghijklm"), (3, "untouched")], "record_id int, content string")
    shown = {r["record_id"]: r["highlighted"] for r in S.highlight(text, S.merge_spans(df)).collect()}
    assert shown == {1: "[0123456789ab]c[defghij]klm", 3: "untouched"}


def test_keyword_occurrences_overlap(spark):
    df = spark.createDataFrame([(1, "aAaa xx Aa"), (2, "none"), (3, "a.a.a")], "record_id int, content string")
    kw = spark.createDataFrame([("aa",), ("a.a",)], "keyword string")
    got = sorted(tuple(r) for r in S.keyword_occurrences(df, kw).collect())
    assert got == [(1, 0, 2, "aA"), (1, 1, 3, "Aa"), (1, 2, 4, "aa"), (1, 8, 10, "Aa"), (3, 0, 3, "a.a"), (3, 2, 5, "a.a")]


def framework(spark):
    return spark.createDataFrame([
        ("F", 0, "T0", 0, "poor care"), ("F", 0, "T0", 1, "care"), ("F", 1, "T1", 0, "Care"), ("F", 1, "T1", 1, "co-op"),
        ("F", 2, "T2", 0, "ca"),
    ], "framework string, theme_idx int, theme string, kw_idx int, keyword string")


def test_keyword_spans_whole_words(spark):
    df = spark.createDataFrame([(1, "Poor care here. Careful now. The co-op, a co-opt.")], "record_id int, content string")
    from reportloom.functions.text import split_sentences
    got = sorted((r["theme"], r["start"], r["keywords"]) for r in N.keyword_spans(split_sentences(df), framework(spark)).collect())
    assert got == [("T0", 0, "poor care, care"), ("T1", 0, "Care"), ("T1", 29, "co-op")]


def scored(spark, rows):
    return spark.createDataFrame(
        [(1, "F", i, f"T{i}", ks, s) for i, (ks, s) in enumerate(rows)],
        "record_id int, framework string, theme_idx int, theme string, keyword_list array<string>, combined_score double")


def test_select_themes_needs_new_keyword_or_high_score(spark):
    rows = [(["a"], 0.9), (["a"], 0.76), (["a"], 0.74), (["a", "b"], 0.7), (["b"], 0.69), (["c"], 0.68)]
    got = {r["theme"] for r in N.select_themes(scored(spark, rows)).collect()}
    assert got == {"T0", "T1", "T3"}


def test_annotate_at_the_default_threshold(spark):
    docs = spark.createDataFrame([(1, "t", "Poor care here."), (2, "u", "Nothing."), (3, "v", None)], "record_id int, title string, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "record_id int, vector array<double>")
    themes = spark.createDataFrame([("F", 0, "T0", [1.0, 0.1]), ("F", 1, "T1", [0.0, 1.0])], "framework string, theme_idx int, theme string, theme_vector array<double>")
    got = N.annotate(docs, framework(spark), vectors, themes).collect()
    assert [(r["record_id"], r["theme"], r["confidence"], r["matched_sentences"]) for r in got] == [(1, "T0", "High", "Poor care here.")]
    assert got[0]["combined_score"] == pytest.approx(0.3 + 0.7 * 1 / math.sqrt(1.01), abs=1e-3)
    all_rows = N.with_placeholders(N.annotate(docs, framework(spark), vectors, themes), docs, framework(spark))
    assert all_rows.filter(F.col("theme") == D.NO_THEME).count() == 2


def test_context_vectors_raise_similarity(spark):
    pairs = spark.createDataFrame([(1, "F", "T0", ["k"])], "record_id int, framework string, theme string, keyword_list array<string>")
    vec = "array<double>"
    docs = spark.createDataFrame([(1, [0.0, 1.0])], f"record_id int, vector {vec}")
    themes = spark.createDataFrame([("F", "T0", [1.0, 0.0])], f"framework string, theme string, theme_vector {vec}")
    context = spark.createDataFrame([(1, "k", [1.0, 1.0])], f"record_id int, keyword string, vector {vec}")
    assert N.semantic_similarity(pairs, docs, themes).first()["semantic_similarity"] == 0.0
    got = N.semantic_similarity(pairs, docs, themes, context).first()["semantic_similarity"]
    assert got == pytest.approx(1 / math.sqrt(2))


def corpus(spark, n, words, length, copies, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i:03d}" for i in range(words)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(words)], k=length)) for _ in range(n)]
    texts += [texts[0]] * copies  # one group of copies holds a large share
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, content string")


@pytest.mark.parametrize("n, words, length, threshold", [
    (60, 30, 12, 0.3), (60, 30, 12, 0.7), (80, 600, 8, 0.3), (80, 600, 8, 0.8),
])
def test_similar_pairs_equal_brute_force(spark, n, words, length, threshold):
    docs = corpus(spark, n, words, length, 40, seed=n + words)
    counts = X.term_counts(docs)
    known = X.in_vocabulary(counts, X.vocabulary(counts, X.document_count(docs)))
    weights = X.tfidf_weights(known)
    groups = X.copy_groups(X.document_vectors(X.weighted_terms(known)))
    table = {}
    for r in weights.collect():
        table.setdefault(r["record_id"], {})[r["term"]] = r["weight"]
    reps = {r["rep"]: r["copies"] for r in groups.collect()}
    assert sum(reps.values()) == n + 40 and max(reps.values()) >= 41
    expected = {}
    for a, b in itertools.combinations(sorted(reps), 2):
        cosine = sum(w * table[b].get(t, 0.0) for t, w in table[a].items())
        if cosine >= threshold:
            expected[(a, b)] = cosine
    got = X.similar_pairs(groups, threshold).collect()
    assert len(got) == len({(r["left_id"], r["right_id"]) for r in got})
    assert {(r["left_id"], r["right_id"]): pytest.approx(r["cosine"]) for r in got} == expected


def test_candidates_are_few_and_complete(spark):
    """Bounds leave little more than the similar pairs, and none of them out."""
    docs = corpus(spark, 150, 400, 25, 30, seed=5)
    near = docs.select((docs.record_id + 1000).alias("record_id"), F.concat("content", F.lit(" w399")).alias("content")).limit(40)
    signatures, groups, pairs = X.similar_documents(docs.unionByName(near), 0.8)
    found = {(r.left_id, r.right_id) for r in pairs.collect()}
    candidates = {(r.left_id, r.right_id) for r in X.candidate_pairs(groups, 0.8).collect()}
    assert found and found <= candidates and len(candidates) <= 20 * len(found)


def test_silhouette_equals_pairs(spark):
    rng = random.Random(3)
    rows = [(i, f"t{t}", rng.random()) for i in range(12) for t in range(i % 3 * 3, i % 3 * 3 + 4) if rng.random() < 0.8]
    labels = [(i, "abc"[i % 3] if i != 11 else "alone") for i in range(13)]  # 12 has no terms
    got = {r.record_id: r.silhouette for r in K.silhouette(
        spark.createDataFrame(rows, "record_id long, term string, weight double"), spark.createDataFrame(labels, "record_id long, cluster string")).collect()}
    vectors = {i: {t: w for j, t, w in rows if j == i} for i, _ in labels}
    square = lambda a, b: sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in a.keys() | b.keys())
    for i, own in labels:
        mean = {}
        for c in {c for _, c in labels}:
            members = [j for j, other in labels if other == c and j != i]
            if members:
                mean[c] = sum(square(vectors[i], vectors[j]) for j in members) / len(members)
        a, b = mean.get(own), min(v for c, v in mean.items() if c != own)
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b)), i


def test_tf_and_idf_schemes(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, "dd the")], "record_id int, content string")
    counts = X.term_counts(docs)
    vocab = X.vocabulary(counts, X.document_count(docs))
    assert {r["term"] for r in vocab.collect()} == {"aa", "bb", "cc", "dd"}
    known = X.in_vocabulary(counts, vocab)
    aa = known.select("record_id", "term", X.tf_weight("augmented").alias("t"), X.idf_weight("smooth").alias("i")).filter("record_id = 1")
    got = {r["term"]: (r["t"], r["i"]) for r in aa.collect()}
    assert got["aa"] == (1.0, pytest.approx(math.log(4 / 3) + 1)) and got["bb"][0] == 0.75
    everywhere = X.vocabulary(X.term_counts(docs.filter("record_id < 3")), X.document_count(docs.filter("record_id < 3")))
    assert everywhere.filter("term = 'aa'").select(X.idf_weight("probabilistic")).first()[0] is None
    assert X.vocabulary(counts, X.document_count(docs), min_df=2).count() == 1
    assert X.vocabulary(counts, X.document_count(docs), max_features=2).count() == 2
    with pytest.raises(ValueError):
        X.tf_weight("nope")


def test_profile_edges(spark):
    rows = [(1, "t", None, None), (2, "t", None, None), (3, None, "2020-01-05", "x"), (4, "a long title", "2020-04-05", None)]
    df = spark.createDataFrame(rows, "record_id int, title string, d string, ref string").withColumn("date_of_report", F.to_date("d")).withColumn("content", F.col("title"))
    valid = A.validate_data(df).first()
    assert (valid["duplicates"], valid["row_count"]) == (1, 4)
    assert "date_of_report incomplete" in valid["warnings"]
    months = A.monthly_timeline(df).orderBy("month").collect()
    assert [r["n"] for r in months] == [1, 0, 0, 1]
    with pytest.raises(ValueError):
        A.validate_data(df.drop("title"))
    assert [r["record_id"] for r in A.sort_reports(df, descending=True).collect()] == [4, 3, 1, 2]
