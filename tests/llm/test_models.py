"""Classifiers by held-out accuracy, their numeric parts against plain versions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportloom.llm import lm_scoring as lm, quality_classifier as mil, toxicity as crf
from reportloom.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def larger(spark, name):
    import os
    if not os.path.isdir(LARGER):
        pytest.skip("needs the larger tables")
    return spark.read.parquet(f"{LARGER}/{name}.parquet")


def held_out_rates(spark, query, target):
    labels = larger(spark, "labels")
    rows = QUERIES[query](spark, LARGER)
    assert rows.count() == larger(spark, "documents").count()
    assert rows.filter("score < 0 or score > 1 or score is null").count() == 0
    joined = rows.filter("held_out").join(labels, "doc_id")
    assert joined.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).count() == 0
    counts = {(r[target], r.predicted): r["count"] for r in joined.groupBy(target, "predicted").count().collect()}
    rate = lambda y: counts.get((y, 1), 0) / max(1, counts.get((y, 0), 0) + counts.get((y, 1), 0))
    return rate(1), rate(0)


def test_toxicity_on_held_out_rows(spark):
    hit, false_alarm = held_out_rates(spark, "op3_toxicity", "toxic")
    assert hit >= 0.6 and false_alarm <= 0.04


def test_quality_on_held_out_rows(spark):
    hit, false_alarm = held_out_rates(spark, "op9_quality_classifier", "quality")
    assert hit >= 0.97 and false_alarm <= 0.15


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    chain = crf.Chain(np.zeros(1), 0.0, -0.7, 0.4, 1.1)
    sizes = np.array([1, 4, 3])
    starts = np.cumsum(sizes) - sizes
    e = rng.normal(0, 1, sizes.sum())
    odds = sum(crf.forward_backward(chain, e, starts, sizes))
    step = {(0, 0): 0.0, (0, 1): chain.to_one, (1, 0): chain.to_zero, (1, 1): chain.stay_one}
    for start, size in zip(starts, sizes):
        total, ones = 0.0, np.zeros(size)
        for path in itertools.product((0, 1), repeat=int(size)):
            score = chain.to_one * path[0] + sum(e[start + k] * y for k, y in enumerate(path))
            score += sum(step[path[k], path[k + 1]] for k in range(size - 1))
            total += np.exp(score)
            ones += np.exp(score) * np.array(path)
        assert 1 / (1 + np.exp(-odds[start:start + size])) == pytest.approx(ones / total)


def test_toxic_spans_point_at_the_words():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(120):
        own = [str(w) for w in rng.choice(words, 40)]
        if i % 3 == 0:
            own[int(rng.integers(0, 40))] = "Vile!"
            own[int(rng.integers(0, 40))] = "vile"
        texts.append(" ".join(own))
        labels.append(float(i % 3 == 0))
    chain = crf.fit(texts, np.array(labels), np.ones(120))
    score, spans = crf.tag(chain, pa.array(["é a word1 vile VILE, word2.", "word1 word2 word3", ""]))
    assert score[0] > 0.7 and score[1] < 0.3 and score[2] < 0.3
    assert spans == ["10:20", "", ""]


def test_attention_gradients():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (9, mil.DIMENSIONS))
    starts, labels = np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = mil.Attention.fresh(x)

    def loss():
        logit, _ = model.forward(x, starts)
        return float(np.sum(np.log1p(np.exp(logit)) - labels * logit))

    logit, state = model.forward(x, starts)
    slopes = model.gradients(state, 1 / (1 + np.exp(-logit)) - labels, starts)
    for name, slope in slopes.items():
        at = tuple(int(rng.integers(0, n)) for n in model.p[name].shape)
        model.p[name][at] += 1e-5
        high = loss()
        model.p[name][at] -= 2e-5
        low = loss()
        model.p[name][at] += 1e-5
        assert slope[at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-6), name


def test_passages_cover_every_word():
    texts = pa.array(["", "a b", " ".join(f"w{i}" for i in range(130)), None, "x x x"])
    doc, x = mil.passages(texts)
    assert doc.tolist() == [0, 1, 2, 2, 2, 3, 4]
    assert np.expm1(x[:, -2]).round().tolist() == [0, 2, 64, 64, 2, 0, 3]
    assert x[6, mil.SHAPES + mil.PER_WORD] == pytest.approx(2 / 3)


def test_window_network_is_a_distribution():
    rng = np.random.default_rng(8)
    network = lm.Network.fresh(rng.integers(0, 50, lm.WORDS * lm.CELLS))
    for name in ("group", "member"):
        network.p[name] = rng.normal(0, 0.3, network.p[name].shape).astype(np.float32)
    around = np.repeat(rng.integers(0, lm.WORDS + 1, (1, 4)), lm.WORDS, axis=0)
    assert np.exp(network.log_probabilities(around, np.arange(lm.WORDS))).sum() == pytest.approx(1, abs=1e-3)


def test_window_network_gradient():
    rng = np.random.default_rng(9)
    network = lm.Network.fresh(np.ones(lm.WORDS * lm.CELLS, np.int64))
    for name in ("group", "member"):
        network.p[name] = rng.normal(0, 0.3, network.p[name].shape).astype(np.float32)
    around, words = rng.integers(0, 50, (200, 4)), rng.integers(0, 50, 200)
    before = network.log_probabilities(around, words).mean()
    squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in network.p.items()}
    for _ in range(20):
        network.learn(around, words, squares, 0.02)
    assert network.log_probabilities(around, words).mean() > before + 0.5


def test_windows_stay_inside_documents():
    around = lm.windows_of(np.array([0, 0, 0, 1]), np.array([5, 6, 7, 8]))
    e = lm.EDGE
    assert around.tolist() == [[e, e, 6, 7], [e, 5, 7, e], [5, 6, e, e], [e, e, e, e]]


def test_context_helps_and_order_matters(spark):
    rng = np.random.default_rng(10)
    pairs = [(f"left{i}", f"right{i}") for i in range(20)]
    def text():
        return " ".join(w for k in rng.integers(0, 20, 60) for w in pairs[k])
    rows = [(i, text()) for i in range(600)]
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:50]]
    tokens = lm.token_table(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    counts = lm.corpus_counts(tokens)
    network = lm.train(tokens, counts)
    mean = {}
    for name, part in (("ordered", rows[:50]), ("shuffled", shuffled)):
        owner, cells = lm.cells_of(pa.array([t for _, t in part]))
        mean[name] = network.log_probabilities(lm.windows_of(owner, cells // lm.CELLS), cells // lm.CELLS).mean()
    fresh = lm.Network.fresh(counts)
    plain = fresh.log_probabilities(lm.windows_of(owner, cells // lm.CELLS), cells // lm.CELLS).mean()
    assert mean["ordered"] > plain + 0.3 and mean["ordered"] > mean["shuffled"] + 0.3


def plain_scores(text, network, counts):
    """Log-likelihood of a text, word by word, in double precision."""
    _, cells = lm.cells_of(pa.array([text or ""]))
    p = {k: v.astype(float) for k, v in network.p.items()}
    words, total = cells // lm.CELLS, 0.0
    padded = [lm.EDGE] * lm.SIDE + words.tolist() + [lm.EDGE] * lm.SIDE
    table = counts.reshape(lm.WORDS, lm.CELLS) + 1.0
    for i, (word, cell) in enumerate(zip(words, cells)):
        around = padded[i:i + lm.SIDE] + padded[i + lm.SIDE + 1:i + 2 * lm.SIDE + 1]
        c = np.tanh(sum(p["embed"][w] * p["place"][k] for k, w in enumerate(around)))
        g, m = divmod(int(word), lm.MEMBERS)
        for logits, own in ((c @ p["group"] + p["group0"], g), (c @ p["member"][g] + p["member0"][g], m)):
            total += logits[own] - np.log(np.exp(logits).sum())
        total += np.log(table[word, cell % lm.CELLS] / table[word].sum())
    return len(words), total


def test_lm_scores_equal_plain_sums(spark, edge):
    texts = edge.filter("doc_id is null or doc_id <> 8")  # one text of 30,000 words is enough for the plain loop
    tokens = lm.token_table(texts)
    counts = lm.corpus_counts(tokens)
    network = lm.train(tokens, counts)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.log_likelihood, 1), r.mean_log_likelihood is None) for r in lm.score_tokens(tokens, counts, network).collect())
    expected = []
    for r in texts.collect():
        n, total = plain_scores(r.text, network, counts)
        expected.append((str(r.doc_id), n, total, n == 0))
    for a, b in zip(got, sorted(expected)):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], rel=1e-4, abs=0.1)
    assert counts.sum() == sum(n for _, n, *_ in got) and len(got) == len(expected)


def test_lm_learns_from_every_window(spark, edge, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 2000)
    tokens = lm.token_table(edge)
    _, cells = lm.cells_of(pa.array([r.text or "" for r in edge.collect()]))
    seen = [w for turn in range(lm.TURNS) for r in tokens.filter(F.col("turn") == turn).collect() for w in np.frombuffer(r["words"], "<u2")]
    assert sorted(seen) == sorted((cells // lm.CELLS).tolist())
    again = [c for batch in [pa.RecordBatch.from_pylist([r.asDict() for r in tokens.select("words", "cells").collect()])] for _, cs in lm._words_and_cells(batch) for c in cs]
    assert sorted(again) == sorted(cells.tolist())


def test_lm_trains_on_a_small_table(spark):
    df = spark.createDataFrame([(1, "left right " * 5)], "doc_id long, text string").coalesce(1)
    tokens = lm.token_table(df)
    counts = lm.corpus_counts(tokens)
    network, fresh = lm.train(tokens, counts), lm.Network.fresh(counts)
    assert not np.array_equal(network.flat(), fresh.flat())
    before, after = (lm.score_tokens(tokens, counts, n).first().log_likelihood for n in (fresh, network))
    assert after > before


def test_lm_query_returns_every_document(spark, sf_dir, documents):
    got = QUERIES["op1_lm_scoring"](spark, sf_dir)
    assert got.count() == documents.count()
    assert got.select(F.sum("n_tokens")).first()[0] == documents.select(F.sum(F.size(F.expr("filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")))).first()[0]


@pytest.mark.parametrize("score", [crf.score_documents, mil.score_documents])
def test_classifiers_on_edge_rows(spark, edge, nothing, score):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, None), (None, 0, 1), (9, 0, 1), (9, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(edge, labels).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert score(nothing, labels).count() == 0
    assert score(edge, labels.limit(0)).count() == edge.count()


def test_lm_on_an_empty_table(nothing):
    assert lm.score_documents(nothing).count() == 0
