"""Whitening, decontamination and the filter audit against plain versions."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from brute import LOWER, WORD
from reportloom.llm import decontamination as D, filter_audit as A, queries, whitening as W

BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- whitening ---------------------------------------------------------------

@pytest.mark.parametrize("d, values", [
    (20, None), (64, None), (64, np.r_[np.full(10, 3.0), np.ones(54)]), (90, np.r_[1e6, 1e5, np.linspace(70, 57, 88)]),
    (64, np.r_[5.0, np.zeros(63)]), (3, np.zeros(3)),
])
def test_leading_components_equal_dense_ones(d, values):
    rng = np.random.default_rng(1)
    if values is None:
        x = rng.normal(size=(4000, d))
        v = x.T @ x / 4000
    else:
        u = np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = (u * values) @ u.T
    v = (v + v.T) / 2
    found, q, _ = W.leading_components(lambda b: v @ b, d)
    expected = np.sort(np.linalg.eigvalsh(v))[::-1][:32]
    assert np.allclose(found, expected, atol=1e-12 * max(1, expected[0]))
    assert np.abs(v @ q - q * found).max(initial=0) <= 1e-11 * max(1, expected[0])
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-13)


def test_whitening_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = W.whiten(table).toPandas().sort_values(["vec_id", "component"])
    rows = table.toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(rows.embedding).astype(float)) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1]
    expected = centred @ u[:, :32] / np.sqrt(values[:32])
    whitened = got.whitened.to_numpy().reshape(n, 32)
    assert np.allclose(whitened, expected * np.sign((whitened * expected).sum(axis=0)), atol=1e-9)
    assert (got.deviation.to_numpy().reshape(n, 32)[:, 0] == ((n * x - sums) ** 2).sum(axis=1).astype(np.int64)).all()
    assert np.allclose(got.explained.to_numpy()[:32], values[:32] / values.sum())
    assert got.identity_error.max() < 1e-9 and (got.n == n).all()


def test_whitening_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 0), (1, [1.0, 2.0, 0.5], 0), (2, None, 0), (3, [1.0, None, 2.0], 0), (4, [nan, 1.0, 1.0], 0),
            (5, [inf, 0.0, 0.0], 0), (6, [], 0), (7, [1.0, 2.0], 0), (None, [0.25, -1.0, 3.0], 0), (8, [-2.0, 1.0, 0.0], 0), (9, [4.0, 4.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = W.whiten(table).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["1", "8", "9", "None"] and {r.n for r in got} == {5}
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 15
    x = np.array([v for _, v, _ in rows if v and len(v) == 3 and None not in v and np.isfinite(v).all()]) * 64
    exact = {str(i): int(((5 * r - x.sum(axis=0)) ** 2).sum()) for i, r in zip(["1", "1", "None", "8", "9"], x)}
    assert all(r.deviation == exact[str(r.vec_id)] for r in got)
    assert max(r.identity_error for r in got) < 1e-9
    assert W.whiten(table.limit(0)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, "vec_id long, embedding array<double>")).count() == 0
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 5e11])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in W.whiten(far).collect())


# --- decontamination ---------------------------------------------------------

def plain_hits(text, items):
    words, hit, found = BENCH_WORD.findall((text or "").translate(LOWER)), set(), set()
    for item_id, item in items:
        of = BENCH_WORD.findall((item or "").translate(LOWER))
        for i in range(max(1, len(of) - 9) if of else 0):
            window = of[i:i + 10]
            for at in range(len(words) - len(window) + 1):
                if words[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add("" if item_id is None else str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def check_hits(spark, documents, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.decontaminate(documents, bench, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    expected = sorted(((r.doc_id, *plain_hits(r.text, items)) for r in documents.collect()), key=str)
    assert got == expected


ITEMS = [(1, "one TWO three, four five six seven eight nine ten eleven"), (10, "Seven eight"), (2, "absent words only"), (3, None), (4, " ,;"),
         (None, "same line same line"), (5, "one two three four five six seven eight nine ten eleven twelve"), (5, "a text"), (6, "wort0x0 wort1x1")]


def test_decontamination_equals_plain_version(spark, edge, nothing):
    check_hits(spark, edge, ITEMS)
    check_hits(spark, edge, ITEMS, block_words=3 + D.WINDOW)  # several blocks, items cut
    check_hits(spark, nothing, ITEMS)
    check_hits(spark, edge, [])


def test_decontamination_of_given_documents(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for item_id, text in items:
        words = BENCH_WORD.findall(text.translate(LOWER))
        for i in range(len(words) - 9):
            windows.setdefault(tuple(words[i:i + 10]), set()).add(str(item_id))
    got = {r.doc_id: (r.n_hit, r.n_items) for r in queries.op12_decontamination(spark, sf_dir).collect()}
    for r in documents.collect():
        words, hit, found = BENCH_WORD.findall((r.text or "").translate(LOWER)), set(), set()
        for i in range(len(words) - 9):
            if tuple(words[i:i + 10]) in windows:
                hit.update(range(i, i + 10))
                found |= windows[tuple(words[i:i + 10])]
        assert got[r.doc_id] == (len(hit), len(found))
    assert any(n for n, _ in got.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=4), st.lists(st.integers(0, 5), min_size=1, max_size=14))
def test_phrases_and_near_places(texts, item):
    """One segment: phrases are the equal runs; near places have every term within reach."""
    flat = np.array([w for t in texts for w in t], np.int64)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    counts = np.bincount(flat, minlength=6)
    import pyarrow as pa

    segment = D.Segment(edges, pa.array(list("abcdef")), counts, np.argsort(flat, kind="stable"))
    for group in D.windows_of(np.array(item), np.array([len(item)]), 4):
        near, phrases = D.look_up(segment, group, np.arange(6), None, 3)
        expected, close = set(), set()
        for k, window in enumerate(group.terms.tolist()):
            for e, text in zip(edges, texts):
                expected |= {(k, int(e) + i) for i in range(len(text) - len(window) + 1) if text[i:i + len(window)] == window}
        assert set(zip(phrases[0].tolist(), phrases[1].tolist())) == expected and len(phrases[0]) == len(expected)
        for k, place in zip(near[0], near[1]):
            e = np.searchsorted(edges, place, side="right") - 1
            around = set(flat[max(place - 3, edges[e]):min(place + 4, edges[e + 1])].tolist())
            assert set(group.terms[k].tolist()) <= around
            close.add(int(k))
        assert {k for k, _ in expected} <= close


def test_near_matches_find_moved_words(spark):
    docs = spark.createDataFrame([(1, "x seven one two six five three four eight nine ten y"), (2, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = {r.doc_id: (r.n_hit, r.n_near_items) for r in D.decontaminate(docs, bench).collect()}
    assert rows == {1: (0, 1), 2: (0, 0)}


# --- filter audit ------------------------------------------------------------

def plain_audit(rows, labels):
    good, toxic, least = {}, {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = good.get(i) or q == 1, toxic.get(i) or t == 1
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    parts = {}
    for r in rows:
        text = r.text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": r.doc_id is not None and r.doc_id > least[text],
        }
        named = r.doc_id is not None
        parts.setdefault(r.source or "", []).append((fails, bool(named and good.get(r.doc_id)), bool(named and toxic.get(r.doc_id))))
    out = []
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                removed = [d for d in left if d[0][f]]
                failing = sum(d[0][f] for d in docs)
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(removed)
                out.append([part, "".join(order), k + 1, len(left), len(removed), failing - len(removed),
                            sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed), f])
        for row in out:
            if row[0] == part:
                row[-1] = shapley[row[-1]]
    return sorted(map(tuple, out))


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_plain_version(spark, edge, nothing):
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, A.audit(edge, labels).select(*COLUMNS).collect()))
    assert got == plain_audit(edge.collect(), marks)
    assert A.audit(nothing, labels).count() == 0
    assert A.audit(edge, labels.limit(0)).count() == len(got)


def test_audit_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    expected = db.sql(queries.OP13_SQL).df()[COLUMNS].values.tolist()
    got = queries.op13_filter_audit(spark, sf_dir).select(*COLUMNS).toPandas().values.tolist()
    assert sorted(got) == sorted(expected)


def test_codebooks_number_words_globally(spark, edge, monkeypatch):
    """Columns of different shards and codebooks mean the same word everywhere."""
    monkeypatch.setattr(A, "CODEBOOK_WORDS", 5)
    shards = A.build_shards(edge.repartition(5))
    books = {r.grp: r.ids for r in A.codebooks(shards).collect()}
    words = {r.grp: r.words for r in shards.collect() if r.words}
    numbers = {}
    for grp, listed in words.items():
        for word, number in zip(listed, books[grp]):
            assert numbers.setdefault(word, number) == number
    every = sorted({w for r in edge.collect() for w in WORD.findall(r.text or "")}, key=lambda w: w.encode())
    assert numbers == {w: i for i, w in enumerate(every)}
