"""The gram index, term numbers and keyword search against plain versions."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from reportloom.operators import search as R
from reportloom.operators.dictionary import number_terms

LETTERS = st.text(alphabet="abÄ\U0001f600", max_size=40)


def plain(texts, keywords):
    out = []
    for i, text in texts:
        lower = (text or "").lower()
        for k in {(k or "").lower() for k in keywords} - {""}:
            out += [(i, k, at, text[at:at + len(k)]) for at in range(len(lower)) if lower.startswith(k, at)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÄ\U0001f600", min_size=1, max_size=7), min_size=1, max_size=8, unique=True), LETTERS)
def test_gram_index_finds_all(keywords, text):
    start, which = R.GramIndex.of(keywords).search(R._codes(text))
    expected = sorted((at, k) for k, w in enumerate(keywords) for at in range(len(text)) if text.startswith(w, at))
    assert sorted(zip(start.tolist(), which.tolist())) == expected


def test_occurrences_in_blocks(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choices("abcd é", k=rng.randrange(200)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "ABC abc"), (102, "ABC abc"), (None, "abcabc"), (103, "a" * 5000), (104, "x\0y\0ab")]
    keywords = ["abc", "a", "bc", "", None, "ABC", "aa", "é a", "abcabc", "zzz", "d é ab", "\0y"]
    docs = spark.createDataFrame(texts, "record_id long, content string")
    kw = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    expected = sorted(plain(texts, keywords), key=str)
    for size in (100, 2):
        got = R.occurrences(docs, kw, block_keywords=size).collect()
        assert sorted(map(tuple, got), key=str) == expected
    first = R.occurrences(docs.filter("record_id <> 102"), kw, once=True).collect()
    assert len({(r.record_id, r.keyword) for r in first}) == len(first)
    assert {(r.record_id, r.keyword, r.start) for r in first} <= {e[:3] for e in expected}
    assert R.occurrences(docs.limit(0), kw).count() == 0 and R.occurrences(docs, kw.limit(0)).count() == 0


def test_a_hundred_thousand_keywords():
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    keywords = sorted({"".join(rng.choice(letters, 8)) for _ in range(100_000)})
    index = R.GramIndex.of(keywords)
    text = " ".join(keywords[::100])
    start, which = index.search(R._codes(text))
    assert which.tolist()[:5] == [0, 100, 200, 300, 400] and len(which) == len(keywords[::100])


def test_term_numbers_are_dense_and_in_byte_order(spark):
    terms = ["b", "a", "a", "ä", "Z", "", None, "\U0001f600", "￿", "10", "9"] + [f"t{i}" for i in range(500)]
    df = spark.createDataFrame([(t,) for t in terms], "term string").repartition(7)
    got = {r.term: r.term_id for r in number_terms(df).collect()}
    distinct = sorted({t for t in terms if t is not None}, key=lambda t: t.encode())
    assert got == {t: i for i, t in enumerate(distinct)}
    assert number_terms(df.limit(0)).count() == 0
