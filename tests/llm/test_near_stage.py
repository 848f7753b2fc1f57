"""The near-dedup stage of the pipeline at its own threshold."""

import numpy as np
import pytest

import brute
import corpus_pipeline
from reportloom.llm import near_dedup


def similarity(a, b):
    a, b = brute.shingles(a), brute.shingles(b)
    return len(a & b) / len(a | b)


def planted():
    """Pairs whose texts differ at their ends, at .80 and up to .85, and some below .80."""
    rows = []
    for n in range(40):
        words = [f"p{n}w{k}" for k in range(4 + 90)]
        # 90 shingles, of which the copy lacks ``cut`` and has ``cut`` others.
        cut = 8 + n % 4
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:-cut] + [f"q{n}w{k}" for k in range(cut)]))]
    return rows


def test_near_stage_links_pairs_from_80(spark, sf_dir):
    rows = planted()
    found = [similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert sum(x == 0.8 for x in found) and sum(0.8 < x < 0.85 for x in found) and sum(x < 0.8 for x in found)
    component = brute.near_components(rows, 80)
    expected = {i for i in component if component[i] == i}
    assert len(expected) == 50 and len(set(brute.near_components(rows).values())) == 80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, df, sf_dir).collect()} == expected


def test_near_stage_on_documents(spark, sf_dir, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    component = brute.near_components(list(rows.items()), 80)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents, sf_dir)
    assert {r.doc_id for r in kept.collect()} == {i for i in component if component[i] == i}


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 99])
def test_bands_follow_the_threshold(percent):
    bands, length = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** length) ** bands <= near_dedup.MISSED and bands * length <= near_dedup.T


def test_bands_of_op5_are_as_before():
    assert near_dedup.banding(85) == (48, 8) and near_dedup.banding(80) == (50, 6)
    assert near_dedup.banding(100)[0] == 1 and np.isfinite(near_dedup.banding(1)).all()
