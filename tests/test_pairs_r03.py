"""Similar pairs: vectors meet in blocks and travel once per part, not once per pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reportloom.operators import vectors as X


def near_copies(spark):
    """Three large groups of nearly equal texts, texts that share rare words with many, copies, a null and an empty text."""
    rng = random.Random(11)
    rows = []
    for group in range(3):
        base = [f"w{group}x{rng.randrange(400)}" for _ in range(40)] + [f"common{j}" for j in range(10)]
        rows += [" ".join(base[:k % 7] + base[k % 7 + 2:] + [f"own{group}y{k}"]) for k in range(30)]
    rows += [" ".join(f"w{rng.randrange(3)}x{rng.randrange(400)}" for _ in range(20)) for _ in range(40)] + rows[:3] + [None, "", "alone"]
    return spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(rows)], "record_id string, content string")


@pytest.mark.parametrize("threshold", [0.5, 0.8])
@pytest.mark.parametrize("small", [True, False])
def test_pairs_of_blocks_equal_brute_force(spark, monkeypatch, threshold, small):
    if small:
        monkeypatch.setattr(X, "BLOCK_TERMS", 300)
        monkeypatch.setattr(X, "CLUSTER_PART", 4)
        monkeypatch.setattr(X, "MOST_CELLS", 64)
    _, groups, pairs = X.similar_documents(near_copies(spark), threshold)
    vectors = {r.rep: {t.term: t.weight for t in r.vector} for r in groups.collect()}
    ids = sorted(vectors)
    wanted = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            cosine = sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
            if cosine >= threshold - X.SLACK:
                wanted[a, b] = cosine
    got = pairs.collect()
    assert len(got) == len({(r.left_id, r.right_id) for r in got}) == len(wanted) > 500
    assert {(r.left_id, r.right_id): r.cosine for r in got} == pytest.approx(wanted)


def test_terms_of_pairs_are_not_shuffled(spark):
    _, groups, pairs = X.similar_documents(near_copies(spark), 0.8)
    for df in (X.candidate_pairs(groups, 0.8), pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*(term#|left_rep#)", plan)
    assert not X.candidate_pairs(groups.filter(F.lit(False)), 0.8).collect()
    assert not X.similar_pairs(groups.filter("rep = 'd135'"), 0.8).collect()
