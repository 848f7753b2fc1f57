import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reportloom.operators import cluster as K, ward as W


def plain_ward(points, sizes):
    """Step by step: always the pair that adds least; returns heights and member sets."""
    groups = [(n, np.array(p, float) * n, frozenset([i])) for i, (p, n) in enumerate(zip(points, sizes))]
    made = []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                (a, s, _), (b, t, _) = groups[i], groups[j]
                cost = a * b / (a + b) * ((s / a - t / b) ** 2).sum()
                if best is None or cost < best[0]:
                    best = cost, i, j
        cost, i, j = best
        (a, s, m), (b, t, o) = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(a + b, s + t, m | o)]
        made.append((np.sqrt(2 * cost), m | o))
    return made


def vectors(spark, points, micro=None):
    rows = [(i, [float(x) for x in p], int(micro[i]) if micro is not None else i) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "record_id int, v array<double>, micro int").select("record_id", array_to_vector("v").alias("features"), "micro")


def members(merges, leaves):
    inside = {i: frozenset([i]) for i in leaves}
    for r in merges:
        inside[r["merged"]] = inside[r["left"]] | inside[r["right"]]
    return [inside[r["merged"]] for r in merges]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merges_equal_plain_ward(spark, seed):
    """Every document its own micro-cluster: heights, members and the squares inside."""
    points = np.random.default_rng(seed).normal(size=(60, 5))
    merges = W.ward_merges(W.cluster_features(vectors(spark, points))).orderBy("step").collect()
    plain = plain_ward(points, [1] * 60)
    assert [r["height"] for r in merges] == pytest.approx([h for h, _ in plain], rel=1e-9)
    assert members(merges, range(60)) == [m for _, m in plain]
    assert merges[-1]["within"] == pytest.approx(((points - points.mean(axis=0)) ** 2).sum())
    assert merges[-1]["size"] == 60


def test_merges_of_summaries_weigh_sizes(spark):
    rng = np.random.default_rng(7)
    points, micro = rng.normal(size=(200, 3)), rng.integers(0, 12, 200) * 3
    features = W.cluster_features(vectors(spark, points, micro))
    names = sorted(set(micro.tolist()))
    plain = plain_ward([points[micro == m].mean(axis=0) for m in names], [(micro == m).sum() for m in names])
    merges = W.ward_merges(features).orderBy("step").collect()
    assert [r["height"] for r in merges] == pytest.approx([h for h, _ in plain], rel=1e-9)
    assert members(merges, names) == [frozenset(names[i] for i in m) for _, m in plain]
    inside = sum(((points[micro == m] - points[micro == m].mean(axis=0)) ** 2).sum() for m in names)
    assert merges[0]["within"] - merges[0]["height"] ** 2 / 2 == pytest.approx(inside)


def test_ties_copies_and_small_tables(spark):
    grid = [[x, y] for x in range(4) for y in range(4)] + [[0, 0]] * 3
    merges = W.ward_merges(W.cluster_features(vectors(spark, grid))).orderBy("step").collect()
    heights = [r["height"] for r in merges]
    assert len(merges) == len(grid) - 1 and heights == sorted(heights)
    assert heights[:3] == [0.0] * 3 and heights[3] == pytest.approx(1.0)
    one = W.cluster_features(vectors(spark, [[1, 2]]))
    assert W.ward_merges(one).count() == 0
    assert [tuple(r) for r in W.ward_cuts(one, W.ward_merges(one), [2]).collect()] == [(2, 0, 0)]
    none = W.cluster_features(vectors(spark, [[1, 2]]).filter("false"))
    assert W.ward_merges(none).count() == 0 and W.ward_cuts(none, W.ward_merges(none), [2]).count() == 0


def test_too_many_summaries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_MICRO", 3)
    with pytest.raises(ValueError, match="at most 3"):
        W.ward_merges(W.cluster_features(vectors(spark, np.eye(4))))


def test_cuts_find_the_groups(spark):
    rng = np.random.default_rng(5)
    truth = np.arange(300) % 3
    points = np.eye(3)[truth] * 9 + rng.normal(size=(300, 3))
    found, metrics = K.choose_clusters(vectors(spark, points).drop("micro"), method="ward", micro=40)
    best = metrics.filter("chosen").first()
    assert best["k"] == best["clusters"] == 3 and best["eligible"]
    pairs = found.withColumn("truth", F.col("record_id") % 3).select("truth", "cluster").distinct()
    assert pairs.count() == 3 and found.count() == 300
