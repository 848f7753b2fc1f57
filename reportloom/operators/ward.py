"""Ward clustering of any number of documents, through micro-clusters.

Documents are summed up in micro-clusters: count, sum of vectors, sum of squared lengths. Ward's
merges need nothing else, so they work on a number of summaries that is an argument and does not
grow with the documents. Where every document is a micro-cluster of its own the merges are Ward's own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

MICRO = 256  # micro-clusters, at any number of documents
MOST_MICRO = 4096  # summaries that the merges accept; more is an error
MERGES = "step int, left int, right int, merged int, height double, size long, within double"


def micro_clusters(vectors: DataFrame, n: int = MICRO, seed: int = 42) -> DataFrame:
    """``vectors`` with the number of their micro-cluster, by k-means."""
    model = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="micro").fit(vectors)
    return model.transform(vectors)


def cluster_features(assigned: DataFrame, micro: str = "micro") -> DataFrame:
    """(micro, size, total, squares): count, sum of vectors and sum of squared lengths per micro-cluster.

    Summed before the shuffle, so a micro-cluster that holds most documents is no hot group.
    """
    summary = Summarizer.metrics("count", "sum", "normL2").summary(F.col("features")).alias("_s")
    square = F.aggregate(vector_to_array("_s.normL2"), F.lit(0.0), lambda total, x: total + x * x)
    return assigned.groupBy(F.col(micro).cast("int").alias("micro")).agg(summary).select(
        "micro", F.col("_s.count").alias("size"), vector_to_array("_s.sum").alias("total"), square.alias("squares")
    )


def _costs(centers: np.ndarray, sizes: np.ndarray, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Nearest other cluster of every cluster, the first of equals, and what merging with it adds to the squares."""
    nearest, least = np.empty(len(sizes), np.int64), np.empty(len(sizes))
    for low in range(0, len(sizes), rows):
        at = np.arange(low, min(low + rows, len(sizes)))
        apart = np.zeros((len(at), len(sizes)))
        for column in range(centers.shape[1]):
            apart += (centers[at, column][:, None] - centers[:, column][None]) ** 2
        apart *= sizes[at][:, None] * sizes[None] / (sizes[at][:, None] + sizes[None])
        apart[np.arange(len(at)), at] = np.inf
        nearest[at] = apart.argmin(axis=1)
        least[at] = apart[np.arange(len(at)), nearest[at]]
    return nearest, least


def _reciprocal_merges(sizes: np.ndarray, totals: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(left, right, cost, size) of all merges, children before parents; node i of a merge is leaves + its place.

    Clusters that are each other's nearest merge, all such pairs at once. Ward's cost never falls below that
    of a cluster's own merges, so this gives the tree of the stepwise procedure.
    """
    nodes, made, leaves = np.arange(len(sizes)), [], len(sizes)
    cost_of = np.zeros(2 * leaves)
    sizes, totals = sizes.astype(np.float64), totals.astype(np.float64)
    while len(nodes) > 1:
        nearest, least = _costs(totals / sizes[:, None], sizes)
        own = np.arange(len(nodes))
        left = own[(nearest[nearest] == own) & (own < nearest)]
        right = nearest[left]
        stay = np.setdiff1d(own, np.concatenate([left, right]))
        for a, b in zip(left, right):
            node = leaves + len(made)
            cost_of[node] = max(least[a], cost_of[nodes[a]], cost_of[nodes[b]])  # rounding must not turn the order
            made.append((int(nodes[a]), int(nodes[b]), float(cost_of[node]), float(sizes[a] + sizes[b])))
        new = leaves + len(made) - len(left) + np.arange(len(left))
        nodes = np.concatenate([nodes[stay], new])
        totals = np.concatenate([totals[stay], totals[left] + totals[right]])
        sizes = np.concatenate([sizes[stay], sizes[left] + sizes[right]])
    return made


def ward_merges(features: DataFrame) -> DataFrame:
    """Merge table over the micro-clusters, by rising height: step, left, right, merged, height, size, within.

    Nodes below the first ``merged`` number are micro-clusters. The height is the square root of twice
    the growth in squares; ``within`` is the sum of squares inside all clusters after the step. No micro-cluster or
    a single one gives an empty table. At most ``MOST_MICRO`` summaries reach the driver.
    """
    spark = features.sparkSession
    n = features.count()
    if n > MOST_MICRO:
        raise ValueError(f"{n} micro-clusters; at most {MOST_MICRO} can be merged")
    rows = features.orderBy("micro").collect()
    if n < 2:
        return spark.createDataFrame([], MERGES)
    sizes, totals = np.array([r["size"] for r in rows]), np.array([r["total"] for r in rows])
    made = _reciprocal_merges(sizes, totals)
    within = sum(r["squares"] for r in rows) - float(((totals ** 2).sum(axis=1) / sizes).sum())
    order = sorted(range(len(made)), key=lambda i: (made[i][2], i))
    first = rows[-1]["micro"] + 1
    number = {i: r["micro"] for i, r in enumerate(rows)} | {n + i: first + step for step, i in enumerate(order)}
    table = []
    for step, i in enumerate(order):
        left, right, cost, size = made[i]
        within += cost
        low, high = sorted((number[left], number[right]))
        table.append((step, low, high, first + step, float(np.sqrt(2 * cost)), int(size), within))
    return spark.createDataFrame(table, MERGES)


def ward_cuts(features: DataFrame, merges: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, micro, cluster): the micro-clusters' clusters where the tree is cut into ``k``, numbered by their first member.

    A ``k`` above the number of micro-clusters gives one cluster each.
    """
    micros = [r["micro"] for r in features.select("micro").orderBy("micro").collect()]
    steps = merges.orderBy("step").collect()
    rows = []
    for k in ks:
        parent = {}
        for step in steps[: max(len(micros) - k, 0)]:
            parent[step["left"]] = parent[step["right"]] = step["merged"]
        names: dict[int, int] = {}
        for micro in micros:
            node = micro
            while node in parent:
                node = parent[node]
            rows.append((k, micro, names.setdefault(node, len(names))))
    return features.sparkSession.createDataFrame(rows, "k int, micro int, cluster int")
