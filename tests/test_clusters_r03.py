"""Clusterings clean texts once, with patterns only where they can match, and a grid builds its vectors once."""

import pytest
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.functions.helpers import drop_all
from reportloom.operators import cluster as K

TEXTS = [
    "See http://a.b/c or www.x.y and mail me@there.org about the plain words here", "Call 123-456-7890 or ٣٣٣٤٤٤٥٥٥٥ on the ward today please",
    "On 3rd march 2020 and 4 may 2021 at 10:45 or 1/2/2020 the nurse came", "Ref no. 12-34, case: ab-12 and reference x9 were closed by them",
    "Under regulation 28 and subsection 4 the coroner dated the signed report", "nothing of the kind is said in here", "", None, "ab cd", "A MARCH of 3 MAY 2020",
]


def test_cleaning_equals_all_patterns_in_order(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain = F.regexp_replace(drop_all(F.lower(F.coalesce("t", F.lit(""))), T.MODELING_NOISE), "[^a-z]+", " ")
    rows = df.select("t", T.clean_text_for_modeling("t").alias("clean"), plain.alias("plain")).collect()
    for r in rows:
        words = [w for w in r.plain.split(" ") if len(w) > 2]
        assert r.clean == (" ".join(words) if len(words) >= 3 else ""), r.t


def test_a_grid_builds_vectors_once(spark, monkeypatch):
    rows = [(i, " ".join(f"word{'abc'[i % 3]}{chr(97 + (i * j) % 19)}" for j in range(12))) for i in range(30)]
    docs = spark.createDataFrame(rows, "record_id int, content string")
    calls, build = [], K.model_vectors
    monkeypatch.setattr(K, "model_vectors", lambda *a, **o: calls.append(a) or build(*a, **o))
    found = {(r.target, r.dims): r for r in K.optimise_parameters(docs, {"target": [3], "min_cluster_size": [2], "dims": [64, 128]}).collect()}
    assert len(calls) == 1 and sorted(found) == [(3, 64), (3, 128)]
    clean = docs.select("record_id", T.clean_text_for_modeling("content").alias("clean"))
    labels = K._fit(build(clean, "clean", "record_id", 64), 3, "kmeans", 42)
    from pyspark.ml.evaluation import ClusteringEvaluator
    assert found[3, 64].silhouette == pytest.approx(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labels), abs=1e-4)
