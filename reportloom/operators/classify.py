"""Sentence classification: training, prediction, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from reportloom.functions.helpers import blank, strip
from reportloom.functions.predicates import contains_negation
from reportloom.functions.text import confidence_label, split_sentences
from reportloom.operators.evaluate import accuracy_and_f1


def prepare_labels(train: DataFrame, test: DataFrame | None = None, label: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """Trimmed lower-case labels; test rows with an unknown label are dropped."""
    def clean(df: DataFrame) -> DataFrame:
        return df.withColumn(label, F.lower(strip(label))).filter(~blank(label))

    train = clean(train)
    if test is not None:
        test = clean(test).join(train.select(label).distinct(), label, "left_semi")
    return train, test


def label_index(train: DataFrame, label: str = "label") -> DataFrame:
    """Labels with a number in alphabetical order; one row per label."""
    names = train.agg(F.sort_array(F.collect_set(label)).alias("names"))
    return names.select(F.posexplode("names").alias("label_id", "label"))


def train_classifier(
    train: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14,
    iterations: int = 20, reg: float = 0.01,
) -> PipelineModel:
    """Hashed TF-IDF and logistic regression, all in Spark ML."""
    indexer = StringIndexer(
        inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"
    ).fit(train)
    return Pipeline(stages=[
        indexer,
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_']+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=iterations, regParam=reg,
                           predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw"),
        IndexToString(inputCol="_p", outputCol="predicted", labels=indexer.labels),
    ]).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``predicted`` label and its probability as ``score``.

    The label stage of training is left out, so unlabelled rows are kept.
    """
    scored = rows
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    return scored.withColumn("score", F.array_max(vector_to_array("_prob"))).drop(
        "_words", "_tf", "_x", "_p", "_prob", "_raw"
    )


def classify_sentences(
    model: PipelineModel, reports: DataFrame, threshold: float = 0.65, text: str = "content",
    framework: str = "Classifier",
) -> DataFrame:
    """Annotation rows for sentences that state a failure and score high enough."""
    meta = [c for c in ("title", "coroner_name", "coroner_area", "year", "date_of_report") if c in reports.columns]
    sentences = split_sentences(reports.filter(F.col(text).isNotNull()), text, ["record_id", *meta])
    negated = sentences.filter(contains_negation("sentence")).withColumn("text", F.col("sentence"))
    return predict(model, negated).filter(F.col("score") >= threshold).select(
        "record_id", *meta, F.lit(framework).alias("framework"),
        F.col("predicted").alias("theme"), F.round("score", 4).alias("score"),
        confidence_label("score").alias("confidence"),
        F.col("sentence").alias("matched_sentences"), "sentence_idx",
    )


def evaluate_classifier(model: PipelineModel, test: DataFrame, label: str = "label") -> DataFrame:
    scored = predict(model, test).withColumnRenamed(label, "human")
    return accuracy_and_f1(scored)


def append_corrections(training: DataFrame, corrected: DataFrame) -> DataFrame:
    """Training rows plus the corrected sentences that carry a label."""
    new = corrected.filter(~blank("human")).select(
        F.col("sentence").alias("text"), F.col("human").alias("label")
    )
    return training.select("text", "label").unionByName(new)
