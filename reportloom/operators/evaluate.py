"""Human against predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.helpers import blank, strip


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a human label, both labels trimmed."""
    kept = df.filter(~blank("human"))
    return kept.withColumns({
        "human": strip("human"), "predicted": strip(F.coalesce("predicted", F.lit(""))),
    })


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion(df: DataFrame) -> DataFrame:
    """Count per predicted (row) and human (column) label.

    Every label has its diagonal cell, 0 included; other cells that are 0 are
    left out, so the result grows with the labels and not with their square.
    """
    rows = labelled(df)
    cells = rows.groupBy("predicted", "human").agg(F.count("*").alias("n"))
    labels = cells.select(F.explode(F.array("predicted", "human")).alias("label")).distinct()
    diagonal = labels.select(F.col("label").alias("predicted"), F.col("label").alias("human"), F.lit(0).cast("long").alias("n"))
    return cells.unionByName(diagonal).groupBy("predicted", "human").agg(F.sum("n").alias("n"))


def confusion_normalised(df: DataFrame) -> DataFrame:
    """Confusion as a share of the predicted row; empty rows give 0."""
    total = F.sum("n").over(Window.partitionBy("predicted"))
    return confusion(df).select(
        "predicted", "human", F.round(_share(F.col("n"), total), 4).alias("share")
    )


def _per_label(rows: DataFrame) -> DataFrame:
    """tp, fp and fn of each label from one count of the label pairs."""
    pairs = rows.groupBy(
        F.lower("predicted").alias("p"), F.lower("human").alias("h")
    ).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.when(
        F.col("p") == F.col("h"),
        F.array(F.struct(F.col("p").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))),
    ).otherwise(F.array(
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        F.struct(F.col("h").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")),
    ))))
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def theme_metrics(df: DataFrame) -> DataFrame:
    """Precision and recall per label, case-insensitive."""
    tp = F.col("tp")
    return _per_label(labelled(df)).select(
        "label", "tp", "fp", "fn",
        F.round(_share(tp, tp + F.col("fp")), 2).alias("precision"),
        F.round(_share(tp, tp + F.col("fn")), 2).alias("recall"),
    )


def precision_by_human_label(df: DataFrame) -> DataFrame:
    """Precision in percent for every label a human used, best first."""
    human = labelled(df).select(F.col("human").alias("theme")).distinct()
    metrics = _per_label(labelled(df))
    return (
        human.join(metrics, F.lower("theme") == F.col("label"))
        .select(
            "theme",
            F.round(_share(F.col("tp"), F.col("tp") + F.col("fp")) * 100, 2).alias("precision_pct"),
        )
        .orderBy(F.desc("precision_pct"), "theme")
    )


def mistaken_for(df: DataFrame) -> DataFrame:
    """For every wrong prediction: what the human label was, in percent."""
    wrong = labelled(df).filter(F.lower("predicted") != F.lower("human"))
    counts = wrong.groupBy(F.lower("predicted").alias("predicted"), "human").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("predicted"))
    return counts.withColumn("pct", F.round(_share(F.col("n"), total) * 100, 2))


def missed_as(df: DataFrame) -> DataFrame:
    """For every missed human label: what was predicted instead, in percent."""
    wrong = labelled(df).filter(F.lower("predicted") != F.lower("human"))
    counts = wrong.groupBy(F.lower("human").alias("human"), "predicted").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("human"))
    return counts.withColumn("pct", F.round(_share(F.col("n"), total) * 100, 2))


def overall_precision(df: DataFrame) -> DataFrame:
    hit = F.when(F.col("human") == F.col("predicted"), 1.0).otherwise(0.0)
    return labelled(df).agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 2).alias("overall_precision"),
    )


def report_precision(df: DataFrame) -> DataFrame:
    """Per report: right and wrong human labels and the share of right ones."""
    correct = F.col("human") == F.col("predicted")

    def listed(test: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(test, F.col("human")))), ", ")

    return labelled(df).withColumn("title", strip("title")).groupBy("title").agg(
        listed(correct).alias("correct_themes"),
        listed(~correct).alias("incorrect_themes"),
        F.round(F.avg(F.when(correct, 1.0).otherwise(0.0)), 2).alias("report_precision"),
    )


def average_report_precision(df: DataFrame) -> DataFrame:
    return report_precision(df).agg(
        F.count("*").alias("reports"),
        F.round(F.avg("report_precision"), 2).alias("average_precision"),
    )


def apply_corrections(predictions: DataFrame, corrections: DataFrame, key: str = "record_id") -> DataFrame:
    """Human label: '' for "No Theme", the prediction if unchanged, else lower case."""
    chosen = F.col("selected")
    return predictions.join(corrections.select(key, "selected"), key, "left").withColumn(
        "human",
        F.when(chosen.isNull(), F.lit(None).cast("string"))
        .when(chosen == "No Theme", "")
        .when(chosen == F.col("predicted"), F.col("predicted"))
        .otherwise(F.lower(chosen)),
    ).drop("selected")


def accuracy_and_f1(df: DataFrame) -> DataFrame:
    """Accuracy and F1 weighted by the number of human labels."""
    per = _per_label(labelled(df))
    f1 = _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    support = F.col("tp") + F.col("fn")
    return per.agg(
        F.sum(support).alias("n"),
        F.round(_share(F.sum("tp"), F.sum(support)), 4).alias("accuracy"),
        F.round(F.try_divide(F.sum(f1 * support), F.sum(support)), 4).alias("weighted_f1"),
    )
