"""Evaluation of a binary classifier from labels, predictions and scores.

Curves and areas work on one row per distinct score; running totals over those
rows are bucketed, so neither a popular score nor a long tail meets one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketlens.operators.ranking import running_totals
from basketlens.session import durable


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    return df.agg(
        *[cell(a, p).alias(f"n{a}{p}") for a in (0, 1) for p in (0, 1)]
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four (actual, predicted) counts, zeros included, from one pass."""
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n"))
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    return _cells(df, label, prediction).select(F.inline(rows))


def _divide(top: Column, bottom: Column) -> Column:
    """A ratio whose empty denominator gives 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg."""
    cells = _cells(df, label, prediction)

    def of_class(c: int) -> Column:
        hit = F.col(f"n{c}{c}")
        support = F.col(f"n{c}0") + F.col(f"n{c}1")
        predicted = F.col(f"n0{c}") + F.col(f"n1{c}")
        return F.struct(
            _divide(hit, predicted).alias("precision"),
            _divide(hit, support).alias("recall"),
            _divide(2.0 * hit, support + predicted).alias("f1"),
            support.alias("support"),
        )

    per_class = cells.select("*", of_class(0).alias("c0"), of_class(1).alias("c1"))
    total = F.col("c0.support") + F.col("c1.support")
    accuracy = _divide(F.col("n00") + F.col("n11"), total)

    def macro(field: str) -> Column:
        return (F.col(f"c0.{field}") + F.col(f"c1.{field}")) / 2.0

    def weighted(field: str) -> Column:
        parts = [F.col(f"c{c}.{field}") * F.col(f"c{c}.support") for c in (0, 1)]
        return _divide(parts[0] + parts[1], total)

    def row(name: str, pick) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[pick(f).cast("double").alias(f) for f in ("precision", "recall", "f1")],
            (F.col(f"c{name}.support") if name in ("0", "1") else total).alias("support"),
        )

    rows = F.array(
        row("0", lambda f: F.col(f"c0.{f}")),
        row("1", lambda f: F.col(f"c1.{f}")),
        row("accuracy", lambda f: accuracy if f == "f1" else F.lit(None)),
        row("macro avg", macro),
        row("weighted avg", weighted),
    )
    return per_class.select(F.inline(rows))


def score_steps(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, from high to low, with running totals.

    ``tp``/``fp`` count positives and negatives at or above the score; ``next_``
    columns hold what the next lower score adds.
    """
    counts = durable(
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    return running_totals(
        counts,
        "score",
        {"pos": "tp", "neg": "fp"},
        descending=True,
        following={"pos": "next_pos", "neg": "next_neg"},
    )


def _with_totals(steps: DataFrame) -> DataFrame:
    totals = steps.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t"))
    return steps.withColumn("_t", totals.scalar())


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    steps = score_steps(df, label, score)
    below_half = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    # two counts of billions do not multiply in 64 bits
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return steps.agg((F.sum(below_half) / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum of recall steps times precision, without interpolation."""
    steps = score_steps(df, label, score)
    area = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return steps.agg((area / F.sum("pos")).alias("average_precision"))


def roc_curve(
    df: DataFrame, label: str = "label", score: str = "score", drop_intermediate: bool = True
) -> DataFrame:
    """(fpr, tpr, threshold) points, starting at (0, 0) with an infinite threshold.

    A point between two equal steps lies on the line through its neighbours and
    is left out by default, as the curve does not change.
    """
    steps = _with_totals(score_steps(df, label, score))
    if drop_intermediate:
        opening = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        steps = steps.where(opening | F.col("next_pos").isNull() | bend)
    points = steps.select(
        (F.col("fp") / F.col("_t.neg")).alias("fpr"),
        (F.col("tp") / F.col("_t.pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(precision, recall, threshold) points and the end point (1, 0)."""
    points = _with_totals(score_steps(df, label, score)).select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("_t.pos")).alias("recall"),
        F.col("score").alias("threshold"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(end)
