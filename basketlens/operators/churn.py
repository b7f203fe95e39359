"""Churn labels and a boosted-tree churn classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from basketlens.functions.scalars import threshold_label
from basketlens.operators import boosting
from basketlens.operators.features import days_sum
from basketlens.operators.relational import features_churn
from basketlens.sources.schemas import FEATURES

CHURN_DAYS = 20


def churn_label(features: DataFrame, raw_orders: DataFrame, threshold: float = CHURN_DAYS) -> DataFrame:
    """Features with the total of day gaps and churn = total above the threshold.

    ``raw_orders`` are the orders before missing gaps were filled.
    """
    return features_churn(features, days_sum(raw_orders)).withColumn(
        "churn", threshold_label(F.col("days_since_last_order"), threshold)
    )


def class_balance(df: DataFrame, label: str = "churn") -> DataFrame:
    """Negatives, positives and their ratio; a missing class is an error."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    one_class = (F.col("negatives") == 0) | (F.col("positives") == 0)
    problem = F.raise_error(F.lit(f"{label} must hold both classes")).cast("double")
    ratio = F.when(one_class, problem).otherwise(F.col("negatives") / F.col("positives"))
    return counts.withColumn("ratio", ratio)


def class_weight(df: DataFrame, label: str = "churn", balance: DataFrame | None = None) -> DataFrame:
    """Add ``weight``: negatives / positives for positive rows, else 1."""
    balance = class_balance(df, label) if balance is None else balance
    return df.withColumn("_ratio", balance.select("ratio").scalar()).select(
        *df.columns,
        F.when(F.col(label) == 1, F.col("_ratio")).otherwise(F.lit(1.0)).alias("weight"),
    )


def churn_model(
    train: DataFrame,
    columns: Sequence[str] = FEATURES,
    label: str = "churn",
    trees: int = 100,
    depth: int = 6,
    step: float = 0.3,
    **options,
) -> boosting.BoostedTrees:
    """Second-order boosted trees with log loss on weighted rows."""
    return boosting.fit(train, columns, label, "weight", trees, depth, step, **options)


def churn_predict(model: boosting.BoostedTrees, df: DataFrame) -> DataFrame:
    """Predicted class and probability of class 1 beside the given columns."""
    return model.transform(df)
