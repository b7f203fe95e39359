"""The churn workflow from features and raw orders to scored test users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from basketlens.operators import churn, scoring
from basketlens.operators.boosting import BoostedTrees
from basketlens.operators.features import apply_scaler, scaler_stats
from basketlens.operators.sampling import SEED, stratified_split
from basketlens.session import durable
from basketlens.sources.schemas import FEATURES


@dataclass(frozen=True)
class ChurnRun:
    balance: DataFrame
    model: BoostedTrees
    scored: DataFrame

    def report(self) -> DataFrame:
        return scoring.classification_report(self.scored, "churn")

    def confusion(self) -> DataFrame:
        return scoring.confusion_matrix(self.scored, "churn")

    def areas(self) -> DataFrame:
        roc = scoring.roc_auc(self.scored, "churn")
        return roc.withColumn(
            "average_precision", scoring.average_precision(self.scored, "churn").scalar()
        )

    def roc(self) -> DataFrame:
        return scoring.roc_curve(self.scored, "churn")

    def precision_recall(self) -> DataFrame:
        return scoring.pr_curve(self.scored, "churn")


def run_churn(
    features: DataFrame,
    raw_orders: DataFrame,
    threshold: float = churn.CHURN_DAYS,
    seed: int = SEED,
    **model_options,
) -> ChurnRun:
    """Label, split, scale on the train part, weigh, fit, score the test part."""
    labelled = durable(churn.churn_label(features, raw_orders, threshold))
    split = stratified_split(labelled, "churn", seed=seed)
    train = split.where("NOT is_test").drop("is_test")
    test = split.where("is_test").drop("is_test")
    stats = durable(scaler_stats(train))
    balance = durable(churn.class_balance(train))
    weighted = durable(
        churn.class_weight(apply_scaler(train, stats), balance=balance)
    )
    model = churn.churn_model(weighted, FEATURES, **model_options)
    scored = durable(churn.churn_predict(model, apply_scaler(test, stats)))
    return ChurnRun(balance, model, scored)
