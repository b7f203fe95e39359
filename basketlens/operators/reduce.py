"""Principal components: covariance in one pass, projection as plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, functions as F

from basketlens.sources.schemas import FEATURES


def covariance(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row of means and pairwise population covariances."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[
            F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov_{a}__{b}")
            for a, b in combinations_with_replacement(columns, 2)
        ],
    )


def covariance_table(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """The covariances as rows (feature_a, feature_b, covariance)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_a"),
                F.lit(b).alias("feature_b"),
                F.col(f"cov_{a}__{b}").alias("covariance"),
            )
            for a, b in combinations_with_replacement(columns, 2)
        ]
    )
    return covariance(df, columns).select(F.inline(cells))


class PcaModel:
    """Means and loadings; columns x columns numbers, whatever the row count."""

    def __init__(self, columns: Sequence[str], means, loadings, variances):
        self.columns = tuple(columns)
        self.means = means
        self.loadings = loadings
        self.variances = variances

    def transform(self, df: DataFrame, key: str = "user_id", prefix: str = "pc") -> DataFrame:
        def component(weights) -> F.Column:
            return sum(
                (
                    (F.col(c) - F.lit(float(m))) * F.lit(float(w))
                    for c, m, w in zip(self.columns, self.means, weights, strict=True)
                ),
                F.lit(0.0),
            )

        return df.select(
            key,
            *[component(w).alias(f"{prefix}{i + 1}") for i, w in enumerate(self.loadings)],
        )


def fit_pca(df: DataFrame, columns: Sequence[str] = FEATURES, k: int = 3) -> PcaModel:
    """Top ``k`` components of the centred data; the largest loading is positive."""
    row = covariance(df, columns).first()
    size = len(columns)
    matrix = np.zeros((size, size))
    for (i, a), (j, b) in combinations_with_replacement(enumerate(columns), 2):
        matrix[i, j] = matrix[j, i] = row[f"cov_{a}__{b}"]
    values, vectors = np.linalg.eigh(matrix)
    top = np.argsort(values)[::-1][:k]
    loadings = vectors[:, top].T
    largest = np.abs(loadings).argmax(axis=1)
    loadings = loadings * np.sign(loadings[np.arange(len(loadings)), largest])[:, None]
    means = [row[f"mean_{c}"] for c in columns]
    return PcaModel(columns, means, loadings, values[top])


def pca(df: DataFrame, columns: Sequence[str] = FEATURES, k: int = 3, key: str = "user_id") -> DataFrame:
    return fit_pca(df, columns, k).transform(df, key)
