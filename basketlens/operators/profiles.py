"""Descriptions of clusters in unscaled feature units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.functions.scalars import join_labels, round_half_even, within_pct
from basketlens.sources.schemas import FEATURES

# The description texts and the tolerance of the first.
CONSISTENT = "Consistent customers"
ENGAGED = "High-engagement shoppers"
RETAINED = "Retention customers"
VARIETY = "Variety seekers"
UNSTABLE = "Unstable shoppers"
TOLERANCE = 0.05


def cluster_means(
    df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "cluster"
) -> DataFrame:
    """Per cluster: feature means, size, and the overall means beside them.

    The overall means are taken from the per-cluster sums, so the data is read
    once; the window ranges over one row per cluster.
    """
    everything = Window.partitionBy()
    sums = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("cluster_size"),
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
    )
    return sums.select(
        label,
        "cluster_size",
        *[(F.col(f"_s_{c}") / F.col("cluster_size")).alias(c) for c in columns],
        *[
            (F.sum(f"_s_{c}").over(everything) / F.sum("cluster_size").over(everything)).alias(
                f"overall_{c}"
            )
            for c in columns
        ],
    )


def classify_cluster(columns: Sequence[str] = FEATURES) -> Column:
    """Text for a row holding a mean per feature and ``overall_`` counterparts."""

    def above(c: str) -> Column:
        return F.col(c) > F.col(f"overall_{c}")

    def below(c: str) -> Column:
        return F.col(c) < F.col(f"overall_{c}")

    steady = within_pct(
        [F.col(c) for c in columns], [F.col(f"overall_{c}") for c in columns], TOLERANCE
    )
    traits = [
        (above("total_max_orders") & below("average_days_btw_orders"), ENGAGED),
        (above("reorder_mean"), RETAINED),
        (above("unique_products") & below("reorder_mean"), VARIETY),
    ]
    return F.when(steady, F.lit(CONSISTENT)).otherwise(join_labels(traits, UNSTABLE))


def cluster_profiles(
    df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "cluster", places: int = 2
) -> DataFrame:
    """Rounded means, size and description per cluster."""
    return cluster_means(df, columns, label).select(
        label,
        *[round_half_even(F.col(c), places).alias(c) for c in columns],
        "cluster_size",
        classify_cluster(columns).alias("description"),
    )


def overall_mean(df: DataFrame, columns: Sequence[str] = FEATURES, places: int = 2) -> DataFrame:
    return df.agg(*[round_half_even(F.avg(c), places).alias(c) for c in columns])


def profile_delta(
    df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "cluster", places: int = 2
) -> DataFrame:
    """Cluster mean minus overall mean, rounded."""
    return cluster_means(df, columns, label).select(
        label,
        *[
            round_half_even(F.col(c) - F.col(f"overall_{c}"), places).alias(c) for c in columns
        ],
    )


def profile_sizes(
    df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "cluster"
) -> DataFrame:
    return cluster_means(df, columns, label).select(label, *columns, "cluster_size")
