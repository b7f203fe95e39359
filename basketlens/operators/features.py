"""Per-user features and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from basketlens.operators.quality import fill_nulls
from basketlens.sources.schemas import FEATURES


def user_features(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Seven behavioural features per user, over order lines.

    Means are weighted by basket size because each line counts once.  The one
    distinct count makes Spark aggregate by (user, product) before it aggregates
    by user, so a user or product with very many lines is spread out.
    """
    filled = fill_nulls(orders)
    lined = filled.join(lines, "order_id").where(F.col("user_id").isNotNull())
    return lined.groupBy("user_id").agg(
        F.max("order_number").alias("total_max_orders"),
        F.avg("days_since_prior_order").alias("average_days_btw_orders"),
        F.avg("reordered").alias("reorder_mean"),
        F.avg("order_hour_of_day").alias("average_hour_of_day"),
        F.avg("order_dow").alias("average_order_dow"),
        F.count_distinct("product_id").alias("unique_products"),
        F.avg("add_to_cart_order").alias("average_add_to_cart_order"),
    )


def days_sum(orders: DataFrame) -> DataFrame:
    """Total of the recorded day gaps per user, from un-filled orders."""
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.coalesce(F.sum("days_since_prior_order"), F.lit(0.0)).alias("days_since_last_order")
        )
    )


def scaler_stats(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and population deviation of each column, as one row from one pass."""
    return df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"std_{c}") for c in columns],
    )


def apply_scaler(df: DataFrame, stats: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Z-scores under given statistics; a constant column is only centred."""
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()

    def scaled(c: str):
        deviation = F.col(f"_s.std_{c}")
        divisor = F.when(deviation == 0.0, F.lit(1.0)).otherwise(deviation)
        return ((F.col(c) - F.col(f"_s.mean_{c}")) / divisor).alias(c)

    return df.withColumn("_s", packed).select(
        *[scaled(c) if c in columns else F.col(c) for c in df.columns]
    )


def standardize(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    return apply_scaler(df, scaler_stats(df, columns), columns)
