"""Exploratory aggregates.

Counts by product attribute are taken per product first: a product that owns a
third of all lines is reduced to one partial count per task before any shuffle,
and the joins that follow see one row per product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.functions.scalars import keyword_flag, percent_text
from basketlens.operators.ranking import quantiles, value_frequencies
from basketlens.operators.sampling import SEED
from basketlens.session import durable

# Fixed value: resamples behind a plotted band.
RESAMPLES = 1000


def orders_per_user(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.max("order_number").alias("total_orders"))
    )


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Rows per value; missing values are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(out))
    )


def equal_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bins`` equal-width bins between minimum and maximum, empty ones included.

    A bin holds its left edge; the last one holds its right edge too.  A single
    distinct value gets an interval one wide around it.
    """
    counts = value_counts(df.select(F.col(column).cast("double").alias("_v")), "_v", "_n")
    low, high = F.min("_v"), F.max("_v")
    single = low == high
    span = counts.agg(
        F.struct(
            F.when(single, low - 0.5).otherwise(low).alias("low"),
            F.when(single, high + 0.5).otherwise(high).alias("high"),
        ).alias("span")
    ).scalar()

    def edge(index: Column) -> Column:
        step = (F.col("_s.high") - F.col("_s.low")) / F.lit(float(bins))
        return F.when(index == bins, F.col("_s.high")).otherwise(
            index.cast("double") * step + F.col("_s.low")
        )

    guess = F.floor(
        (F.col("_v") - F.col("_s.low")) / (F.col("_s.high") - F.col("_s.low")) * F.lit(float(bins))
    )
    last = bins - 1
    placed = (
        counts.withColumn("_s", span)
        .withColumn("_b", F.least(guess, F.lit(last)))
        # the division may land one bin off; the edges decide
        .withColumn(
            "bin",
            F.when(F.col("_v") < edge(F.col("_b")), F.col("_b") - 1)
            .when(
                (F.col("_v") >= edge(F.col("_b") + 1)) & (F.col("_b") != last), F.col("_b") + 1
            )
            .otherwise(F.col("_b"))
            .cast("int"),
        )
        .groupBy("bin")
        .agg(F.sum("_n").alias("n"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(placed, "bin", "left")
        .withColumn("_s", span)
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_left"),
            edge(F.col("bin") + 1).alias("bin_right"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def orders_per_user_hist(orders: DataFrame, bins: int = 25) -> DataFrame:
    return equal_width_histogram(orders_per_user(orders), "total_orders", bins)


def gap_hist(orders: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the day gap; the input is expected to be filled."""
    return equal_width_histogram(orders, "days_since_prior_order", bins)


def orders_by_hour(orders: DataFrame) -> DataFrame:
    return value_counts(orders, "order_hour_of_day", "n_orders")


def orders_by_dow(orders: DataFrame) -> DataFrame:
    return value_counts(orders, "order_dow", "n_orders")


def distinct_values(orders: DataFrame) -> DataFrame:
    """Distinct hours and weekdays, from one small table of their pairs."""
    pairs = orders.groupBy("order_hour_of_day", "order_dow").agg(F.count(F.lit(1)))
    return pairs.agg(
        F.count_distinct("order_hour_of_day").alias("distinct_hours"),
        F.count_distinct("order_dow").alias("distinct_days"),
    )


# Quartile names and positions.
QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles as one row.

    Everything is read off one table of value counts.
    """
    counts = durable(value_frequencies(df, column))
    x, n = F.col("value"), F.col("frequency")
    total = F.sum("frequency")
    mean = counts.agg((F.sum(x * n) / total).alias("m")).scalar()
    squares = F.sum(n * (x - F.col("_m")) * (x - F.col("_m")))
    moments = counts.withColumn("_m", mean).agg(
        total.alias("count"),
        F.max("_m").alias("mean"),
        F.when(total > 1, F.sqrt(squares / (total - 1))).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    packed = quantiles(counts, QUARTILES).select(F.struct(*QUARTILES).alias("q")).scalar()
    return moments.withColumn("_q", packed).select(
        "count", "mean", "std", "min", *[F.col(f"_q.{q}").alias(q) for q in QUARTILES], "max"
    )


def outlier_stats(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the furthest inlier, outliers."""
    counts = durable(value_frequencies(df, column))
    packed = quantiles(counts, QUARTILES).select(F.struct(*QUARTILES).alias("q")).scalar()
    x = F.col("value")
    spread = F.col("_q.q75") - F.col("_q.q25")
    inlier = (x >= F.col("_q.q25") - F.lit(reach) * spread) & (
        x <= F.col("_q.q75") + F.lit(reach) * spread
    )
    return counts.withColumn("_q", packed).agg(
        *[F.max(f"_q.{q}").alias(q) for q in QUARTILES],
        F.min(F.when(inlier, x)).alias("whisker_low"),
        F.max(F.when(inlier, x)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inlier, F.col("frequency"))), F.lit(0)).alias("outliers"),
    )


def reorder_by_cart_pos(lines: DataFrame, z: float = 1.96) -> DataFrame:
    """Mean reorder flag per cart position with a normal-approximation band."""
    half = F.lit(z) * F.stddev_samp(F.col("reordered").cast("double")) / F.sqrt(
        F.count("reordered")
    )
    mean = F.avg("reordered")
    return (
        lines.where(F.col("add_to_cart_order").isNotNull())
        .groupBy("add_to_cart_order")
        .agg(
            F.count("reordered").alias("n"),
            mean.alias("reorder_mean"),
            (mean - half).alias("band_low"),
            (mean + half).alias("band_high"),
        )
    )


def _poisson_weights(resamples: int):
    """Rows (group, value, frequency, seed) to one row per resample: the weight that rows
    of this value get together, a Poisson number whose mean is their count."""

    def draw(batches):
        for batch in batches:
            for group, value, frequency, seed in zip(*(batch[c].to_numpy() for c in ("grp", "value", "frequency", "seed"))):
                weight = np.random.default_rng(int(seed)).poisson(frequency, resamples)
                yield pd.DataFrame(
                    {"grp": group, "resample": np.arange(resamples, dtype="int32"), "weight": weight, "total": weight * value}
                )

    return draw


def bootstrap_means(
    df: DataFrame, group: str, column: str, resamples: int = RESAMPLES, level: float = 0.95, seed: int = SEED
) -> DataFrame:
    """Mean of a column per group (a whole number) with a bootstrap percentile band:
    (group, n, mean, band_low, band_high).

    Every row gets a Poisson weight of mean 1 in each resample.  Weights of equal values
    add up to a Poisson number again, so one draw per (group, value, resample) serves all
    rows of a value, and the table is read once.  Draws are seeded by group and value.
    Missing groups and values are left out; a resample whose weights are all zero (only
    likely for groups of a few rows) has no mean and is left out too.
    """
    known = df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
    counts = durable(
        known.groupBy(F.col(group).cast("long").alias("grp"), F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .withColumn("seed", F.xxhash64("grp", "value", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)))
    )
    drawn = counts.mapInPandas(_poisson_weights(resamples), "grp long, resample int, weight long, total double")
    means = drawn.groupBy("grp", "resample").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0))).alias("at"))
    ends = F.percentile("at", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    bands = means.groupBy("grp").agg(ends.alias("ends"))
    found = counts.groupBy("grp").agg(
        F.sum("frequency").alias("n"),
        (F.sum(F.col("value") * F.col("frequency")) / F.sum("frequency")).alias("mean"),
    )
    return found.join(bands, "grp").select(
        F.col("grp").alias(group), "n", "mean", F.get("ends", F.lit(0)).alias("band_low"), F.get("ends", F.lit(1)).alias("band_high")
    )


def reorder_rate(lines: DataFrame) -> DataFrame:
    rate = lines.agg(F.avg("reordered").alias("reorder_rate"))
    return rate.select("reorder_rate", percent_text(F.col("reorder_rate")).alias("rate_text"))


def lines_per_product(lines: DataFrame) -> DataFrame:
    return value_counts(lines, "product_id", "_n")


def _count_by(counted: DataFrame, column: str, out: str) -> DataFrame:
    return (
        counted.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.sum("_n").alias(out))
    )


def _top(counts: DataFrame, name: str, out: str, n: int) -> DataFrame:
    """The largest counts; ties in name order."""
    return counts.orderBy(F.desc(out), F.asc(name)).limit(n)


def top_products(lines: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    # a line without a known product has no name to count, so inner is enough
    named = lines_per_product(lines).join(products.select("product_id", "product_name"), "product_id")
    return _top(_count_by(named, "product_name", "quantity"), "product_name", "quantity", n)


def top_departments(lines: DataFrame, dim: DataFrame, n: int = 10) -> DataFrame:
    named = lines_per_product(lines).join(dim.select("product_id", "department"), "product_id")
    return _top(_count_by(named, "department", "order_count"), "department", "order_count", n)


def top_aisles(lines: DataFrame, dim: DataFrame, n: int = 10) -> DataFrame:
    named = lines_per_product(lines).join(dim.select("product_id", "aisle"), "product_id")
    return _top(_count_by(named, "aisle", "order_count"), "aisle", "order_count", n)


def organic_share(lines: DataFrame, dim: DataFrame, keyword: str = "Organic") -> DataFrame:
    """Lines with and without the keyword in the product name, and their share."""
    named = lines_per_product(lines).join(dim.select("product_id", "product_name"), "product_id")
    flagged = named.select(keyword_flag(F.col("product_name"), keyword).alias("is_organic"), "_n")
    counts = _count_by(flagged, "is_organic", "n")
    # two rows: a window over them, so that the lines are read once
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("is_organic", "n", (F.col("n") * F.lit(100.0) / total).alias("percent"))
