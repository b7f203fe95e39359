"""Joins between the six tables.

No broadcast is forced: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with
adaptive execution splitting a partition that one key dominates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def rows_of(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def rows_with_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return df.join(keys.select(column), column, "left_semi")


def subtract_row(df: DataFrame, row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the single row of ``row`` from every row of ``df``."""
    packed = row.select(F.struct(*columns).alias("r")).scalar()
    return df.withColumn("_row", packed).select(
        *[
            (F.col(c) - F.col(f"_row.{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def lines_products_left(lines: DataFrame, products: DataFrame) -> DataFrame:
    return lines.join(products, "product_id", "left")


def product_dim(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    return products.join(aisles, "aisle_id").join(departments, "department_id")


def lines_product_dim(lines: DataFrame, dim: DataFrame) -> DataFrame:
    return lines.join(dim, "product_id")


def orders_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return orders.join(lines, "order_id")


def wide_table(
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    aisles: DataFrame,
    departments: DataFrame,
) -> DataFrame:
    """Every line with its order and, where known, its product, aisle and department.

    The three dimensions are joined to each other first, so the lines meet one
    table instead of three.
    """
    dimension = products.join(aisles, "aisle_id", "left").join(
        departments, "department_id", "left"
    )
    return orders_lines(orders, lines).join(dimension, "product_id", "left")


def features_churn(features: DataFrame, days: DataFrame) -> DataFrame:
    return features.join(days, "user_id", "left")
