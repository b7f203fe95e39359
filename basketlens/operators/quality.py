"""Row counts, missing values, duplicates and clean-up of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

GAP_COLUMN = "days_since_prior_order"


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table; no column is read for a count."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
            )
            for name, df in tables.items()
        ]
    )


def preview(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The first rows under an explicit order."""
    return df.select(*(columns or df.columns)).orderBy(*order).limit(n)


def strip_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values of every column in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def missing_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column; one pass per table."""
    return _stack(
        [
            null_counts(df)
            .unpivot([], df.columns, "variable_name", "missing_values")
            .select(F.lit(name).alias("table_name"), "variable_name", "missing_values")
            for name, df in tables.items()
        ]
    )


def fill_nulls(df: DataFrame, column: str = GAP_COLUMN, value: float = 0.0) -> DataFrame:
    return df.fillna({column: value}) if column in df.columns else df


def duplicate_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Whether each table holds a repeated row, and whether all of them do.

    Grouping on all columns is combined map-side, so many copies of one row
    cost one shuffled record per task.
    """
    flags = _stack(
        [
            df.groupBy(*df.columns)
            .agg(F.count(F.lit(1)).alias("_copies"))
            .agg(F.coalesce(F.max("_copies") > 1, F.lit(False)).alias("has_duplicates"))
            .select(F.lit(name).alias("table_name"), "has_duplicates")
            for name, df in tables.items()
        ]
    )
    overall = flags.agg(F.every("has_duplicates").alias("all_tables")).scalar()
    answer = F.when(F.col("_all"), F.lit("Yes")).otherwise(F.lit("No"))
    return flags.withColumn("_all", overall).select(
        "table_name", "has_duplicates", answer.alias("answer")
    )


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
