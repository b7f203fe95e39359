"""Reading and writing the six tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.sources.schemas import TABLES


@dataclass(frozen=True)
class ShopTables:
    orders: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame
    order_products_prior: DataFrame
    order_products_train: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def load_table(spark: SparkSession, directory: str, name: str, fmt: str = "csv") -> DataFrame:
    """One table with its declared schema; text files are never scanned to infer it."""
    schema, _ = TABLES[name]
    path = f"{directory.rstrip('/')}/{name}.{fmt}"
    if fmt == "csv":
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("sep", ",")
            .option("quote", '"')
            .option("escape", '"')
            .option("mode", "FAILFAST")
            .csv(path)
        )
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown table format {fmt!r}; use 'csv' or 'parquet'")


def load_tables(spark: SparkSession, directory: str, fmt: str = "csv") -> ShopTables:
    return ShopTables(
        **{name.replace("__", "_"): load_table(spark, directory, name, fmt) for name in TABLES}
    )


def raw_orders(spark: SparkSession, directory: str, fmt: str = "csv") -> DataFrame:
    """Orders as stored: the day gap of a first order is still missing."""
    return load_table(spark, directory, "orders", fmt)


def write_tables(tables: ShopTables, directory: str, fmt: str = "parquet") -> None:
    """Store the six tables under the names :func:`load_tables` expects."""
    named = tables.named()
    for name in TABLES:
        writer = named[name.replace("__", "_")].write.mode("errorifexists")
        path = f"{directory.rstrip('/')}/{name}.{fmt}"
        if fmt == "csv":
            writer.option("header", True).option("escape", '"').csv(path)
        else:
            writer.parquet(path)


def cast_types(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared types; a missing value in a key column is an error."""
    schema, required = TABLES[name]
    casted = {}
    for field in schema:
        if field.name not in df.columns:
            continue
        value = F.col(field.name).try_cast(field.dataType)
        if field.name in required:
            problem = F.raise_error(F.lit(f"{name}.{field.name} is missing or not a number"))
            value = F.coalesce(value, problem.cast(field.dataType))
        else:
            value = F.col(field.name).cast(field.dataType)
        casted[field.name] = value
    return df.withColumns(casted)
