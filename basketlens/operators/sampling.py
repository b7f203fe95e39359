"""Seeded samples and splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.functions.scalars import sample_key
from basketlens.session import durable

SAMPLE_SIZE = 3000
SEED = 42


def sample_n(df: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED, key: str = "user_id") -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer) in hash order of ``key``,
    which must be unique."""
    marked = _mark_first(df, [], lambda total: F.lit(n), "_picked", seed, key)
    return marked.where("_picked").select(*df.columns)


def stratified_split(
    df: DataFrame,
    label: str,
    test_size: float = 0.2,
    seed: int = SEED,
    key: str = "user_id",
    digits: int = 4,
) -> DataFrame:
    """Add ``is_test``: round(n * test_size) rows of each label, exactly.

    ``key`` must be unique; ``df`` is evaluated once and written.
    """

    def target(total: Column) -> Column:
        return F.round(total * F.lit(test_size)).cast("long")

    return _mark_first(df, [label], target, "is_test", seed, key, digits)


def _mark_first(
    df: DataFrame,
    by: Sequence[str],
    target: Callable[[Column], Column],
    out: str,
    seed: int,
    key: str,
    digits: int = 4,
) -> DataFrame:
    """Flag the first ``target(rows)`` rows of each group in hash order.

    The hash order is cut into 16**digits cells, and their running counts name the
    last cell wholly taken and the one that straddles the target; only the rows of
    that one are numbered, which gives the last hash taken.
    """
    groups = list(by) or ["_all"]
    cells = df.select("*", sample_key(F.col(key), seed).alias("_hash"), F.lit(0).alias("_all"))
    cells = durable(cells.withColumn("_cell", F.substring("_hash", 1, digits)))
    counted = cells.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = Window.partitionBy(*groups).orderBy("_cell")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most 16**digits rows per group
    bounds = durable(
        counted.select(
            *groups,
            "_cell",
            F.sum("_rows").over(upto).alias("_upto"),
            (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"),
            target(F.sum("_rows").over(whole)).alias("_target"),
        )
    )
    straddling = bounds.where("_before < _target AND _upto > _target")
    inside = Window.partitionBy(*groups, "_cell").orderBy("_hash", key)
    taken = (
        cells.join(straddling, [*groups, "_cell"])
        .withColumn("_number", F.row_number().over(inside) + F.col("_before"))
        .where("_number <= _target")
    )
    cut = taken.groupBy(*groups).agg(F.max(F.struct("_hash", key)).alias("_cut"))
    # a row per group; written, so that its size decides how it is joined
    limits = durable(
        bounds.groupBy(*groups)
        .agg(F.max(F.when(F.col("_upto") <= F.col("_target"), F.col("_cell"))).alias("_last"))
        .join(cut, groups, "left")
    )
    first = (F.col("_cell") <= F.col("_last")) | (F.struct("_hash", key) <= F.col("_cut"))
    return cells.join(limits, groups).select(*df.columns, F.coalesce(first, F.lit(False)).alias(out))
