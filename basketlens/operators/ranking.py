"""Order-dependent building blocks that hold when one key owns a third of the rows.

A plain window sends each key to one task, and an un-partitioned window sends
everything to one.  Here ordered data is cut into *cells* first: rows are
numbered or summed inside a cell, and a small per-cell table carries what comes
before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.session import durable

# A key with more rows than this is split.
HOT_ROWS = 1_000_000

# Sampled rows expected from a key that is exactly at the limit.
_PROBE_ROWS = 200


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS, seed: int = 42) -> DataFrame | None:
    """Written table of the keys owning more than about ``limit`` rows, at most
    2 * rows / limit of them; None if there are none.

    No key can be that large in a small table, which the row count (file footers
    only) tells.  Otherwise a thin row sample is counted.  Results never depend
    on the keys: they only decide which of two exact plans a key takes.
    """
    if df.count() <= limit:
        return None
    fraction = min(1.0, _PROBE_ROWS / limit)
    probe = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction, seed)
    threshold = limit if fraction == 1.0 else _PROBE_ROWS // 2
    counted = probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = durable(counted.where(F.col("_rows") > threshold).select(*keys))
    return None if found.isEmpty() else found


def split_hot(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, rows of the listed keys; the list's measured size
    decides whether it is broadcast."""
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def cell_offsets(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Per cell (``keys`` + ``levels``): its row count and the rows before it.

    ``levels`` are order-preserving and go from coarse to fine, so each window
    below ranges over one level inside its parent only.
    """
    cells = df.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_rows"))
    result = cells.withColumn("_before", F.lit(0).cast("long"))
    for depth, level in enumerate(levels):
        parent = [*keys, *levels[:depth]]
        here = [*parent, level]
        rolled = cells if depth == len(levels) - 1 else cells.groupBy(*here).agg(
            F.sum("_rows").alias("_rows")
        )
        preceding = Window.partitionBy(*parent).orderBy(level).rowsBetween(
            Window.unboundedPreceding, -1
        )
        step = rolled.select(
            *here, F.coalesce(F.sum("_rows").over(preceding), F.lit(0)).alias("_step")
        )
        result = (
            result.join(step, here)
            .withColumn("_before", F.col("_before") + F.col("_step"))
            .drop("_step")
        )
    return result


def ordinal_by_cells(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    out: str,
) -> DataFrame:
    """Row number per key for keys too large for one task."""
    offsets = cell_offsets(df, keys, levels).drop("_rows")
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    return (
        df.join(offsets, [*keys, *levels])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_before")
    )


def value_buckets(df: DataFrame, value: str, buckets: int = 1024) -> DataFrame:
    """Add ``_bucket``, an order-preserving cut of a numeric column.

    The cut points are approximate quantiles (at most ``buckets`` numbers at the
    driver); only the balance of the buckets depends on them, never a result.
    """
    probs = [i / buckets for i in range(1, buckets)]
    found = df.agg(
        F.percentile_approx(F.col(value).cast("double"), probs, 10 * buckets).alias("q")
    ).first()["q"]
    inner = sorted(set(found or []))
    splits = [float("-inf"), *inner, float("inf")]
    prepared = df.withColumn("_value", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket", handleInvalid="error")
    return cut.transform(prepared).drop("_value").withColumn("_bucket", F.col("_bucket").cast("int"))


def running_totals(
    distinct: DataFrame,
    value: str,
    totals: Mapping[str, str],
    descending: bool = False,
    following: Mapping[str, str] | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Cumulative sums over a whole table ordered by ``value`` (one row per value).

    ``totals`` maps a source column to its running-sum column (row included);
    ``following`` maps a source column to one holding the next row's content.
    Window sizes: one bucket, and the bucket table itself (``buckets`` rows).
    """
    following = dict(following or {})
    cut = value_buckets(distinct, value, buckets)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first_of = F.max_by if descending else F.min_by

    per_bucket = cut.groupBy("_bucket").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in totals],
        *[first_of(c, value).alias(f"_f_{c}") for c in following],
        F.count(F.lit(1)).alias("_rows"),
    )
    across = Window.orderBy(direction("_bucket"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in totals],
        *[F.lead(f"_f_{c}").over(across).alias(f"_n_{c}") for c in following],
    )
    inside = Window.partitionBy("_bucket").orderBy(direction(value))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most ``buckets`` rows
    joined = cut.join(F.broadcast(carried), "_bucket")
    added: dict[str, Column] = {
        out: F.sum(c).over(upto) + F.col(f"_b_{c}") for c, out in totals.items()
    }
    added |= {
        out: F.coalesce(F.lead(c).over(inside), F.col(f"_n_{c}")) for c, out in following.items()
    }
    return joined.select(*distinct.columns, *[expr.alias(out) for out, expr in added.items()])


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, frequency) of a numeric column, missing values left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def quantiles(frequencies: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of :func:`value_frequencies` as one
    row, one column per entry of ``probs``.

    Working on counted values, no task's memory depends on how many rows or
    distinct values there are.  The input is read more than once: hand in a
    written table.
    """
    ranked = running_totals(
        frequencies, "value", {"frequency": "_upto"}, following={"value": "_next"}
    )
    total = frequencies.agg(F.sum("frequency").alias("t")).scalar()
    placed = ranked.withColumn("_total", total)

    def at(prob: float) -> Column:
        position = F.lit(float(prob)) * (F.col("_total") - 1)
        low = F.floor(position)
        value = F.col("value")
        upper = F.when(low + 1 < F.col("_upto"), value).otherwise(F.coalesce("_next", "value"))
        inside = (low >= F.col("_upto") - F.col("frequency")) & (low < F.col("_upto"))
        return F.max(F.when(inside, value + (upper - value) * (position - low)))

    return placed.agg(*[at(p).alias(name) for name, p in probs.items()])
