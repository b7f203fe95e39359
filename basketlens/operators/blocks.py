"""Distances between rows of a table in blocks, without a driver copy.

Rows are dealt into blocks of bounded size, packed in one row each, so that a task holds
a block or two whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.session import durable

BLOCK_ROWS = 2048


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances, summed axis by axis (no cancellation)."""
    out = np.zeros((len(left), len(right)))
    for axis in range(left.shape[1]):
        out += (left[:, axis, None] - right[None, :, axis]) ** 2
    return out


def block_of(key: Column, blocks: Column | int) -> Column:
    count = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.pmod(F.xxhash64(key), count).cast("int")


def every_block(blocks: Column | int) -> Column:
    count = F.lit(blocks) if isinstance(blocks, int) else blocks
    return F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))


def blocks_for(rows: int, size: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // size))


def packed_blocks(df: DataFrame, columns: list[str], key: str, size: int = BLOCK_ROWS) -> DataFrame:
    """A written table (block, rows, keys, x) with one row per block of about ``size``
    rows: ``x`` is the block's matrix, row by row, in the order of the keys' hashes.

    Rows are dealt by hash, so a block is a random part of the table and depends on
    nothing but the rows; iterative models read it again and again without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    picked = df.select(
        F.col(key).alias("key"), F.xxhash64(key).alias("h"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
    )
    blocks = blocks_for(picked.count(), size)
    names = [f"x{i}" for i in range(len(columns))]

    def pack(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy() for c in names])
        order = np.lexsort([*x.T[::-1], table.column("h").to_numpy()])
        keys = table.column("key").take(pa.array(order)).combine_chunks()
        return pa.table(
            [
                pa.array([table.column("block")[0].as_py()], pa.int32()),
                pa.array([len(x)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), keys),
                pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()),
            ],
            ["block", "rows", "keys", "x"],
        )

    # few blocks are small, but each is work for a task of its own
    parts = min(blocks, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return durable(
        picked.withColumn("block", block_of(F.col("key"), blocks)).repartition(parts, "block")
        .groupBy("block").applyInArrow(pack, f"block int, rows long, keys array<{kind}>, x binary")
    )


def matrix(raw: bytes, columns: int) -> np.ndarray:
    """The matrix of a packed block."""
    return np.frombuffer(raw, np.float64).reshape(-1, columns)


def hash_of(values: np.ndarray, start: np.ndarray | int = 42) -> np.ndarray:
    """What ``xxhash64`` gives for a column of long or int values, as unsigned numbers;
    ``start`` is the hash of the columns before it."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )

    def turned(x, bits):
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    values, start = np.atleast_1d(values), np.asarray(start).astype(np.uint64)
    if values.dtype == np.int32:
        h = start + p5 + np.uint64(4) ^ values.astype(np.uint32).astype(np.uint64) * p1
        h = turned(h, 23) * p2 + p3
    else:
        h = start + p5 + np.uint64(8) ^ turned(values.astype(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


# Sums are taken in units of 1e-18, as whole numbers: their order changes nothing.
_PLACES = 18
SUMS = f"sums array<decimal(38,{_PLACES})>"


def sums_of(vectors: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of a task's vectors, none if there are no vectors."""
    total = None
    for vector in vectors:
        whole = np.array([int(v) for v in np.rint(vector * 10.0**_PLACES)], object)
        total = whole if total is None else total + whole
    if total is not None:
        with localcontext(prec=60):
            values = [Decimal(v).scaleb(-_PLACES) for v in total]
        yield pa.record_batch([pa.array([values], pa.list_(pa.decimal128(38, _PLACES)))], ["sums"])


def total_of(partial: DataFrame) -> np.ndarray:
    """The sum of all tasks' vectors (see :func:`sums_of`), empty if there are none.

    One vector per task reaches the driver, and tasks are bounded: a table of packed
    blocks is read in at most four parts per core, or of 128 MB each.  Whole numbers are
    added up, so their order changes nothing, and a pass is a job of a single stage."""
    found = partial.toArrow()
    if not found.num_rows:
        return np.empty(0)
    values = found.column("sums").combine_chunks().flatten()
    places = pa.array(np.tile(np.arange(len(values) // found.num_rows), found.num_rows))
    totals = pa.table([places, values], ["pos", "value"]).group_by("pos").aggregate([("value", "sum")])
    out = np.empty(totals.num_rows)
    out[totals.column("pos").to_numpy()] = [float(v) for v in totals.column("value_sum").to_pylist()]
    return out
