"""Fuzzy c-means by repeated one-pass aggregation.

A pass computes memberships on the executors, over packed blocks, and returns only
weighted sums; all cluster counts still running share it.  Sums are decimals, so a fit
does not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.functions.scalars import argmax_label, named
from basketlens.operators.blocks import SUMS, matrix, packed_blocks, sums_of, total_of
from basketlens.operators.sampling import SEED
from basketlens.session import discard

# Fuzzifier and stopping rule.
FUZZIFIER = 2.0
ERROR = 0.005
MAX_ITERATIONS = 1000

# Rows of a block, and rows whose memberships are held at a time.
BLOCK_ROWS = 4096
_CHUNK_ROWS = 2048


def _distances(x: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Squared distances by spot and row, from one matrix product; the small ones, whose
    digits that loses, axis by axis."""
    size = np.einsum("cd,cd->c", spots, spots)[:, None] + np.einsum("nd,nd->n", x, x)
    squared = size - 2.0 * (spots @ x.T)
    size *= 1e-4
    spot, row = np.nonzero(squared <= size)
    squared[spot, row] = ((spots[spot] - x[row]) ** 2).sum(axis=1)
    return squared


def _memberships(squared: np.ndarray, m: float) -> np.ndarray:
    """Memberships by centre and row; a row on a centre belongs to it alone."""
    nearest = squared.min(axis=0)
    if nearest.min(initial=np.inf) > 0.0:
        closeness = nearest / squared
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            closeness = np.where(nearest > 0.0, nearest / squared, squared == 0.0)
    if m != 2.0:
        closeness **= 1.0 / (m - 1.0)
    closeness /= closeness.sum(axis=0)
    return closeness


def _sums(
    x: np.ndarray, centres: Mapping[int, np.ndarray], previous: Mapping[int, np.ndarray], m: float
) -> dict[int, np.ndarray]:
    """Per c a row per cluster: Σu^m, Σu^m·d², Σu², Σ(u - u before)², Σu^m·x; the fourth
    is 0 for counts without ``previous`` centres."""
    totals = {c: np.zeros((c, 4 + x.shape[1])) for c in centres}
    before = {c: spots for c, spots in previous.items() if c in centres}
    every = np.concatenate([*centres.values(), *before.values()])
    for at in range(0, len(x), _CHUNK_ROWS):
        part = x[at : at + _CHUNK_ROWS]
        squared = np.split(_distances(part, every), np.cumsum([*centres, *before])[:-1])
        old = dict(zip(before, squared[len(centres) :]))
        for (c, total), apart in zip(totals.items(), squared):
            u = _memberships(apart, m)
            powered = u * u if m == 2.0 else u**m
            total[:, 0] += powered.sum(axis=1)
            total[:, 1] += np.einsum("cn,cn->c", powered, apart)
            total[:, 2] += np.einsum("cn,cn->c", u, u)
            total[:, 4:] += powered @ part
            if c in old:
                u -= _memberships(old[c], m)
                total[:, 3] += np.einsum("cn,cn->c", u, u)
    return totals


def fuzzy_pass(
    df: DataFrame,
    columns: Sequence[str],
    centres: Mapping[int, np.ndarray],
    previous: Mapping[int, np.ndarray] | None = None,
    m: float = FUZZIFIER,
) -> DataFrame:
    """Per (c, cluster): Σu^m, Σu^m·x, objective, Σu² and the squared change of u
    since ``previous`` centres."""
    columns, previous = list(columns), dict(previous or {})
    centres = dict(centres)
    sums = ["weight", "objective", "u2", "change", *[f"wx_{c}" for c in columns]]

    def accumulate(batches):
        totals = {c: np.zeros((c, len(sums))) for c in centres}
        rows = 0
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            rows += len(x)
            for c, table in _sums(x, centres, previous, m).items():
                totals[c] += table
        for c, table in totals.items():
            out = pd.DataFrame(table, columns=sums)
            if c not in previous:
                out["change"] = np.inf
            out.insert(0, "cluster", np.arange(c))
            out.insert(0, "c", c)
            out["n"] = rows
            yield out

    schema = "c int, cluster int, " + ", ".join(f"{s} double" for s in sums) + ", n long"
    partial = df.select(*columns).mapInPandas(accumulate, schema)
    return partial.groupBy("c", "cluster").agg(*[F.sum(s).alias(s) for s in [*sums, "n"]])


def _block_pass(
    blocks: DataFrame, columns: int, centres: Mapping[int, np.ndarray], previous: Mapping[int, np.ndarray], m: float, error: float
) -> tuple[float, dict[int, np.ndarray]]:
    """The rows, and per c the sums of :func:`_sums` over all packed blocks.

    Whether memberships moved by less than ``error`` is all that the change tells: a task
    that has seen a count move further leaves that count's change at what it is."""
    centres, previous = dict(centres), dict(previous)

    def vectors(batches):
        open_counts = dict(previous)
        moved = {c: 0.0 for c in previous}
        for batch in batches:
            for raw in batch.column("x"):
                x = matrix(raw.as_py(), columns)
                found = _sums(x, centres, open_counts, m)
                yield np.concatenate([[float(len(x))], *[t.ravel() for t in found.values()]])
                for c in list(open_counts):
                    moved[c] += found[c][:, 3].sum()
                    if moved[c] > 2.0 * error**2:
                        del open_counts[c]

    total = total_of(blocks.select("x").mapInArrow(lambda b: sums_of(vectors(b)), SUMS))
    out, at = {}, 1
    for c in centres:
        size = c * (4 + columns)
        out[c] = total[at : at + size].reshape(c, 4 + columns)
        at += size
    return total[0], out


def fuzzy_step(df: DataFrame, columns: Sequence[str], centres: np.ndarray, m: float = FUZZIFIER) -> DataFrame:
    """One update from given centres: the new centres, weights and objective shares."""
    passed = fuzzy_pass(df, columns, {len(centres): np.asarray(centres, dtype=float)}, m=m)
    return passed.select(
        "cluster",
        "weight",
        "objective",
        *[(F.col(f"wx_{c}") / F.col("weight")).alias(c) for c in columns],
    )


@dataclass(frozen=True)
class FuzzyModel:
    columns: tuple[str, ...]
    centres: np.ndarray
    m: float
    objectives: tuple[float, ...]
    fpc: float
    converged: bool

    @property
    def c(self) -> int:
        return len(self.centres)

    def memberships(self) -> Column:
        """The membership array of a row, as JVM arithmetic."""
        gaps = [
            sum(
                (
                    (F.col(name) - F.lit(float(v))) * (F.col(name) - F.lit(float(v)))
                    for name, v in zip(self.columns, centre, strict=True)
                ),
                F.lit(0.0),
            )
            for centre in self.centres
        ]
        power = 1.0 / (self.m - 1.0)

        def closeness(squared: Column, nearest: Column) -> Column:
            return F.transform(
                squared,
                lambda d: F.when(d == nearest, F.lit(1.0))
                .when(nearest == 0.0, F.lit(0.0))
                .otherwise(F.pow(nearest / d, F.lit(power))),
            )

        def shares(close: Column) -> Column:
            total = F.aggregate(close, F.lit(0.0), lambda acc, v: acc + v)
            return named(total, lambda t: F.transform(close, lambda v: v / t))

        # what an element of an array needs is named, or it is worked out anew for each
        squared = F.array(*gaps)
        return named(squared, lambda s: named(F.array_min(s), lambda n: named(closeness(s, n), shares)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the membership array and the hard label of the largest one."""
        return df.withColumn("memberships", self.memberships()).withColumn(
            "cluster", argmax_label(F.col("memberships"))
        )


def _first_centres(df: DataFrame, columns: Sequence[str], largest: int, seed: int, key: str):
    """Spread-out distinct rows out of all rows.

    Every next one is drawn with a chance in proportion to its squared distance from
    those before it: the row with the lowest ``-log(u) / distance`` wins, ``u`` being
    a hash of its key.
    """
    chosen: list[list[float]] = []
    while len(chosen) < largest:
        bits = F.pmod(F.xxhash64(key, F.lit(seed + len(chosen))), F.lit(1 << 52))
        draw = -F.log((bits + 1) / F.lit(float((1 << 52) + 1)))
        gaps = [
            sum(((F.col(c) - F.lit(v)) ** 2 for c, v in zip(columns, centre, strict=True)), F.lit(0.0))
            for centre in chosen
        ]
        apart = F.least(*gaps) if len(gaps) > 1 else gaps[0] if gaps else F.lit(1.0)
        spot = F.array(*[F.col(c).cast("double") for c in columns])
        left = df.where(apart > 0.0)
        best = left.agg(F.min_by(spot, F.struct(draw / apart, F.col(key))).alias("spot")).first()["spot"]
        if best is None:
            raise ValueError(f"{largest} clusters need as many distinct rows, found {len(chosen)}")
        chosen.append(best)
    return np.array(chosen)


def fuzzy_cmeans(
    df: DataFrame,
    columns: Sequence[str],
    cs: Sequence[int],
    m: float = FUZZIFIER,
    error: float = ERROR,
    maxiter: int = MAX_ITERATIONS,
    seed: int = SEED,
    key: str = "user_id",
) -> dict[int, FuzzyModel]:
    """One model per cluster count; all counts advance in the same passes.

    A count stops when the memberships move less than ``error`` in Frobenius norm.
    """
    columns = list(columns)
    data = df.select(key, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        drawn = _first_centres(data, columns, max(cs), seed, key)
        blocks = packed_blocks(data, columns, key, BLOCK_ROWS)
    finally:
        data.unpersist()
    # hundreds of passes read them; a pass is mostly the work of a small job
    kept = blocks.select("x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(kept, columns, {c: drawn[:c] for c in cs}, m, error, maxiter)
    finally:
        kept.unpersist()
        discard(blocks)


def _fitted(
    blocks: DataFrame, columns: list[str], current: dict[int, np.ndarray], m: float, error: float, maxiter: int
) -> dict[int, FuzzyModel]:
    """The models that the passes over packed blocks lead to from first centres."""
    previous: dict[int, np.ndarray] = {}
    history: dict[int, list[float]] = {c: [] for c in current}
    models: dict[int, FuzzyModel] = {}
    for iteration in range(maxiter):
        rows, found = _block_pass(blocks, len(columns), current, previous, m, error)
        for c, sums in found.items():
            history[c].append(float(sums[:, 1].sum()))
            settled = c in previous and sums[:, 3].sum() ** 0.5 < error
            if settled or iteration == maxiter - 1:
                models[c] = FuzzyModel(
                    tuple(columns), current[c], m, tuple(history[c]), float(sums[:, 2].sum() / rows), settled
                )
                del current[c]
                previous.pop(c, None)
                continue
            previous[c] = current[c]
            current[c] = sums[:, 4:] / sums[:, :1]
        if not current:
            break
    return models
