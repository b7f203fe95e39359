"""Gaussian mixtures with full covariances, all cluster counts in shared passes.

An EM step is one pass over packed blocks for every model that is still moving: tasks
take responsibilities in logarithms and hand on, per component, the sums of r, r x and
r x x'; the step itself is taken at the driver from these sums, whose number does not
depend on the rows.  Models start from k-means, and a model stops when its mean
log-likelihood gains less than the tolerance.  Sums are decimals, so a fit does not
depend on how the table is partitioned.

Cases: a floor on the diagonal keeps covariances of few or equal rows regular; a component
that loses all its rows stays where it is; an empty table leaves the start unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from basketlens.operators.blocks import SUMS, matrix, packed_blocks, squared_distances, sums_of, total_of
from basketlens.operators.lloyd import BLOCK_ROWS, kmeans

# Fixed value: what is added to the variances.
FLOOR = 1e-6


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of weight times density, by row and component."""
        out = np.empty((len(x), len(self.weights)))
        for c, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances)):
            lower = np.linalg.cholesky(covariance)
            scaled = np.linalg.solve(lower, (x - mean).T)
            size = np.log(np.diag(lower)).sum() + 0.5 * len(mean) * np.log(2 * np.pi)
            out[:, c] = np.log(max(weight, 1e-300)) - size - 0.5 * (scaled**2).sum(axis=0)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the components in every row, and the rows' log-likelihoods."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        likelihood = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - likelihood[:, None]), likelihood


@dataclass(frozen=True)
class MixtureModel:
    columns: tuple[str, ...]
    mixture: Mixture
    log_likelihood: float  # mean over rows
    history: tuple[float, ...]


def _moments(blocks: DataFrame, columns: int, shares: Sequence[Callable], sizes: Sequence[int]) -> list[tuple]:
    """For every model the rows, the sum of log-likelihoods and per component the sums of
    r, r x and r x x'."""
    each = 1 + columns + columns * columns

    def vectors(batches):
        for batch in batches:
            for raw in batch.column("x"):
                x = matrix(raw.as_py(), columns)
                flat = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)])
                parts = [np.array([float(len(x))])]
                for share in shares:
                    r, likelihood = share(x)
                    parts += [np.array([likelihood.sum()]), (r.T @ flat).ravel()]
                yield np.concatenate(parts)

    total = total_of(blocks.select("x").mapInArrow(lambda b: sums_of(vectors(b)), SUMS))
    out, at = [], 1
    for k in sizes:
        if not len(total):
            out.append((0.0, 0.0, np.zeros((k, each))))
            continue
        out.append((total[0], total[at], total[at + 1 : at + 1 + k * each].reshape(k, each)))
        at += 1 + k * each
    return out


def em_step(blocks: DataFrame, columns: int, mixtures: Sequence[Mixture], floor: float = FLOOR) -> list[tuple[float, Mixture]]:
    """For every mixture its mean log-likelihood and the mixture after a step."""
    found = _moments(blocks, columns, [m.responsibilities for m in mixtures], [len(m.weights) for m in mixtures])
    return [(likelihood / max(rows, 1.0), _maximised(sums, rows, columns, floor, m)) for m, (rows, likelihood, sums) in zip(mixtures, found)]


def _maximised(sums: np.ndarray, rows: float, columns: int, floor: float, before: Mixture) -> Mixture:
    n = sums[:, 0]
    held = n > 1e-9
    size = np.where(held, n, 1.0)
    means = np.where(held[:, None], sums[:, 1 : 1 + columns] / size[:, None], before.means)
    second = sums[:, 1 + columns :].reshape(-1, columns, columns) / size[:, None, None]
    spread = second - means[:, :, None] * means[:, None, :]
    spread = (spread + spread.transpose(0, 2, 1)) / 2 + floor * np.eye(columns)
    # what rounding leaves of a variance is not below the floor
    values, vectors = np.linalg.eigh(spread)
    spread = (vectors * np.maximum(values, floor)[:, None, :]) @ vectors.transpose(0, 2, 1)
    covariances = np.where(held[:, None, None], spread, before.covariances)
    return Mixture(n / max(rows, 1.0), means, covariances)


def gaussian_mixtures(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int],
    seed: int = 42,
    iterations: int = 100,
    tolerance: float = 1e-3,
    key: str = "user_id",
    block_rows: int = BLOCK_ROWS,
) -> dict[int, MixtureModel]:
    """One mixture of each size."""
    columns = list(columns)
    d = len(columns)
    blocks = packed_blocks(df, columns, key, block_rows)
    starts = kmeans(df, columns, ks, 1, seed, key=key, block_rows=block_rows)

    def hard(centres):
        def share(x):
            return np.eye(len(centres))[squared_distances(x, centres).argmin(axis=1)], np.zeros(len(x))

        return share

    moments = _moments(blocks, d, [hard(starts[k].centres) for k in ks], list(ks))
    moving = {
        k: _maximised(sums, rows, d, FLOOR, Mixture(np.full(k, 1 / k), starts[k].centres, np.tile(np.eye(d), (k, 1, 1))))
        for k, (rows, _, sums) in zip(ks, moments)
    }
    history: dict[int, list[float]] = {k: [] for k in ks}
    models = {}
    for step in range(iterations + 1):
        found = em_step(blocks, d, list(moving.values()))
        following = {}
        for (k, mixture), (likelihood, after) in zip(moving.items(), found):
            seen = history[k]
            seen.append(likelihood)
            if step == iterations or len(seen) > 1 and seen[-1] - seen[-2] < tolerance:
                models[k] = MixtureModel(tuple(columns), mixture, likelihood, tuple(seen))
            else:
                following[k] = after
        moving = following
        if not moving:
            break
    return {k: models[k] for k in ks}


def with_labels(df: DataFrame, models: dict[int, MixtureModel], prefix: str = "cluster_") -> DataFrame:
    """The rows with their likeliest component per model, ``<prefix><k>``."""
    added = [f"{prefix}{k}" for k in models]

    def run(batches):
        for batch in batches:
            out = []
            for model in models.values():
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in model.columns])
                out.append(pa.array(model.mixture.log_densities(x).argmax(axis=1).astype(np.int32)))
            yield pa.record_batch([*batch.columns, *out], [*batch.schema.names, *added])

    shape = StructType([*df.schema.fields, *[StructField(c, IntegerType()) for c in added]])
    return df.mapInArrow(run, shape)
