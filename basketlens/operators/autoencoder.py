"""A small autoencoder trained by block-local mini-batches, applied as column arithmetic.

Rows are dealt by key hash into blocks of bounded size.  In a round every block starts
from the common weights and Adam moments and takes ``ROUND_BATCHES`` steps on batches of
its own rows; weights and moments come back weighted by rows and are averaged, so
there is one job per round, whatever the number of steps.  Networks from ``STARTS`` starts
advance in the same rounds, since some never leave a plateau; the best is kept.  Blocks, their order and
their batches follow from keys, rows and seed, and averages are sums of decimals, so the
trained weights do not depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketlens.operators.blocks import SUMS, matrix, packed_blocks, sums_of, total_of
from basketlens.sources.schemas import FEATURES

# Network and training settings.
HIDDEN = 8
CODE = 3
LEARNING_RATE = 0.01

BATCH = 64

# Rows of a block, and batches it trains on in a round.  Training ends when the best loss
# has fallen by less than TOLERANCE of itself over the last PATIENCE rounds; ROUNDS only
# bounds a run that never settles.
BLOCK_ROWS = 4096
STARTS = 8
ROUND_BATCHES = 256
TOLERANCE = 2e-2
PATIENCE = 8
ROUNDS = 60


def _shapes(inputs: int, hidden: int, code: int):
    return [(inputs, hidden), (hidden, code), (code, hidden), (hidden, inputs)]


def _unpack(flat, shapes):
    """Weights and biases by layer; leading axes of ``flat`` are kept."""
    layers, at = [], 0
    for rows, cols in shapes:
        weights = flat[..., at : at + rows * cols].reshape(*flat.shape[:-1], rows, cols)
        at += rows * cols
        layers.append((weights, flat[..., at : at + cols]))
        at += cols
    return layers


def _start(shapes, seed: int):
    rng = np.random.default_rng(seed)
    parts = []
    for rows, cols in shapes:
        limit = np.sqrt(6.0 / (rows + cols))
        parts += [rng.uniform(-limit, limit, rows * cols), np.zeros(cols)]
    return np.concatenate(parts)


def _loss_and_gradient(flat, shapes, x):
    """Mean squared error and its gradient, for one network or for each of several."""
    layers = _unpack(flat, shapes)
    outputs = [x]
    for i, (weights, bias) in enumerate(layers):
        z = outputs[-1] @ weights + bias[..., None, :]
        outputs.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    miss = outputs[-1] - x
    delta = 2.0 / x.size * miss
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        into = np.swapaxes(outputs[i], -1, -2) @ delta
        parts += [delta.sum(axis=-2), into.reshape(*flat.shape[:-1], -1)]
        if i:
            delta = (delta @ np.swapaxes(layers[i][0], -1, -2)) * (outputs[i] > 0.0)
    return (miss**2).mean(axis=(-2, -1)), np.concatenate(parts[::-1], axis=-1)


class Autoencoder:
    def __init__(self, columns, hidden, code, flat, losses, converged):
        self.columns = tuple(columns)
        self.hidden, self.code = hidden, code
        self.flat = flat
        self.losses = losses
        self.converged = converged

    def transform(self, df: DataFrame, key: str = "user_id", prefix: str = "ae") -> DataFrame:
        """The code layer as columns; no Python runs per row."""
        layers = _unpack(self.flat, _shapes(len(self.columns), self.hidden, self.code))

        def dense(inputs, layer, names):
            weights, bias = layer
            return {
                name: F.greatest(
                    sum(
                        (F.col(c) * F.lit(float(w)) for c, w in zip(inputs, weights[:, j])),
                        F.lit(float(bias[j])),
                    ),
                    F.lit(0.0),
                )
                for j, name in enumerate(names)
            }

        hidden = [f"_h{i}" for i in range(self.hidden)]
        code = [f"{prefix}{i + 1}" for i in range(self.code)]
        return (
            df.withColumns(dense(self.columns, layers[0], hidden))
            .withColumns(dense(hidden, layers[1], code))
            .select(key, *code)
        )


def gradient_sums(df: DataFrame, columns: Sequence[str], flat: np.ndarray, hidden: int = HIDDEN, code: int = CODE) -> DataFrame:
    """Rows (pos, value): the sum over all rows of the loss (pos -1), the number of
    rows (pos -2) and the sum of the gradient by weight."""
    shapes = _shapes(len(columns), hidden, code)

    def add(batches):
        total, loss_sum, rows = np.zeros(len(flat)), 0.0, 0
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            if len(x):
                loss, gradient = _loss_and_gradient(flat, shapes, x)
                total += gradient * len(x)
                loss_sum += loss * len(x)
                rows += len(x)
        whole = np.concatenate([[rows, loss_sum], total])
        yield pd.DataFrame({"pos": np.arange(-2, len(flat)), "value": whole})

    sums = df.select(*columns).mapInPandas(add, "pos int, value double")
    return sums.groupBy("pos").agg(F.sum("value").alias("value"))


def settled(losses: Sequence[float], tolerance: float, patience: int) -> bool:
    """Whether the best loss fell by less than ``tolerance`` of itself over the last
    ``patience`` rounds."""
    if len(losses) <= patience:
        return False
    before = min(losses[:-patience])
    return before - min(losses) <= tolerance * before


def train_block(x, weights, first, second, steps: int, shapes, rate: float, batches: int, seed) -> tuple:
    """``batches`` Adam steps on batches of ``x`` in seeded order, each row in turn;
    ``steps`` were taken before.  Returns weights and moments, of one network or several."""
    rng = np.random.default_rng(seed)
    order, at = rng.permutation(len(x)), 0
    for step in range(steps + 1, steps + batches + 1):
        if at >= len(x):
            order, at = rng.permutation(len(x)), 0
        _, gradient = _loss_and_gradient(weights, shapes, x[order[at : at + BATCH]])
        at += BATCH
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        weights = weights - scale * first / (np.sqrt(second) + 1e-7)
    return weights, first, second


def _round(number: int, states: np.ndarray, shapes, rate: float, batches: int, seed: int):
    """Over all blocks, times rows: 1, every start's loss before the round, and all
    weights, first and second moments after it."""
    inputs, steps = shapes[0][0], number * batches

    def vectors(found):
        for batch in found:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("x").to_pylist()):
                x = matrix(raw, inputs)
                loss, _ = _loss_and_gradient(states[0], shapes, x)
                after = train_block(x, *states, steps, shapes, rate, batches, [seed, number, block])
                yield np.concatenate([np.ones(1), loss, *map(np.ravel, after)]) * len(x)

    return lambda found: sums_of(vectors(found))


def train_autoencoder(
    df: DataFrame,
    columns: Sequence[str] = FEATURES,
    encoding_dim: int = CODE,
    rounds: int = ROUNDS,
    hidden: int = HIDDEN,
    learning_rate: float = LEARNING_RATE,
    seed: int = 42,
    tolerance: float = TOLERANCE,
    patience: int = PATIENCE,
    key: str = "user_id",
    block_rows: int = BLOCK_ROWS,
    round_batches: int = ROUND_BATCHES,
    starts: int = STARTS,
) -> Autoencoder:
    """Train on scaled columns until the loss has :func:`settled`, for ``rounds`` rounds
    at most, and keep the weights of the best loss.  ``losses`` holds the best start's loss
    over the whole table before each round and after the last, ``converged`` tells
    whether it settled."""
    columns = list(columns)
    shapes = _shapes(len(columns), hidden, encoding_dim)
    states = np.zeros((3, starts, sum(rows * cols + cols for rows, cols in shapes)))
    states[0] = [_start(shapes, seed + i) for i in range(starts)]
    best, losses, converged = states[0, 0], [], False
    blocks = packed_blocks(df, columns, key, block_rows).select("block", "x")
    for number in range(rounds + 1):
        # the last pass only measures
        batches = round_batches if number < rounds else 0
        sums = total_of(blocks.mapInArrow(_round(number, states, shapes, learning_rate, batches, seed), SUMS))
        if not len(sums):
            break
        means = sums[1:] / sums[0]
        losses.append(float(means[:starts].min()))
        if losses[-1] == min(losses):
            best = states[0, means[:starts].argmin()]
        if converged := settled(losses, tolerance, patience):
            break
        states = means[starts:].reshape(states.shape)
    return Autoencoder(columns, hidden, encoding_dim, best, losses, converged)


def autoencode(df: DataFrame, columns: Sequence[str] = FEATURES, key: str = "user_id", **options) -> DataFrame:
    return train_autoencoder(df, columns, key=key, **options).transform(df, key)
