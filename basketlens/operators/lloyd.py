"""K-means for all cluster counts and restarts in shared passes, and by mini-batches.

Rows are packed into blocks dealt by the hash of their key (``packed_blocks``).  One pass
over the blocks advances every model: distances to all centres of all models come from one
matrix product per block, and only sums per centre leave a task.  A model whose centres
have settled drops out of the passes that follow.

Seeding scales with the table: per restart a few passes draw rows in proportion to their
squared distance from those drawn before, by hashes of seed and row place; rows are then
counted by nearest drawn row, and every model's first centres are picked among the drawn,
weighted rows at the driver.

Sums are decimals, so centres do not depend on how the table is partitioned.

Mini-batches are the blocks themselves, as many rows as a batch, in their seeded order;
a centre's rate is one over the rows it has taken so far.  A job takes several batches in
a row, in one task, since each starts from the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.operators.blocks import SUMS, matrix, packed_blocks, squared_distances, sums_of, total_of

# rows of a block in full passes
BLOCK_ROWS = 4096
# passes that draw rows to start from, and how many a pass draws per cluster on average
DRAWS, OVERSAMPLE = 5, 2
# batches that one job takes
BATCHES_PER_JOB = 16
# mini-batches stop when the smoothed cost per row has not fallen for so many
PATIENCE = 10


@dataclass(frozen=True)
class KMeansModel:
    columns: tuple[str, ...]
    centres: np.ndarray
    cost: float  # squared error over all rows
    steps: int

    def label(self) -> Column:
        """The nearest centre's number, the first of equally near ones."""
        away = F.array(
            *[
                sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(self.columns, centre)), F.lit(0.0))
                for centre in self.centres
            ]
        )
        return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def _nearest(x: np.ndarray, models: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per model the number of the nearest centre and the squared distance, by row."""
    every = squared_distances(x, np.concatenate(models))
    at = 0
    rows = np.arange(len(x))
    for centres in models:
        own = every[:, at : at + len(centres)]
        at += len(centres)
        place = own.argmin(axis=1)
        yield place, own[rows, place]


def _per_centre(x: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows and column sums by centre, flat."""
    columns = [np.bincount(place, minlength=k)] + [np.bincount(place, x[:, i], k) for i in range(x.shape[1])]
    return np.stack(columns, axis=1).ravel()


def lloyd_step(blocks: DataFrame, columns: int, models: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For every model the cost of its centres over all rows, the rows of each centre, and
    the centres after a step; a centre without rows stays."""

    def vectors(batches):
        for batch in batches:
            for raw in batch.column("x"):
                x = matrix(raw.as_py(), columns)
                found = _nearest(x, models)
                parts = [(np.array([away.sum()]), _per_centre(x, place, len(m))) for m, (place, away) in zip(models, found)]
                yield np.concatenate([v for pair in parts for v in pair])

    total = total_of(blocks.select("x").mapInArrow(lambda b: sums_of(vectors(b)), SUMS))
    out, at = [], 0
    for centres in models:
        if not len(total):
            out.append((0.0, np.zeros(len(centres)), centres))
            continue
        cost, sums = total[at], total[at + 1 : at + 1 + centres.size + len(centres)].reshape(len(centres), -1)
        at += 1 + sums.size
        n = sums[:, :1]
        out.append((float(cost), sums[:, 0], np.where(n > 0, sums[:, 1:] / np.maximum(n, 1), centres)))
    return out


# -- seeding -----------------------------------------------------------------------


def _drawn(blocks: DataFrame, columns: int, centres: Sequence[np.ndarray], costs: Sequence[float], draw: int, seed: int, number: int):
    """Rows drawn for every restart in proportion to their squared distance."""

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("x")):
                x = matrix(raw.as_py(), columns)
                chance = np.random.default_rng([seed, number, block]).random((len(centres), len(x)))
                for i, (_, away) in enumerate(_nearest(x, centres)):
                    taken = x[chance[i] * costs[i] < draw * away]
                    if len(taken):
                        yield pa.record_batch(
                            [pa.array(np.full(len(taken), i, np.int32)), pa.array(taken.tolist(), pa.list_(pa.float64()))], ["start", "row"]
                        )

    # ``draw`` rows per restart and pass on average
    return blocks.select("block", "x").mapInArrow(run, "start int, row array<double>").collect()


def _spread(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted points, each drawn by weight times squared distance from
    those before it, the best of a few tries."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    away = squared_distances(points, np.array(chosen))[:, 0]
    while len(chosen) < k:
        mass = weights * away
        if mass.sum() <= 0:
            chosen.append(points[rng.integers(len(points))])
            continue
        tries = rng.choice(len(points), size=2 + int(np.log(k)), p=mass / mass.sum())
        after = np.minimum(away[:, None], squared_distances(points, points[tries]))
        best = (weights[:, None] * after).sum(axis=0).argmin()
        chosen.append(points[tries[best]])
        away = after[:, best]
    return np.array(chosen)


def first_centres(blocks: DataFrame, columns: int, ks: Sequence[int], restarts: int, seed: int) -> list[list[np.ndarray]]:
    """Per restart the first centres of a model of each size."""
    draw = OVERSAMPLE * max(ks)
    row = blocks.orderBy("block").select("x").first()
    if row is None:
        return [[np.zeros((k, columns)) for k in ks] for _ in range(restarts)]
    block = matrix(bytes(row.x), columns)
    held = [block[np.random.default_rng([seed, i]).integers(len(block))][None] for i in range(restarts)]
    for number in range(DRAWS):
        costs = [max(cost, 1e-300) for cost, _, _ in lloyd_step(blocks, columns, held)]
        found = _drawn(blocks, columns, held, costs, draw, seed, number)
        for i in range(restarts):
            more = sorted(tuple(r.row) for r in found if r.start == i)
            held[i] = np.unique(np.concatenate([held[i], np.array(more).reshape(-1, columns)]), axis=0)
    weights = [n for _, n, _ in lloyd_step(blocks, columns, held)]
    return [
        [_spread(points, np.maximum(w, 1e-9), k, np.random.default_rng([seed, i, k])) for k in ks]
        for i, (points, w) in enumerate(zip(held, weights))
    ]


# -- fits --------------------------------------------------------------------------


def kmeans(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int],
    restarts: int = 1,
    seed: int = 42,
    iterations: int = 300,
    tolerance: float = 1e-3,
    key: str = "user_id",
    block_rows: int = BLOCK_ROWS,
) -> dict[int, KMeansModel]:
    """The lowest-cost model of each size over ``restarts``; a model settles when no
    centre moves by more than ``tolerance``."""
    columns = list(columns)
    blocks = packed_blocks(df, columns, key, block_rows)
    starts = first_centres(blocks, len(columns), ks, restarts, seed)
    moving = {(k, i): starts[i][j] for j, k in enumerate(ks) for i in range(restarts)}
    settled: dict[tuple[int, int], KMeansModel] = {}
    for step in range(1, iterations + 1):
        found = lloyd_step(blocks, len(columns), list(moving.values()))
        following = {}
        for (name, centres), (cost, _, after) in zip(moving.items(), found):
            if step == iterations or ((after - centres) ** 2).sum(axis=1).max() <= tolerance**2:
                settled[name] = KMeansModel(tuple(columns), centres, cost, step)
            else:
                following[name] = after
        moving = following
        if not moving:
            break
    return {k: min((settled[k, i] for i in range(restarts)), key=lambda m: m.cost) for k in ks}


def take_in(centres: np.ndarray, taken: np.ndarray, rows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres as means of all rows they ever took, and how many: ``taken`` before, and
    now ``rows`` with these column sums."""
    after = taken + rows
    moved = (centres * taken[:, None] + sums) / np.maximum(after, 1)[:, None]
    return np.where(rows[:, None] > 0, moved, centres), after


def batch_step(x: np.ndarray, centres: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres after a batch, the rows that each has taken so far, and the batch's cost
    before it."""
    ((place, away),) = _nearest(x, [centres])
    sums = _per_centre(x, place, len(centres)).reshape(len(centres), -1)
    return *take_in(centres, taken, sums[:, 0], sums[:, 1:]), float(away.sum())


def _batches(columns: int, models: Sequence[tuple[np.ndarray, np.ndarray]], order: Sequence[int]):
    """The models after the blocks of ``order``, one after the other."""
    shape = ["model", "centres", "taken", "costs"]

    def run(table: pa.Table) -> pa.Table:
        blocks = {b: matrix(x, columns) for b, x in zip(table.column("block").to_pylist(), table.column("x").to_pylist())}
        out = []
        for i, (centres, taken) in enumerate(models):
            costs = []
            for block in order:
                x = blocks[block]
                centres, taken, cost = batch_step(x, centres, taken)
                costs.append(cost / len(x))
            out.append((i, centres.ravel().tolist(), taken.tolist(), costs))
        return pa.table([pa.array(v) for v in zip(*out)], shape)

    return run


def minibatch_kmeans(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int],
    batch_rows: int = 3000,
    seed: int = 42,
    passes: int = 100,
    patience: int = PATIENCE,
    key: str = "user_id",
) -> dict[int, KMeansModel]:
    """One model of each size from batches of about ``batch_rows`` rows, in a seeded order
    anew in every pass over the table, until no model's smoothed cost per row has fallen
    for ``patience`` batches or the table has been passed ``passes`` times."""
    columns = list(columns)
    d = len(columns)
    blocks = packed_blocks(df, columns, key, batch_rows)
    (starts,) = first_centres(blocks, d, ks, 1, seed)
    models = [(c, np.zeros(len(c))) for c in starts]
    count = blocks.count()
    smooth = [None] * len(models)
    best, waited, steps = [np.inf] * len(models), [0] * len(models), 0
    rng, order = np.random.default_rng(seed), []
    share = min(1.0, 2.0 / (count + 1)) if count else 1.0
    while count and steps < passes * count and min(waited) < patience:
        while len(order) < BATCHES_PER_JOB:
            order += rng.permutation(count).tolist()
        now, order = order[:BATCHES_PER_JOB], order[BATCHES_PER_JOB:]
        # at most BATCHES_PER_JOB blocks
        chosen = blocks.where(F.col("block").isin(sorted(set(now)))).select("block", "x")
        found = (
            chosen.groupBy(F.lit(0).alias("all"))
            .applyInArrow(_batches(d, models, now), "model long, centres array<double>, taken array<double>, costs array<double>")
            .collect()
        )
        steps += len(now)
        for r in found:
            models[r.model] = (np.array(r.centres).reshape(-1, d), np.array(r.taken))
            for cost in r.costs:
                old = smooth[r.model]
                smooth[r.model] = cost if old is None else old + share * (cost - old)
                if smooth[r.model] < best[r.model]:
                    best[r.model], waited[r.model] = smooth[r.model], 0
                else:
                    waited[r.model] += 1
    costs = lloyd_step(blocks, d, [c for c, _ in models])
    return {k: KMeansModel(tuple(columns), c, cost, steps) for k, (c, _), (cost, _, _) in zip(ks, models, costs)}
