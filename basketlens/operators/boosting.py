"""Second-order boosted trees for a binary label, grown by Spark aggregations.

Features are cut once into bins at weighted quantiles, from a mergeable sketch, and rows
packed into blocks of bins, labels, weights and margins.  A tree grows level by level:
tasks add up gradients and Hessians of the log loss by (node, feature, bin) over their
blocks, one ``groupBy`` adds up the tasks', and these sums, nodes times features times
bins at most, reach the driver, where each node's split of the highest regularised gain
is chosen.  A row finds its node by comparing its bins; margins are written again every
``WRITE_EVERY`` trees.  Scoring is a column expression.

Gradients are added up as whole numbers in a unit that follows from the total weight, so
sums do not depend on the order of rows, and no sum can overflow.

Cases: missing or NaN values go to the side that gains more (left if none was seen);
rows with a missing label or weight are left out of the training; an empty table gives no
trees, and every score is the base score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.session import discard, durable

# points of a quantile summary; the ranks of its values are off by 3 / POINTS at most
POINTS = 2048
# summaries are merged in this many groups first
LANES = 64
BINS = 256
# a split must gain more than this
LEAST_GAIN = 1e-6
# rows of a packed block; trees between two writings of the margins
BLOCK_ROWS = 8192
WRITE_EVERY = 3


# -- bins --------------------------------------------------------------------------


def _pruned(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with their weights, at most ``points`` of them; a dropped
    value's weight goes to the next one kept."""
    distinct, place = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(place, weights, len(distinct)))
    if len(distinct) > points:
        kept = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, points + 1) / points * (1 - 1e-12)))
        kept = np.union1d(np.minimum(kept, len(distinct) - 1), [len(distinct) - 1])
        distinct, upto = distinct[kept], upto[kept]
    return distinct, np.diff(upto, prepend=0.0)


def weighted_sketch(df: DataFrame, columns: Sequence[str], weight: str, points: int = POINTS) -> DataFrame:
    """(feature, points, weights): per column a summary of its weighted distribution,
    exact while a column has at most ``points`` distinct values.

    Tasks summarise their rows, groups of tasks and then all are merged, so nobody
    holds more than a group's summaries."""
    columns = list(columns)
    shape = "feature int, lane int, points array<double>, weights array<double>"

    def row(feature: int, lane: int, values, weights) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([feature], pa.int32()), pa.array([lane], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([weights], pa.list_(pa.float64()))],
            ["feature", "lane", "points", "weights"],
        )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0)) for _ in columns]
        for batch in batches:
            w = batch.column("_weight").to_numpy(zero_copy_only=False)
            for i in range(len(columns)):
                x = batch.column(f"_x{i}").to_numpy(zero_copy_only=False)
                known = ~np.isnan(x)
                held[i] = _pruned(np.concatenate([held[i][0], x[known]]), np.concatenate([held[i][1], w[known]]), 8 * points)
        lane = TaskContext.get().partitionId() % LANES
        for i, (values, weights) in enumerate(held):
            if len(values):
                yield row(i, lane, *_pruned(values, weights, points))

    def merge(table: pa.Table) -> pa.Table:
        both = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("points", "weights"))
        return pa.Table.from_batches([row(table.column("feature")[0].as_py(), table.column("lane")[0].as_py(), *_pruned(*both, points))])

    named = df.select(
        F.col(weight).cast("double").alias("_weight"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    )
    parts = named.where("_weight > 0").mapInArrow(summarise, shape)
    lanes = parts.groupBy("feature", "lane").applyInArrow(merge, shape)
    return lanes.groupBy("feature").applyInArrow(merge, shape).drop("lane")


def cut_points(sketch: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """For every feature ascending cuts: the weighted quantiles above its least value.

    A value's bin is the number of cuts not above it; every feature has at least one
    cut."""
    cuts = [[0.0] for _ in range(features)]
    for r in sketch.collect():  # a summary per feature
        values, upto = np.array(r.points), np.cumsum(r.weights)
        ranks = upto[-1] * (np.arange(1, bins) / bins - 1e-9)
        chosen = np.unique(values[np.searchsorted(upto, ranks)])
        cuts[r.feature] = chosen[chosen > values[0]].tolist() or [float(values[0])]
    return cuts


def binned(df: DataFrame, columns: Sequence[str], cuts: list[list[float]], out: str = "bins") -> DataFrame:
    """``df`` with an array of bins by feature, -1 for a missing value."""
    marked = [f"_bin{i}" for i in range(len(cuts))]
    edges = [[-float("inf"), *c, float("inf")] for c in cuts]
    as_doubles = df.withColumns({f"_in{i}": F.nanvl(F.col(c).cast("double"), F.lit(None)) for i, c in enumerate(columns)})
    bucketizer = Bucketizer(
        splitsArray=edges, inputCols=[f"_in{i}" for i in range(len(cuts))], outputCols=marked, handleInvalid="keep"
    )
    places = [F.when(F.col(m) <= len(c), F.col(m).cast("int")).otherwise(-1) for m, c in zip(marked, cuts)]
    return bucketizer.transform(as_doubles).select(*df.columns, F.array(*places).alias(out))


# -- trees -------------------------------------------------------------------------


@dataclass
class Tree:
    """Splits by node (the root is 1, a node's children are 2n and 2n + 1) and the
    values of the nodes that are not split."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins reaches."""
        node = np.ones(len(bins), np.int64)
        size = 2 * max(self.splits, default=0) + 2
        feature, last, first = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        inner = np.zeros(size, bool)
        for n, (f, b, missing_left) in self.splits.items():
            inner[n], feature[n], last[n], first[n] = True, f, b, -1 if missing_left else 0
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[inner[node[rows]]]
            at = node[rows]
            x = bins[rows, feature[at]]
            node[rows] = 2 * at + ((x > last[at]) | (x < first[at]))
        return node

    def added(self, bins: np.ndarray) -> np.ndarray:
        """The value of the node that each row of bins reaches."""
        values = np.zeros(2 * max(self.splits, default=0) + 2)
        for n, v in self.values.items():
            values[n] = v
        return values[self.nodes(bins)]

    def expression(self, goes_left, end, node: int = 1) -> str:
        """Nested SQL: ``goes_left(split)`` is a condition, ``end(node)`` an outcome."""
        split = self.splits.get(node)
        if split is None:
            return end(node)
        left, right = (self.expression(goes_left, end, child) for child in (2 * node, 2 * node + 1))
        return f"IF({goes_left(split)}, {left}, {right})"


# -- a level -----------------------------------------------------------------------

_BLOCKS = "bins binary, y binary, w binary, margin binary"


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table of blocks from rows (bins, y, w, margin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.slice(at, block_rows)
                bins = part.column("bins").flatten().to_numpy().astype(np.int16)
                numbers = (part.column(c).to_numpy().astype(np.float64) for c in ("y", "w", "margin"))
                yield pa.record_batch(
                    [pa.array([x.tobytes()], pa.binary()) for x in (bins, *numbers)], ["bins", "y", "w", "margin"]
                )

    return durable(rows.select("bins", "y", "w", "margin").mapInArrow(run, _BLOCKS))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for bins, *numbers in zip(*(batch.column(c) for c in ("bins", "y", "w", "margin"))):
            y, w, margin = (np.frombuffer(x.as_py(), np.float64) for x in numbers)
            yield np.frombuffer(bins.as_py(), np.int16).reshape(len(y), -1), y, w, margin


def unit_of(total: float) -> float:
    """A unit in which no sum over rows of this total weight overflows."""
    return max(total / 2.0**61, 2.0**-50)


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss, in whole units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return tuple(np.rint(x / unit).astype(np.int64) for x in (w * (p - y), w * p * (1.0 - p)))


def _exact(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole sums per cell; halves of a number are small enough for floating point."""
    high = np.bincount(cells, values >> 30, size).astype(np.int64)
    return (high << 30) + np.bincount(cells, values & ((1 << 30) - 1), size).astype(np.int64)


def histogram(blocks: DataFrame, tree: Tree, level: Sequence[int], unit: float, new: Sequence[Tree] = ()) -> DataFrame:
    """(node, feature, bin, g, h) sums over the rows that reach the nodes of ``level``.

    ``new`` are trees that the blocks' margins do not hold yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(2 * max(level) + 2, -1)
        place[list(level)] = np.arange(len(level))
        width, sums = 0, None
        for bins, y, w, margin in _unpacked(batches):
            at = place[np.minimum(tree.nodes(bins), len(place) - 1)]
            here = np.flatnonzero(at >= 0)
            margin = margin + sum(t.added(bins) for t in new)
            g, h = (x[here] for x in gradients(margin, y, w, unit))
            if bins.max(initial=0) + 2 > width or sums is None:
                # bins seen so far set the width of a feature
                wider = int(bins.max(initial=0)) + 2
                grown = np.zeros((3, len(level), bins.shape[1], wider), np.int64)
                if sums is not None:
                    grown[..., :width] = sums
                width, sums = wider, grown
            features = bins.shape[1]
            cells = ((at[here, None] * features + np.arange(features)) * width + bins[here] + 1).ravel()
            size = sums[0].size
            sums += np.stack(
                [_exact(cells, np.repeat(x, features), size) for x in (g, h)] + [np.bincount(cells, minlength=size)]
            ).reshape(sums.shape)
        if sums is not None:
            node, feature, bin_ = np.nonzero(sums[2])
            yield pa.record_batch(
                [
                    pa.array(np.asarray(level, np.int64)[node]), pa.array(feature.astype(np.int32)), pa.array((bin_ - 1).astype(np.int32)),
                    pa.array(sums[0][node, feature, bin_]), pa.array(sums[1][node, feature, bin_]),
                ],
                ["node", "feature", "bin", "g", "h"],
            )

    parts = blocks.mapInArrow(run, "node long, feature int, bin int, g long, h long")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def moved(blocks: DataFrame, new: Sequence[Tree]) -> DataFrame:
    """A written table of the blocks with the new trees in their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [(m + sum(t.added(b) for t in new)).tobytes() for b, _, _, m in _unpacked([batch])]
            yield pa.record_batch(
                [*[batch.column(c) for c in ("bins", "y", "w")], pa.array(margins, pa.binary())], ["bins", "y", "w", "margin"]
            )

    return durable(blocks.mapInArrow(run, _BLOCKS))


@dataclass(frozen=True)
class Split:
    """Bins up to ``bin`` of ``feature`` go left; ``g`` and ``h`` are a side's sums."""

    node: int
    feature: int
    bin: int
    missing_left: bool
    gain: float
    g_left: float
    h_left: float
    g_right: float
    h_right: float


def best_splits(
    sums: pa.Table, unit: float = 1.0, penalty: float = 1.0, gamma: float = 0.0, min_child: float = 1.0
) -> list[Split]:
    """For every node that can be split with a gain its best split, from the level's
    :func:`histogram`, whose size nodes, features and bins bound.

    ``unit`` is what one unit of the sums is worth.  Ties go to the first feature, then
    the lowest bin, then to missing values on the left."""
    node, feature, bin_, g, h = (sums.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h"))
    if not len(node):
        return []
    nodes, row = np.unique(node, return_inverse=True)
    shape = (len(nodes), feature.max() + 1, bin_.max() + 2)
    there = np.zeros(shape, bool)
    there[row, feature, bin_ + 1] = True
    upto, missing, whole = [], [], []
    for values in (g, h):
        cells = np.zeros(shape, values.dtype)
        cells[row, feature, bin_ + 1] = values
        left = np.cumsum(cells, axis=2)
        upto.append(left[..., 1:])
        missing.append(cells[..., :1])
        whole.append(left[..., -1:] * unit)
    # the last axis: missing values on the left, on the right
    g_left, h_left = (np.stack([u * unit, (u - m) * unit], axis=-1) for u, m in zip(upto, missing))
    g_all, h_all = (w[..., None] for w in whole)
    g_right, h_right = g_all - g_left, h_all - h_left

    def worth(g, h):
        return g * g / np.maximum(h + penalty, 1e-300)

    gain = worth(g_left, h_left) + worth(g_right, h_right) - worth(g_all, h_all)
    allowed = (h_left >= min_child) & (h_right >= min_child) & there[..., 1:, None] & (gain > max(gamma, LEAST_GAIN))
    allowed[..., 1] &= missing[1] != 0
    ranked = np.where(allowed, np.round(gain, 9), -np.inf).reshape(len(nodes), -1)
    out = []
    for i, at in enumerate(ranked.argmax(axis=1)):
        if ranked[i, at] > -np.inf:
            place = np.unravel_index(at, gain.shape[1:])
            numbers = [float(x[(i, *place)]) for x in (gain, g_left, h_left, g_right, h_right)]
            out.append(Split(int(nodes[i]), int(place[0]), int(place[1]), bool(place[2] == 0), *numbers))
    return out


@dataclass
class BoostedTrees:
    columns: tuple[str, ...]
    cuts: list[list[float]]
    trees: list[Tree]
    base: float

    def margin(self) -> Column:
        """The sum of the trees' values over the feature columns."""

        def by_value(split: tuple[int, int, bool]) -> str:
            feature, bin_, missing_left = split
            name = self.columns[feature].replace("`", "``")
            value = f"nanvl(CAST(`{name}` AS DOUBLE), NULL)"
            above = self.cuts[feature][bin_] if bin_ < len(self.cuts[feature]) else float("inf")
            shown = "DOUBLE('Infinity')" if above == float("inf") else f"{above!r}D"
            return f"coalesce({value} < {shown}, {str(missing_left).lower()})"

        parts = [F.expr(t.expression(by_value, lambda n, t=t: f"{t.values[n]!r}D")) for t in self.trees]
        # added up in pairs: a deep chain of sums would exhaust the optimizer's stack
        parts = [F.lit(self.base), *parts]
        while len(parts) > 1:
            parts = [sum(parts[i + 1 : i + 2], parts[i]) for i in range(0, len(parts), 2)]
        return parts[0]

    def transform(self, df: DataFrame, prediction: str = "prediction", score: str = "score") -> DataFrame:
        """Class (0 or 1) and probability of class 1 beside the given columns."""
        scored = df.withColumn(score, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin())))
        return scored.select(*df.columns, (F.col(score) > 0.5).cast("int").alias(prediction), score)


def fit(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    weight: str,
    trees: int = 100,
    depth: int = 6,
    step: float = 0.3,
    penalty: float = 1.0,
    gamma: float = 0.0,
    min_child: float = 1.0,
    bins: int = BINS,
    base: float = 0.0,
) -> BoostedTrees:
    """Boosted trees; ``base`` is the margin before the first one."""
    columns = list(columns)
    known = df.select(*columns, F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    known = durable(known.where("y IS NOT NULL AND w > 0"))
    cuts = cut_points(weighted_sketch(known, columns, "w"), len(columns), bins)
    total = known.agg(F.sum("w")).first()[0]
    model = BoostedTrees(tuple(columns), cuts, [], base)
    if not total:
        return model
    unit = unit_of(total)
    blocks = packed(binned(known, columns, cuts).withColumn("margin", F.lit(base)))
    new: list[Tree] = []
    for _ in range(trees):
        tree, level = Tree(), [1]
        for _ in range(depth):
            sums = histogram(blocks, tree, level, unit, new)
            found = best_splits(sums.toArrow(), unit, penalty, gamma, min_child)
            if not found:
                break
            for s in found:
                tree.splits[s.node] = (s.feature, s.bin, s.missing_left)
                for child, side_g, side_h in ((2 * s.node, s.g_left, s.h_left), (2 * s.node + 1, s.g_right, s.h_right)):
                    tree.values[child] = -step * side_g / (side_h + penalty)
            level = [child for s in found for child in (2 * s.node, 2 * s.node + 1)]
        if not tree.splits:
            break  # the next tree would be the same
        model.trees.append(tree)
        new.append(tree)
        if len(new) == WRITE_EVERY:
            before, blocks, new = blocks, moved(blocks, new), []
            discard(before)
    return model
