"""Exact nearest neighbours, and a non-linear embedding from their fuzzy graph.

Space is cut into cells along a sample, and cells side by side make up blocks of bounded
size.  A row's neighbours in its own block bound how far the others can be; only cells
whose box is at most that bound away can hold one.  The row asks the blocks of those
cells and keeps the nearest of all answers.  Only the sample and the cells' boxes, some
``MAX_CELLS`` of them, visit the driver.

The embedding's coordinates are the leading eigenvectors of the normalised graph,
found in a block Krylov space whose vectors are a table of packed blocks: multiplying by
the graph is one exchange of sums between blocks, and only products of vectors (a few
dozen numbers squared per block) visit the driver.  It ends when the residual is small, not after a number of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from basketlens.operators.blocks import block_of, blocks_for, every_block
from basketlens.operators.sampling import SEED
from basketlens.session import discard, durable

# Neighbours per row and dimensions of the embedding.
NEIGHBOURS = 15
DIMENSIONS = 3

# Cells grow with the rows up to about this many; beyond, they hold more.
MAX_CELLS = 4096
_ROWS_OF_ONE_CELL = 1024
# rows per cell of the sample that says where to cut
_CELL_SAMPLE = 64
# rows of a block, and rows that ask it in one task
_LEAST_BLOCK, _LARGEST_BLOCK = 2048, 32768
_ASKING_ROWS = 16384
# rows of a leaf, and asking rows whose distances are held at a time
_LEAF_ROWS = 128

_NEAR = "`{key}` long, neighbour long, distance double, weight double"

RESIDUAL = 1e-3
# Rows of a block of the graph's vectors.
GRAPH_ROWS = 8192
# Vectors are combined and the space starts anew from the best ones.
KRYLOV_BLOCKS = 20
MAX_ROUNDS = 400


def _edge_weights(distances, k):
    """exp(-(d - rho) / sigma): rho is the first positive distance, sigma makes a
    row's weights add up to log2(k)."""
    positive = np.where(distances > 0.0, distances, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)[:, None]
    beyond = np.maximum(distances - rho, 0.0)
    target = np.log2(k)
    low, high = np.zeros(len(beyond)), np.full(len(beyond), np.inf)
    sigma = np.ones(len(beyond))
    for _ in range(64):
        total = np.exp(-beyond / sigma[:, None]).sum(axis=1)
        over = total > target
        high = np.where(over, sigma, high)
        low = np.where(over, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2.0, sigma * 2.0)
        sigma = np.clip(sigma, 1e-9, 1e9)
    floor = 1e-3 * np.maximum(distances.mean(axis=1), 1e-12)
    return np.exp(-beyond / np.maximum(sigma, floor)[:, None])


def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """An axis and a value near its middle that part the rows, none if all are equal;
    equal rows stay together."""
    for axis in np.argsort(-x.std(axis=0), kind="stable"):
        values = np.sort(x[:, axis])
        if values[0] < values[-1]:
            middle = values[len(values) // 2]
            return int(axis), float(values[np.searchsorted(values, middle, "right")] if middle == values[0] else middle)
    return None


def _cut_up(x: np.ndarray, size: float) -> tuple[list[tuple[int, float]], list[list[int]], list[np.ndarray]]:
    """Rows cut in two again and again until at most ``size`` are left or all are equal:
    the cuts, where both sides of each lead to (a cut, or -1 - leaf), and the leaves' rows,
    neighbours side by side."""
    cuts, branches, leaves = [], [], []
    waiting = [(np.arange(len(x)), None, 0)]
    while waiting:
        rows, above, side = waiting.pop()
        cut = _cut(x[rows]) if len(rows) > size else None
        if above is not None:
            branches[above][side] = -1 - len(leaves) if cut is None else len(cuts)
        if cut is None:
            leaves.append(rows)
            continue
        beyond = x[rows, cut[0]] >= cut[1]
        waiting += [(rows[beyond], len(cuts), 1), (rows[~beyond], len(cuts), 0)]
        cuts.append(cut)
        branches.append([0, 0])
    return cuts, branches, leaves


def _chunks(x: np.ndarray) -> list[np.ndarray]:
    """The rows in small parts that lie close together."""
    leaves = _cut_up(x, _LEAF_ROWS)[2]
    return [leaf[at : at + _LEAF_ROWS] for leaf in leaves for at in range(0, len(leaf), _LEAF_ROWS)]


def _gaps(low, high, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances between boxes; a row is a box of its own."""
    total = 0.0
    for axis in range(other_low.shape[1]):
        a, b = low[..., axis, None], high[..., axis, None]
        gap = np.maximum(other_low[:, axis] - b, a - other_high[:, axis])
        total = total + np.maximum(gap, 0.0) ** 2
    return total


def _reach(bound: np.ndarray) -> np.ndarray:
    """The squared bounds, a little more for rounding."""
    return (bound * (1 + 1e-9) + 1e-9) ** 2


@dataclass(frozen=True)
class _Ground:
    """The parted space: cuts that lead to cells, the boxes of the cells' rows, regions of
    cells side by side, and the blocks of each region (all numbered from its first)."""

    axis: np.ndarray
    value: np.ndarray
    branches: np.ndarray
    low: np.ndarray
    high: np.ndarray
    region: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def asked(self, x: np.ndarray, bound: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the blocks, without their ``own`` one, that may hold a row within their bound."""
        found, reach = [np.empty(0, np.int64)], _reach(bound)
        for part in _chunks(x):
            y = x[part]
            close = np.flatnonzero(_gaps(y.min(axis=0), y.max(axis=0), self.low, self.high) <= reach[part].max())
            row, cell = np.nonzero(_gaps(y, y, self.low[close], self.high[close]) <= reach[part][:, None])
            found.append(np.unique(part[row] * len(self.first) + self.region[close[cell]]))
        row, region = np.divmod(np.sort(np.concatenate(found)), len(self.first))
        many = self.blocks[region]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, block = np.repeat(row, many), np.repeat(self.first[region], many) + place
        return row[block != own], block[block != own]


def _cells_of(x: np.ndarray, axis: np.ndarray, value: np.ndarray, branches: np.ndarray) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError("rows without a number in every column have no neighbours")
    if not len(axis):
        return np.zeros(len(x), int)
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while len(rows):
        node = at[rows]
        at[rows] = branches[node, (x[rows, axis[node]] >= value[node]).astype(int)]
        rows = rows[at[rows] >= 0]
    return -1 - at


def _matrix_of(table: pa.Table | pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(c)) for c in columns])


def _numbers(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])


def _part_space(data: DataFrame, rows: int, columns: list[str], key: str, cells: int | None, block_rows: int | None, seed: int) -> _Ground:
    """The space cut along a sample, so that cells and regions hold about as many rows each.

    The sample only says where to cut; boxes are those of all rows."""
    cells = cells or max(1, min(MAX_CELLS, rows // _ROWS_OF_ONE_CELL))
    block_rows = block_rows or min(max(rows // 32, _LEAST_BLOCK), _LARGEST_BLOCK)
    share = min(1.0, cells * _CELL_SAMPLE / rows)
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = _matrix_of(data.where(drawn).select(*columns).toArrow(), columns)
    cuts, branches, leaves = _cut_up(sample[~np.isnan(sample).any(axis=1)], max(1.0, share * rows / cells))
    axis, value = np.array([a for a, _ in cuts], int), np.array([v for _, v in cuts])
    branches = np.array(branches, int).reshape(-1, 2)

    def run(batches):
        for batch in batches:
            x = _matrix_of(batch, columns)
            found, place, held = np.unique(_cells_of(x, axis, value, branches), return_inverse=True, return_counts=True)
            order = np.argsort(place, kind="stable")
            starts = np.cumsum(held) - held
            ends = [f.reduceat(x[order], starts, axis=0) if len(x) else x for f in (np.minimum, np.maximum)]
            yield pa.record_batch([pa.array(v) for v in (found, held, *ends[0].T, *ends[1].T)], names)

    low, high = [f"low{i}" for i in range(len(columns))], [f"high{i}" for i in range(len(columns))]
    names = ["cell", "held", *low, *high]
    shape = "cell long, held long, " + ", ".join(f"{c} double" for c in [*low, *high])
    # a row per cell
    known = (
        data.select(*columns).mapInArrow(run, shape).groupBy("cell")
        .agg(F.sum("held").alias("held"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])
        .toPandas()
    )
    held = np.zeros(len(leaves), np.int64)
    lows, highs = np.full((len(leaves), len(columns)), np.inf), np.full((len(leaves), len(columns)), -np.inf)
    held[known["cell"]], lows[known["cell"]], highs[known["cell"]] = known["held"], known[low], known[high]
    region, filled = np.zeros(len(leaves), int), 0
    for cell, n in enumerate(held):
        fresh = cell > 0 and filled + n > block_rows
        region[cell] = region[cell - 1] + fresh if cell else 0
        filled = n if fresh else filled + n
    blocks = np.maximum(1, -(-np.bincount(region, held).astype(np.int64) // (2 * block_rows)))
    return _Ground(axis, value, branches, lows, highs, region, np.cumsum(blocks) - blocks, blocks)


def _housed(df: DataFrame, ground: _Ground, columns: list[str], key: str) -> DataFrame:
    """The rows with the block of their part of the space."""

    def run(batches):
        for batch in batches:
            x = _matrix_of(batch, columns)
            region = ground.region[_cells_of(x, ground.axis, ground.value, ground.branches)]
            places = [pa.array(v[region].astype(np.int32)) for v in (ground.first, ground.blocks)]
            yield pa.record_batch([*batch.columns, *places], [key, *columns, "first", "blocks"])

    numbers = ", ".join(f"`{c}` double" for c in columns)
    placed = df.mapInArrow(run, f"`{key}` long, {numbers}, first int, blocks int")
    return placed.select(key, *columns, (F.col("first") + block_of(F.col(key), F.col("blocks"))).alias("block"))


def parted(data: DataFrame, columns: list[str], key: str, block_rows: int, seed: int) -> DataFrame:
    """The rows (key, columns, block) in blocks of about ``block_rows`` that lie close together."""
    rows = data.count()
    cells = max(1, min(MAX_CELLS, 4 * rows // block_rows))
    return _housed(_numbers(data, columns, key), _part_space(data, rows, columns, key, cells, block_rows, seed), columns, key)


def _nearest_of(
    asking: pd.DataFrame, known: pd.DataFrame, columns: list[str], key: str, k: int, others: bool
) -> pd.DataFrame:
    """Of each asking row the k nearest known ones, if ``others`` without the row of its
    own key, as far as its bound allows; ties by key.  The index is the asking row's place.

    Known rows lie in leaves, and only leaves near enough are compared.  A matrix product
    tells which pairs may be near enough, up to its rounding; only their distances are
    taken axis by axis."""
    none = pd.DataFrame({key: np.empty(0, np.int64), "neighbour": np.empty(0, np.int64), "distance": np.empty(0)}, index=np.empty(0, np.int64))
    if asking.empty or known.empty:
        return none
    names, spots = known[key].to_numpy(), known[columns].to_numpy(dtype=float)
    # of equal rows the first k by key are enough, and one more where the asking row is among them
    order = np.lexsort([names, *spots.T])
    names, spots = names[order], spots[order]
    fresh = np.append(True, (spots[1:] != spots[:-1]).any(axis=1))
    kept = np.arange(len(spots)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] <= k
    names, spots = names[kept], spots[kept]
    leaves = _cut_up(spots, _LEAF_ROWS)[2]
    sizes = np.array([len(leaf) for leaf in leaves])
    order, starts = np.concatenate(leaves), np.cumsum(sizes) - sizes
    names, spots = names[order], spots[order]
    low, high = np.minimum.reduceat(spots, starts, axis=0), np.maximum.reduceat(spots, starts, axis=0)
    middle = spots.mean(axis=0)
    centred = spots - middle
    norms = (centred * centred).sum(axis=1)
    right = np.column_stack([-2.0 * centred, np.ones(len(spots)), norms])
    reach, far = norms.max(), np.abs(spots).max()
    least = k if others else k - 1
    every, all_mine, bounds = asking[columns].to_numpy(dtype=float), asking[key].to_numpy(), asking["bound"].to_numpy()
    parts = [none]
    for chunk in _chunks(every):
        x, mine = every[chunk], all_mine[chunk]
        left = x - middle
        size = (left * left).sum(axis=1)
        slack = 1e-13 * (np.sqrt(size + reach) + np.maximum(np.abs(x).max(axis=1), far)) ** 2
        left = np.column_stack([left, size, np.ones(len(x))])
        # no row beyond the bound is among the nearest of all
        limit = _reach(bounds[chunk])
        most = limit + slack
        gaps = _gaps(x.min(axis=0), x.max(axis=0), low, high)
        if not np.isfinite(most).all():
            # the nearest leaves tell how far the nearest rows are at most
            order = np.argsort(gaps, kind="stable")
            few = np.zeros(len(gaps), bool)
            few[order[: np.searchsorted(np.cumsum(sizes[order]), 4 * (least + 1)) + 1]] = True
            apart = left @ right[np.repeat(few, sizes)].T
            if least < apart.shape[1]:
                most = np.minimum(most, np.partition(apart, least, axis=1)[:, least] + 2.0 * slack)
        close = np.flatnonzero(np.repeat(gaps <= most.max(), sizes))
        apart = left @ right[close].T
        near = apart <= most[:, None]
        if np.count_nonzero(near) > 4 * k * len(x) and least < len(close):
            near &= apart <= np.partition(apart, least, axis=1)[:, least : least + 1] + 2.0 * slack[:, None]
        row, other = np.nonzero(near)
        other = close[other]
        if others:
            kept = mine[row] != names[other]
            row, other = row[kept], other[kept]
        found = np.zeros(len(row))
        for axis in range(x.shape[1]):
            found += (x[row, axis] - spots[other, axis]) ** 2
        kept = found <= limit[row]
        row, other, found = row[kept], other[kept], found[kept]
        order = np.lexsort([names[other], found, row])
        row, other, found = row[order], other[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = (place < k) & np.isfinite(found)
        row, other, found = row[kept], other[kept], found[kept]
        parts.append(pd.DataFrame({key: mine[row], "neighbour": names[other], "distance": np.sqrt(found)}, index=chunk[row]))
    return pd.concat(parts[1:]).sort_index(kind="stable")


def _together(asked: DataFrame, points: DataFrame, key: str):
    """Asking rows and the points of the blocks they ask; a block that many rows ask is met
    by one part of them at a time."""
    # a row per block, of thousands of rows each
    parts = F.broadcast(
        asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(_ASKING_ROWS)).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.col("parts")).cast("int").alias("part")
    queries = asked.join(parts, "block").select(*asked.columns, part)
    # named anew, since the points may ask themselves
    named = [F.col(c).alias(c) for c in points.columns]
    spread = points.join(parts, "block").select(*named, every_block(F.col("parts")).alias("part"))
    return queries.groupBy("block", "part").cogroup(spread.groupBy("block", "part"))


def _listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def _nearest(queries: DataFrame, points: DataFrame, ground: _Ground, columns: list[str], key: str, k: int, others: bool) -> DataFrame:
    """The k nearest ``points`` of every query: found in its own block, and in the blocks
    that may hold nearer ones than those."""
    numbers = ", ".join(f"`{c}` double" for c in columns)

    def at_home(asking: pa.Table, known: pa.Table) -> pa.Table:
        own = asking.to_pandas().assign(bound=np.inf)
        near = _nearest_of(own, known.to_pandas(), columns, key, k, others)
        counts = np.bincount(near.index, minlength=len(own))
        distances, last = near["distance"].to_numpy(), np.cumsum(counts) - 1
        bound = np.full(len(own), np.inf)
        bound[counts == k] = distances[last[counts == k]]
        row, block = ground.asked(_matrix_of(asking, columns), bound, own["block"].iloc[0] if len(own) else -1)
        lists = [(near["neighbour"].to_numpy(), counts), (distances, counts), (block.astype(np.int32), np.bincount(row, minlength=len(own)))]
        return pa.table(
            [*[asking.column(c) for c in (key, *columns)], pa.array(bound), *[_listed(*v) for v in lists]],
            [key, *columns, "bound", "neighbours", "distances", "asked"],
        )

    def answer(asking: pa.Table, known: pa.Table) -> pa.Table:
        near = _nearest_of(asking.to_pandas(), known.to_pandas(), columns, key, k, others)
        row, counts = np.unique(near.index, return_counts=True)
        lists = [_listed(near[c].to_numpy(), counts) for c in ("neighbour", "distance")]
        keys = asking.column(key).to_numpy()[row]
        return pa.table([pa.array(keys, pa.int64()), *lists], [key, "neighbours", "distances"])

    answered = f"`{key}` long, neighbours array<long>, distances array<double>"
    own = durable(
        _together(queries, points, key).applyInArrow(at_home, f"`{key}` long, {numbers}, bound double, neighbours array<long>, distances array<double>, asked array<int>")
    )
    asked = own.select(key, *columns, "bound", F.explode("asked").alias("block"))
    far = _together(asked, points, key).applyInArrow(answer, answered)
    # at most k rows of each asked block meet here
    met = own.select(key, "neighbours", "distances").unionByName(far).groupBy(key).agg(
        F.collect_list(F.struct("neighbours", "distances")).alias("near")
    )

    def weigh(batches):
        for batch in batches:
            near = batch.column("near")
            neighbours, distances = near.flatten().flatten()
            row = pc.list_parent_indices(near).to_numpy()[pc.list_parent_indices(neighbours).to_numpy()]
            neighbours, distances = neighbours.flatten().to_numpy(), distances.flatten().to_numpy()
            order = np.lexsort([neighbours, distances, row])
            row, neighbours, distances = row[order], neighbours[order], distances[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            apart = distances[best].reshape(-1, k)
            weights = _edge_weights(apart, k).ravel() if len(apart) else np.empty(0)
            keys = np.repeat(batch.column(key).to_numpy(), k)
            yield pa.record_batch(
                [pa.array(v) for v in (keys, neighbours[best], apart.ravel(), weights)], [key, "neighbour", "distance", "weight"]
            )

    return met.mapInArrow(weigh, _NEAR.format(key=key))


def nearest_neighbours(
    df: DataFrame,
    columns: Sequence[str],
    k: int = NEIGHBOURS,
    seed: int = SEED,
    key: str = "user_id",
    cells: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest other rows of every row, or all others if they are fewer: (key,
    neighbour, distance, weight).

    ``key`` is a unique whole number; rows at the same distance are taken by key.
    """
    columns = list(columns)
    data = durable(_numbers(df, columns, key))
    rows = data.count()
    # a small table has fewer others than ``k``: then all of them are neighbours
    k = min(k, rows - 1)
    if k < 1:
        return df.sparkSession.createDataFrame([], _NEAR.format(key=key))
    ground = _part_space(data, rows, columns, key, cells, block_rows, seed)
    points = durable(_housed(data, ground, columns, key))
    discard(data)
    return _nearest(points, points, ground, columns, key, k, others=True)


def nearest_known(
    new: DataFrame,
    known: DataFrame,
    columns: Sequence[str],
    k: int = NEIGHBOURS,
    seed: int = SEED,
    key: str = "user_id",
    cells: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest rows of ``known`` of every row of ``new``, or all of them if they are
    fewer: (key, neighbour, distance, weight).  Keys are unique in either table; a key in
    both is two rows.
    """
    columns = list(columns)
    data = durable(_numbers(known, columns, key))
    rows = data.count()
    k = min(k, rows)
    if k < 1:
        return new.sparkSession.createDataFrame([], _NEAR.format(key=key))
    ground = _part_space(data, rows, columns, key, cells, block_rows, seed)
    points = durable(_housed(data, ground, columns, key))
    queries = durable(_housed(_numbers(new, columns, key), ground, columns, key))
    discard(data)
    return _nearest(queries, points, ground, columns, key, k, others=False)


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """Symmetric weights a + b - ab over both directions of an edge."""
    both = edges.select("i", "j", "weight").unionByName(
        edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    )
    total, squares = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    return both.groupBy("i", "j").agg((total - (total * total - squares) / 2.0).alias("weight"))


def _blocks_of_graph(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed nodes (block, rows, keys, roots) and packed edges by the block of their
    second end (block, at, heads, data): ``heads`` are runs of edges to one node."""
    degrees = graph.groupBy("i").agg(F.sqrt(F.sum("weight")).alias("root"))
    degrees = durable(degrees)
    spot = F.row_number().over(Window.partitionBy("block").orderBy("i")) - 1
    count = blocks_for(degrees.count(), GRAPH_ROWS)
    nodes = durable(
        degrees.withColumn("block", block_of(F.col("i"), count)).withColumn("spot", spot.cast("int"))
    )
    other = nodes.select(*[F.col(c).alias(f"_{c}") for c in nodes.columns])
    scaled = (
        graph.join(nodes, "i").join(other, graph["j"] == other["_i"])
        .select(
            F.col("_block").alias("source"), F.col("_spot").alias("origin"), "block", "spot",
            (F.col("weight") / (F.col("root") * F.col("_root"))).alias("weight"),
        )
    )

    def pack_nodes(table: pa.Table) -> pa.Table:
        table = table.sort_by("spot")
        held = [table.column(c).to_numpy().astype(k).tobytes() for c, k in (("i", np.int64), ("root", np.float64))]
        return pa.table(
            [pa.array([v], k) for v, k in zip([table.column("block")[0].as_py(), len(table), *held], _NODE_KINDS)],
            ["block", "rows", "keys", "roots"],
        )

    def pack_edges(table: pa.Table) -> pa.Table:
        block, spot, origin = (table.column(c).to_numpy() for c in ("block", "spot", "origin"))
        order = np.lexsort([origin, spot, block])
        block, spot = block[order], spot[order]
        fresh = np.ones(len(block), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (spot[1:] != spot[:-1])
        starts = np.flatnonzero(fresh)
        parts = (
            origin[order].astype(np.int32), table.column("weight").to_numpy()[order],
            starts.astype(np.int64), block[starts].astype(np.int32), spot[starts].astype(np.int32),
        )
        return pa.table(
            [pa.array([table.column("source")[0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
            ["source", *_EDGE_PARTS],
        )

    packed = nodes.groupBy("block").applyInArrow(pack_nodes, "block int, rows long, keys binary, roots binary")
    edges = scaled.groupBy("source").applyInArrow(
        pack_edges, "source int, " + ", ".join(f"{c} binary" for c in _EDGE_PARTS)
    )
    return durable(packed), durable(edges)


_NODE_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
_EDGE_PARTS = ("origin", "weight", "starts", "block", "spot")
_STATE = "block int, rows long, basis binary, image binary, products binary"
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _state(block: int, basis: np.ndarray, image: np.ndarray) -> list:
    """A block's vectors and their products with the image."""
    products = np.hstack([basis, image]).T @ image
    return [block, len(image), basis.tobytes(), image.tobytes(), products.tobytes()]


def _vectors(rows: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


def _stated(states: list[list]) -> pa.Table:
    columns = zip(*states) if states else [()] * len(_KINDS)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], [c.split()[0] for c in _STATE.split(", ")])


Turns = list[tuple[np.ndarray, np.ndarray]]


def _turned(basis: np.ndarray, image: np.ndarray, turns: Turns) -> np.ndarray:
    for turn, shift in turns:
        image = image @ turn - basis @ shift
    return image


def _multiplied(state: DataFrame, edges: DataFrame, turns: Turns) -> DataFrame:
    """The block (the image under ``turns``) joins the basis; its product with the graph is
    the new image."""
    width = turns[-1][0].shape[1]
    names = ["to", "source", "rows", "spots", "data"]

    def send(here: pa.Table, out: pa.Table) -> pa.Table:
        block, rows, basis, image = (here.column(c)[0].as_py() for c in ("block", "rows", "basis", "image"))
        basis = _vectors(rows, basis)
        x = _turned(basis, _vectors(rows, image), turns)
        # the block's own vectors stay with it
        sent = [[block, -1, rows, b"", np.hstack([basis, x]).tobytes()]]
        if len(out):
            kinds = (np.int32, np.float64, np.int64, np.int32, np.int32)
            origin, weight, starts, to, spots = (
                np.frombuffer(out.column(c)[0].as_py(), k) for c, k in zip(_EDGE_PARTS, kinds)
            )
            sums = np.add.reduceat(weight[:, None] * x[origin], starts, axis=0)
            ends = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
            for a, b in zip(ends[:-1], ends[1:]):
                sent.append([int(to[a]), block, int(b - a), spots[a:b].tobytes(), sums[a:b].tobytes()])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*sent), kinds)], names)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("source")
        to, _, rows, spots, data = (table.column(c).to_pylist() for c in names)
        basis = _vectors(rows[0], data[0])
        image = np.zeros((rows[0], width))
        for n, at, values in zip(rows[1:], spots[1:], data[1:]):
            image[np.frombuffer(at, np.int32)] += _vectors(n, values)
        return _stated([_state(to[0], basis, image)])

    sent = state.select("block", "rows", "basis", "image").groupBy("block").cogroup(edges.groupBy("source")).applyInArrow(
        send, "to int, source int, rows long, spots binary, data binary"
    )
    return durable(sent.groupBy("to").applyInArrow(add, _STATE))


def _restated(state: DataFrame, change) -> DataFrame:
    """A written table of the blocks with basis and image changed."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "basis", "image")))
            states = [_state(b, *change(_vectors(n, x), _vectors(n, y))) for b, n, x, y in rows]
            yield from _stated(states).to_batches()

    return durable(state.mapInArrow(run, _STATE))


def _inner(state: DataFrame, width: int) -> np.ndarray:
    """Sums over all rows of the products with the image, a few dozen numbers squared
    per block."""
    found = state.select("block", "products").toArrow().sort_by("block").column("products").to_pylist()
    return sum(np.frombuffer(x, np.float64).reshape(-1, width) for x in found)


def _products(state: DataFrame, turns: Turns) -> DataFrame:
    """The blocks' products (see :func:`_state`) with the image under ``turns``."""

    def run(batches):
        for batch in batches:
            out = []
            for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("rows", "basis", "image"))):
                basis = _vectors(n, x)
                out.append(_state(0, basis, _turned(basis, _vectors(n, y), turns))[-1])
            yield pa.record_batch([batch.column("block"), pa.array(out, pa.binary())], ["block", "products"])

    return state.select("block", "rows", "basis", "image").mapInArrow(run, "block int, products binary")


def _orthonormal(state: DataFrame, width: int) -> tuple[Turns, np.ndarray, np.ndarray]:
    """The image made orthonormal, also to the basis: the turns and shifts still to be
    applied to the state's image, what the image had in the basis, and its triangle R.
    Done twice for accuracy; the vectors are not written in between."""
    turns: Turns = []
    inner_all = whole = None
    for first in (True, False):
        products = _inner(state if first else _products(state, turns), width)
        inner, gram = products[:-width], products[-width:]
        rest = gram - inner.T @ inner
        upper = np.linalg.cholesky(rest + np.eye(width) * 1e-14 * max(np.trace(gram), 1e-300)).T
        turn = np.linalg.inv(upper)
        inner_all = inner if first else inner_all
        whole = upper if first else upper @ whole
        turns = [*turns, (turn, inner @ turn)]
    return turns, inner_all, whole


def spectral(graph: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, residual: float = RESIDUAL) -> DataFrame:
    """Rows (i, spots): leading eigenvectors of the normalised graph (i, j, weight)
    beside the constant one, in a block Krylov space that restarts from its best
    vectors until their residuals are below ``residual``.

    Nodes and edges are packed in blocks; a product is one exchange of sums per pair of
    blocks."""
    graph = durable(graph)
    nodes, packed = _blocks_of_graph(graph)
    width = dimensions + 1
    # a pseudo-random number of the row alone
    draws = F.array(*[
        F.pmod(F.xxhash64("i", F.lit(seed + a)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0 for a in range(width)
    ])

    def unpack(batches):
        for batch in batches:
            for block, keys, roots in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "roots"))):
                i = np.frombuffer(keys, np.int64)
                yield pa.record_batch(
                    [pa.array(np.full(len(i), block, np.int32)), pa.array(i), pa.array(np.frombuffer(roots, np.float64))],
                    ["block", "i", "root"],
                )

    def begin(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        block = table.column("block")[0].as_py()
        drawn = table.column("drawn").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return _stated([_state(block, table.column("root").to_numpy()[:, None] / norm, np.ascontiguousarray(drawn))])

    rows = nodes.mapInArrow(unpack, "block int, i long, root double")
    norm = rows.agg(F.sqrt(F.sum(F.col("root") * F.col("root")))).first()[0]
    parts = max(1, min(nodes.count(), 4 * graph.sparkSession.sparkContext.defaultParallelism))
    # read again and again, at the place where the vectors come to
    edges = packed.repartition(parts, "source").persist(StorageLevel.DISK_ONLY)
    try:
        state = durable(rows.withColumn("drawn", draws).groupBy("block").applyInArrow(begin, _STATE))
        turns, _, _ = _orthonormal(state, width)
        for _ in range(MAX_ROUNDS // KRYLOV_BLOCKS):
            small = np.zeros((0, 0))
            for _ in range(KRYLOV_BLOCKS):
                before = state
                state = _multiplied(before, edges, turns)
                discard(before)
                turns, inner, rest = _orthonormal(state, width)
                inner = inner[1:]
                size = len(inner)
                grown = np.zeros((size, size))
                grown[: len(small), : len(small)] = small
                grown[:, size - width :] = inner
                grown[size - width :, :] = inner.T
                small = grown
                values, vectors = np.linalg.eigh((small + small.T) / 2.0)
                top = np.argsort(values)[::-1][:width]
                missing = np.linalg.norm(rest @ vectors[size - width :, top[:dimensions]], axis=0)
                if missing.max() < residual:
                    break
            # the best vectors, and the space's next block if it goes on
            chosen = np.vstack([np.zeros((1, width)), vectors[:, top]])
            before = state
            state = _restated(before, lambda basis, image: (np.ascontiguousarray(basis[:, :1]), basis @ chosen))
            discard(before)
            if missing.max() < residual:
                return _spots(nodes, state, dimensions)
            turns, _, _ = _orthonormal(state, width)
    finally:
        edges.unpersist()
    raise RuntimeError(f"the spectrum is too tight: residual {missing.max():.1e} after {MAX_ROUNDS} rounds")


def _spots(nodes: DataFrame, state: DataFrame, dimensions: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for n, keys, image in zip(*(batch.column(c).to_pylist() for c in ("rows", "keys", "image"))):
                spots = np.ascontiguousarray(_vectors(n, image)[:, :dimensions])
                offsets = pa.array(np.arange(0, spots.size + 1, dimensions, dtype=np.int32))
                listed = pa.ListArray.from_arrays(offsets, pa.array(spots.ravel()))
                yield pa.record_batch([pa.array(np.frombuffer(keys, np.int64)), listed], ["i", "spots"])

    met = nodes.join(state.select("block", "image"), "block").select("rows", "keys", "image")
    return durable(met.mapInArrow(run, "i long, spots array<double>"))


def scaled_spectral(graph: DataFrame, dimensions: int, seed: int = SEED, residual: float = RESIDUAL) -> DataFrame:
    """Spectral coordinates (i, spots) with signs fixed, the largest of them 10 in size."""
    found = spectral(graph, dimensions, seed, residual)
    axes = [F.get("spots", F.lit(i)) for i in range(dimensions)]
    # the entry of the largest size is positive; of equal ones that of the smallest key
    ends = found.agg(
        *[F.max_by(a, F.struct(F.round(F.abs(a), 9), -F.col("i"))).alias(f"e{i}") for i, a in enumerate(axes)]
    ).first()
    peak = max(abs(e) for e in ends) or 1.0
    return found.select("i", F.array(*[a * F.lit((10.0 if e >= 0 else -10.0) / peak) for a, e in zip(axes, ends)]).alias("spots"))


def neighbour_embedding(
    df: DataFrame,
    columns: Sequence[str],
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    seed: int = SEED,
    key: str = "user_id",
    prefix: str = "nb",
    residual: float = RESIDUAL,
) -> DataFrame:
    """``dimensions`` coordinates of every row, the largest of them 10 in size."""
    near = durable(nearest_neighbours(df, columns, neighbours, seed, key))
    edges = near.select(F.col(key).alias("i"), F.col("neighbour").alias("j"), "weight")
    found = scaled_spectral(fuzzy_union(edges), dimensions, seed, residual)
    return found.select(
        F.col("i").alias(key), *[F.get("spots", F.lit(n)).alias(f"{prefix}{n + 1}") for n in range(dimensions)]
    )
