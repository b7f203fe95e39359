"""A point layout of the fuzzy neighbour graph, and the placing of new rows in it.

The layout starts from the graph's spectral coordinates and moves all points at once,
one written table per epoch.  An edge is drawn in an epoch with a chance equal to its
weight and pulls its ends together; a drawn edge also brings ``NEGATIVES`` pushes from
other points.  Which points push is dealt anew in each epoch: rows are hashed into
crowds of bounded size, and a row takes the mean push of its whole crowd, which is the
expected push of points drawn at random.  An epoch is a join of the drawn edges with
both ends, a sum per point, and a grouping by crowd; nothing but the number of rows and
the largest weight visits the driver.

Of many points these are packed: blocks are parts of the space of the first coordinates, so
that most edges stay inside a block, and keep their edges; an epoch sends blocks the spots of
the other ends of their edges, and the crowds' pushes.  Both ways give the same layout.

A point's step is divided by its edges' stiffness, so that many edges at once do not
overshoot.  Sums are whole numbers and draws are hashes of keys: reruns are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from basketlens.operators.blocks import hash_of, matrix, squared_distances
from basketlens.operators.neighbours import (
    DIMENSIONS,
    NEIGHBOURS,
    RESIDUAL,
    fuzzy_union,
    nearest_known,
    nearest_neighbours,
    parted,
    scaled_spectral,
)
from basketlens.operators.sampling import SEED
from basketlens.session import discard, durable

# Closeness 1 / (1 + a d^(2b)) that falls off beyond a distance of 0.1, pushes
# per drawn edge, and the largest push along an axis.
CURVE_A = 1.577
CURVE_B = 0.895
NEGATIVES = 5
LARGEST_PUSH = 4.0

EPOCHS = 40
CROWD_ROWS = 256

# Points from which on an epoch exchanges packed blocks, and the rows of a block.
PACKED_POINTS = 20_000
BLOCK_POINTS = 8192

# sums are taken in these units, chances in parts of 2^20
_UNIT = float(1 << 30)
_PARTS = 1 << 20


def _pulls(state: DataFrame, edges: DataFrame, epoch: int, dimensions: int, seed: int) -> DataFrame:
    """Per point with a drawn edge: the sum of its pulls, their stiffness, and how many."""
    chance = F.pmod(F.xxhash64(F.least("i", "j"), F.greatest("i", "j"), F.lit(seed + epoch)), F.lit(_PARTS))
    ends = (
        edges.where(chance < F.col("weight") * F.lit(_PARTS))
        .join(state.withColumnRenamed("spots", "own"), "i")
        .join(state.select(F.col("i").alias("j"), F.col("spots").alias("other")), "j")
    )
    gaps = [F.get("other", F.lit(c)) - F.get("own", F.lit(c)) for c in range(dimensions)]
    far = F.greatest(sum((g * g for g in gaps), F.lit(0.0)), F.lit(1e-12))
    ends = ends.withColumn("far", far).withColumn(
        "pull",
        F.lit(2 * CURVE_A * CURVE_B) * F.pow("far", F.lit(CURVE_B - 1)) / (1 + F.lit(CURVE_A) * F.pow("far", F.lit(CURVE_B))),
    )

    def total(value):
        # rint is arithmetic; round would go through a decimal per edge
        return F.sum(F.rint(value * F.lit(_UNIT)).cast("long")) / F.lit(_UNIT)

    return ends.groupBy("i").agg(
        F.array(*[total(F.col("pull") * g) for g in gaps]).alias("pulled"),
        total(F.col("pull")).alias("stiffness"),
        F.count(F.lit(1)).alias("drawn"),
    )


def _crowd_push(spots: np.ndarray) -> np.ndarray:
    """The mean push of all other points of a crowd on each."""
    if len(spots) < 2:
        return np.zeros_like(spots)
    far = squared_distances(spots, spots)
    size = 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * far**CURVE_B))
    pushes = np.empty_like(spots)
    for axis, at in enumerate(spots.T):
        push = at[:, None] - at[None, :]
        push *= size
        pushes[:, axis] = np.clip(push, -LARGEST_PUSH, LARGEST_PUSH, out=push).sum(axis=1)
    return pushes / (len(spots) - 1)


def _after(spots, drawn, pulled, stiffness, push, rate: float) -> np.ndarray:
    """The spots after a move at this rate."""
    force = pulled + NEGATIVES * drawn[:, None] * push
    step = force / np.maximum(stiffness, 1e-9)[:, None]
    # a point without a drawn edge stays
    return spots + rate * np.where(drawn[:, None] > 0, np.clip(step, -LARGEST_PUSH, LARGEST_PUSH), 0.0)


def _moved(rate: float):
    def move(crowd: pd.DataFrame) -> pd.DataFrame:
        crowd = crowd.sort_values("i")
        spots = np.array(crowd["spots"].tolist())
        held = [np.array(crowd[c].tolist()) for c in ("drawn", "pulled", "stiffness")]
        return pd.DataFrame({"i": crowd["i"], "spots": list(_after(spots, *held, _crowd_push(spots), rate))})

    return move


# -- packed blocks -----------------------------------------------------------------

_STATE = "block int, rows long, keys binary, spots binary"
_SENT = "to int, source int, at binary, spots binary"
# what a row that is sent to a block holds, beside the spots of another block's points
_OWN, _PUSHES = -1, -2
_EDGE_KINDS = {"spot": np.int32, "end": np.int32, "weight": np.float64, "mixed": np.uint64}


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(v), kinds[kind]) for v, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _packed_graph(edges: DataFrame, start: DataFrame, dimensions: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the points' state, what a block sends (source, block, origins), and
    the edges by the block of their first end.

    An edge's other end is its place in all that the block is sent, in order of source and
    origin; ``mixed`` is the hash of its two keys."""
    axes = [f"s{c}" for c in range(dimensions)]
    flat = durable(start.select("i", *[F.get("spots", F.lit(c)).cast("double").alias(a) for c, a in enumerate(axes)]))
    spot = (F.row_number().over(Window.partitionBy("block").orderBy("i")) - 1).cast("int")
    nodes = durable(parted(flat, axes, "i", BLOCK_POINTS, seed).withColumn("spot", spot))
    discard(flat)
    other = nodes.select(F.col("i").alias("j"), F.col("block").alias("source"), F.col("spot").alias("origin"))
    met = edges.join(nodes.select("i", "block", "spot"), "i").join(other, "j").select("i", "j", "weight", "block", "spot", "source", "origin")

    def pack_nodes(table: pa.Table) -> pa.Table:
        table = table.sort_by("spot")
        x = np.column_stack([table.column(a).to_numpy() for a in axes])
        return _table([(table.column("block")[0].as_py(), len(x), table.column("i").to_numpy().astype(np.int64).tobytes(), x.tobytes())], _STATE)

    def pack_edges(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.lexsort([held["j"], held["spot"]])
        held = {c: v[order] for c, v in held.items()}
        ends, end = np.unique(held["source"].astype(np.int64) << 32 | held["origin"], return_inverse=True)
        low, high = np.minimum(held["i"], held["j"]), np.maximum(held["i"], held["j"])
        parts = {"spot": held["spot"], "end": end, "weight": held["weight"], "mixed": hash_of(high, hash_of(low))}
        block = int(held["block"][0])
        rows = [(block, -1, b"", *[parts[c].astype(k).tobytes() for c, k in _EDGE_KINDS.items()])]
        source, origin = (ends >> 32).astype(int), (ends & 0xFFFFFFFF).astype(np.int32)
        for s in np.unique(source):
            rows.append((block, int(s), origin[source == s].tobytes(), b"", b"", b"", b""))
        return _table(rows, shape)

    shape = "block int, source int, origins binary, " + ", ".join(f"{c} binary" for c in _EDGE_KINDS)
    state = durable(nodes.groupBy("block").applyInArrow(pack_nodes, _STATE))
    packed = durable(met.groupBy("block").applyInArrow(pack_edges, shape))
    discard(nodes)
    return state, packed.where("source >= 0").select("source", "block", "origins"), packed.where("source < 0").select("block", *_EDGE_KINDS)


def _pushes(state: DataFrame, crowds: int, per: int, epoch: int, dimensions: int, seed: int) -> DataFrame:
    """Every block's pushes, from crowds of which ``per`` meet in a group."""

    def deal(batches):
        for batch in batches:
            rows = []
            for block, keys, spots in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "spots"))):
                keys, spots = np.frombuffer(keys, np.int64), matrix(spots, dimensions)
                crowd = hash_of(np.int32(epoch), hash_of(np.int32(seed), hash_of(keys))).astype(np.int64) % crowds
                order = np.argsort(crowd, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(crowd[order] // per)) + 1):
                    rows.append((int(crowd[at[0]] // per), block, at.astype(np.int32).tobytes(), crowd[at].tobytes(), keys[at].tobytes(), spots[at].tobytes()))
            yield from _table(rows, "meeting int, block int, at binary, crowd binary, keys binary, spots binary").to_batches()

    def push(table: pa.Table) -> pa.Table:
        held = {c: table.column(c).to_pylist() for c in table.column_names}
        at, crowd, keys = (np.frombuffer(b"".join(held[c]), k) for c, k in (("at", np.int32), ("crowd", np.int64), ("keys", np.int64)))
        spots = matrix(b"".join(held["spots"]), dimensions)
        block = np.repeat(held["block"], [len(v) // 4 for v in held["at"]])
        pushes = np.empty_like(spots)
        order = np.lexsort([keys, crowd])
        for one in np.split(order, np.flatnonzero(np.diff(crowd[order])) + 1):
            pushes[one] = _crowd_push(spots[one])
        order = np.argsort(block, kind="stable")
        rows = [
            (int(block[of[0]]), _PUSHES, at[of].tobytes(), pushes[of].tobytes())
            for of in np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
        ]
        return _table(rows, _SENT)

    dealt = state.mapInArrow(deal, "meeting int, block int, at binary, crowd binary, keys binary, spots binary")
    return dealt.groupBy("meeting").applyInArrow(push, _SENT)


def _packed_epoch(
    state: DataFrame, sends: DataFrame, edges: DataFrame, crowds: int, per: int, epoch: int, rate: float, dimensions: int, seed: int
) -> DataFrame:
    """The written state after an epoch."""

    def send(here: pa.Table, asked: pa.Table) -> pa.Table:
        block, keys, spots = (here.column(c)[0].as_py() for c in ("block", "keys", "spots"))
        rows = [(block, _OWN, keys, spots)]
        spots = matrix(spots, dimensions)
        for to, origins in zip(asked.column("block").to_pylist(), asked.column("origins").to_pylist()):
            rows.append((to, block, b"", spots[np.frombuffer(origins, np.int32)].tobytes()))
        return _table(rows, _SENT)

    def move(come: pa.Table, out: pa.Table) -> pa.Table:
        rows = sorted(zip(*(come.column(c).to_pylist() for c in ("source", "to", "at", "spots"))), key=lambda r: r[0])
        (block, keys, spots), = [(to, at, matrix(raw, dimensions)) for source, to, at, raw in rows if source == _OWN]
        others = matrix(b"".join(raw for source, _, _, raw in rows if source >= 0), dimensions)
        push = np.zeros_like(spots)
        for source, _, at, raw in rows:
            if source == _PUSHES:
                push[np.frombuffer(at, np.int32)] = matrix(raw, dimensions)
        sums, drawn = np.zeros((len(spots), dimensions + 1)), np.zeros(len(spots), np.int64)
        if len(out):
            at, end, weight, mixed = (np.frombuffer(out.column(c)[0].as_py(), k) for c, k in _EDGE_KINDS.items())
            chance = hash_of(np.int32(seed + epoch), mixed) & np.uint64(_PARTS - 1)
            taken = np.flatnonzero(chance.astype(np.int64) < weight * _PARTS)
            at, gaps = at[taken], others[end[taken]] - spots[at[taken]]
            far = np.maximum(sum(g * g for g in gaps.T) + np.zeros(len(gaps)), 1e-12)
            pull = 2 * CURVE_A * CURVE_B * far ** (CURVE_B - 1) / (1 + CURVE_A * far**CURVE_B)
            # whole numbers: their order changes nothing
            units = np.rint(np.column_stack([pull[:, None] * gaps, pull]) * _UNIT).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            if len(starts):
                sums[at[starts]] = np.add.reduceat(units, starts, axis=0) / _UNIT
            drawn = np.bincount(at, minlength=len(spots))
        after = _after(spots, drawn, sums[:, :-1], sums[:, -1], push, rate)
        return _table([(block, len(after), keys, np.ascontiguousarray(after).tobytes())], _STATE)

    sent = state.groupBy("block").cogroup(sends.groupBy("source")).applyInArrow(send, _SENT)
    come = sent.unionByName(_pushes(state, crowds, per, epoch, dimensions, seed))
    return durable(come.groupBy("to").cogroup(edges.groupBy("block")).applyInArrow(move, _STATE))


def _packed_layout(edges: DataFrame, start: DataFrame, dimensions: int, epochs: int, seed: int, crowds: int) -> DataFrame:
    state, sends, packed = _packed_graph(edges, start, dimensions, seed)
    blocks = state.count()
    parts = max(1, min(blocks, 4 * start.sparkSession.sparkContext.defaultParallelism))
    # read in every epoch, at the place where what is sent comes to
    kept = packed.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    try:
        for epoch in range(epochs):
            after = _packed_epoch(state, sends, kept, crowds, -(-crowds // blocks), epoch, 1.0 - epoch / epochs, dimensions, seed)
            discard(state)
            state = after
    finally:
        kept.unpersist()

    def unpack(batches):
        for batch in batches:
            for keys, spots in zip(batch.column("keys").to_pylist(), batch.column("spots").to_pylist()):
                keys, spots = np.frombuffer(keys, np.int64), np.frombuffer(spots, np.float64)
                offsets = pa.array(np.arange(0, spots.size + 1, dimensions, dtype=np.int32))
                yield pa.record_batch([pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(spots))], ["i", "spots"])

    return state.mapInArrow(unpack, "i long, spots array<double>")


def laid_out(
    graph: DataFrame, start: DataFrame, dimensions: int, epochs: int = EPOCHS, seed: int = SEED, crowd_rows: int = CROWD_ROWS
) -> DataFrame:
    """The points (i, spots) after ``epochs`` of moves over a symmetric graph (i, j,
    weight); the rate falls to zero in equal steps."""
    graph = durable(graph)
    peak = graph.agg(F.max("weight")).first()[0]
    if peak is None:
        return start
    edges = graph.withColumn("weight", F.col("weight") / F.lit(peak))
    state = durable(start)
    points = state.count()
    crowds = max(1, -(-points // crowd_rows))
    if points >= PACKED_POINTS:
        return _packed_layout(edges, state, dimensions, epochs, seed, crowds)
    for epoch in range(epochs):
        pulls = _pulls(state, edges, epoch, dimensions, seed)
        none = F.array(*[F.lit(0.0)] * dimensions)
        pulled = state.join(pulls, "i", "left").select(
            "i", "spots", F.coalesce("pulled", none).alias("pulled"),
            F.coalesce("stiffness", F.lit(0.0)).alias("stiffness"), F.coalesce("drawn", F.lit(0)).alias("drawn"),
            F.pmod(F.xxhash64("i", F.lit(seed), F.lit(epoch)), F.lit(crowds)).alias("crowd"),
        )
        after = durable(
            pulled.groupBy("crowd").applyInPandas(_moved(1.0 - epoch / epochs), "i long, spots array<double>")
        )
        discard(state)
        state = after
    return state


def neighbour_layout(
    df: DataFrame,
    columns: Sequence[str],
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
    epochs: int = EPOCHS,
    seed: int = SEED,
    key: str = "user_id",
    prefix: str = "ly",
    residual: float = RESIDUAL,
) -> DataFrame:
    """``dimensions`` coordinates of every row.

    ``key`` is a unique whole number.  Equal rows start a little apart.  A table of one
    row has no neighbours and gives no rows, as :func:`nearest_neighbours` does.
    """
    near = durable(nearest_neighbours(df, columns, neighbours, seed, key))
    shape = f"`{key}` long, " + ", ".join(f"{prefix}{c + 1} double" for c in range(dimensions))
    if near.isEmpty():
        return df.sparkSession.createDataFrame([], shape)
    graph = durable(fuzzy_union(near.select(F.col(key).alias("i"), F.col("neighbour").alias("j"), "weight")))
    first = scaled_spectral(graph, dimensions, seed, residual)

    def apart(axis: int):
        return (F.pmod(F.xxhash64("i", F.lit(seed + axis)), F.lit(_PARTS)) / F.lit(_PARTS / 2.0) - 1.0) * F.lit(1e-4)

    # spectral coordinates vary in their last digits, moves would spread that
    start = first.select(
        "i", F.array(*[F.round(F.get("spots", F.lit(c)), 6) + apart(c) for c in range(dimensions)]).alias("spots")
    )
    found = laid_out(graph, start, dimensions, epochs, seed)
    return found.select(
        F.col("i").alias(key), *[F.get("spots", F.lit(c)).alias(f"{prefix}{c + 1}") for c in range(dimensions)]
    )


def place(
    new: DataFrame,
    known: DataFrame,
    layout: DataFrame,
    columns: Sequence[str],
    neighbours: int = NEIGHBOURS,
    seed: int = SEED,
    key: str = "user_id",
) -> DataFrame:
    """Coordinates of rows that were not laid out: the mean of their nearest known rows'
    coordinates, weighted as edges of the graph are."""
    near = nearest_known(new, known, columns, neighbours, seed, key)
    axes = [c for c in layout.columns if c != key]
    spots = layout.select(F.col(key).alias("neighbour"), *axes)
    met = near.join(spots, "neighbour")
    return met.groupBy(key).agg(*[(F.sum(F.col(a) * F.col("weight")) / F.sum("weight")).alias(a) for a in axes])
