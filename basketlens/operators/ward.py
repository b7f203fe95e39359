"""Ward clustering by rounds of reciprocal nearest neighbours.

Ward's cost allows every pair of clusters that are each other's cheapest partner to merge
at once, in any order, without changing the tree.  Clusters are a written table; a round
finds all cheapest partners exactly, block against block, where lower bounds leave room
for one, and merges all such pairs.  When few clusters are left they are merged at the
driver along chains of nearest neighbours.  One tree serves every k.

With ``condense_to`` k-means condenses the rows to so many centroids first, and only
these (with their sizes) are merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.operators.blocks import blocks_for
from basketlens.operators.partition import KS, VECTOR, assemble
from basketlens.operators.sampling import SEED
from basketlens.session import discard, durable

MICRO_CLUSTERS = 500
# clusters of a block, blocks of a run, and the clusters that the driver merges
BLOCK_ROWS = 512
RUN_BLOCKS = 32
FINISH = 4096


def ward_merges(sizes, centroids):
    """Merges (height, a, b) of the full tree, lowest first.

    Follows chains of nearest neighbours: two clusters that are each other's
    nearest are merged at once, which Ward's cost allows in any order.  Slot
    ``b`` is absorbed by slot ``a``.
    """
    sizes = np.asarray(sizes, dtype=float).copy()
    centroids = np.asarray(centroids, dtype=float).copy()
    alive = np.ones(len(sizes), dtype=bool)
    merges, chain = [], []
    for _ in range(len(sizes) - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            tip = chain[-1]
            cost = sizes * sizes[tip] / (sizes + sizes[tip])
            cost = cost * ((centroids - centroids[tip]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[tip] = np.inf
            best = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[best]:
                best = chain[-2]
                break
            chain.append(best)
        height = float(cost[best])
        del chain[-2:]
        a, b = min(tip, best), max(tip, best)
        together = sizes[a] + sizes[b]
        centroids[a] = (sizes[a] * centroids[a] + sizes[b] * centroids[b]) / together
        sizes[a] = together
        alive[b] = False
        merges.append((height, a, b))
    order = np.argsort([h for h, _, _ in merges], kind="stable")
    return [merges[i] for i in order]


def micro_clusters(df: DataFrame, columns: Sequence[str], k: int = MICRO_CLUSTERS, seed: int = SEED):
    """The rows with the number of their micro-cluster, ``_micro``, and the clusters'
    sizes and centroids (at most ``k`` rows)."""
    vectors = assemble(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, featuresCol=VECTOR, predictionCol="_micro").fit(vectors)
    finally:
        vectors.unpersist()
    rows = model.transform(assemble(df, columns)).drop(VECTOR)
    table = rows.groupBy("_micro").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(c).alias(c) for c in columns]
    )
    return rows, table


# -- exact merging -----------------------------------------------------------------


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number per unordered pair of ids, so that equal costs are settled alike from
    both sides and not along the ids."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    x = low * np.uint64(0x9E3779B97F4A7C15) + high
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _nearest(ids, n, x, other_ids, other_n, other_x, known=np.inf):
    """For each cluster the cost, order and id of the cheapest partner among the others, if
    it costs no more than ``known``.

    A matrix product tells which pairs may be the cheapest, up to its rounding; only
    their costs are taken axis by axis."""
    least, order, best = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
    if not len(ids) or not len(other_ids):
        return least, order, best
    middle = x.mean(axis=0)
    a, b = x - middle, other_x - middle
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    squared = np.column_stack([a, a2, np.ones(len(a))]) @ np.column_stack([-2.0 * b, np.ones(len(b)), b2]).T
    weight = 1.0 / (1.0 / n[:, None] + 1.0 / other_n)
    slack = 1e-13 * (np.sqrt(a2.max() + b2.max()) + max(np.abs(x).max(), np.abs(other_x).max())) ** 2
    squared *= weight
    weight *= slack
    squared[ids[:, None] == other_ids] = np.inf
    squared -= weight
    weight *= 2.0
    weight += squared
    limit = np.minimum(weight.min(axis=1), known)
    row, column = np.nonzero((squared <= limit[:, None]) & np.isfinite(squared))
    total = np.zeros(len(row))
    for axis in range(x.shape[1]):
        total += (x[row, axis] - other_x[column, axis]) ** 2
    cost = total * (n[row] * other_n[column] / (n[row] + other_n[column]))
    place = _pair_order(ids[row], other_ids[column])
    by = np.lexsort([column, place, cost, row])
    first = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
    first = first[cost[first] <= np.broadcast_to(known, len(ids))[row[first]]]
    least[row[first]], order[row[first]], best[row[first]] = cost[first], place[first], other_ids[column[first]]
    return least, order, best


def _axes(columns: int) -> list[str]:
    return [f"x{i}" for i in range(columns)]


def _points(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in _axes(columns)])


def _codes(columns: int, low: np.ndarray, high: np.ndarray):
    """A place along a curve through space: interleaved bits of the scaled axes."""
    bits = max(62 // columns, 1)
    width = np.where(high > low, high - low, 1.0)

    def run(batches):
        for batch in batches:
            cells = np.clip((_points(batch, columns) - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            code = np.zeros(len(batch), np.int64)
            for bit in range(bits):
                for axis in range(min(columns, 62)):
                    code |= ((cells[:, axis] >> bit) & 1) << (bit * columns + axis)
            yield pa.record_batch([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    return run


def _leaves(x: np.ndarray, n: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``rows``: halves along the widest axis, or by size
    where sizes are far apart."""
    out, left = [], [np.arange(len(x))]
    while left:
        held = left.pop()
        if len(held) <= rows:
            out.append(held)
            continue
        width = np.ptp(x[held], axis=0)
        sizes = np.log2(n[held])
        by = sizes if np.ptp(sizes) > 4.0 else x[held, width.argmax()]
        half = len(held) // 2
        cut = np.argpartition(by, half)
        left += [held[cut[half:]], held[cut[:half]]]
    return out


def _room(n, x, least_n, low, high):
    """Less than the cost of each cluster with any from a box."""
    gap = np.maximum(np.maximum(low - x, x - high), 0.0)
    return (gap**2).sum(axis=-1) * (n * least_n / (n + least_n)) * (1 - 1e-9)


def _blocks(columns: int, block_rows: int):
    """Packed blocks of neighbouring clusters, each with its box, its least size, and the
    nearest neighbours inside its run of at most ``RUN_BLOCKS`` blocks."""
    names = ["block", "run", "ids", "n", "x", "cost", "place", "near", "least_n", "open", *_box(columns)]

    def packed(number: int, run: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
        x = _points(table, columns)
        leaves = [(ids[held], n[held], x[held]) for held in _leaves(x, n, block_rows)]
        low, high = (np.array([f(leaf[2], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        least_n = np.array([leaf[1].min() for leaf in leaves])
        for i, own in enumerate(leaves):
            found = list(_nearest(*own, *own))
            room = _room(least_n[i], np.maximum(low[i], np.minimum(low, high[i])), least_n, low, high)
            for j in np.argsort(room, kind="stable"):
                if room[j] > found[0].max():
                    break
                asking = _room(own[1], own[2], least_n[j], low[j], high[j]) <= found[0] if i != j else [False]
                if np.any(asking):
                    other = _nearest(*(v[asking] for v in own), *leaves[j], found[0][asking])
                    now = [v[asking] for v in found]
                    nearer = (other[0] < now[0]) | (other[0] == now[0]) & (other[1] < now[1])
                    for v, before, after in zip(found, now, other):
                        v[asking] = np.where(nearer, after, before)
            yield pa.record_batch(
                [
                    pa.array([number + i]), pa.array([run]),
                    *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (*own, *found)],
                    pa.array([float(least_n[i])]), pa.array([float(found[0].max())]),
                    *[pa.array([float(v)]) for v in (*low[i], *high[i])],
                ],
                names,
            )

    def run(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= RUN_BLOCKS * block_rows:
                yield from packed(number, number, pa.Table.from_batches(held))
                number, held, rows = number + rows, [], 0
        if rows:
            yield from packed(number, number, pa.Table.from_batches(held))

    return run


def _box(columns: int) -> list[str]:
    return [f"low{i}" for i in range(columns)] + [f"high{i}" for i in range(columns)]


def _apart(columns: int, left: str, right: str) -> Column:
    """Less than the cost of any pair from two boxes."""
    gaps = [
        F.greatest(F.col(f"{left}low{i}") - F.col(f"{right}high{i}"), F.col(f"{right}low{i}") - F.col(f"{left}high{i}"), F.lit(0.0))
        for i in range(columns)
    ]
    a, b = F.col(f"{left}least_n"), F.col(f"{right}least_n")
    return sum((g * g for g in gaps), F.lit(0.0)) * (a * b / (a + b)) * (1 - 1e-9)


def _requests(columns: int):
    """The clusters of a block that may find a nearer one in another block, packed by that
    block (o_block, ids, n, x, cost)."""
    names = ["o_block", "ids", "n", "x", "cost"]
    kinds = [pa.int64(), *[pa.binary()] * 4]

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        if len(there):
            ids, n, cost = (np.frombuffer(here.column(c)[0].as_py(), k) for c, k in (("ids", np.int64), ("n", float), ("cost", float)))
            x = np.frombuffer(here.column("x")[0].as_py(), float).reshape(-1, columns)
            box = np.column_stack([there.column(f"o_{c}").to_numpy() for c in _box(columns)])
            least_n, names_of = there.column("o_least_n").to_numpy(), there.column("o_block").to_pylist()
            for at in range(len(there)):
                asking = _room(n, x, least_n[at], box[at, :columns], box[at, columns:]) <= cost
                if asking.any():
                    out.append((names_of[at], *[v[asking].tobytes() for v in (ids, n, x, cost)]))
        return pa.table([pa.array(list(v), k) for v, k in zip(zip(*out) if out else [()] * 5, kinds)], names)

    return run


def _between(columns: int):
    """Rows (id, cost, place, near) of the clusters that find a nearer one in another block."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                def part(name, kind):
                    return np.frombuffer(batch.column(name)[i].as_py(), kind)

                ids, n, x = part("ids", np.int64), part("n", np.float64), part("x", np.float64).reshape(-1, columns)
                others = part("o_ids", np.int64), part("o_n", np.float64), part("o_x", np.float64).reshape(-1, columns)
                cost, place, near = _nearest(ids, n, x, *others, part("cost", np.float64))
                found = np.isfinite(cost)
                yield pa.record_batch([pa.array(v[found]) for v in (ids, cost, place, near)], ["id", "cost", "place", "near"])

    return run


def _inside(batches):
    for batch in batches:
        for i in range(len(batch)):
            found = [
                np.frombuffer(batch.column(c)[i].as_py(), kind)
                for c, kind in (("ids", np.int64), ("cost", np.float64), ("place", np.int64), ("near", np.int64))
            ]
            paired = np.isfinite(found[1])
            yield pa.record_batch([pa.array(v[paired]) for v in found], ["id", "cost", "place", "near"])


def _open_groups(columns: int, groups: list[tuple]):
    """(block, o_run) for every run of blocks that may hold a nearer partner."""
    table = np.array([g[1:] for g in groups], float)
    numbers = np.array([g[0] for g in groups], np.int64)

    def run(batches):
        for batch in batches:
            box = np.column_stack([batch.column(c).to_numpy() for c in _box(columns)])
            n, room = (batch.column(c).to_numpy()[:, None] for c in ("least_n", "open"))
            gap = np.maximum(
                np.maximum(box[:, None, :columns] - table[:, 1 + columns :], table[:, 1 : 1 + columns] - box[:, None, columns:]), 0.0
            )
            least = (gap**2).sum(axis=2) * (n * table[:, 0] / (n + table[:, 0])) * (1 - 1e-9)
            row, place = np.nonzero(least <= room)
            yield pa.record_batch([batch.column("block").take(pa.array(row)), pa.array(numbers[place])], ["block", "o_run"])

    return run


def nearest_partners(clusters: DataFrame, columns: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table (id, near, cost): for every cluster (id, n, x0, x1, ...) the
    partner whose merging costs least, exactly.

    Clusters are sorted along a curve through space, cut into runs and these into
    blocks.  A cluster's nearest inside the run bounds what it asks of blocks of other
    runs: of those whose box and least size leave room for a nearer one, which is asked
    of whole runs first.  Only asking clusters are sent on.  Of the runs, one per
    ``RUN_BLOCKS * block_rows`` clusters, the boxes reach every task.

    A block is little data but much work, so the parts follow the count of blocks."""
    axes, box = _axes(columns), _box(columns)
    ends = clusters.agg(*[F.min(c) for c in axes], *[F.max(c) for c in axes], F.count(F.lit(1))).first()
    low, high, rows = np.array(ends[:columns]), np.array(ends[columns:-1]), ends[-1]
    kinds = "id long, n double, " + ", ".join(f"{c} double" for c in axes)
    coded = clusters.select("id", "n", *axes).mapInArrow(_codes(columns, low, high), kinds + ", code long")
    shape = (
        "block long, run long, ids binary, n binary, x binary, cost binary, place binary, near binary, "
        "least_n double, open double, " + ", ".join(f"{c} double" for c in box)
    )
    cores, count = clusters.sparkSession.sparkContext.defaultParallelism, blocks_for(rows, block_rows)
    runs = max(blocks_for(count, RUN_BLOCKS), min(cores, count))
    parts = max(blocks_for(count, RUN_BLOCKS), min(4 * cores, count))
    ordered = coded.repartitionByRange(runs, "code", "id").sortWithinPartitions("code", "id")
    blocks = durable(ordered.mapInArrow(_blocks(columns, block_rows), shape))
    summary = blocks.select("block", "run", "least_n", "open", *box)
    grouped = summary.groupBy("run").agg(
        F.min("least_n"), *[(F.min if c.startswith("low") else F.max)(c) for c in box]
    )
    open_groups = summary.mapInArrow(_open_groups(columns, [tuple(r) for r in grouped.collect()]), "block long, o_run long")
    facing = summary.select(F.col("run").alias("o_run"), *[F.col(c).alias(f"o_{c}") for c in ("block", "least_n", *box)])
    asks = (
        open_groups.join(facing, "o_run")
        .join(summary, "block").where((F.col("run") != F.col("o_run")) & (_apart(columns, "", "o_") <= F.col("open")))
        .select("block", *[f"o_{c}" for c in ("block", "least_n", *box)])
    )
    packed = ("ids", "n", "x")
    asking = blocks.select("block", *packed, "cost").repartition(parts, "block").groupBy("block")
    requests = asking.cogroup(asks.repartition(parts, "block").groupBy("block")).applyInArrow(
        _requests(columns), "o_block long, ids binary, n binary, x binary, cost binary"
    )
    others = blocks.select(F.col("block").alias("o_block"), *[F.col(c).alias(f"o_{c}") for c in packed])
    pairs = requests.repartition(parts, "o_block").join(others, "o_block")
    kind = "id long, cost double, place long, near long"
    found = pairs.mapInArrow(_between(columns), kind).unionByName(blocks.mapInArrow(_inside, kind))
    best = found.groupBy("id").agg(F.min(F.struct("cost", "place", "near")).alias("best"))
    nearest = durable(best.select("id", "best.near", "best.cost"))
    discard(blocks)
    return nearest


def exact_merges(points: DataFrame, columns: int, finish: int = FINISH, block_rows: int = BLOCK_ROWS):
    """Ward's merge tree over the rows (id, n, x0, x1, ...) of a written table.

    In each round all pairs of clusters that are each other's cheapest partner merge,
    which Ward's cost allows in any order; when at most ``finish`` clusters are left,
    these are merged at the driver.  Returns the rounds' merges, one written table
    (id, into, cost) each, and the driver's as (cost, into, id); a merged cluster keeps the
    id ``into``."""
    axes = _axes(columns)
    clusters, rounds = points, []
    while clusters.count() > finish:
        near = nearest_partners(clusters, columns, block_rows)
        back = near.select(F.col("id").alias("near"), F.col("near").alias("again"))
        mutual = near.join(back, "near").where("again = id AND id > near")
        merged = durable(mutual.select("id", F.col("near").alias("into"), "cost"))
        absorbed = merged.join(clusters, "id").select(F.col("into").alias("id"), F.col("n").alias("m"), *[F.col(c).alias(f"o_{c}") for c in axes])
        total = F.col("n") + F.col("m")
        joined = clusters.join(merged.select("id"), "id", "left_anti").join(absorbed, "id", "left")
        mean = [
            F.when(F.col("m").isNull(), F.col(c)).otherwise((F.col("n") * F.col(c) + F.col("m") * F.col(f"o_{c}")) / total).alias(c)
            for c in axes
        ]
        following = durable(joined.select("id", F.coalesce(total, F.col("n")).alias("n"), *mean))
        discard(near)
        if clusters is not points:
            discard(clusters)
        clusters = following
        rounds.append(merged)
    last = clusters.toPandas().sort_values("id")  # at most ``finish`` clusters
    ids = last["id"].to_numpy()
    merges = ward_merges(last["n"].to_numpy(), last[axes].to_numpy(dtype=float)) if len(last) else []
    own = [(cost, int(ids[a]), int(ids[b])) for cost, a, b in merges]
    return rounds, own


def distinct_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A written table (id, n, x0, x1, ...) of the distinct rows; equal rows merge at no
    cost."""
    named = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    counted = named.groupBy(*_axes(len(columns))).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return durable(counted.withColumn("id", F.monotonically_increasing_id()))


def _cut(points: DataFrame, rounds: list[DataFrame], own: list[tuple], ks: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(id, end) for every point and (end, cluster_<k> ...) for every end.

    A cut into k leaves out the k - 1 highest merges.  Every point looks up its *end*, the
    first cluster on its way up that such a merge took in or that reached the driver, by
    doubling along the rounds' merges; ends are few and get their labels at the driver,
    numbered from the largest cluster down."""
    most = max(ks) - 1
    highest = list(own)
    merges = durable(reduce(DataFrame.unionByName, rounds)) if rounds else None
    if merges is not None:
        highest += [(r.cost, r.into, r.id) for r in merges.orderBy(F.desc("cost"), "id").limit(most).collect()]
    highest = sorted(highest, key=lambda m: (-m[0], m[2]))[:most]
    taken = {b: a for _, a, b in highest}
    ends = points.select("id", F.col("id").alias("end"))
    if merges is not None:
        cut = [int(b) for b in taken]
        jumps = durable(merges.where(~F.col("id").isin(cut)).select("id", F.col("into").alias("end")))
        while True:
            further = jumps.select(F.col("id").alias("end"), F.col("end").alias("next"))
            longer = durable(jumps.join(further, "end", "left").select("id", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("more")))
            discard(jumps)
            jumps = longer
            if jumps.where("more").isEmpty():
                break
        ends = points.select("id").join(jumps.select("id", "end"), "id", "left").select("id", F.coalesce("end", "id").alias("end"))
    ends = durable(ends)
    # at most the driver's clusters and the highest merges
    sums = ends.join(points, "id").groupBy("end").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x0")).alias("x")).collect()
    above = {r.id: r.end for r in ends.where(F.col("id").isin([int(a) for a in taken.values()])).collect()}
    parent = {b: a for _, a, b in own}

    def root(node: int, closed: set[int]) -> int:
        while node not in closed:
            if node in parent:
                node = parent[node]
            elif node in taken:
                node = above[taken[node]]
            else:
                break
        return node

    rows = {r.end: [] for r in sums}
    for k in ks:
        closed = {b for _, _, b in highest[: k - 1]}
        size: dict[int, list[float]] = {}
        for r in sums:
            held = size.setdefault(root(r.end, closed), [0.0, 0.0])
            held[0] += r.n
            held[1] += r.x
        names = sorted(size, key=lambda c: (-size[c][0], size[c][1] / size[c][0]))
        for end, found in rows.items():
            found.append(names.index(root(end, closed)))
    shape = "end long, " + ", ".join(f"cluster_{k} int" for k in ks)
    labels = points.sparkSession.createDataFrame([(int(e), *found) for e, found in rows.items()], shape)
    return ends, labels


def ward(
    df: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int] = KS,
    key: str = "user_id",
    condense_to: int | None = None,
    seed: int = SEED,
    finish: int = FINISH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows with one label column ``cluster_<k>`` per requested k.

    Exact by default; with ``condense_to`` k-means first condenses the rows to so many
    centroids, and only these are merged.  Rows with a missing value are an error."""
    if condense_to is None:
        checked = durable(df.withColumns({
            c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing"))) for c in columns
        }))
        points = distinct_points(checked, columns)
        rows = checked.join(
            points.select("id", *[F.col(f"x{i}").alias(f"_x{i}") for i in range(len(columns))]),
            reduce(and_, [F.col(c).cast("double") == F.col(f"_x{i}") for i, c in enumerate(columns)]),
        ).drop(*[f"_x{i}" for i in range(len(columns))]).withColumnRenamed("id", "_id")
    else:
        rows, table = micro_clusters(df, columns, condense_to, seed)
        rows = rows.withColumn("_id", F.col("_micro").cast("long"))
        names = {c: f"x{i}" for i, c in enumerate(columns)}
        points = durable(table.select(F.col("_micro").cast("long").alias("id"), "n", *[F.col(c).alias(n) for c, n in names.items()]))
    rounds, own = exact_merges(points, len(columns), finish, block_rows)
    ends, labels = _cut(points, rounds, own, ks)
    found = ends.join(labels, "end").drop("end").withColumnRenamed("id", "_id")
    return rows.join(found, "_id").select(*df.columns, *[f"cluster_{k}" for k in ks])


def merge_heights(df: DataFrame, columns: Sequence[str], finish: int = FINISH, block_rows: int = BLOCK_ROWS) -> list[float]:
    """Costs of all merges of distinct rows, lowest first, for tables that fit the driver."""
    rounds, own = exact_merges(distinct_points(df, columns), len(columns), finish, block_rows)
    return sorted([m[0] for m in own] + [r.cost for t in rounds for r in t.collect()])
