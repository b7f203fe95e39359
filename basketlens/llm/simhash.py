"""SimHash fingerprints and the links between near ones.

A fingerprint bit is set if it is set in more than half of a text's shingle hashes.
Equal fingerprints are one node from the start.  Nodes are embedded as vectors of bit
counts over short segments; the Manhattan distance of two such vectors never exceeds
the number of differing bits.  If at most ``max_bits`` bits differ, then in one of
``groups`` groups of segments the distance is at most ``max_bits // groups``: with
the default three groups and four bits, at most one.  So every node goes to its own
grid cell in each group, and as a visitor to the cells one step above it; two near
nodes meet in a cell as two owners or as visitor and owner.  Pairs that meet are
verified on the 64 bits.

Cells are compared in blocks of at most ``block`` owners: a fuller cell is dealt into
blocks and every two of its blocks meet in a group of their own, so no task holds a
cell whatever its size.  A group hands on a spanning forest of its links, never all
pairs of a cluster; the forest keeps every connection.

Cases: a missing or wordless text has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows are linked and each keeps
its row; rows with a missing key are linked, but a component is named by its smallest
key present (missing if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.llm.components import components
from basketlens.session import durable

SEED = 42
BITS = 64
SEGMENT = 2


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes (none: zero)."""
    totals = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * totals > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """Rows (key, own, fp): ``own`` is a hash of the text, ``fp`` the fingerprint as a
    signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            prints = np.array(
                [fingerprint(column[i].as_py() or "", shingle) for i in range(len(column))], np.uint64
            )
            yield pa.record_batch(
                [batch.column("key"), batch.column("own"), pa.array(prints.view(np.int64))], ["key", "own", "fp"]
            )

    picked = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("text")
    )
    id_type = docs.schema[key].dataType.simpleString()
    return picked.mapInArrow(run, f"key {id_type}, own long, fp long")


def _segment_counts(first: int, count: int) -> list[Column]:
    """Set bits of ``count`` segments of the fingerprint, from segment ``first`` on."""
    mask = (1 << SEGMENT) - 1
    return [
        F.bit_count(F.shiftright("fp", SEGMENT * (first + j)).bitwiseAND(F.lit(mask)))
        for j in range(count)
    ]


def grid(nodes: DataFrame, groups: int) -> DataFrame:
    """Rows (fp, group, cell, visitor): own cells, and those one step above."""
    segments = BITS // SEGMENT
    parts = []
    for g in range(groups):
        first = g * segments // groups
        count = (g + 1) * segments // groups - first
        # cells are numbers in base SEGMENT + 2, so that a step never carries
        places = [(SEGMENT + 2) ** j for j in range(count)]
        cell = sum((c.cast("long") * p for c, p in zip(_segment_counts(first, count), places)), F.lit(0))
        owner = F.struct(cell.cast("long").alias("cell"), F.lit(False).alias("visitor"))
        visits = [
            F.struct((cell + p).cast("long").alias("cell"), F.lit(True).alias("visitor"))
            for p in places
        ]
        parts.append(
            nodes.select("fp", F.lit(g).alias("group"), F.inline(F.array(owner, *visits)))
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union


class _Meeting:
    """The nodes that meet in one group, and the forest of the links found so far."""

    def __init__(self, nodes: np.ndarray, max_bits: int):
        self.nodes, self.max_bits = nodes, max_bits
        self.tree = np.arange(len(nodes))
        self.links: list[tuple[int, int]] = []

    def compare(self, left: range, right: range, tile: int = 1024) -> None:
        """Link every node of ``left`` to those of ``right``; equal ranges once."""
        for i in range(left.start, left.stop, tile):
            a = self.nodes[i : min(i + tile, left.stop)]
            for j in range(i if left == right else right.start, right.stop, tile):
                b = self.nodes[j : min(j + tile, right.stop)]
                near = np.bitwise_count(a[:, None] ^ b[None, :]) <= self.max_bits
                for row in np.flatnonzero(near.any(axis=1)).tolist():
                    self._join(i + row, j + np.flatnonzero(near[row]))

    def _join(self, one: int, others: np.ndarray) -> None:
        trees, at = np.unique(self.tree[others], return_index=True)
        for tree, other in zip(trees.tolist(), others[at].tolist()):
            if tree != self.tree[one]:
                self.tree[self.tree == tree] = self.tree[one]
                self.links.append((one, other))


def _link(max_bits: int):
    def forest(fps: np.ndarray, role: np.ndarray, visitors: bool) -> np.ndarray:
        # roles: 0 owners of the first block, 1 those of the second block or visitors
        order = np.argsort(role, kind="stable")
        first = int((role == 0).sum())
        meeting = _Meeting(fps[order], max_bits)
        own, other = range(first), range(first, len(fps))
        if len(other):
            meeting.compare(own, other)
        elif not visitors:
            meeting.compare(own, own)
        return meeting.nodes[np.array(meeting.links, np.int64).reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by meeting; the last one of a batch may go on in the next."""
        rest: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            fps = table.column("fp").to_numpy().view(np.uint64)
            role = table.column("role").to_numpy()
            keys = [table.column(c).to_numpy() for c in ("group", "cell", "x", "y")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *change.tolist(), len(fps)]
            found = [np.zeros((0, 2), np.uint64)]
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    found.append(forest(fps[a:b], role[a:b], keys[3][a] < 0))
            pairs = np.concatenate(found).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(c)[len(batch) - 1] for c in ("group", "cell", "x", "y")]
            same = np.all([batch.column(c).to_numpy() == v.as_py() for c, v in zip(("group", "cell", "x", "y"), last)], axis=0)
            cut = int(np.argmax(same))
            if cut or (rest and [rest[-1].column(c)[0] for c in ("group", "cell", "x", "y")] != last):
                yield emit(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield emit(pa.Table.from_batches(rest))

    return run


def links(nodes: DataFrame, max_bits: int = 4, groups: int = 3, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect all nodes ``fp`` with at most ``max_bits`` differing
    bits, without listing all pairs of a cluster."""
    if max_bits // groups > 1:
        raise ValueError("more bits need more groups: a visitor goes one step only")
    spread = grid(nodes, groups)
    sizes = durable(
        spread.groupBy("group", "cell").agg(
            F.count_if(~F.col("visitor")).alias("owners"), F.count_if("visitor").alias("visitors")
        )
        # a cell needs an owner and somebody to meet
        .where("owners > 0 AND owners + visitors > 1")
    )
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    placed = spread.join(
        sizes.select("group", "cell", blocks("owners").alias("n"), blocks("visitors").alias("m")), ["group", "cell"]
    ).withColumn("mine", F.pmod(F.xxhash64("fp"), F.when(F.col("visitor"), F.col("m")).otherwise(F.col("n"))).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("n") - 1)
    # meetings: (x, y) of two owner blocks, x <= y; (x, -1 - y) of owner block x and visitor block y
    with_owners = F.transform(
        numbers,
        lambda k: F.struct(
            F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y"),
            (k < F.col("mine")).cast("int").alias("role"),
        ),
    )
    with_visitors = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda k: F.struct(F.col("mine").alias("x"), (-1 - k).alias("y"), F.lit(0).alias("role")),
    )
    as_visitor = F.transform(
        numbers, lambda k: F.struct(k.alias("x"), (-1 - F.col("mine")).alias("y"), F.lit(1).alias("role"))
    )
    as_owner = F.when(F.col("m") > 0, F.concat(with_owners, with_visitors)).otherwise(with_owners)
    meetings = F.when(F.col("visitor"), as_visitor).otherwise(as_owner)
    met = placed.select("fp", "group", "cell", F.inline(meetings))
    keys = ["group", "cell", "x", "y"]
    sorted_cells = met.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_cells.mapInArrow(_link(max_bits), "a long, b long").distinct()


def rooted(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int, groups: int) -> DataFrame:
    """Rows (key, own, fp, root): ``root`` is the same within a component only."""
    prints = durable(fingerprints(docs, key, text, shingle))
    nodes = durable(prints.select("fp").distinct())
    roots = durable(components(durable(links(nodes, max_bits, groups))))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "key", "own", "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    groups: int = 3,
) -> DataFrame:
    """``key``, ``fp`` (signed 64 bits) and ``component_id`` for every document."""
    found = rooted(docs, key, text, shingle, max_bits, groups)
    named = found.groupBy(F.col("root").alias("of")).agg(F.min("key").alias("component_id"))
    return found.join(named, F.col("root") == F.col("of")).select(
        F.col("key").alias(key), "fp", "component_id"
    )


def keep_one(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    groups: int = 3,
) -> DataFrame:
    """One document of each component, as it is: the one with the smallest key."""
    found = rooted(docs, key, text, shingle, max_bits, groups)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "own")).alias("one")
    ).select(F.col("one.key").alias("one_key"), F.col("one.own").alias("one_own"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("key"),
        F.xxhash64(F.col(text)).alias("own"),
    )
    chosen = rows.join(first, F.col("key").eqNullSafe(F.col("one_key")) & (F.col("own") == F.col("one_own")))
    # repeated rows agree in key and text; one of them stays
    repeated = Window.partitionBy("key", "own").orderBy(F.xxhash64("row"))
    return chosen.withColumn("turn", F.row_number().over(repeated)).where("turn = 1").select("row.*")
