"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``.

A conversation's rows, in turn order, become legal (perhaps a system turn, then user and
assistant turns in pairs, or nothing) by keeping a row, giving it the role that is due,
deleting it, or inserting an empty turn.  Blank rows and repeats of an earlier row must
go; a truncated row that stays costs extra.  The *audit* is the letters of the edits
(D, I, K, R) in order; of the cheapest edits the one with the least audit is taken, and
since the due role follows from what stands before, the audit fixes the repair.

Method, a Viterbi search over the four states of the grammar (nothing yet, after a
system, user, assistant turn), parallel within a conversation by rank convergence:

* rows are range partitioned and sorted by conversation and turn, and cut into chunks of
  at most ``chunk_rows`` rows, so neither a task nor a row holds an unbounded conversation;
* backward: every chunk computes the costs to the end of the conversation from a
  speculative vector at its end; in fix-up passes a chunk whose follower has begun with
  another vector runs again from that one, only until the old and the new vector differ
  by a constant; passes end when no chunk's vector changes;
* forward: the stitched costs decide every step; a chunk is traced from each of the four
  states, and chunks' maps from entry to exit state are composed by doubling until they
  no longer depend on the entry.

Chunks whose rows must all be deleted shift every cost alike and are passed over in the
fix-up.  Cost vectors are interned up to constants: few exist, so a row costs a
table look-up.  Conversations inside one chunk, nearly all, take one pass and no join.

Cases: missing keys are one conversation; a missing role or text is a single space (so
the row is blank); missing turns come first and count in no gap; rows with equal turns
are ordered by role, then by a hash of role and text; repeated rows are duplicates; no
rows give no chunks.  ``turn`` is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from basketlens.llm.columns import BLANKS
from basketlens.session import durable

CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
# role initials by code; a symbol is an initial, 4 more if truncated, or GONE
INITIALS = {"s": 1, "u": 2, "a": 3}
TRUNCATED, BLANK, GONE = 4, 8, 8
LEGAL = {(1, 2), (2, 3), (3, 2)}
# the state after each state and initial, and the role that is due in each state
NEXT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
DUE = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
# what is still inserted after the last row
TAIL = ("", "II", "I", "")


class Search:
    """Backward costs and forward steps as tables over interned vectors."""

    def __init__(self, rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5):
        self.rerole, self.delete, self.insert, self.truncated = rerole, delete, insert, truncated
        self.at_end = tuple(insert * len(t) for t in TAIL)
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.backward: list[list] = []
        self.forward: list[list] = []

    def intern(self, vector) -> tuple[int, int]:
        """Number of a vector up to constants, and the constant."""
        low = min(vector)
        shape = tuple(int(v - low) for v in vector)
        number = self.known.get(shape)
        if number is None:
            number = self.known[shape] = len(self.vectors)
            self.vectors.append(shape)
            self.backward.append([None] * 9)
            self.forward.append([None] * 9)
        return number, int(low)

    def _edits(self, after: tuple[int, ...], symbol: int, state: int) -> list[tuple[int, str, int]]:
        """(cost to the end, letter, next state) of the edits that use the row up."""
        out = [(self.delete + after[state], "D", state)]
        if symbol != GONE:
            extra = self.truncated * (symbol >= TRUNCATED)
            kept = NEXT.get((state, symbol % TRUNCATED))
            if kept is not None:
                out.append((extra + after[kept], "K", kept))
            due = NEXT[state, DUE[state]]
            out.append((self.rerole + extra + after[due], "R", due))
        return out

    def _before(self, after: tuple[int, ...], symbol: int) -> list[int]:
        costs = [min(self._edits(after, symbol, s))[0] for s in range(4)]
        for _ in range(3):
            costs = [min(costs[s], self.insert + costs[NEXT[s, DUE[s]]]) for s in range(4)]
        return costs

    def back(self, number: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, and what all its costs have grown by."""
        found = self.backward[number][symbol]
        if found is None:
            found = self.backward[number][symbol] = self.intern(self._before(self.vectors[number], symbol))
        return found

    def step(self, number: int, symbol: int, state: int) -> tuple[str, int, int]:
        """Least letters up to the row's own, the state after it, and their cost."""
        found = self.forward[number][symbol]
        if found is None:
            found = self.forward[number][symbol] = [self._step(number, symbol, s) for s in range(4)]
        return found[state]

    def _step(self, number: int, symbol: int, state: int) -> tuple[str, int, int]:
        after = self.vectors[number]
        before = self._before(after, symbol)
        letters = ""
        start = state
        while True:
            best = [(x, s) for cost, x, s in self._edits(after, symbol, state) if cost == before[state]]
            due = NEXT[state, DUE[state]]
            if self.insert + before[due] == before[state]:
                best.append(("I", due))
            letter, state = min(best)
            letters += letter
            if letter != "I":
                spent = before[start] - after[state]
                return letters, state, spent

    def start(self, symbols: list[int], end: tuple[int, ...]) -> tuple[int, ...]:
        """The vector before the first symbol, given the one after the last."""
        number, total = self.intern(end)
        for symbol in reversed(symbols):
            number, grown = self.back(number, symbol)
            total += grown
        return tuple(total + v for v in self.vectors[number])

    def fix(self, symbols: list[int], old_end, new_end, old_start) -> tuple[int, ...]:
        """``start`` for ``new_end``, run only until both ends' vectors agree up to a
        constant."""
        old, a = self.intern(old_end)
        new, b = self.intern(new_end)
        for symbol in reversed(symbols):
            if old == new:
                return tuple(v + b - a for v in old_start)
            old, grown = self.back(old, symbol)
            a += grown
            new, grown = self.back(new, symbol)
            b += grown
        return tuple(b + v for v in self.vectors[new])

    def vectors_after(self, symbols: list[int], end) -> list[int]:
        number, _ = self.intern(end)
        out = [0] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            out[i] = number
            number, _ = self.back(number, symbols[i])
        return out

    def trace(self, symbols: list[int], after: list[int], state: int) -> tuple[list[str], int, int]:
        """Letters row by row, the state at the end, the cost of the letters."""
        out, cost = [], 0
        for symbol, number in zip(symbols, after):
            letters, state, spent = self.step(number, symbol, state)
            out.append(letters)
            cost += spent
        return out, state, cost


@cache
def _search(costs: tuple[int, ...]) -> Search:
    return Search(*costs)


# -- chunks ------------------------------------------------------------------------

_ROWS = "turns array<long>, roles array<string>, texts array<string>, codes array<int>, h1 array<long>, h2 array<long>"
_NAMES = ("turn", "role", "text", "code", "h1", "h2")
_LISTS = ("turns", "roles", "texts", "codes", "h1", "h2")


def _prepared(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    named = rows.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*[F.when(first == x, F.lit(n)) for x, n in INITIALS.items()], F.lit(0))
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return named.select(
        "*", (initial + fault).alias("code"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"),
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column has another value than the row before; the first row does."""
    a, b = column[:-1], column[1:]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])


def _pack(chunk_rows: int, chunk_bytes: int):
    def packed(part, first, keys, data, offsets, whole) -> pa.RecordBatch:
        n = len(offsets) - 1
        spans = pa.array(offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(spans, data.column(c)) for c in _NAMES]
        return pa.record_batch(
            [pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), keys, pa.array(whole, pa.bool_()), *lists],
            ["part", "seq", "key", "whole", *_LISTS],
        )

    def sizes(data: pa.RecordBatch) -> np.ndarray:
        return pc.binary_length(data.column("text")).to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        # the open conversation's rows; whether it was cut, and is the partition's first
        held, rows, size, cut, leading = [], 0, 0, False, True

        def shut(whole: bool) -> pa.RecordBatch:
            data = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return packed(part, seq, data.column("key")[:1], data, [0, len(data)], [whole])

        for batch in batches:
            if not len(batch):
                continue
            starts = np.flatnonzero(_changes(batch.column("key")))
            if held and _changes(pa.concat_arrays([held[-1].column("key")[-1:], batch.column("key")[:1]]))[1]:
                yield shut(not (cut or leading))
                held, rows, size, cut, leading, seq = [], 0, 0, False, False, seq + 1
            ends = np.append(starts[1:], len(batch))
            total = np.concatenate([[0], np.cumsum(sizes(batch))])
            small = (ends - starts <= chunk_rows) & (total[ends] - total[starts] <= chunk_bytes)
            at = 0
            while at < len(starts):
                inner = bool(at) or not held
                if inner and not leading and small[at] and at < len(starts) - 1:
                    # conversations that begin and end in this batch, as many as follow
                    to = at
                    while to < len(starts) - 1 and small[to]:
                        to += 1
                    low, high = starts[at], starts[to]
                    data = batch.slice(low, high - low)
                    yield packed(
                        part, seq, batch.column("key").take(pa.array(starts[at:to])), data,
                        np.append(starts[at:to], high) - low, [True] * (to - at),
                    )
                    seq += to - at
                    at = to
                    continue
                low, end = starts[at], ends[at]
                while low < end:
                    high = int(np.searchsorted(total, total[low] + max(chunk_bytes - size, 0), "right")) - 1
                    high = min(max(high, low + (not held)), low + chunk_rows - rows, end)
                    if high > low:
                        held.append(batch.slice(low, high - low))
                        rows, size, low = rows + int(high - low), size + int(total[high] - total[low]), high
                    if low < end:
                        yield shut(False)
                        held, rows, size, cut, seq = [], 0, 0, True, seq + 1
                if at < len(starts) - 1:
                    yield shut(not (cut or leading))
                    held, rows, size, cut, leading, seq = [], 0, 0, False, False, seq + 1
                at += 1
        if held:
            yield shut(False)

    return run


def _symbols(codes: np.ndarray, repeated: np.ndarray) -> list[int]:
    return np.where((codes >= BLANK) | repeated, GONE, codes % BLANK).tolist()


def _repeated(h1: np.ndarray, h2: np.ndarray, earlier: set | None = None) -> np.ndarray:
    """Rows whose role and text an earlier row has."""
    seen = set() if earlier is None else set(earlier)
    out = np.zeros(len(h1), bool)
    for i, pair in enumerate(zip(h1.tolist(), h2.tolist())):
        if pair in seen:
            out[i] = True
        else:
            seen.add(pair)
    return out


# -- repaired rows -----------------------------------------------------------------

_OUT = (
    "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "first_initial int, last_initial int, cost long, audit string, repaired array<struct<role:string,text:string>>"
)


def _repaired_row(search: Search, roles, texts, letters: list[str], state: int, tail: str):
    out = []
    for role, text, step in zip(roles, texts, letters):
        for letter in step:
            if letter == "D":
                break
            due = DUE[state]
            if letter == "K":
                state = NEXT[state, INITIALS[role[0]]]
                out.append((role, text))
            else:
                state = NEXT[state, due]
                out.append((ROLE[due], "" if letter == "I" else text))
    for _ in tail:
        out.append((ROLE[DUE[state]], ""))
        state = NEXT[state, DUE[state]]
    return out


def _facts(turns: pa.Array, codes: np.ndarray, repeated: np.ndarray) -> tuple:
    there = turns.drop_null().to_numpy(zero_copy_only=False)
    blank = codes >= BLANK
    initials = (codes % TRUNCATED).tolist()
    return (
        int(there[0]) if len(there) else None,
        int(there[-1]) if len(there) else None,
        len(np.unique(there)),
        int(blank.sum()),
        int((repeated & ~blank).sum()),
        int(((codes % BLANK >= TRUNCATED) & ~blank & ~repeated).sum()),
        sum(pair not in LEGAL for pair in zip(initials, initials[1:])),
        initials[0],
        initials[-1],
    )


def _output(rows: list[tuple], keys: pa.Array, more: dict[str, pa.Array]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64(), pa.string()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    repaired = [r[len(kinds)] for r in rows]
    flat = pa.array([{"role": a, "text": b} for r in repaired for a, b in r], pa.struct([("role", pa.string()), ("text", pa.string())]))
    spans = np.concatenate([[0], np.cumsum([len(r) for r in repaired])])
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.record_batch(
        [keys, *more.values(), *columns, pa.ListArray.from_arrays(pa.array(spans, pa.int32()), flat)],
        ["key", *more, *names],
    )


def _solve_whole(costs: tuple[int, ...]):
    """Conversations inside one chunk: costs, trace and rows in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(costs)
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                codes = batch.column("codes")[i].values.to_numpy()
                repeated = _repeated(*(batch.column(c)[i].values.to_numpy() for c in ("h1", "h2")))
                symbols = _symbols(codes, repeated)
                letters, state, cost = search.trace(symbols, search.vectors_after(symbols, search.at_end), 0)
                texts = [batch.column(c)[i].values.to_pylist() for c in ("roles", "texts")]
                rows.append((
                    *_facts(batch.column("turns")[i].values, codes, repeated),
                    cost + search.at_end[state], "".join(letters) + TAIL[state],
                    _repaired_row(search, *texts, letters, 0, TAIL[state]),
                ))
            yield _output(rows, batch.column("key"), {"chunk": pa.array([None] * len(rows), pa.int64())})

    return run


# -- conversations of several chunks -----------------------------------------------


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks that may not hold all of their conversation, with ``idx``, their place in
    the order of all of them, and ``conv``, the first ``idx`` of their conversation."""
    split = chunks.where(~F.col("whole"))
    parts = split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a partition's chunks, as many as it packed
    place = F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1
    narrow = split.select("part", "seq", "key").withColumn("place", place).join(bases, "part")
    idx = (F.col("base") + F.col("place")).alias("idx")
    numbered = durable(narrow.select("part", "seq", "key", idx))
    convs = numbered.groupBy(F.col("key").alias("k")).agg(F.min("idx").alias("conv"), F.max("idx").alias("end"))
    return durable(
        numbered.join(convs, F.col("key").eqNullSafe(F.col("k")))
        .select("part", "seq", "idx", "conv", (F.col("idx") == F.col("end")).alias("last"))
    )


def _earlier(chunks: DataFrame) -> DataFrame:
    """For each chunk the hashes of its rows that an earlier chunk of its conversation has."""
    pairs = chunks.select(
        "conv", "idx", F.explode(F.array_distinct(F.arrays_zip("h1", "h2"))).alias("h")
    )
    firsts = pairs.groupBy("conv", "h").agg(F.min("idx").alias("first"))
    late = pairs.join(firsts, ["conv", "h"]).where("idx > first")
    # at most a chunk's rows
    return late.groupBy("idx").agg(F.collect_list("h").alias("earlier"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of each chunk, and whether any row may stay."""
    for batch in batches:
        out, live = [], []
        for i in range(len(batch)):
            codes, h1, h2 = (batch.column(c)[i].values.to_numpy() for c in ("codes", "h1", "h2"))
            earlier = batch.column("earlier")[i].as_py() or []
            symbols = _symbols(codes, _repeated(h1, h2, {(h["h1"], h["h2"]) for h in earlier}))
            out.append(bytes(symbols))
            live.append(any(s != GONE for s in symbols))
        yield pa.record_batch(
            [*[batch.column(c) for c in ("idx", "conv", "last")], pa.array(out, pa.binary()), pa.array(live)],
            ["idx", "conv", "last", "symbols", "live"],
        )


_VECTORS = "idx long, conv long, place long, end array<long>, start array<long>"


def _speculate(costs: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(costs)
        for batch in batches:
            starts = [search.start(list(s.as_py()), search.at_end) for s in batch.column("symbols")]
            yield pa.record_batch(
                [*[batch.column(c) for c in ("idx", "conv", "place")], pa.array([search.at_end] * len(batch), pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
                ["idx", "conv", "place", "end", "start"],
            )

    return run


def _fix_up(costs: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(costs)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("symbols", "end", "want", "start")]
            starts = [search.fix(list(s), end, want, start) for s, end, want, start in zip(*columns)]
            yield pa.record_batch(
                [*[batch.column(c) for c in ("idx", "conv", "place", "want")], pa.array(starts, pa.list_(pa.int64()))],
                ["idx", "conv", "place", "end", "start"],
            )

    return run


def _stitched(marked: DataFrame, costs: tuple[int, ...]) -> DataFrame:
    """(idx, end): the vector after each chunk with rows that may stay, up to a constant."""
    # each partition's share of the chunks in order, then a prefix over partitions
    live = marked.where("live")
    blocks = F.floor(F.col("idx") / 4096)
    sizes = live.groupBy(blocks.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("idx")) - 1
    ordered = live.withColumn("block", blocks).withColumn("inside", inside).join(bases, "block")
    ordered = durable(ordered.select("idx", "conv", "symbols", (F.col("base") + F.col("inside")).alias("place")))
    vectors = durable(ordered.mapInArrow(_speculate(costs), _VECTORS))
    while True:
        follower = vectors.select(
            (F.col("place") - 1).alias("place"), "conv",
            F.transform("start", lambda v: v - F.array_min("start")).alias("want"),
        )
        wanted = vectors.join(follower, ["place", "conv"])
        shape = F.transform("end", lambda v: v - F.array_min("end"))
        changed = durable(wanted.where(shape != F.col("want")))
        if changed.isEmpty():
            return vectors.select("idx", "end")
        rerun = changed.join(ordered.select("idx", "symbols"), "idx").mapInArrow(_fix_up(costs), _VECTORS)
        vectors = durable(vectors.join(changed.select("idx"), "idx", "left_anti").unionByName(rerun))


def _exits(costs: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(costs)
        for batch in batches:
            exits = []
            for symbols, end in zip(batch.column("symbols").to_pylist(), batch.column("end").to_pylist()):
                symbols = list(symbols)
                after = search.vectors_after(symbols, end or search.at_end)
                exits.append([search.trace(symbols, after, s)[1] for s in range(4)] if end else [0, 1, 2, 3])
            yield pa.record_batch(
                [batch.column("idx"), batch.column("conv"), pa.array(exits, pa.list_(pa.int32()))],
                ["idx", "conv", "exits"],
            )

    return run


def _entries(ended: DataFrame, costs: tuple[int, ...]) -> DataFrame:
    """(idx, entry): the state in which each chunk is entered."""
    maps = durable(ended.mapInArrow(_exits(costs), "idx long, conv long, exits array<int>"))
    step = 1
    while True:
        # a map from the conversation's first chunk on, or one that does not depend on its entry, is settled
        open_ = (F.col("idx") - F.col("conv") >= step) & (F.size(F.array_distinct("exits")) > 1)
        if maps.where(open_).isEmpty():
            break
        earlier = maps.select((F.col("idx") + step).alias("idx"), "conv", F.col("exits").alias("first"))
        both = F.transform("first", lambda s: F.get("exits", s))
        maps = durable(
            maps.join(earlier, ["idx", "conv"], "left")
            .select("idx", "conv", F.when(F.col("first").isNull(), F.col("exits")).otherwise(both).alias("exits"))
        )
        step *= 2
    return maps.select((F.col("idx") + 1).alias("idx"), F.col("conv"), F.col("exits")[0].alias("entry"))


def _solve_parts(costs: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(costs)
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                codes = batch.column("codes")[i].values.to_numpy()
                symbols = list(batch.column("symbols")[i].as_py())
                repeated = (np.array(symbols) == GONE) & (codes < BLANK)
                entry = batch.column("entry")[i].as_py() or 0
                end = batch.column("end")[i].as_py() or search.at_end
                letters, state, cost = search.trace(symbols, search.vectors_after(symbols, end), entry)
                tail = TAIL[state] if batch.column("last")[i].as_py() else ""
                texts = [batch.column(c)[i].values.to_pylist() for c in ("roles", "texts")]
                rows.append((
                    *_facts(batch.column("turns")[i].values, codes, repeated),
                    cost + search.insert * len(tail), "".join(letters) + tail,
                    _repaired_row(search, *texts, letters, entry, tail),
                ))
            yield _output(rows, batch.column("key"), {"chunk": batch.column("idx")})

    return run


def _solved(
    rows: DataFrame, key: str, turn: str, role: str, text: str, costs: tuple[int, ...], chunk_rows: int, chunk_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Conversations in one chunk, and the chunks of all others."""
    kind = rows.schema[key].dataType.simpleString()
    prepared = durable(_prepared(rows, key, turn, role, text))
    # rows alike in all but the last are interchangeable, but a third of all may be
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h1", "tie"]
    ordered = (
        prepared.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    )
    chunks = durable(
        ordered.mapInArrow(_pack(chunk_rows, chunk_bytes), f"part int, seq long, key {kind}, whole boolean, {_ROWS}")
    )
    out = f"key {kind}, chunk long, {_OUT}"
    simple = chunks.where("whole").mapInArrow(_solve_whole(costs), out)

    split = durable(chunks.where(~F.col("whole")).join(_numbered(chunks), ["part", "seq"]))
    marked = durable(
        split.select("idx", "conv", "last", "codes", "h1", "h2")
        .join(_earlier(split), "idx", "left")
        .mapInArrow(_mark, "idx long, conv long, last boolean, symbols binary, live boolean")
    )
    ended = durable(marked.join(_stitched(marked, costs), "idx", "left"))
    entries = _entries(ended, costs)
    pieces = split.drop("conv", "last").join(ended.join(entries, ["idx", "conv"], "left"), "idx")
    return simple, pieces.mapInArrow(_solve_parts(costs), out)


def repair(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rerole: int = 1,
    delete: int = 2,
    insert: int = 5,
    truncated: int = 5,
    chunk_rows: int = CHUNK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per chunk: ``key``, chunk (null for a conversation in one piece, else the
    order of its pieces), first_turn, last_turn and turns (distinct ones), the faults blank,
    duplicate, truncated and illegal (neighbours inside the chunk), first and last
    initial, cost, audit and the repaired turns."""
    simple, pieces = _solved(rows, key, turn, role, text, (rerole, delete, insert, truncated), chunk_rows, chunk_bytes)
    return simple.unionByName(pieces).withColumnRenamed("key", key)


def repair_conversations(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    rerole: int = 1,
    delete: int = 2,
    insert: int = 5,
    truncated: int = 5,
    chunk_rows: int = CHUNK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """As :func:`repair`, one row per conversation, which must fit in one."""
    simple, pieces = _solved(rows, key, turn, role, text, (rerole, delete, insert, truncated), chunk_rows, chunk_bytes)
    columns = ("key", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    both = simple.select(*columns).unionByName(_put_together(pieces).select(*columns))
    return both.withColumnRenamed("key", key)


def _put_together(pieces: DataFrame) -> DataFrame:
    lists = F.sort_array(F.collect_list(F.struct(
        "chunk", "first_turn", "last_turn", "turns", "illegal", "first_initial", "last_initial", "audit", "repaired"
    )))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]

    def total(column: str):
        return F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + x[column])

    def at_edges(rule):
        """For how many neighbouring chunks the rule holds."""
        held = F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: rule(F.get("c", i - 1), F.get("c", i)))
        return F.size(F.filter(held, lambda x: F.coalesce(x, F.lit(False))))

    def illegal(a, b):
        pair = a["last_initial"] * 4 + b["first_initial"]
        return b.isNotNull() & ~pair.isin([4 * x + y for x, y in sorted(LEGAL)])

    return pieces.groupBy("key").agg(lists.alias("c"), *sums).select(
        "key",
        F.array_min(F.transform("c", lambda x: x["first_turn"])).alias("first_turn"),
        F.array_max(F.transform("c", lambda x: x["last_turn"])).alias("last_turn"),
        (total("turns") - at_edges(lambda a, b: a["last_turn"] == b["first_turn"])).alias("turns"),
        "blank", "duplicate", "truncated",
        (total("illegal") + at_edges(illegal)).alias("illegal"),
        "cost",
        F.array_join(F.transform("c", lambda x: x["audit"]), "").alias("audit"),
        F.flatten(F.transform("c", lambda x: x["repaired"])).alias("repaired"),
    )
