"""Removing word sequences that an earlier document already has.

Windows of ``length`` consecutive words are found level by level, since a window can
only repeat if the windows inside it do.  The levels' lengths double up to ``length``
(50: 7, 13, 25, 50).  A level asks, for every window of the next length that can still
repeat, about the one with the smallest hash of its own windows (shared windows share
it).  Windows of the next length around one that a second document has are repeated so
far, and only where all of them are can a window of the length after that repeat.  The
loop ends at ``length``, or as soon as no candidate survives: a repeat longer than
``length`` consists of windows of that length, so further levels find no further words.
At the last level every window left learns whether it also starts in a document with a
smaller key, and all words it covers go.

Windows are compared by 64-bit hashes through :mod:`exchange`.

Cases: a missing or wordless text has no words; a text shorter than a window loses
nothing; windows are judged on the input, so a removed copy still removes others;
repeated rows have equal keys and do not remove each other; rows with a missing key
come after all others and do not remove anything; keys that are not whole numbers are
refused before any job starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from basketlens.llm import exchange
from basketlens.llm.exchange import Chunk, planes, unplanes
from basketlens.llm.textarrays import lowest_of, window_hashes
from basketlens.session import durable

_LAST = np.iinfo(np.int64).max

# words of the first level's windows, at most
FIRST_LENGTH = 7


def _order_keys(chunk: Chunk) -> np.ndarray:
    return chunk.keys.fill_null(_LAST).to_numpy().astype(np.int64)


def _smallest(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted hashes; per hash its smallest and largest key; and for each
    input the place of its hash."""
    distinct, place = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), _LAST)
    high = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, place, keys)
    np.maximum.at(high, place, keys)
    return distinct, low, high, place


def level_lengths(length: int) -> list[int]:
    """Lengths of the levels, each at most twice the one before; the first is short."""
    lengths = [-(-length // 2), length]
    while lengths[0] > FIRST_LENGTH:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


class Levels:
    """The windows of one chunk, level by level: what a level asks, and what its reply
    leaves of the next level."""

    def __init__(self, chunk: Chunk, lengths: list[int]):
        self.lengths = lengths
        self.words = chunk.words
        self.hashes = self.words.hashes()
        self.keys = _order_keys(chunk)[self.words.text_of]
        # starts of windows of the next length that can still repeat
        self.alive = self.words.fits(lengths[1])

    def ask(self, level: int) -> None:
        """Distinct sorted ``hashes`` of the level's windows, and their smallest keys."""
        length = self.lengths[level]
        windows = window_hashes(self.hashes, length)
        if level + 1 < len(self.lengths):
            self.at = lowest_of(windows, self.lengths[level + 1] - length + 1, self.alive)
        else:
            self.at = np.flatnonzero(self.alive)
        self.asked, self.low, self.high, self.place = _smallest(windows[self.at], self.keys[self.at])

    def answer(self, level: int, elsewhere: np.ndarray) -> None:
        """Keep what can repeat at the next length, given which windows do elsewhere."""
        candidate = (elsewhere | (self.low < self.high))[self.place]
        at = self.at[candidate]
        marks = np.zeros(len(self.alive) + 1, np.int64)
        np.add.at(marks, np.maximum(at - (self.lengths[level + 1] - self.lengths[level]), 0), 1)
        np.add.at(marks, at + 1, -1)
        self.alive &= np.cumsum(marks[:-1]) > 0
        if level + 2 < len(self.lengths):
            # the next windows' own windows must all be left
            width = self.lengths[level + 2] - self.lengths[level + 1] + 1
            before = np.concatenate([[0], np.cumsum(self.alive)])
            whole = self.words.fits(self.lengths[level + 2])
            starts = np.flatnonzero(whole)
            whole[starts] = before[starts + width] - before[starts] == width
            self.alive = whole


def _bits(replies: list[bytes], counts: list[int]) -> np.ndarray:
    parts = [
        np.unpackbits(np.frombuffer(r, np.uint8), count=n, bitorder="little").astype(bool)
        for r, n in zip(replies, counts)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _reply(table: pa.Table, level: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    own = table.filter(pa.compute.equal(table.column("level"), level)) if len(table) else table
    counts = [c for c in np.diff(exchange.bucket_bounds(hashes, buckets)).tolist() if c]
    return _bits(exchange.in_order(own), counts)


def _found_elsewhere(hashes: list[np.ndarray], _: list[bytes]) -> list[bytes]:
    """For each chunk's hashes: does another chunk have it too?"""
    every, times = np.unique(np.concatenate(hashes), return_counts=True)
    shared = every[times > 1]
    return [
        np.packbits(np.isin(h, shared, assume_unique=True), bitorder="little").tobytes() for h in hashes
    ]


def _smaller_elsewhere(hashes: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """For each chunk's hashes: is there a smaller key than the chunk's smallest?"""
    keys = [unplanes(e, "<i8") for e in extras]
    every, low, _, place = _smallest(np.concatenate(hashes), np.concatenate(keys))
    smallest = low[place]
    out, at = [], 0
    for own in keys:
        out.append(np.packbits(smallest[at : at + len(own)] < own, bitorder="little").tobytes())
        at += len(own)
    return out


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 13,
    chunk_bytes: int = exchange.CHUNK_BYTES,
    range_bytes: int = exchange.RANGE_BYTES,
) -> DataFrame:
    """``key`` (a whole number), n_words, n_removed and the ``kept`` words of every
    document, joined by single blanks."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"the key {key} must be a whole number")
    lengths = level_lengths(length)
    last = len(lengths) - 1
    packed = exchange.chunks(docs, key, text, chunk_bytes)
    buckets = exchange.ranges(packed, range_bytes)
    kind = docs.schema[key].dataType.simpleString()

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                chunk = Chunk(batch, row)
                levels = Levels(chunk, lengths)
                levels.ask(0)
                yield exchange.requests(chunk.number, levels.asked, None, buckets)

    def reached(chunk: Chunk, replies: pa.Table, to: int) -> Levels:
        """The chunk's windows at level ``to``, after the replies to all before."""
        levels = Levels(chunk, lengths)
        for level in range(to):
            levels.ask(level)
            levels.answer(level, _reply(replies, level, levels.asked, buckets))
        levels.ask(to)
        return levels

    def later_level(to: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = Chunk(left)
            levels = reached(chunk, right, to)
            smallest = levels.low if to == last else None
            return pa.Table.from_batches([exchange.requests(chunk.number, levels.asked, smallest, buckets)])

        return run

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        levels = reached(chunk, right, last)
        smaller = _reply(right, last, levels.asked, buckets)
        gone = levels.at[smaller[levels.place] | (levels.keys[levels.at] > levels.low[levels.place])]
        words = chunk.words
        marks = np.zeros(len(words) + 1, np.int64)
        marks[gone] += 1
        np.add.at(marks, gone + length, -1)
        removed = np.cumsum(marks[:-1]) > 0
        stays = np.concatenate([[0], np.cumsum(~removed)])[words.first]
        kept = np.flatnonzero(~removed)
        pieces = [chunk.raw[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())]
        texts = [b" ".join(pieces[a:b]) for a, b in zip(stays[:-1].tolist(), stays[1:].tolist())]
        counts = words.counts.astype(np.int64)
        return pa.table(
            [chunk.keys, pa.array(counts), pa.array(counts - np.diff(stays)), pa.array(texts, pa.binary()).cast(pa.string())],
            ["key", "n_words", "n_removed", "kept"],
        )

    replies = None
    for level in range(last + 1):
        if level == 0:
            asked = packed.mapInArrow(first_level, exchange.REQUEST)
        else:
            together = packed.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            asked = together.applyInArrow(later_level(level), exchange.REQUEST)
        found = exchange.answers(asked, _smaller_elsewhere if level == last else _found_elsewhere)
        found = found.withColumn("level", F.lit(level))
        if level < last:
            found = durable(found)
        replies = found if replies is None else replies.unionByName(found)
        if 0 < level < last and found.isEmpty():
            # no chunk has a candidate left
            break
    done = packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        cut, f"key {kind}, n_words long, n_removed long, kept string"
    )
    return done.withColumnRenamed("key", key)
