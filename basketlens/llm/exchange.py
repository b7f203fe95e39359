"""Asking all texts about a hash: requests and answers between chunks and hash ranges.

Grouping every word window of a corpus by hash moves one row per window.  Here a
*chunk* of texts sends its distinct hashes once, sorted and packed, one row per hash
range; a range sees the hashes of all chunks together, and answers each chunk in the
order it asked.  A hash in every text is one entry per chunk, so no hash is hot, and
both sides are bounded: a chunk by ``CHUNK_BYTES`` of text (or its longest text), a
range by the number of ranges, which follows the size of the corpus.

Chunks are rows of a written table that hold their texts, so every pass over them,
also after a lost executor, sees the same chunk.  There are never more request rows
than hashes; larger chunks make them fuller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from basketlens.llm.textarrays import Words, blank_separated
from basketlens.session import durable

CHUNK_BYTES = 4 << 20
# text per hash range; what a range gathers is of the same order
RANGE_BYTES = 8 << 20

REQUEST = "chunk long, bucket int, hashes binary, extra binary"
ANSWER = "chunk long, bucket int, answer binary"


def _cut(raw: bytes, lengths: np.ndarray) -> Words:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Words(np.frombuffer(raw, np.uint8), offsets, blank_separated())


def chunks(docs: DataFrame, key: str, text: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """A written table (chunk, keys, lengths, texts, n_bytes, n_words) of packed texts."""
    kind = docs.schema[key].dataType.simpleString()

    def row(number: int, keys: list, key_type: pa.DataType, parts: list[bytes]) -> pa.RecordBatch:
        raw = b"".join(parts)
        packed = zstandard.ZstdCompressor(level=6).compress(raw)
        spans = pa.array([0, len(keys)], pa.int32())
        flat = pa.array(keys, key_type)
        lengths = pa.array([len(p) for p in parts], pa.int32())
        return pa.record_batch(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(spans, flat),
                pa.ListArray.from_arrays(spans, lengths),
                pa.array([packed], pa.binary()),
                pa.array([len(raw)], pa.int64()),
                pa.array([len(_cut(raw, lengths.to_numpy()))], pa.int64()),
            ],
            ["chunk", "keys", "lengths", "texts", "n_bytes", "n_words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = pa.null()
        number = TaskContext.get().partitionId() << 32
        keys, parts, held = [], [], 0
        for batch in batches:
            key_type = batch.schema.field(key).type
            ids, texts = batch.column(key), batch.column(text)
            for i in range(len(batch)):
                raw = (texts[i].as_py() or "").encode()
                if parts and held + len(raw) > limit:
                    yield row(number, keys, key_type, parts)
                    number, keys, parts, held = number + 1, [], [], 0
                keys.append(ids[i].as_py())
                parts.append(raw)
                held += len(raw)
        if parts:
            yield row(number, keys, key_type, parts)

    return durable(
        docs.select(key, text).mapInArrow(
            run, f"chunk long, keys array<{kind}>, lengths array<int>, texts binary, n_bytes long, n_words long"
        )
    )


def ranges(packed: DataFrame, per_range: int = RANGE_BYTES) -> int:
    """How many hash ranges the corpus needs."""
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // per_range))


class Chunk:
    """The texts of one row of the chunk table, cut into words."""

    def __init__(self, row: pa.Table | pa.RecordBatch, at: int = 0):
        self.number = row.column("chunk")[at].as_py()
        self.keys = row.column("keys")[at].values
        lengths = row.column("lengths")[at].values.to_numpy()
        self.raw = zstandard.ZstdDecompressor().decompress(row.column("texts")[at].as_py())
        self.words = _cut(self.raw, lengths)


def planes(values: np.ndarray) -> bytes:
    """Bytes by significance: high bytes of small numbers are zero runs, which the
    shuffle's compression removes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    table = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(table.T).view(kind).ravel()


def bucket_bounds(hashes: np.ndarray, buckets: int) -> list[int]:
    """Where each range of sorted hashes begins, and their number."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]


def requests(number: int, hashes: np.ndarray, extra: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """One row per range that has hashes; ``hashes`` are sorted and distinct."""
    bounds = bucket_bounds(hashes, buckets)
    used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    parts = [hashes[bounds[b] : bounds[b + 1]] for b in used]
    steps = [planes(np.diff(p, prepend=np.uint64(0))) for p in parts]
    more = [None if extra is None else planes(extra[bounds[b] : bounds[b + 1]]) for b in used]
    return pa.record_batch(
        [
            pa.array([number] * len(used), pa.int64()),
            pa.array(used, pa.int32()),
            pa.array(steps, pa.binary()),
            pa.array(more, pa.binary()),
        ],
        ["chunk", "bucket", "hashes", "extra"],
    )


def answers(
    asked: DataFrame, answer: Callable[[list[np.ndarray], list[bytes]], list[bytes]]
) -> DataFrame:
    """``answer`` gets the hashes and extras of all chunks in one range and returns
    the reply to each."""

    def run(table: pa.Table) -> pa.Table:
        hashes = [
            np.cumsum(unplanes(h.as_py(), "<u8"), dtype=np.uint64) for h in table.column("hashes")
        ]
        replies = answer(hashes, [e.as_py() for e in table.column("extra")])
        return pa.table(
            [table.column("chunk"), table.column("bucket"), pa.array(replies, pa.binary())],
            ["chunk", "bucket", "answer"],
        )

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def in_order(table: pa.Table) -> list[bytes]:
    """A chunk's answers in the order of its sorted hashes."""
    buckets = table.column("bucket").to_numpy()
    replies = table.column("answer")
    return [replies[int(i)].as_py() for i in np.argsort(buckets)]
