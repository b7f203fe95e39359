"""Stupid-backoff scores of every document under the n-grams of all others.

Counts of all n-grams up to ``order`` words are tables partitioned by n-gram hash; each
document's n-grams are joined with them and its word scores summed.  Both go through
:mod:`exchange`: chunks send their distinct n-grams with their own counts, a hash
range adds them up and returns the totals.  Words and pairs are asked for at once, longer
n-grams level by level: another document can only have one whose two (n-1)-grams other
documents have, so only those are asked for, and all others count zero as they would
anyway.  Requests and replies are written tables that are deleted once they are used.  A document is scored as if it were not in
the corpus: its own counts are taken off first (``held_out``), so that copies count
but the document itself does not.

A word's score is count(context, word) / count(context) for the longest context with
a count above zero, times ``backoff`` for each word the context was shortened by; for
a word seen nowhere else it is ``backoff`` ** ``order`` / words of the corpus.

Cases: a missing or wordless text has no words, score 0 and no mean; repeated rows are
documents of their own, each seeing the other; in a corpus of one document every word
is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from basketlens.llm import exchange
from basketlens.llm.exchange import Chunk, planes, unplanes
from basketlens.llm.textarrays import mix, window_hashes
from basketlens.session import discard, durable, shuffles_deleted

# Longest n-grams of the first request: their parts are almost always known elsewhere.
AT_ONCE = 2


def _grams(chunk: Chunk, order: int) -> list[np.ndarray]:
    """For n = 1..order the hashes of n-grams, by starting word, of all words; those
    that reach over the end of a text are zero."""
    words = chunk.words.hashes()
    out = []
    for n in range(1, order + 1):
        grams = np.zeros(len(words), np.uint64)
        found = window_hashes(words, n)
        grams[: len(found)] = found
        grams[~chunk.words.fits(n)] = 0
        out.append(grams)
    return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    return np.unique(every[every != 0], return_counts=True)


def _open(grams: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Of the n-grams one longer than ``counts`` goes: both parts have a count above zero.
    Within a text this is the same wherever the n-gram occurs."""
    known = counts[-1] > 0
    return (grams[len(counts)] != 0) & known & np.append(known[1:], False)[: len(known)]


def _counts(
    grams: list[np.ndarray], replies: pa.Table, text_of: np.ndarray, upto: int, held_out: bool
) -> list[np.ndarray]:
    """For n = 1..``upto`` the count of the n-gram at each starting word."""
    at_once = min(len(grams), AT_ONCE)
    counts: list[np.ndarray] = []
    for n in range(1, upto + 1):
        g = grams[n - 1]
        there = g != 0 if n <= at_once else _open(grams, counts)
        if n == 1 or n > at_once:
            asked = grams[:at_once] if n == 1 else [g[there]]
            hashes, _ = _distinct(asked)
            level = replies.filter(pc.equal(replies.column("level"), max(n, at_once)))
            parts = [unplanes(r, "<u8").astype(np.int64) for r in exchange.in_order(level)]
            totals = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        seen = np.zeros(len(g), np.int64)
        seen[there] = totals[np.searchsorted(hashes, g[there])]
        if held_out:
            seen[there] -= _own_counts(g[there], text_of[there])
        counts.append(seen)
    return counts


def _own_counts(grams: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each n-gram how often its text has it."""
    mixed = mix(grams + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    ranked = mixed[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
    sizes = np.diff(np.append(starts, len(ranked)))
    out = np.empty(len(grams), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _word_scores(counts: list[np.ndarray], place: np.ndarray, total: np.ndarray, backoff: float) -> np.ndarray:
    """Natural logarithms, one per word.

    ``counts[n - 1][i]`` is the count of the n-gram that starts at word i, ``place[i]``
    the number of words before word i in its text, ``total`` the words of the corpus.
    """
    order, size = len(counts), len(place)
    score = np.log(backoff) * order - np.log(total)
    settled = np.zeros(size, bool)
    for n in range(order, 0, -1):
        at = np.arange(size) - (n - 1)
        possible = (place >= n - 1) & ~settled
        at = np.where(possible, at, 0)
        found = possible & (counts[n - 1][at] > 0)
        context = total if n == 1 else counts[n - 2][at]
        steps = np.minimum(place, order - 1) - (n - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log(backoff) * steps + np.log(counts[n - 1][at]) - np.log(context)
        score = np.where(found, value, score)
        settled |= found
    return score


def _add_up(hashes: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    every = np.concatenate(hashes)
    distinct, place = np.unique(every, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, place, np.concatenate([unplanes(e, "<u4") for e in extras]).astype(np.int64))
    out, at = [], 0
    for h in hashes:
        out.append(planes(totals[place[at : at + len(h)]].astype("<u8")))
        at += len(h)
    return out


def score_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = 2,
    backoff: float = 0.4,
    held_out: bool = True,
    chunk_bytes: int = exchange.CHUNK_BYTES,
    range_bytes: int = exchange.RANGE_BYTES,
) -> DataFrame:
    """``key``, n_words, log_score (sum over words) and mean_log_score."""
    packed = exchange.chunks(docs, key, text, chunk_bytes)
    buckets = exchange.ranges(packed, range_bytes)
    kind = docs.schema[key].dataType.simpleString()

    at_once = min(order, AT_ONCE)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                chunk = Chunk(batch, row)
                hashes, counts = _distinct(_grams(chunk, at_once))
                yield exchange.requests(chunk.number, hashes, counts.astype("<u4"), buckets)

    def ask_longer(n: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = Chunk(left)
            grams = _grams(chunk, n)
            counts = _counts(grams, right, chunk.words.text_of, n - 1, held_out)
            hashes, times = _distinct([grams[n - 1][_open(grams, counts)]])
            return pa.Table.from_batches([exchange.requests(chunk.number, hashes, times.astype("<u4"), buckets)])

        return run

    def answered(asked: DataFrame, n: int) -> DataFrame:
        return exchange.answers(asked, _add_up).withColumn("level", F.lit(n))

    words = packed.agg(F.sum("n_words")).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        text_of, size = chunk.words.text_of, chunk.words.counts
        counts = _counts(_grams(chunk, order), right, text_of, order, held_out)
        place = np.arange(len(text_of)) - chunk.words.first[text_of]
        total = np.full(len(text_of), words) - (size[text_of] if held_out else 0)
        scores = _word_scores(counts, place, np.maximum(total, 1), backoff)
        sums = np.bincount(text_of, scores, minlength=len(size))
        return pa.table(
            [chunk.keys, pa.array(size.astype(np.int64)), pa.array(sums)], ["key", "n_words", "log_score"]
        )

    # each step is written, and what it moved or asked is deleted, before the next
    with shuffles_deleted(docs.sparkSession):
        levels = [durable(answered(packed.mapInArrow(ask, exchange.REQUEST), at_once))]
        for n in range(at_once + 1, order + 1):
            known = reduce(DataFrame.unionByName, levels)
            asked = durable(
                packed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(ask_longer(n), exchange.REQUEST)
            )
            levels.append(durable(answered(asked, n)))
            discard(asked)
        replies = reduce(DataFrame.unionByName, levels)
        done = durable(
            packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
                score, f"key {kind}, n_words long, log_score double"
            )
        )
    discard(packed, *levels)
    return done.select(
        F.col("key").alias(key), "n_words", "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )
