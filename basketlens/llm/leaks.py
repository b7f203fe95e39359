"""Benchmark decontamination by winnowing.

Texts and benchmark items are cut into the same words.  A fingerprint is the smallest
hash of ``gram`` words in every run of ``window - gram + 1`` such grams, so two texts
that share ``window`` words share a fingerprint at the same place.  Fingerprints are
joined; around each hit the windows that contain it are joined, as text, with the
windows of the items, which extends the hit to every shared word and leaves no false
one.  Items of fewer than ``window`` words are single windows of their own length; for
each such length ``n`` the fingerprints also take runs of ``n - gram + 1`` grams (or,
if ``n < gram``, all ``n``-grams).

The document side is never collected: fingerprints flow from the scan into the join,
and only documents with hits send window texts.  Whether the benchmark's tables are
broadcast is left to their measured size.

Cases: a missing or wordless text has no windows; an item without words is never
found; rows with the same key and text share their hits, each keeping its own result
row; items with a missing id count as hits but are not listed; an item id that occurs
twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketlens.llm.columns import ascii_lower, whole
from basketlens.llm.textarrays import (
    Words,
    alphanumeric,
    blocks,
    lists,
    lowering,
    lowest_of,
    window_hashes,
)
from basketlens.session import durable

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str):
    return F.array_remove(F.split(ascii_lower(whole(text)), _NOT_WORD), "")


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Rows (item, words, content): every window of every item once."""
    cut = items.select(F.col(key).alias("item"), _words(text).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    return cut.select(
        "item",
        length.alias("words"),
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - length + 1),
                    lambda i: F.array_join(F.slice("w", i, length), " "),
                )
            )
        ).alias("content"),
    )


def _prints(words: Words, hashes: np.ndarray, spans: list[int], gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram length, positions, fingerprints) that find every span of given lengths.

    A run's minimum is also the minimum of the shorter runs that hold it, so the
    shortest span of at least ``gram`` words covers the longer ones.
    """
    sized = {min(s, gram): s for s in sorted(spans, reverse=True)}
    for k, span in sorted(sized.items()):
        grams = window_hashes(hashes, k)
        at = lowest_of(grams, span - k + 1, words.fits(span))
        yield k, at, grams[at]


def fingerprints(docs: DataFrame, keys: list[str], text: str, spans: list[int], gram: int) -> DataFrame:
    """Rows (keys..., gram, print, pos) of all texts, for spans of the given lengths."""
    chars, lower = alphanumeric(), lowering()
    spec = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in blocks(batch.column(text)):
                words = Words(lower[data], offsets, chars)
                hashes, of = words.hashes(), words.text_of
                for k, at, prints in _prints(words, hashes, spans, gram):
                    rows = pa.array(of[at] + start)
                    yield pa.record_batch(
                        [
                            *[batch.column(c).take(rows) for c in keys],
                            pa.array(np.full(len(at), k, np.int32)),
                            pa.array(prints.view(np.int64)),
                            pa.array((at - words.first[of[at]]).astype(np.int32)),
                        ],
                        [*keys, "gram", "print", "pos"],
                    )

    return docs.select(*keys, text).mapInArrow(run, f"{spec}, gram int, print long, pos int")


def _extend(spans: list[int], gram: int):
    """Per text: its number of words, and the windows around its hits as text."""
    chars, lower = alphanumeric(), lowering()

    def around(pos: np.ndarray, gram_of: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
        for span in spans:
            k = min(span, gram)
            mine = pos[gram_of == k]
            starts = np.unique((mine[:, None] - np.arange(span - k + 1)[None, :]).ravel())
            yield span, starts[(starts >= 0) & (starts + span <= count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits")
            for start, stop, data, offsets in blocks(batch.column("text")):
                data = lower[data]
                words = Words(data, offsets, chars)
                ends, size, place, content = [0], [], [], []
                raw = data.tobytes()
                for i in range(stop - start):
                    found = hits[start + i].as_py()
                    if found:
                        a, b = words.first[i], words.first[i + 1]
                        own = [raw[s:e] for s, e in zip(words.start[a:b], words.end[a:b])]
                        pos = np.array([h["pos"] for h in found], np.int64)
                        grams = np.array([h["gram"] for h in found], np.int64)
                        for span, starts in around(pos, grams, len(own)):
                            size += [span] * len(starts)
                            place += starts.tolist()
                            content += [b" ".join(own[s : s + span]).decode() for s in starts]
                    ends.append(len(size))
                windows = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(content, pa.string())],
                        ["words", "pos", "content"],
                    ),
                )
                rows = batch.slice(start, stop - start)
                yield pa.record_batch(
                    [rows.column("id"), rows.column("own"), pa.array(words.counts.astype(np.int64)), windows],
                    ["id", "own", "n_words", "windows"],
                )

    return run


def _matches(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int, gram: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, own, n_words) of all documents, and (hit_id, hit_own, spans, items) of
    those with hits."""
    windows = durable(item_windows(items, item_key, item_text, window))
    # at most ``window`` different lengths
    spans = [r[0] for r in windows.select("words").distinct().orderBy("words").collect()]
    own = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("text")
    )
    contents = windows.select("words", "content").distinct()
    # a window's text has the window's fingerprints, so items need no second scan
    known = durable(
        fingerprints(contents, ["words"], "content", spans, gram)
        .where(F.col("gram") == F.least(F.col("words"), F.lit(gram)))
        .select("gram", "print")
        .distinct()
    )
    hits = (
        fingerprints(own, ["id", "own"], "text", spans, gram)
        .join(known, ["gram", "print"])
        .groupBy("id", "own")
        .agg(F.collect_set(F.struct("gram", "pos")).alias("hits"))
    )
    joined = own.join(
        hits.withColumnsRenamed({"id": "hit_id", "own": "hit_own"}),
        F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit_own")),
        "left",
    ).select("id", "own", "text", "hits")
    id_type = own.schema["id"].dataType.simpleString()
    counted = joined.mapInArrow(
        _extend(spans, gram),
        f"id {id_type}, own long, n_words long, windows array<struct<words int, pos int, content string>>",
    )
    # one written row per document, windows only where there were hits
    checked = durable(counted)
    found = checked.where(F.size("windows") > 0).select("id", "own", F.inline("windows")).distinct()
    matches = found.join(windows, ["words", "content"]).groupBy("id", "own").agg(
        F.collect_set(F.struct("pos", "words")).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    return checked.select("id", "own", "n_words"), matches.withColumnsRenamed({"id": "hit_id", "own": "hit_own"})


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit_own"))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    gram: int = 5,
) -> DataFrame:
    """``key``, n_words, n_hit, items (sorted ids as text) and contaminated."""
    every, matches = _matches(docs, items, key, text, item_key, item_text, window, gram)
    hit_words = F.size(
        F.array_distinct(
            F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["words"] - 1)))
        )
    )
    return every.join(matches, _same(), "left").select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce(hit_words, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    gram: int = 5,
) -> DataFrame:
    """The documents without any item's window, as they are."""
    _, matches = _matches(docs, items, key, text, item_key, item_text, window, gram)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("id"),
        F.xxhash64(F.col(text)).alias("own"),
    )
    return rows.join(matches.select("hit_id", "hit_own"), _same(), "left_anti").select("row.*")
