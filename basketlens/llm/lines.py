"""Dropping lines that many documents share.

Lines are normalised (ASCII blanks stripped at both ends, A-Z lowered) and hashed to
128 bits; a document counts once per hash; lines whose hash is found in at least
``min_docs`` documents go from every document, the others stay in their places.  The
frequent hashes are written once; whether they are broadcast or shuffled to the lines
is left to their measured size, and a line shared by everyone is one row after
partial aggregation.

Cases: a missing or empty text is one empty line; empty keys are never dropped; every
row is a document, so repeated rows count as often as they occur and are cut alike; a
document that loses all lines keeps the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketlens.llm.columns import ascii_lower, let, strip, whole
from basketlens.session import durable


def _keys(text: str, min_chars: int) -> Column:
    """Per line its hash, or null for keys that are too short to count."""

    def one(line: Column) -> Column:
        return let(
            strip(line),
            lambda k: F.when(
                F.length(k) >= min_chars,
                F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")),
            ),
        )

    return F.transform(F.split(ascii_lower(whole(text)), "\n"), one)


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (a, b) of lines found in at least ``min_docs`` documents."""
    each = docs.select(F.explode(F.array_distinct(F.array_compact(_keys(text, min_chars)))).alias("k"))
    counted = each.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_docs).select("a", "b")


def drop_frequent_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``key``, n_lines, n_dropped and the ``kept`` text of every document."""
    frequent = durable(frequent_lines(docs, text, min_docs, min_chars))
    # only these names meet in the join, whatever the table's columns are called
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("own"))
    placed = picked.select("id", "own", F.posexplode(_keys("text", min_chars)).alias("pos", "k")).where(
        F.col("k").isNotNull()
    )
    hits = placed.select("id", "own", "pos", "k.a", "k.b").join(frequent, ["a", "b"])
    # rows that agree in key and text are cut alike, so they may share one set
    cut = hits.groupBy(F.col("id").alias("cut_id"), F.col("own").alias("cut_own")).agg(F.collect_set("pos").alias("cut"))
    joined = picked.join(
        cut, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("own") == F.col("cut_own")), "left"
    )
    split = F.split(whole("text"), "\n")
    kept = let(
        split,
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("cut")),
                lambda i: F.get(x, i),
            ),
            "\n",
        ),
    )
    return joined.select(
        "id",
        F.size(split).cast("long"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long"),
        F.when(F.col("cut").isNull(), whole("text")).otherwise(kept),
    ).toDF(key, "n_lines", "n_dropped", "kept")
