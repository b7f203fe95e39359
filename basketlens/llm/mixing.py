"""Mixing sources to target weights with a cap on repetitions.

All sources share the total size by weight.  A source whose share exceeds
``max_epochs`` times its own size is clamped there and its excess goes to the others
by weight, until no share is above its cap.  That fixed point is computed in one pass
over the sources ordered by cap per weight: the clamped ones are a prefix.

A document is taken ``floor(target / size of its source)`` times as a whole; what is
then missing is filled by one more repetition of documents in a seeded hash order up
to the missing amount (rounded at the last hash value).  The cut in that order is
found by radix: per source, ten hash bits at a time, so no task orders more than a
thousand cells of a source or the documents of one last cell.

Cases: a missing text has size 0; a missing source is a source of its own, last in
order; repeated rows share their hash and are taken alike; sources without words get
target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.llm.columns import BLANKS, whole, words
from basketlens.session import durable

HASH_BITS = 60
_STEP_BITS = 10


def seeded_hash(key: Column, seed: int) -> Column:
    """60 bits that depend on key and seed alone."""
    shown = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(shown), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``target`` for rows (source, source_size, weight): one row per source.

    Comparisons use exact integers: a source is clamped if its cap over its weight is
    at most what is left over the weights left.
    """
    exact = lambda c: c.cast("decimal(28,0)")
    caps = sources.withColumn("_cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (
        caps.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(onward))
        .withColumn(
            "_clamped",
            exact(F.col("_cap")) * F.col("_open") <= exact(F.col("_left")) * F.col("weight"),
        )
    )
    free = F.struct(F.col("_left").alias("left"), F.col("_open").alias("open"))
    first_free = F.max_by(
        F.when(~F.col("_clamped"), free), F.when(~F.col("_clamped"), F.col("_open"))
    ).over(everything)
    share = exact(first_free["left"]) * F.col("weight")
    return level.withColumn(
        "target",
        F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(
            share.cast("double") / first_free["open"].cast("double")
        ),
    ).select("source", "source_size", "weight", "target")


def _narrow(sized: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """From rows (source, lo, missing): the next ten bits of each source's cut."""
    cell = F.shiftright(F.col("h") - F.col("lo"), shift)
    inside = sized.join(state, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("h") >= F.col("lo")) & (cell < (1 << _STEP_BITS))
    )
    cells = inside.groupBy("s", "lo", "missing", cell.alias("c")).agg(F.sum("size").alias("z"))
    upto = Window.partitionBy("s").orderBy("c")
    summed = cells.withColumn("after", F.sum("z").over(upto))
    # the first cell whose end is above what is missing holds the cut
    beyond = F.col("after") > F.col("missing")
    found = summed.groupBy("s", "lo", "missing").agg(
        F.min_by(F.when(beyond, F.struct("c", (F.col("after") - F.col("z")).alias("b"))),
                 F.when(beyond, F.col("c"))).alias("f")
    )
    past = F.col("lo") + (1 << (shift + _STEP_BITS))
    return found.select(
        "s",
        F.coalesce(F.col("lo") + F.shiftleft(F.col("f.c").cast("long"), shift), past).alias("lo"),
        (F.col("missing") - F.coalesce(F.col("f.b"), F.lit(0))).alias("missing"),
    )


def hash_cuts(sized: DataFrame, missing: DataFrame, levels: int = 2) -> DataFrame:
    """Rows (s, cut): documents of source s with a hash below ``cut`` fill what is
    missing (rows (s, missing)), to within half the size at one hash value."""
    state = missing.select("s", F.lit(0).cast("long").alias("lo"), "missing")
    shift = HASH_BITS
    for _ in range(levels):
        shift -= _STEP_BITS
        state = _narrow(sized, state, shift)
    inside = sized.join(state, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("h") >= F.col("lo")) & (F.shiftright(F.col("h") - F.col("lo"), shift) < 1)
    )
    values = inside.groupBy("s", "missing", "h").agg(F.sum("size").alias("z"))
    before = F.sum("z").over(Window.partitionBy("s").orderBy("h")) - F.col("z")
    taken = values.withColumn("before", before).where(
        2 * F.col("before") + F.col("z") <= 2 * F.col("missing")
    )
    last = taken.groupBy(F.col("s").alias("t")).agg(F.max("h").alias("last"))
    return state.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select(
        "s", F.coalesce(F.col("last") + 1, F.col("lo")).alias("cut")
    )


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.size(words(text)).cast("long").alias("size"),
        seeded_hash(F.col(key), seed).alias("h"),
    )


def plan(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Written rows (s, source_size, target, whole, cut): a document of source s is
    taken ``whole`` times, and once more if its hash is below ``cut``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here to the targets
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighted = totals.withColumn("weight", F.get(cycle, turn % len(weights)))
    epochs = F.floor(F.col("target") / F.col("source_size"))
    targets = durable(
        water_fill(weighted, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0)).cast("long"))
        .select(
            F.col("source").alias("s"), "source_size", "target", "whole",
            (F.col("target") - F.col("whole") * F.col("source_size")).alias("missing"),
        )
    )
    cuts = hash_cuts(sized, targets.select("s", "missing")).withColumnRenamed("s", "t")
    # a source that no cut is found for has no more words than are missing
    return durable(
        targets.join(cuts, F.col("s").eqNullSafe(F.col("t")), "left")
        .withColumn("cut", F.coalesce("cut", F.lit(1 << HASH_BITS)))
        .drop("t", "missing")
    )


def _repeats() -> Column:
    return F.col("whole") + (F.col("h") < F.col("cut")).cast("long")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``key``, size, source_size, target, taken and repeats for every document.

    Sources in code-point order take ``weights`` in turn.
    """
    sized = durable(_sized(docs, key, source, text, seed))
    planned = sized.join(plan(sized, weights, max_epochs), F.col("source").eqNullSafe(F.col("s")))
    return planned.withColumn("repeats", _repeats()).select(
        F.col("key").alias(key), "size", "source_size", "target",
        (F.col("size") * F.col("repeats")).alias("taken"), "repeats",
    )


def sample(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them.  A text without words
    adds nothing to a mix and is not taken."""
    sized = durable(_sized(docs, key, source, text, seed))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        seeded_hash(F.col(key), seed).alias("h"),
        F.length(F.btrim(whole(text), F.lit(BLANKS))).alias("content"),
    ).where(F.col("content") > 0)
    planned = rows.join(plan(sized, weights, max_epochs), F.col("source").eqNullSafe(F.col("s")))
    repeated = planned.withColumn("repeats", _repeats()).where("repeats > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    )
    return repeated.select("row.*")
