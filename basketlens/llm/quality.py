"""Quality rules whose cutoffs carry a guarantee on rejected good documents.

Every rule is a score and a fixed list of cutoffs from lenient to strict; a document
whose score exceeds the chosen cutoff is rejected.  The rules are tightened together: step
i takes the i-th cutoff of each (a shorter list stays at its last one).  Which step a
stratum may use is decided on labelled documents: under the hypothesis "this step rejects
more than ``risk`` of the good documents" the number of good labelled documents that any
of its rules rejects is binomial, so the exact lower tail is a p-value.  Steps are tested
from lenient to strict and testing stops at the first one not proven (fixed sequence, so
no further correction is needed inside a stratum); the level is divided by the number of
strata (Bonferroni).  With probability ``1 - delta`` no stratum loses more than ``risk`` of
its good documents to all rules together.  A stratum without a rejected good document
needs ln(delta / strata) / ln(1 - risk) labels, about 220 for four strata.

Cases: a missing text has no words; a missing stratum value is a stratum of its own;
a repeated row is a document of its own; a document with several labels counts once,
as good if any label says so; labels without a document, or without a quality, are
ignored; a stratum with too few labels keeps all that passes the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketlens.llm.columns import let, whole, words
from basketlens.session import durable

# Tail terms added one by one; beyond them a geometric bound is added, which only
# makes the test more careful.
TAIL_TERMS = 4096


@dataclass(frozen=True)
class Rule:
    """``score`` is SQL over the measures; ``cutoffs`` go from lenient to strict."""

    name: str
    score: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols_per_word", "n_symbols / n_words", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeated_words", "n_repeat_words / n_words", (0.18, 0.15, 0.12, 0.1, 0.08, 0.05)),
    Rule("long_words", "word_chars / n_words", (15.0, 12.0, 10.0, 9.0, 8.0, 7.0, 6.5, 6.0)),
)


def _repeat_words(w: Column, size: int) -> Column:
    """Words inside a window of ``size`` words that occurs twice or more in ``w``.

    Windows are compared by 64-bit hash within one text.  Texts without a repeated
    window stop at the distinct count; the others sort (hash, position) pairs.
    """
    n = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
    )

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(s: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                same = (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
                return F.when(same, x["i"])

            return F.sort_array(F.array_compact(F.transform(s, one)))

        def union(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))
            )
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(let(pairs, spots), union)
        )

    return F.when(n >= size, let(hashes, covered)).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` without its text, with the six counts the rules use."""
    lines = F.filter(F.split(whole(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = F.struct(
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                F.length(F.array_join(w, "")).cast("long").alias("chars"),
                _repeat_words(w, window).cast("long").alias("repeat"),
            ),
        ).alias("words"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            ),
        ).alias("lines"),
        F.regexp_count(whole(text), F.lit("[#*$%&|<>]")).cast("long").alias("symbols"),
    )
    kept = [c for c in docs.columns if c != text]
    # a generator is evaluated once, however often a filter above names its output
    return docs.select(*kept, F.explode(F.array(counts)).alias("_counts")).select(
        *kept,
        F.col("_counts.words.n").alias("n_words"),
        F.col("_counts.words.chars").alias("word_chars"),
        F.col("_counts.symbols").alias("n_symbols"),
        F.col("_counts.lines.dup").alias("n_dup_lines"),
        F.col("_counts.words.repeat").alias("n_repeat_words"),
        F.col("_counts.lines.n").alias("n_lines"),
    )


def base_failed(min_words: int = 10, max_repeat_pct: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")
    )


def lower_tail(rejected: Column, n: Column, risk: float) -> Column:
    """P(at most ``rejected`` of ``n``) for a binomial with success rate ``risk``.

    The recurrence runs downwards from the largest term, relative to that term,
    whose own size comes from logarithms summed upwards; terms beyond
    ``TAIL_TERMS`` are replaced by a geometric bound from above.  A count at or
    above the mean proves nothing and is given 1.
    """
    odds = (1.0 - risk) / risk

    def top_log(x: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), x), lambda i: F.log((n - i + 1) / i))
        total = F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)
        chosen = F.when(x >= 1, total).otherwise(F.lit(0.0))
        return chosen + x * F.log(F.lit(risk)) + (n - x) * F.log(F.lit(1.0 - risk))

    def falling(x: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(acc: Column, k: Column) -> Column:
            term = acc["term"] * ((x - k + 1) / (n - x + k)) * odds
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        last = F.least(x, F.lit(TAIL_TERMS).cast("long"))
        ratio = ((x - last) / (n - x + last + 1)) * odds
        summed = F.when(x >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, add))
        return let(
            F.coalesce(summed, start),
            lambda s: s["sum"] + s["term"] * ratio / (F.lit(1.0) - ratio),
        )

    tail = let(rejected.cast("long"), lambda x: F.exp(top_log(x)) * falling(x))
    return F.when(n <= 0, F.lit(1.0)).when(rejected >= n * risk, F.lit(1.0)).otherwise(tail)


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    key: str,
    stratum: str,
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.02,
    delta: float = 0.05,
    failed: Column | None = None,
) -> DataFrame:
    """One row per stratum: for each rule its cutoff at the last proven step, or null.

    Good labelled documents that pass the base rules count."""
    failed = base_failed() if failed is None else failed
    good = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max("quality").alias("_quality"))
        .where("_quality = 1")
    )
    held = measured.where(~failed).join(good, F.col(key) == F.col("_key"), "left_semi")
    steps = [[r.cutoffs[min(i, len(r.cutoffs) - 1)] for r in rules] for i in range(max(len(r.cutoffs) for r in rules))]

    def rejected(at: list[float]) -> Column:
        return reduce(or_, [F.coalesce(F.expr(r.score) > F.lit(c), F.lit(False)) for r, c in zip(rules, at)])

    counts = held.groupBy(F.col(stratum).alias("_stratum")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(rejected(at)).alias(f"_x_{i}") for i, at in enumerate(steps)]
    )
    tests = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"), F.col(f"_x_{i}").alias("x"),
                *[F.lit(c).alias(f"cutoff_{r.name}") for r, c in zip(rules, at)],
            )
            for i, at in enumerate(steps)
        ]
    )
    # one row per stratum: as many windows as strata below, none over documents
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    tested = (
        counts.withColumn("_strata", strata)
        .select("_stratum", "_n", "_strata", F.inline(tests))
        .withColumn("p", lower_tail(F.col("x"), F.col("_n"), risk))
    )
    stop = F.min(F.when(F.col("p") > F.lit(delta) / F.col("_strata"), F.col("step")))
    stopped = tested.withColumn("_stop", stop.over(Window.partitionBy("_stratum")))
    proven = stopped.where(F.col("_stop").isNull() | (F.col("step") < F.col("_stop")))
    return proven.groupBy("_stratum").agg(
        *[F.max_by(f"cutoff_{r.name}", "step").alias(f"cutoff_{r.name}") for r in rules]
    )


def _rejected(rules: tuple[Rule, ...]) -> Column:
    condition = F.lit(False)
    for r in rules:
        above = F.expr(r.score) > F.col(f"cutoff_{r.name}")
        condition = condition | F.coalesce(above, F.lit(False))
    return condition


def _judged(
    measured: DataFrame, proof: DataFrame, labels: DataFrame, key: str, stratum: str,
    rules: tuple[Rule, ...], risk: float, delta: float,
) -> DataFrame:
    """``measured`` with ``kept``; the cutoffs come from ``proof``, the same documents."""
    chosen = cutoffs(proof, labels, key, stratum, rules, risk, delta, F.col("base_failed"))
    # a row per stratum: Spark broadcasts it if its measured size allows
    joined = measured.join(durable(chosen), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~_rejected(rules))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """``key``, the measures, ``base_failed`` and ``kept`` for every document."""
    picked = docs.select(F.col(key), F.col(stratum), F.col(text))
    measured = durable(measures(picked, text).withColumn("base_failed", base_failed()))
    judged = _judged(measured, measured, labels, key, stratum, rules, risk, delta)
    return judged.select(*measured.columns, "kept")


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """The documents that :func:`judge` keeps, as they are.

    Measures are taken twice, which costs less than carrying the texts through a join.
    """
    proof = durable(
        measures(docs.select(F.col(key), F.col(stratum), F.col(text)), text)
        .withColumn("base_failed", base_failed())
    )
    whole_rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(stratum).alias("_of"), F.col(text).alias("_text"),
    )
    measured = measures(whole_rows, "_text").withColumn("base_failed", base_failed())
    judged = _judged(measured, proof.withColumnRenamed(stratum, "_of"), labels, key, "_of", rules, risk, delta)
    return judged.where("kept").select("_row.*")
