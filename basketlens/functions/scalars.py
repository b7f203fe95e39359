"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, places: int) -> Column:
    """Array-library rounding: scale, round half to even, scale back."""
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once however often the body reads it, also
    inside functions of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax_label(memberships: Column) -> Column:
    """Zero-based index of the largest membership; the first one wins ties."""
    return (named(memberships, lambda m: F.array_position(m, F.array_max(m))) - 1).cast("int")


def within_pct(values: Sequence[Column], means: Sequence[Column], pct: float) -> Column:
    """True when every value lies within ``pct`` of its mean.

    The allowance is ``pct * mean``, unsigned, so a negative mean is never met.
    """
    result = F.lit(True)
    for value, mean in zip(values, means, strict=True):
        result = result & (F.abs(value - mean) <= F.lit(pct) * mean)
    return result


def join_labels(labels: Sequence[tuple[Column, str]], default: str) -> Column:
    """Comma-joined texts whose condition holds, or ``default`` when none does."""
    joined = F.concat_ws(", ", *[F.when(cond, F.lit(text)) for cond, text in labels])
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def percent_text(fraction: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f%%", fraction * F.lit(100.0))


def threshold_label(value: Column, threshold: float) -> Column:
    """1 when ``value`` exceeds the threshold; missing counts as 0."""
    return F.coalesce(value > F.lit(float(threshold)), F.lit(False)).cast("int")


def keyword_flag(text: Column, keyword: str) -> Column:
    """Case-sensitive containment; a missing text gives a missing flag."""
    return text.contains(keyword)


def sample_key(key: Column, seed: int) -> Column:
    """A hash order that depends on the key and the seed, never on partitions."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
