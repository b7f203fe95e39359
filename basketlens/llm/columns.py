"""Column expressions shared by the native operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column | str) -> Column:
    """The text, a missing one being empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Runs of anything but ASCII blanks, in order."""
    return F.array_remove(F.split(whole(text), "[\\x20\\x09-\\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def strip(text: Column) -> Column:
    """The text without ASCII blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))
