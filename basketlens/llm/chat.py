"""Chat formatting by grammar round trip, with a loss mask.

A turn is written as ``<|im_start|>role newline text<|im_end|> newline``.  Rendered text is
reparsed by :func:`parse`, a deterministic parser of that grammar, and the recovered
turns are compared with the source.  If they differ, the turns that conflict with the
grammar are escaped and the text is parsed again, then all turns are, until source and
recovery are identical; anything else is an error, never a silently changed turn.

Escaping puts one more backslash between ``<`` and ``|`` wherever there are backslashes
or none between them, so escaped content holds no control string and unescaping takes
exactly one backslash off.  In roles a newline becomes ``<|n|>``.

A conversation is written in *segments* of ``per_segment`` turn numbers, so that no group
grows with a conversation, however many turns it has; a conversation's text is its
segments in order.  The loss mask holds the places of assistant texts, in code points of
the segment, end exclusive.

Only column expressions are used.  Cases: a missing role or text is empty; missing turn
numbers come first, in a segment of their own; rows with equal turns are ordered by role,
then text, and repeated rows stay; a missing key is a conversation of its own; no rows
give no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketlens.llm.columns import let, whole

# fixed: the template's control strings
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|n|>"
LEARNED = "assistant"


def escape(value: Column) -> Column:
    """``value`` without control strings; :func:`unescape` gives it back."""
    return F.regexp_replace(value, r"<(\\*)\|", r"<\\$1|")


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def render(turns: Column) -> Column:
    """The text of turns whose roles and texts are written as they are."""
    parts = F.transform(
        turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    )
    return F.array_join(parts, "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped; null if it is not in the grammar."""
    closing = END + "\n"

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(closing))
        role = F.substring_index(body, "\n", 1)
        sound = piece.endswith(closing) & body.contains("\n") & ~body.contains(END)
        return F.when(sound, _turn(_unescape_role(role), unescape(F.substring(body, F.length(role) + 2, F.length(body)))))

    def turns(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, 2, F.size(pieces)), turn)
        return let(
            found, lambda x: F.when((pieces[0] == "") & ~F.exists(x, lambda t: t.isNull()), x)
        )

    return let(F.split(formatted, r"<\|im_start\|>"), turns)


def _written(source: Column) -> Column:
    """The first form of the turns that the parser gives back: as they are, the
    conflicting ones escaped, all escaped."""

    def escaped(t: Column) -> Column:
        return _turn(_escape_role(t["role"]), escape(t["text"]))

    def if_conflicting(t: Column) -> Column:
        alone = F.array(_turn(t["role"], t["text"]))
        return F.when(F.coalesce(parse(render(alone)) == alone, F.lit(False)), t).otherwise(escaped(t))

    def attempt(turns: Column) -> Column:
        def checked(w: Column) -> Column:
            return let(
                render(w),
                lambda s: F.when(parse(s) == source, F.struct(w.alias("turns"), s.alias("formatted"))),
            )

        return let(turns, checked)

    return F.coalesce(
        attempt(source),
        attempt(F.transform(source, if_conflicting)),
        attempt(F.transform(source, escaped)),
        F.raise_error(F.lit("a rendered conversation does not parse back")),
    )


def _mask(turns: Column) -> Column:
    """Places of the assistant texts in the rendered turns."""
    span = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        start = done["at"] + len(START) + F.length(t["role"]) + 1
        end = start + F.length(t["text"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")).cast(span))
        return F.struct(
            (end + len(END) + 1).cast("long").alias("at"),
            F.when(t["role"] == LEARNED, F.concat(done["spans"], here)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, add, lambda done: done["spans"])


def format_conversations(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    per_segment: int = 64,
) -> DataFrame:
    """``key``, segment, formatted and loss (spans) for every segment of every conversation.

    ``turn`` is a number."""
    picked = rows.select(
        F.col(key).alias("_key"),
        F.floor(F.col(turn) / per_segment).alias("_segment"),
        F.struct(
            F.col(turn).alias("turn"), whole(F.col(role)).alias("role"), whole(F.col(text)).alias("text")
        ).alias("_row"),
    )
    grouped = picked.groupBy("_key", "_segment").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    source = F.transform("_rows", lambda r: _turn(r["role"], r["text"]))
    # a generator is evaluated once, however often its output is named
    made = grouped.select("_key", "_segment", F.explode(F.array(let(source, _written))).alias("_made"))
    return made.select(
        F.col("_key").alias(key),
        F.col("_segment").alias("segment"),
        F.col("_made.formatted").alias("formatted"),
        _mask(F.col("_made.turns")).alias("loss"),
    )


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask of a segment, unescaped, in order."""
    return F.transform(
        loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )


def read_back(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, turns, learned texts and formatted_chars of whole conversations, read
    from their segments.

    A conversation becomes one row here, so it must fit in one; whoever trains on
    segments need not call this."""
    grouped = segments.groupBy(F.col(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("segment", "formatted", "loss"))).alias("_segments")
    )
    return grouped.select(
        F.col("_key").alias(key),
        F.flatten(F.transform("_segments", lambda s: parse(s["formatted"]))).alias("turns"),
        F.flatten(F.transform("_segments", lambda s: under_mask(s["formatted"], s["loss"]))).alias("learned"),
        F.aggregate(
            "_segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["formatted"])
        ).alias("formatted_chars"),
    )
