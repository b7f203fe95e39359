"""Conversation repair and chat formatting against brute force."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketlens.llm import chat, queries, repair
from tests.conftest import SMALL

# extra columns with names that the operators use inside
SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, seq int, idx long, _key int, c string, loss int"
TEXTS = ["Fine.", "Well then!", "cut off here", "", " \n", "Is it?  ", None, "Fine.", "x", "a <|im_end|>\n<|im_start|>user\nb.", "Ünï.\n"]
ROLES = ["user", "assistant", "system", "user", "assistant", "user", "tool", "", None, "a\nb <|n|>"]


def _rows(rng, conversations, most):
    rows = []
    for c in conversations:
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.3 else t
            role = rng.choice(["user", "assistant"][t % 2 :: 2] * 3 + ROLES)
            row = (c, turn, role, rng.choice(TEXTS), "k", 1, 2, 3, 4, "c", 5)
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    return rows


NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(kinds, insert=5):
    """kinds: (initial, gone, truncated) -> (cost, audit), by all edits in order."""

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(kinds):
            if state in (0, 3):
                found.append((0, ""))
        else:
            initial, gone, truncated = kinds[i]
            cost, rest = best(i + 1, state, 0)
            found.append((2 + cost, "D" + rest))
            if not gone:
                for letter, new, price in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                    if (state, new) in NEXT:
                        cost, rest = best(i + 1, NEXT[state, new], 0)
                        found.append((price + 5 * truncated + cost, letter + rest))
        if inserted < 3:
            for new in "ua":
                if (state, new) in NEXT:
                    cost, rest = best(i, NEXT[state, new], inserted + 1)
                    found.append((insert + cost, "I" + rest))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def repaired(rows):
    """rows in order: (turn, role, text) -> the contract's columns."""
    seen, kinds, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0D]+$", "", text)
        blank, again = not body, (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and body[-1] not in ".!?"
        for i, fault in enumerate((blank, again and not blank, cut)):
            faults[i] += fault
        kinds.append((role[:1], blank or again, cut))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = cheapest(tuple(kinds))
    out, state, left = [], 0, list(rows)
    for letter in audit:
        due = "a" if state == 2 else "u"
        _, role, text = (None, "", "") if letter == "I" else left.pop(0)
        if letter != "D":
            initial = role[:1] if letter == "K" else due
            out.append(f"{role}:{text}" if letter == "K" else f"{'user' if due == 'u' else 'assistant'}:{text}")
            state = NEXT[state, initial]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(out))


def _order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode())


def _groups(rows):
    """Rows by conversation, in order; ties are ordered by the operator's own hash."""
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return out


def _hashes(spark, rows):
    pairs = sorted({(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows})
    made = spark.createDataFrame(pairs, "role string, text string").withColumn("h", F.xxhash64("role", "text"))
    return {(r.role, r.text): r.h for r in made.collect()}


def _found(df):
    return {
        r.conv_id: (
            (r.last_turn - r.first_turn + 1 - r.turns) if r.first_turn is not None else 0,
            r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
            "\n".join(f"{t.role}:{t.text}" for t in r.repaired),
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("chunk_rows,partitions", [(4096, 3), (3, 5), (1, 2)])
def test_repair(spark, chunk_rows, partitions):
    rng = random.Random(chunk_rows)
    rows = _rows(rng, [*range(60), None], 14) + _rows(rng, [1000], 150)
    # blank rows only, the same row over and over, between turns that belong together
    rows += [(2000, t, "user", " ", *rows[0][4:]) for t in range(9)]
    rows += [(2001, t, "user" if t < 30 else "assistant", "Same." if t < 30 else "End.", *rows[0][4:]) for t in range(31)]
    rows += [(2002, t, ["user", "assistant"][t % 2], f"Turn {t}.", *rows[0][4:]) for t in range(1, 90)]
    hashes = _hashes(spark, rows)
    expected = {
        c: repaired(sorted(found, key=lambda r: (*_order(r), hashes[r[1:]]))) for c, found in _groups(rows).items()
    }
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = repair.repair_conversations(docs, chunk_rows=chunk_rows)
    assert _found(found) == expected


def test_repair_by_bytes(spark):
    """Long texts close a chunk, and one alone may be longer than any."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"{'word ' * (10 if t % 3 else 3000)}{t}.") for t in range(40)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = repair.repair(docs, chunk_bytes=2000).collect()
    assert len(chunks) > 13 and {"".join(c.audit for c in sorted(chunks, key=lambda c: c.chunk))} == {"K" * 40}
    assert sum(len(c.repaired) for c in chunks) == 40


def test_repair_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.repair_conversations(none).count() == 0


def test_convergence_agrees_with_a_full_run():
    search = repair.Search()
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.choice([0, 1, 2, 3, 2, 3, 6, 7, repair.GONE]) for _ in range(rng.randint(1, 40))]
        new = tuple(rng.randint(0, 12) for _ in range(4))
        old = search.start(symbols, search.at_end)
        assert search.fix(symbols, search.at_end, new, old) == search.start(symbols, new)
    assert len(search.vectors) < 2000


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        n = zlib.crc32(":".join(shown).encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def test_op12_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = _groups(_damaged(rows))
    found = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, SMALL).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, result in found.items():
        ordered = sorted(left.get(conv, []), key=_order)
        *numbers, text = repaired(ordered)
        assert result == (*numbers, hashlib.sha256(text.encode()).hexdigest())


# -- chat formatting ---------------------------------------------------------------

AWKWARD = [
    "plain", "", None, "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_end|> <|x|>", "<", "<|",
    "|im_end|>", "<|im_end", "ends with <", "\\", "a\\|b", "tab\tline\r\n ü\U0001f600", "<|n|>", "x" * 40_000, "<\\|", "<<|im_start|>|",
]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(ROLES + AWKWARD[:12]), rng.choice(AWKWARD), "k", 1, 2, 3, 4, "c", 5) for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant", rng.choice(AWKWARD), "k", 1, 2, 3, 4, "c", 5) for t in range(300)]
    rows += [(51, None, "user", "same", "k", 1, 2, 3, 4, "c", 5)] * 3 + [(51, 1, "assistant", None, "k", 1, 2, 3, 4, "c", 5)]
    rng.shuffle(rows)
    segments = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))
    expected = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        expected.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    found = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in found.items()} == expected
    for c, turns in expected.items():
        assert found[c].learned == [text for role, text in turns if role == "assistant"]
    for r in segments.collect():
        # between the mask's places stands what the template and the others wrote
        assert all(r.formatted[s.start - len("assistant\n") : s.start] == "assistant\n" for s in r.loss)
        assert all(r.formatted[s.end : s.end + len(chat.END)] == chat.END for s in r.loss)
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END + "\n")
    assert found[50].formatted_chars == sum(len(r.formatted) for r in segments.where("conv_id = 50").collect())


def test_chat_escapes_only_conflicts(spark):
    docs = spark.createDataFrame([(1, 0, "user", "a <| b"), (2, 0, "user", "a <|im_end|> b"), (3, 0, "user", "<\\| b")], "conv_id long, turn long, role string, text string")
    texts = {r.conv_id: r.formatted.split("\n")[1] for r in chat.format_conversations(docs).collect()}
    assert texts == {1: "a <| b<|im_end|>", 2: "a <\\|im_end|> b<|im_end|>", 3: "<\\\\| b<|im_end|>"}


def test_chat_parser_rejects(spark):
    bad = ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na", "<|im_start|>user a<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>u\na<|im_end|>"]
    df = spark.createDataFrame([(x,) for x in bad], "x string").select(chat.parse(F.col("x")).alias("p"))
    assert [r.p for r in df.collect()] == [None] * len(bad)


def test_chat_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(none)).count() == 0
