"""Personal data: patterns propose spans, checksums confirm them, context scores them.

A kind has a pattern, a validator and a starting score.  Proposals that fail the
validator are dropped without a retry, except account numbers, whose end is searched for
and which are proposed only when valid; those that pass gain by context words nearby
and stay if they reach ``threshold``.  Kinds marked ``base`` stay whenever they are
valid, whatever their score.  Positions are code points, ends exclusive.

The work is one pass over each text in its own task, so nothing is shuffled.  A text
is only matched against kinds whose ``hint`` it holds.

Cases: a missing or empty text has no spans; repeated rows give the same spans; spans
of different kinds may overlap, spans of one kind never do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


def luhn(number: str) -> bool:
    """Digits from the right, every second one doubled, sum to a multiple of ten."""
    digits = [int(c) for c in reversed(number)]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[1::2]]
    return (sum(digits[::2]) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Account numbers whose rearranged digits leave 1 when divided by 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    number = _digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def valid_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def valid_iban(text: str) -> bool:
    account = text.replace(" ", "")
    return 15 <= len(account) <= 34 and mod97(account)


def valid_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


# Registered lengths of IBANs by country.
_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTHS = {code: length for length, codes in _COUNTRIES.items() for code in codes.split()}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_TOKEN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid account numbers.  The country says where one ends; under a code without a
    registered length it is the longest valid part that ends with a token."""
    at = 0
    while match := _IBAN.search(text, at):
        start, at = match.start(), match.start() + 4
        length = IBAN_LENGTHS.get(text[start : start + 2])
        ends = [m.start() for m in _TOKEN_END.finditer(text, start, match.end() + 1) if m.start() <= match.end()]
        for end in reversed(ends):
            account = text[start:end]
            if (length is None or len(account.replace(" ", "")) == length) and valid_iban(account):
                yield start, end
                at = end
                break


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from
    their ``@`` backwards: linear also in runs of local characters without one."""
    last = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            last = match.end()
            yield start, last


def matches(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


@dataclass(frozen=True)
class Kind:
    """``find`` gives spans from left to right; ``hint`` is a pattern that every text
    with such a span holds."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    hint: str
    valid: Callable[[str], bool] | None = None
    score: float = 0.5
    base: bool = False
    context: tuple[str, ...] = field(default=())


KINDS = (
    Kind("email", emails, "@", None, 0.9, True, ("mail", "contact")),
    # a match can only begin where a run of digits does
    Kind("ip", matches(r"(?<![0-9])[0-9]++(\.[0-9]++){3}"), r"[0-9]\.[0-9]", valid_ip, 0.6, True, ("ip", "server", "host")),
    Kind("card", matches(r"[0-9]([\x20-]?[0-9])+"), r"[0-9][\x20-]?[0-9]", valid_card, 0.7, True, ("card", "visa", "credit", "pay")),
    Kind("phone", matches(r"\+[0-9][\x20().0-9-]+[0-9]"), r"\+", valid_phone, 0.6, True, ("phone", "call", "tel", "mobile")),
    Kind(
        "iban", ibans, r"[A-Z]{2}[0-9]{2}", None, 0.8, False, ("iban", "account", "bank", "konto", "cuenta", "compte"),
    ),
    Kind(
        "ssn", matches(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), r"[0-9]-[0-9]", valid_ssn, 0.3, False,
        ("ssn", "social", "security"),
    ),
)


@dataclass(frozen=True)
class Finder:
    """Compiled kinds; ``reach`` characters on either side count as near."""

    kinds: tuple[Kind, ...] = KINDS
    threshold: float = 0.6
    boost: float = 0.35
    reach: int = 40

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """(number of the kind, start, end, score), by kind, then start."""
        found = []
        for number, kind in enumerate(self.kinds):
            if not re.search(kind.hint, text):
                continue
            for start, end in kind.find(text):
                if kind.valid and not kind.valid(text[start:end]):
                    continue
                near = text[max(0, start - self.reach) : start] + " " + text[end : end + self.reach]
                words = re.findall(r"[a-z]+", near.lower())
                score = kind.score + self.boost * any(w in kind.context for w in words)
                if kind.base or score >= self.threshold:
                    found.append((number, start, end, min(score, 1.0)))
        return found


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", finder: Finder | None = None) -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end, score, base)."""
    finder = finder or Finder()
    names = [k.name for k in finder.kinds]
    base = [k.base for k in finder.kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = [0], []
            column = batch.column(text)
            for i in range(len(column)):
                flat += finder.spans(column[i].as_py() or "")
                ends.append(len(flat))
            spans = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays(
                    [
                        pa.array([names[s[0]] for s in flat], pa.string()),
                        pa.array([s[1] for s in flat], pa.int32()),
                        pa.array([s[2] for s in flat], pa.int32()),
                        pa.array([s[3] for s in flat], pa.float64()),
                        pa.array([base[s[0]] for s in flat], pa.bool_()),
                    ],
                    ["kind", "start", "end", "score", "base"],
                ),
            )
            yield pa.record_batch([batch.column(key), spans], [key, "spans"])

    id_type = docs.schema[key].dataType.simpleString()
    picked = docs.select(key, text)
    return picked.mapInArrow(
        run, f"`{key}` {id_type}, spans array<struct<kind string, start int, end int, score double, base boolean>>"
    )
