"""Array code for texts inside tasks: words and word windows of many texts at once.

Texts come as the bytes of an Arrow column, in blocks of about ``BLOCK_BYTES``, so a
task needs memory for one block (or for its longest text), whatever its partition
holds.  Hashes are 64-bit polynomials over random byte values, modulo 2**64, with a
final mix; equal texts have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
# odd, so that they have inverses modulo 2**64
_BYTE_STEP = _U(0x9E3779B97F4A7C15)
_WORD_STEP = _U(0xD6E8FEB86659FD93)


def blank_separated() -> np.ndarray:
    """Which bytes belong to words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Which bytes belong to words of digits, a-z and all that is not ASCII."""
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = True
    table[ord("a") : ord("z") + 1] = True
    table[128:] = True
    return table


def lowering() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(step: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """step**0, step**1, ... step**(n-1), or those of its inverse."""
    known = _powers.get((int(step), inverse))
    if known is None or len(known) < n:
        base = _U(pow(int(step), -1, 1 << 64)) if inverse else step
        known = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        known[0] = 1
        _powers[int(step), inverse] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """The words of a block of texts.

    ``start``/``end`` are byte positions in ``data``; ``first[i]:first[i+1]`` are the
    words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        here = inside[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = here[:-1]
        after = np.zeros(n, bool)
        after[:-1] = here[1:]
        self.start = np.flatnonzero(here & ~(before & ~edge[:-1]))
        self.end = np.flatnonzero(here & ~(after & ~edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        a = 0
        while a < len(self):
            low = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.start, low + BLOCK_BYTES)))
            high = int(self.end[b - 1])
            n = high - int(low)
            sums = _prefix(_BYTE_VALUES[self.data[low:high]] * _power(_BYTE_STEP, n))
            start, end = self.start[a:b] - low, self.end[a:b] - low
            inverse = _power(_BYTE_STEP, n, True)
            out[a:b] = mix((sums[end] - sums[start]) * inverse[start] + _U(1))
            a = b
        return out

    def fits(self, length: int) -> np.ndarray:
        """Whether ``length`` words from each word on are in the same text."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self)) + length <= last


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive word hashes, one per starting word."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = _prefix(words * _power(_WORD_STEP, n))
    inverse = _power(_WORD_STEP, n, True)
    return mix((sums[length:] - sums[:-length]) * inverse[: n - length + 1] + _U(length))


def lowest_of(values: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Positions holding the first minimum of some ``width`` consecutive values, for
    windows whose start is ``valid``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        smaller = values[j : j + n] < low
        low[smaller] = values[j : j + n][smaller]
        at[smaller] = j
    flags = np.zeros(len(values), bool)
    flags[(np.arange(n) + at)[valid[:n]]] = True
    return np.flatnonzero(flags)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, missing texts being empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return content, places


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of whole texts."""
    content, places = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(places, places[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop, content[places[row] : places[stop]], places[row : stop + 1] - places[row]
        row = stop


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """One list per row from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
