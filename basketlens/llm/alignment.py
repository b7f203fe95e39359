"""Alignment of two tokenizers' ids over the same texts, with corpus-wide pair counts.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces, which put
that space first themselves) the text; both spell the same bytes.  Byte offsets where a
token of each ends cut them into *groups*; a *link* is a pair of occurrences, one of
each, whose bytes overlap, that is, one stretch between neighbouring ends of either.  The
count of an id pair is the number of documents that hold it linked.

Identity-map fast path: an array made once gives for each A-id the B-id of the same
bytes.  Links to that id, above all the groups of one token each, are counted in
vectors of vocabulary length, of which a task hands on one.  Only the other pairs enter
the pair shuffle: per chunk of texts the distinct ones with their numbers of documents;
totals, and the highest count of each A-id (whose partners the vocabulary bounds), go
back to the chunks that asked.  A pair in every document is one row per chunk.

What reaches the driver are the totals of the identity pairs, one per A-id at most.

Cases: a missing or empty text, and one whose tokens do not spell its bytes (B replaces
some characters), has no tokens: zeros and empty groups.  Strings of special tokens are
plain text.  Repeated rows are documents of their own, missing keys too; no rows give
none.  A chunk is ``chunk_bytes`` of text or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from basketlens.llm.exchange import planes, unplanes
from basketlens.llm.textarrays import blocks
from basketlens.session import durable

CHUNK_BYTES = 2 << 20


def _byte_characters() -> dict[str, int]:
    """Byte-level tokenizers show bytes as characters: visible Latin-1 ones as they
    are, the others in order from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    # fixed: the pattern that byte-level tokenizers cut texts with
    _PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    # characters whose classes do not depend on the version of Unicode
    _PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]*")
    _BLANK_RUN = re.compile(r"\s{500}")
    _LONGEST_RUN = 500

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = _byte_characters()
        ids = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            known = all(c in shown for c in token)
            self.bytes_a[i] = bytes(shown[c] for c in token) if known else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.identity = self._identity()
        self.digits = _digit_table(max(len(self.bytes_a), len(self.bytes_b)))
        self.quick = self._merging_by_rank()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _identity(self) -> np.ndarray:
        """For each A-id the B-id of the same bytes, or -1."""
        same: dict[bytes, int] = {}
        for plain in (True, False):  # a piece goes before a lone byte
            for i, raw in enumerate(self.bytes_b):
                if self.b.is_byte(i) != plain and not (self.b.is_control(i) or self.b.is_unknown(i)):
                    same.setdefault(raw, i)
        return np.array([same.get(raw, -1) for raw in self.bytes_a])

    def _merging_by_rank(self) -> tiktoken.Encoding | None:
        """The same byte-pair merges by a faster library, where ids are the order of merges."""
        parts = json.loads(self.a.to_str())
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        simple = (
            parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex")
            and not cut.get("add_prefix_space") and model["type"] == "BPE" and not model.get("ignore_merges")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not simple:
            return None
        vocabulary = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocabulary[m] for m in merged]
        if order != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i < 256 + len(merged)}
        return tiktoken.Encoding("merges", pat_str=self._PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, text: str) -> list[int]:
        text = " " + text
        if (
            self.quick and self._PLAIN.fullmatch(text) and not self._BLANK_RUN.search(text)
            and len(max(text.split(), key=len, default="")) < self._LONGEST_RUN
        ):
            return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both where their tokens spell the text, else none."""
        found = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for text, b in zip(texts, found):
            if text:
                a, raw = self.ids_a(text), b" " + text.encode()
                if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)):
                    out.append((a, b))
                    continue
            out.append(([], []))
        return out


@cache
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..n-1, right aligned, and which of them are shown."""
    powers = 10 ** np.arange(len(str(n - 1)) - 1, -1, -1)
    ids = np.arange(n)[:, None]
    shown = ids >= powers
    shown[:, -1] = True
    return (ids // powers % 10 + ord("0")).astype(np.uint8), shown


class Aligned:
    """Tokens, groups and links of a block of texts.

    ``text_*`` give the number of the text of each token, group or link."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        tokens = pair.encode(texts)
        self.digits = pair.digits
        self.n = len(texts)
        self.n_a = np.array([len(a) for a, _ in tokens], np.int64)
        self.n_b = np.array([len(b) for _, b in tokens], np.int64)
        self.a = np.fromiter(chain.from_iterable(a for a, _ in tokens), np.int64, self.n_a.sum())
        self.b = np.fromiter(chain.from_iterable(b for _, b in tokens), np.int64, self.n_b.sum())
        del tokens
        ends_a, ends_b = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        cuts = np.flatnonzero(at_a | at_b)
        a_ends, b_ends = at_a[cuts], at_b[cuts]
        # the tokens over each stretch between neighbouring ends
        place_a = np.cumsum(a_ends) - a_ends
        place_b = np.cumsum(b_ends) - b_ends
        self.link_a, self.link_b = self.a[place_a], self.b[place_b]
        self.text_link = np.repeat(np.arange(self.n), self.n_a)[place_a]
        shared = a_ends & b_ends
        self.text_group = self.text_link[shared]
        # tokens of A and B up to the end of each group
        self.upto_a, self.upto_b = place_a[shared] + 1, place_b[shared] + 1

    def per_text(self, numbers: np.ndarray) -> np.ndarray:
        return np.bincount(numbers, minlength=self.n).astype(np.int64)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        before_a = np.concatenate([[0], self.upto_a[:-1]])
        before_b = np.concatenate([[0], self.upto_b[:-1]])
        size_a, size_b = self.upto_a - before_a, self.upto_b - before_b
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        separators = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(len(self.a)) + np.repeat(before_b, size_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(self.upto_a, size_b)] = self.b
        separators[self.upto_a + before_b - 1] = ord("|")
        separators[self.upto_a + self.upto_b - 1] = ord(";")
        digits, shown = (table[ids] for table in self.digits)
        raw = np.column_stack([digits, separators])[np.column_stack([shown, np.ones(len(ids), bool)])]
        ends = np.concatenate([[0], np.cumsum(shown.sum(1) + 1)])
        text_ends = ends[np.cumsum(self.n_a + self.n_b)]
        raw = raw.tobytes()
        # the last separator of a text goes
        return [raw[s : e - 1] if e > s else b"" for s, e in zip(np.concatenate([[0], text_ends[:-1]]), text_ends)]


def _distinct(texts: np.ndarray, values: np.ndarray, size: int, n: int) -> tuple[np.ndarray, ...]:
    """Distinct (text, value), sorted: how many per text, the values, their occurrences."""
    found, times = np.unique(texts * size + values, return_counts=True)
    return np.bincount(found // size, minlength=n), found % size, times


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(values.astype("<u4")))


def _unpacked(raw: pa.Scalar) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(raw.as_py()), "<u4").astype(np.int64)


_PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")
_LINKS = ("same_per_text", "same_ids", "same_times", "other_per_text", "other_places", "other_times")


def _align(key: str, text: str, key_kind: pa.DataType, path_a: str, path_b: str, chunk_bytes: int):
    def one(values, kind) -> pa.ListArray:
        flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    names = ["chunk", "keys", *_PER_TEXT, "groups_sha256", *_LINKS, "pairs", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        totals = np.zeros(len(pair.identity), np.int64)
        for batch in batches:
            keys, column = batch.column(key), batch.column(text)
            for low, high, *_ in blocks(column, chunk_bytes):
                made = Aligned(pair, column.slice(low, high - low).to_pylist())
                fast = pair.identity[made.link_a] == made.link_b
                same = _distinct(made.text_link[fast], made.link_a[fast], len(totals), made.n)
                totals += np.bincount(same[1], minlength=len(totals))
                pairs, place = np.unique(made.link_a[~fast] << 32 | made.link_b[~fast], return_inverse=True)
                other = _distinct(made.text_link[~fast], place, max(len(pairs), 1), made.n)
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in made.groups()]
                numbers = (made.n_a, made.n_b, made.per_text(made.text_group), made.per_text(made.text_link))
                yield pa.record_batch(
                    [
                        pa.array([number], pa.int64()), one(keys.slice(low, high - low), key_kind),
                        *[one(x, pa.int64()) for x in numbers], one(shas, pa.string()),
                        *[pa.array([_packed(x)], pa.binary()) for x in (*same, *other)],
                        one(pairs, pa.int64()), one(np.bincount(other[1], minlength=len(pairs)), pa.int64()),
                    ],
                    names,
                )
                number += 1
        if totals.any():
            # the task's vector, as a row without texts
            ids = np.flatnonzero(totals)
            yield pa.record_batch(
                [
                    pa.array([None], pa.int64()), one([], key_kind), *[one([], pa.int64()) for _ in _PER_TEXT],
                    one([], pa.string()), *[pa.array([None], pa.binary()) for _ in _LINKS],
                    one(ids << 32 | pair.identity[ids], pa.int64()), one(totals[ids], pa.int64()),
                ],
                names,
            )

    return run


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """A written table of chunks: per text the numbers of tokens, groups and links and the
    digest of its groups, its links (packed), and the chunk's pairs with their documents;
    and a row without a chunk per task, the task's vector of identity pairs."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    shape = (
        f"chunk long, keys array<{kind.simpleString()}>, {', '.join(f'{c} array<long>' for c in _PER_TEXT)}, "
        f"groups_sha256 array<string>, {', '.join(f'{c} binary' for c in _LINKS)}, pairs array<long>, docs array<long>"
    )
    return durable(
        docs.select(key, text).mapInArrow(_align(key, text, to_arrow_type(kind), path_a, path_b, chunk_bytes), shape)
    )


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a_id``, ``b_id``, ``n_docs`` of every linked pair, ``identity`` (equal bytes, by the
    map) and ``best``: whether no other pair of the A-id has a higher count."""
    pairs = chunks.select(
        F.col("chunk").isNull().alias("identity"), F.explode(F.arrays_zip("pairs", "docs")).alias("p")
    )
    totals = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.docs").alias("n_docs"), F.max("identity").alias("identity")
    )
    # an A-id has at most as many partners as B has ids
    highest = F.max("n_docs").over(Window.partitionBy("a_id"))
    ids = totals.select(
        F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), "n_docs", "identity"
    )
    return ids.withColumn("best", F.col("n_docs") == highest)


def _scored(counts: np.ndarray, best: np.ndarray):
    """``counts`` and ``best`` are the identity pairs' by A-id."""

    def sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        ends = np.concatenate([[0], np.cumsum(per_text)])
        return upto[ends[1:]] - upto[ends[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                same_n, same, same_times, other_n, other, other_times = (_unpacked(batch.column(c)[i]) for c in _LINKS)
                told = batch.column("told")[i].values
                numbers, top = np.zeros(len(told or ()), np.int64), np.zeros(len(told or ()), np.int64)
                if told is not None:
                    place = told.field("place").to_numpy()
                    numbers[place] = told.field("n_docs").to_numpy()
                    top[place] = told.field("best").to_numpy(zero_copy_only=False)
                total = sums(counts[same] * same_times, same_n) + sums(numbers[other] * other_times, other_n)
                highest = sums(best[same] * same_times, same_n) + sums(top[other] * other_times, other_n)
                yield pa.record_batch(
                    [
                        batch.column("keys")[i].values, *[batch.column(c)[i].values for c in _PER_TEXT],
                        pa.array(highest), pa.array(total), batch.column("groups_sha256")[i].values,
                    ],
                    ["key", *_PER_TEXT, "n_best", "count_sum", "groups_sha256"],
                )

    return run


def score(chunks: DataFrame, counts: DataFrame, path_a: str, path_b: str, key: str = "doc_id") -> DataFrame:
    """Per document the numbers of tokens, groups and links, how many links have the
    highest count of their A-id, the sum of the links' counts, and the groups' digest."""
    size = len(_pair(path_a, path_b).identity)
    same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    # the vocabulary bounds what comes back
    for row in counts.where("identity").select("a_id", "n_docs", "best").collect():
        same[row.a_id], best[row.a_id] = row.n_docs, row.best
    texts = chunks.where("chunk IS NOT NULL")
    asked = texts.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    others = counts.where(~F.col("identity")).select(
        F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id")).alias("pair"), "n_docs", "best"
    )
    told = asked.join(others, "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("place", "n_docs", "best")).alias("told")
    )
    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    whole = texts.drop("pairs", "docs").join(told, "chunk", "left")
    numbers = ", ".join(f"{c} long" for c in (*_PER_TEXT, "n_best", "count_sum"))
    return whole.mapInArrow(_scored(same, best), f"key {kind}, {numbers}, groups_sha256 string").withColumnRenamed("key", key)


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """:func:`align`, :func:`pair_counts` and :func:`score` in turn."""
    chunks = align(docs, path_a, path_b, key, text, chunk_bytes)
    return score(chunks, durable(pair_counts(chunks)), path_a, path_b, key)


def groups(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``key`` and the groups of every document, as ``a1,a2|b1;a3|b2,b3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            column = batch.column(text)
            for low, high, *_ in blocks(column, chunk_bytes):
                made = Aligned(pair, column.slice(low, high - low).to_pylist()).groups()
                yield pa.record_batch(
                    [batch.column(key).slice(low, high - low), pa.array([g.decode() for g in made], pa.string())],
                    ["key", "groups"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, groups string").withColumnRenamed("key", key)
