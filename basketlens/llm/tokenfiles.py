"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reads.

Format, one numbered part per range of keys, in a folder:

* ``*.bin``: the token ids of the part's documents one after the other, unsigned
  little-endian, 2 bytes if every id of the vocabulary fits, else 4;
* ``*.idx``: little-endian unsigned 64-bit offsets, one more than documents: where each
  document begins and the last one ends, counted in ids from the start of the whole
  data set;
* the manifest, a Parquet table: part number, file names, first offset, documents, ids.

Documents are range partitioned and sorted by key; each task encodes and writes its
part under a name no other attempt uses and reports it.  Spark keeps the report of one
attempt per part, so a lost or repeated task leaves at most a file nobody names.  The
parts' first offsets are prefix sums over one row per part.  Files are written through
``pyarrow.fs``, so the folder may be local, HDFS or an object store; local files are
memory-mapped when read.

Cases: a missing or empty text has only the end id; a missing key comes first; rows
with equal keys are ordered by their text's hash; an empty table has no parts.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from basketlens.session import durable, ensure_checkpoint_dir


class Encoder:
    """Ids of a text, as bytes of ``dtype``.

    If the tokenizer splits at white space and drops it, blank-separated words are
    encoded on their own: they repeat, so their ids are kept (at most ``keep`` words at
    a time; frequent ones return at once).  A word of printable ASCII and Latin-1
    letters is then cut and encoded by the tokenizer's model itself; any other goes
    through the whole tokenizer, and so does every text if the tokenizer works in
    another way.
    """

    # fixed: the tokenizer's word pattern
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # the same for lower-case words without blanks of the characters below
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    # printable ASCII and Latin-1 letters: composed already, one lower-case form each
    _PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str, keep: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_words = self._splits_at_blanks()
        self.keep = keep
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.shown = _shown_bytes()

    def _splits_at_blanks(self) -> bool:
        parts = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and first.get("pattern") == {"Regex": self._PATTERN}
            and first["behavior"] == "Removed"
            and first["invert"]
            and [r["type"] for r in rest] == ["ByteLevel"]
            and not rest[0]["use_regex"]
            and not rest[0]["add_prefix_space"]
            and parts["model"]["type"] == "BPE"
        )

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.keep:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            ids = self._bytes([t.id for t in self.model.tokenize(shown)])
            self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        # special tokens are found in the text as written
        if self._PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._piece, self._PIECES.findall(word.lower())))
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        known = self.words
        if len(known) >= self.keep:
            known.clear()
        raw = text.encode()
        if raw.isascii() and b"<|" not in raw:
            raw = raw.lower()
        words = raw.split()
        ids = list(map(known.get, words))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    word = words[i]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = self._word(word.decode())
                    ids[i] = found
        return b"".join(ids)


def _shown_bytes() -> dict[int, str]:
    """Byte-level tokenizers show bytes as characters: visible Latin-1 ones as they
    are, the others in order from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(256 + n) for n, b in enumerate(others)}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


_PART_ROWS = "part int, ids_file string, keys array<{key}>, counts array<long>"


def _write_parts(key: str, text: str, folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, keys, counts = None, None, [], []
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.bin"
        stream = None
        for batch in batches:
            if not len(batch):
                continue
            if stream is None:
                encoder = Encoder(tokenizer)
                end = np.array([end_id], encoder.dtype).tobytes()
                out, base = _open(folder)
                stream = out.open_output_stream(f"{base}/{name}")
            texts = batch.column(text)
            keys.append(batch.column(key))
            for i in range(len(batch)):
                ids = encoder.encode(texts[i].as_py() or "") + end
                stream.write(ids)
                counts.append(len(ids) // encoder.dtype.itemsize)
        if stream is not None:
            stream.close()
            both = pa.concat_arrays(keys)
            spans = pa.array([0, len(both)], pa.int32())
            yield pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([name]),
                    pa.ListArray.from_arrays(spans, both),
                    pa.ListArray.from_arrays(spans, pa.array(counts, pa.int64())),
                ],
                ["part", "ids_file", "keys", "counts"],
            )

    return run


def _write_offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for row in range(len(batch)):
                counts = batch.column("counts")[row].values.to_numpy()
                offsets = np.zeros(len(counts) + 1, "<u8")
                np.cumsum(counts, out=offsets[1:])
                offsets += np.uint64(batch.column("base")[row].as_py())
                names.append(batch.column("ids_file")[row].as_py().removesuffix(".bin") + f"-{uuid.uuid4().hex}.idx")
                out, root = _open(folder)
                with out.open_output_stream(f"{root}/{names[-1]}") as stream:
                    stream.write(offsets.tobytes())
            yield pa.record_batch(
                [*[batch.column(c) for c in ("part", "ids_file", "base", "keys")], pa.array(names, pa.string())],
                ["part", "ids_file", "base", "keys", "offsets_file"],
            )

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1
) -> DataFrame:
    """Encode ``docs`` into ``folder`` in key order; returns the written manifest."""
    out, root = _open(folder)
    out.create_dir(root, recursive=True)
    ordered = (
        docs.select(key, text, F.xxhash64(text).alias("_tie"))
        .repartitionByRange(F.col(key).asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col(key).asc_nulls_first(), "_tie")
        .select(key, text)
    )
    kind = docs.schema[key].dataType.simpleString()
    written = durable(
        ordered.mapInArrow(_write_parts(key, text, folder, tokenizer, end_id), _PART_ROWS.format(key=kind))
    )
    totals = written.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("ids"))
    # a row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return durable(
        written.join(bases, "part").mapInArrow(
            _write_offsets(folder),
            f"part int, ids_file string, base long, keys array<{kind}>, offsets_file string",
        )
    )


def _view(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array, memory-mapped if it is local."""
    store, root = _open(folder)
    if isinstance(store, fs.LocalFileSystem):
        buffer = pa.memory_map(f"{root}/{name}").read_buffer()
    else:
        with store.open_input_file(f"{root}/{name}") as file:
            buffer = file.read_buffer()
    return np.frombuffer(buffer, dtype)


def _read_parts(folder: str, dtype: np.dtype, slab: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids = _view(folder, batch.column("ids_file")[row].as_py(), dtype)
                offsets = _view(folder, batch.column("offsets_file")[row].as_py(), np.dtype("<u8")).astype(np.int64)
                keys = batch.column("keys")[row].values
                local = offsets - offsets[0]
                for at in range(0, len(keys), slab):
                    to = min(at + slab, len(keys))
                    docs = [ids[local[i] : local[i + 1]].astype("<u4") for i in range(at, to)]
                    yield pa.record_batch(
                        [
                            keys.slice(at, to - at),
                            pa.array(offsets[at:to]),
                            pa.array(np.diff(offsets[at : to + 1])),
                            pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                        ],
                        ["key", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_files(manifest: DataFrame, folder: str, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and the CRC-32 of the ids as 32-bit integers, read from
    the files of the manifest."""
    dtype = Encoder(tokenizer).dtype
    kind = manifest.schema["keys"].dataType.elementType.simpleString()
    parts = manifest.select("part", "ids_file", "offsets_file", "keys")
    # parts are whole files: one per task, else small manifests are read by one task
    spread = parts.repartition(F.col("part"))
    return spread.mapInArrow(
        _read_parts(folder, dtype), f"key {kind}, start long, n_tokens long, ids_crc32 long"
    ).withColumnRenamed("key", key)


def token_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return re.sub(r"^file:/+", "file:///", root) + f"/tokens-{uuid.uuid4().hex}"
