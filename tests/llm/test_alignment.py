"""Token alignment against both tokenizers and plain loops."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basketlens.llm import alignment, queries
from basketlens.llm.alignment import Pair
from tests.conftest import SMALL

PATHS = [public_tokenizers.path(n) for n in queries.ALIGNED]
SCHEMA = "doc_id long, text string, chunk int, keys string, pairs int, docs int, key string, n_a int, told string"

AWKWARD = [
    None, "", " ", "  two  spaces ", "\n\n\ttabs\r\n", "aaa aa aaaa", "x" * 20_000, " " * 3000 + "end", "▁ piece ▁", "<|endoftext|> <s> </s> <unk>",
    "<0x41> byte", "ﬁne ﬂag ①", "é combining", "日本語のテキスト", "ไทย", "😀😃 emoji 👩‍👩‍👧", "nul \x00 inside", "١٢٣ 四五", "l'été où ça",
    "don't we'll I'VE", "\x85 next   line", "soft\xadhyphen nb\xa0space", "Größe straße ÄÖÜ", "123456 7 89.0", "zero​width", "A", "aःb \U0001e900",
]


def _reference():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in visible}
    chars |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in visible)}
    spelt = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab().items()}
    pieces = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}

    def encode(text):
        if not text:
            return [], []
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        if b"".join(spelt[i] for i in left) != raw or b"".join(pieces[i] for i in right) != raw:
            return [], []
        return [(i, len(spelt[i])) for i in left], [(i, len(pieces[i])) for i in right]

    return encode


def brute(texts):
    """-> for each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), pair counts."""
    encode, counts, found = _reference(), collections.Counter(), []
    for text in texts:
        left, right = encode(text)
        groups, links, i, j = [], [], 0, 0
        ends = [0, 0]
        here = ([], [])
        while i < len(left) or j < len(right):
            if not here[0] and not here[1]:
                here[0].append(left[i][0]), here[1].append(right[j][0])
                ends = [ends[0] + left[i][1], ends[1] + right[j][1]]
                links.append((left[i][0], right[j][0]))
                i, j = i + 1, j + 1
            elif ends[0] < ends[1]:
                here[0].append(left[i][0])
                links.append((left[i][0], right[j - 1][0]))
                ends[0], i = ends[0] + left[i][1], i + 1
            else:
                here[1].append(right[j][0])
                links.append((left[i - 1][0], right[j][0]))
                ends[1], j = ends[1] + right[j][1], j + 1
            if ends[0] == ends[1]:
                groups.append("|".join(",".join(map(str, x)) for x in here))
                here = ([], [])
        counts.update(set(links))
        found.append((len(left), len(right), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), groups)
        for n_a, n_b, n_groups, links, groups in found
    ], counts


def _digest(rows):
    return [(*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for r in rows]


@pytest.mark.parametrize("chunk_bytes", [300, 2 << 20])
def test_alignment(spark, chunk_bytes):
    rng = random.Random(4)
    words = ["the", "Straße", "übung", "naïve", "tion", "queue", "aa", "aaa", "İ", "word,", "42", "x.y"]
    texts = AWKWARD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[30]] * 3
    rows = [(i if i % 17 else None, t, 1, "k", 2, 3, "key", 4, "t") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected, counts = brute(texts)
    found = alignment.align_documents(docs, *PATHS, chunk_bytes=chunk_bytes)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((r[0], *x)) for r, x in zip(rows, _digest(expected)))
    pairs = alignment.pair_counts(alignment.align(docs, *PATHS, chunk_bytes=chunk_bytes)).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs} == counts
    shown = alignment.groups(docs, *PATHS, chunk_bytes=chunk_bytes).collect()
    assert sorted(r.groups for r in shown) == sorted(x[6] for x in expected)


def test_op11_on_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = brute([r.text for r in rows])
    found = queries.QUERIES["op11_token_alignment"](spark, SMALL)
    assert found.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted((r.doc_id, *x) for r, x in zip(rows, _digest(expected)))


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(none, *PATHS).count() == 0 and alignment.groups(none, *PATHS).count() == 0


def test_identity_map_has_equal_bytes():
    pair = Pair(*PATHS)
    known = [(a, b) for a, b in enumerate(pair.identity.tolist()) if b >= 0]
    assert len(known) > 10_000 and all(pair.bytes_a[a] == pair.bytes_b[b] for a, b in known)


def test_merging_by_rank_gives_the_same_ids():
    """Whatever counts as plain is cut and merged alike by both libraries."""
    pair = Pair(*PATHS)
    assert pair.quick is not None
    rng = random.Random(6)
    plain = [chr(c) for c in range(0x2100) if pair._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 600
    for _ in range(1500):
        text = "".join(rng.choice(plain if rng.random() < 0.5 else " \n\t'aeioulst.,1") for _ in range(rng.randint(1, 60)))
        assert pair.quick.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids, ascii(text)
