"""Operators against brute force, on small tables with every awkward case."""

import random

import public_tokenizers
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketlens.llm import (
    language,
    leaks,
    lines,
    mixing,
    personal,
    quality,
    queries,
    simhash,
    substrings,
    tokenfiles,
    urls,
)
from basketlens.llm.queries import TOKENIZER
from tests.conftest import SMALL
from tests.llm import brute

# names the operators use inside, and a nested column
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, row int, own int, "
    "id string, n_words string, kept int, h int, s int, fp string, content array<int>, base_failed string"
)


def _row(key, text, lang="en", source="a"):
    return (key, text, lang, source, len(text or ""), "k", 1, 2, "i", "w", 0, 3, 4, "f", [1], "b")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÑANDÚ", "naïve,", "x\u00a0y", "\u2028", "a'b", "ﬁn"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = text(40)
    made = [_row(i, text(rng.randint(1, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    made += [_row(100 + i, f"{text(5)}\n{shared}\n{text(4)}\n  Same LINE \n") for i in range(15)]
    made += [_row(200, None), _row(201, ""), _row(202, " \n\t "), _row(None, shared), _row(None, None)]
    made += [_row(203, "repeat me " * 12), _row(203, "repeat me " * 12), _row(204, "one two three")]
    made += [_row(205, text(9000)), _row(206, "x" * 50_000), _row(207, "\x0b\x0ctail \r\n")]
    made += [_row(208, text(30), None, None), _row(-5, shared + " end"), _row(209, "<|endoftext|> <|X|> it's 42'S")]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _pairs(rows):
    return [(r[0], r[1]) for r in rows]


def _sorted(found):
    return sorted(map(repr, found))


# -- 1 quality ---------------------------------------------------------------------


def _measures(text):
    w = brute.words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 2000 else None
    full = [x for x in (text or "").split("\n") if brute.words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), covered and len(covered) or 0)


def test_quality_measures(docs, rows):
    found = quality.measures(docs.select("doc_id", "text")).drop("n_lines").collect()
    short = [r for r in rows if len(brute.words(r[1])) < 2000]
    assert _sorted(tuple(r) for r in found if r[1] < 2000) == _sorted((r[0], *_measures(r[1])) for r in short)


@pytest.mark.parametrize("x,n,risk", [(0, 50, 0.05), (3, 400, 0.02), (40, 900, 0.05), (5000, 110_000, 0.05), (9, 100, 0.05), (0, 0, 0.1)])
def test_exact_tail(spark, x, n, risk):
    import math

    row = spark.range(1).select(F.lit(x).cast("long").alias("x"), F.lit(n).cast("long").alias("n"))
    found = row.select(quality.lower_tail(F.col("x"), F.col("n"), risk)).first()[0]
    if not n or x >= n * risk:
        assert found == 1.0
        return

    def term(i):
        logs = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        return math.exp(logs + i * math.log(risk) + (n - i) * math.log(1 - risk))

    assert found == pytest.approx(sum(map(term, range(x + 1))), rel=1e-6)


def test_quality_guarantee(spark):
    """A rule that good documents obey is used; one they break often is not."""
    text = "good words stand here in a line of plain text number"
    made = [(i, f"{text} {i}", "en") for i in range(3000)]
    made += [(5000 + i, " ".join(f"{w}###" for w in text.split()) + f" {i}", "en") for i in range(50)]
    made += [(7000 + i, f"{text} {i} ###########", "fr") for i in range(3000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality")).unionAll(
        docs.where("doc_id >= 7000").select("doc_id", F.lit(1))
    )
    found = {r[0]: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(found[i] for i in range(3000)) and all(found[i] for i in range(7000, 10000))
    assert not any(found[5000 + i] for i in range(50))
    assert sorted(r[0] for r in quality.keep_good(docs, labels).collect()) == sorted(k for k, v in found.items() if v)


def test_quality_without_labels(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(docs, none).collect():
        assert r.kept == (not r.base_failed)
    assert quality.judge(nothing, none).count() == 0 and quality.keep_good(nothing, none).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns


# -- 2 mixing ----------------------------------------------------------------------


def test_mix(docs, rows):
    found = mixing.mix(docs).collect()
    assert _sorted(tuple(r) for r in found) == _sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    target = {}
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left = set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    by_key = {r[0]: r for r in rows}
    taken = {}
    for r in found:
        source = by_key[r.doc_id][3]
        assert r.target == pytest.approx(target[source]) and r.source_size == sizes[source]
        assert r.taken <= 3 * r.size and r.taken == r.size * r.repeats
        taken[source] = taken.get(source, 0) + r.taken
    largest = max(len(brute.words(r[1])) for r in rows)
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest


def test_mix_clamps_and_samples(spark, nothing):
    made = [(i, f"w{i} x y", "big" if i >= 4 else "a") for i in range(1000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    found = mixing.mix(docs, weights=(1,)).collect()
    assert {r.taken for r in found if r.doc_id < 4} == {9}
    total = sum(r.taken for r in found)
    assert abs(total - 3000) <= 3
    sampled = mixing.sample(docs, weights=(1,))
    assert sampled.columns == docs.columns and sampled.count() == sum(r.repeats for r in found)
    assert mixing.mix(nothing).count() == 0 and mixing.sample(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


# -- 3 decontamination -------------------------------------------------------------


@pytest.mark.parametrize("gram", [5, 3, 10])
def test_leaks(spark, docs, rows, gram):
    texts = [r[1] for r in rows if r[1]]
    long = max(texts, key=lambda t: len(t.split()))
    w = long.split()
    items = [(1, " ".join(w[100:115])), (2, " ".join(w[300:307])), (3, "w1 W2!"), (4, None), (5, " ... "), (None, " ".join(w[400:411])),
             (7, "W3"), (7, " ".join(w[500:512])), (8, "not in any of them at all my dear good friend of old days")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.find_leaks(docs, table, gram=gram).collect()
    expected = brute.leaks(_pairs(rows), items)
    assert _sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found) == _sorted(
        (k, n, hit, ids, hit > 0) for (k, _), (n, hit, ids) in zip(_pairs(rows), expected)
    )
    kept = leaks.drop_leaks(docs, table, gram=gram)
    assert kept.columns == docs.columns
    assert kept.count() == sum(hit == 0 for _, hit, _ in expected)


def test_leaks_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in leaks.find_leaks(docs, none).collect()} == {False}
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaks.find_leaks(nothing, items).count() == 0


# -- 4 lines -----------------------------------------------------------------------


def test_lines(docs, rows, nothing):
    split = [(r[1] or "").split("\n") for r in rows]

    def norm(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)

    count = {}
    for ls in split:
        for k in {norm(x) for x in ls}:
            count[k] = count.get(k, 0) + 1
    expected = []
    for r, ls in zip(rows, split):
        kept = [x for x in ls if not norm(x) or count[norm(x)] < 10]
        expected.append((r[0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    found = lines.drop_frequent_lines(docs, min_docs=10)
    assert _sorted(tuple(r) for r in found.collect()) == _sorted(expected)
    assert any(e[2] for e in expected)
    assert lines.drop_frequent_lines(nothing).count() == 0


# -- 5 personal data ---------------------------------------------------------------

PERSONAL_TEXTS = [
    "mail a.b@c.d.org, x@a_b@c.d y@.z @q.r a@b.c@d.e -@-.- b@c.d_e@f.g",
    "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.0002.0003.0255 9.9.9 1.2.3.4567",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 1 2 3",
    "call +49 (0) 151.234-5678 or +1 2 +123456789012345678 +12345678",
    "iban DE89 3702 0400 4404 3201 30 GB82WEST12345698765432 DE89370400440532013001 ssn 123-45-6789 and 000-12-1234",
    "ünï 10.0.0.1 ünï x@y.zz 1" * 3,
]


@pytest.mark.parametrize("text", [*PERSONAL_TEXTS, "", "9" * 30_000 + ".1.2", "a" * 30_000 + " b@c.de"])
def test_personal_base(text):
    kinds = personal.KINDS
    found = [(kinds[k].name, s, e) for k, s, e, _ in personal.Finder().spans(text) if kinds[k].base]
    assert found == brute.personal(text)


def test_personal_added(spark, docs, rows, nothing):
    found = personal.Finder().spans(PERSONAL_TEXTS[4])
    added = [(personal.KINDS[k].name, PERSONAL_TEXTS[4][s:e]) for k, s, e, _ in found if not personal.KINDS[k].base]
    assert added == [("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789")]
    assert personal.Finder().spans("number 123-45-6789 here") == []
    got = personal.find_personal(docs).collect()
    assert len(got) == len(rows) and personal.find_personal(nothing).count() == 0


@pytest.mark.parametrize(
    "text,account",
    [
        ("DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
        ("to DE89 3704 0044 0532 0130 00 2024", "DE89 3704 0044 0532 0130 00"),
        ("GB82 WEST 1234 5698 7654 32 USD 500", "GB82 WEST 1234 5698 7654 32"),
        ("DE89370400440532013000 2024-01-31", "DE89370400440532013000"),
        ("NO9386011117947 EUR 12", "NO9386011117947"),
        ("REF AB12 DE89370400440532013000 please", "DE89370400440532013000"),
        ("ZZ36370400440532013000 BIC COBADEFFXXX", None),
        ("DE89370400440532013000X", None),
        ("DE8937040044053201300 0", "DE8937040044053201300 0"),
    ],
)
def test_account_numbers_before_other_tokens(text, account):
    found = [text[s:e] for k, s, e, _ in personal.Finder().spans(text) if personal.KINDS[k].name == "iban"]
    assert found == ([account] if account else [])


# -- 6 SimHash ---------------------------------------------------------------------


def test_simhash(docs, rows, nothing):
    found = simhash.near_duplicates(docs).collect()
    expected = [
        (k, brute.fingerprint(t), c) for (k, t), c in zip(_pairs(rows), brute.smallest_keys(_pairs(rows)))
    ]
    assert _sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == _sorted(expected)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute.groups([brute.fingerprint(t) for _, t in _pairs(rows)])))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_links_of_clusters_and_full_cells(spark):
    rng = random.Random(2)
    made = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        made |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    # a chain, each four bits from the next, in one cell of two groups
    made |= {sum(3 << (2 * j) for j in range(2 * i)) for i in range(16)}
    made |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    prints = sorted(made)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    expected = brute.groups(prints)
    for block in (4096, 7):
        edges = simhash.links(nodes, 4, 3, block).collect()
        parent = {p: p for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= 4
            parent[max(find(a), find(b))] = min(find(a), find(b))
        assert [find(p) for p in prints] == [prints[i] for i in expected]


# -- 7 token files -----------------------------------------------------------------


def test_token_files(spark, docs, rows, nothing):
    path = public_tokenizers.path(TOKENIZER)
    folder = tokenfiles.token_folder(spark)
    manifest = tokenfiles.write_token_files(docs, folder, path)
    found = sorted(tokenfiles.read_token_files(manifest, folder, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    # equal keys come in an order of their own: compare sets of content, and sums
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append(r[1])
    assert sum(r.n_tokens for r in found[:-1]) == found[-1].start
    tokenizer = Tokenizer.from_file(path)
    for key in text:
        expected = [e[1:] for e in brute.token_rows(text[key], tokenizer)]
        assert _sorted((r.n_tokens, r.ids_crc32) for r in found if r.doc_id == key) == _sorted(expected)
    empty = tokenfiles.token_folder(spark)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(nothing, empty, path), empty, path).count() == 0


@pytest.mark.parametrize("name", [TOKENIZER, "byte_bpe_50k.json"])
def test_encoder(name, rows):
    path = public_tokenizers.path(name)
    encoder, tokenizer = tokenfiles.Encoder(path, keep=50), Tokenizer.from_file(path)
    odd = ["a\x1cb\x1dc", "A\u0301 \u0301e", "İSTANBUL ΣΑΣ", "don't 'Re we'LL", "<|startoftext|>x <|STARTOFTEXT|>", "\x00\x7f", "日本語 12３"]
    for text in [*(r[1] or "" for r in rows), *odd]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(memoryview(encoder.encode(text)).cast("H")) == ids


# -- 8 substrings ------------------------------------------------------------------


@pytest.mark.parametrize("length,chunk,per_range", [(13, 8 << 20, 16 << 20), (13, 500, 1000), (6, 2000, 300), (1, 900, 5000)])
def test_repeats(docs, rows, length, chunk, per_range):
    found = substrings.remove_repeats(docs, length=length, chunk_bytes=chunk, range_bytes=per_range).collect()
    expected = [(k, *e) for (k, _), e in zip(_pairs(rows), brute.repeats(_pairs(rows), length))]
    assert _sorted(tuple(r) for r in found) == _sorted(expected)
    assert any(e[2] for e in expected)


@pytest.fixture(scope="module")
def long_repeats():
    """Documents that share passages of 12 to 700 words, and one repeat of their own."""
    rng = np.random.default_rng(17)

    def words(n):
        return [f"w{i}" for i in rng.integers(0, 4000, n)]

    passages = [words(n) for n in (12, 13, 26, 49, 50, 51, 120, 199, 200, 201, 700)]
    rows = []
    for i in range(24):
        parts = [words(int(rng.integers(3, 60)))]
        for p in rng.choice(len(passages), 3):
            parts += [passages[p], words(int(rng.integers(1, 30)))]
        rows.append((i, " ".join(w for part in parts for w in part)))
    own = words(230)
    return [*rows, (24, " ".join(own + words(5) + own)), (25, None), (26, rows[3][1]), (27, "")]


@pytest.mark.parametrize("length", [13, 50, 200])
@pytest.mark.parametrize("chunk,per_range", [(4 << 20, 8 << 20), (3000, 2000)])
def test_repeats_at_longer_lengths(spark, long_repeats, length, chunk, per_range):
    df = spark.createDataFrame(long_repeats, "doc_id long, text string").repartition(3)
    found = substrings.remove_repeats(df, length=length, chunk_bytes=chunk, range_bytes=per_range).collect()
    expected = [(k, *e) for (k, _), e in zip(long_repeats, brute.repeats(long_repeats, length))]
    assert _sorted(tuple(r) for r in found) == _sorted(expected)
    assert any(e[2] for e in expected) and any(not e[2] for e in expected)


def test_levels_end_when_no_candidate_survives(spark, monkeypatch):
    assert [substrings.level_lengths(n) for n in (1, 6, 13, 50, 200)] == [
        [1, 1], [3, 6], [7, 13], [7, 13, 25, 50], [7, 13, 25, 50, 100, 200]
    ]
    asked = []
    answers = substrings.exchange.answers
    monkeypatch.setattr(substrings.exchange, "answers", lambda *a: asked.append(1) or answers(*a))
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(250)) + " " + shared) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in substrings.remove_repeats(df, length=200).collect()} == {0}
    # thirty shared words, then the text's end: no window of 50 has all of its windows of
    # 25 left, so the third level asks nothing and ends the loop
    assert len(asked) == 3


def test_repeats_refuse_text_keys(spark):
    with pytest.raises(TypeError, match="whole number"):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_repeats_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


# -- 9 URLs ------------------------------------------------------------------------

URLS = [
    "http://a.example.net/en/1", "http://A.EXAMPLE.net/de/1?x#y", "https://net/", "https://notnet/", "http://x.net",
    "http://example.com/de/x", "http://b.example.com/en", "http://q.org/fr/", "http://q.org/fr", "org/fr/", None, "",
    "ftp://user@example.net:80/en/", "http:///path", "http://?q", "http://example.net./en/", "http://org/fr/a/b", "a://b://c.net/",
    "http://" + "a." * 2000 + "net/" + "p" * 5000, "http://example.net/en/1", "http://example.net/en/1", "http://net#x/en", "http://é.net/",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("example.net", "/e", "block"), ("org", "/fr/a", "block"), ("org", "/fr/a", "allow"), ("com", "", "block")]


@pytest.mark.parametrize("rules", [RULES, RULES[:4], []])
def test_urls(spark, rules):
    import re

    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    expected = []
    for i, u in enumerate(URLS):
        m = re.search("://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).translate(brute.LOWER), m.group(2)) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        expected.append((i, host, path, best[1], best[2]))
    assert _sorted(tuple(r) for r in urls.judge_urls(pages, table).collect()) == _sorted(expected)
    assert urls.judge_urls(pages.limit(0), table).count() == 0


# -- 10 language model -------------------------------------------------------------


@pytest.mark.parametrize("order,chunk,per_range", [(2, 8 << 20, 16 << 20), (3, 700, 900), (1, 5000, 400)])
def test_scores(docs, rows, order, chunk, per_range):
    found = language.score_documents(docs, order=order, chunk_bytes=chunk, range_bytes=per_range).collect()
    expected = brute.backoff_scores([r[1] for r in rows], order)
    assert len(found) == len(rows)
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_score) for r in found)
    theirs = sorted((r[0] is None, r[0] or 0, n, s) for r, (n, s) in zip(rows, expected))
    for a, b in zip(mine, theirs):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-9)


def test_registered_scores_use_two_words_of_context(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in docs), brute.backoff_scores([r.text for r in docs], 3)))
    found = queries.op10_lm_scores(spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, pytest.approx(r.log_score, rel=1e-9)) for r in found} == expected


@pytest.mark.parametrize("order", [3, 5])
def test_longer_scores_by_level(docs, rows, order):
    found = language.score_documents(docs, order=order, chunk_bytes=3000, range_bytes=2000).collect()
    expected = brute.backoff_scores([r[1] for r in rows], order)
    theirs = sorted((r[0] is None, r[0] or 0, n, s) for r, (n, s) in zip(rows, expected))
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_score) for r in found)
    for a, b in zip(mine, theirs, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-9)


def test_scores_of_nothing(spark, nothing):
    assert language.score_documents(nothing).count() == 0
    alone = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert language.score_documents(alone, order=2).first().log_score == pytest.approx(2 * brute.math.log(0.16))


# -- names, and the quality method at work --------------------------------------------


@pytest.mark.parametrize("key,text", [("id", "own"), ("own", "cut"), ("cut", "id"), ("pos", "k"), ("a", "b"), ("cut_id", "cut_own"), ("n_lines", "kept")])
def test_lines_with_clashing_names(spark, key, text):
    rows = [(i, f"common\nown {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, f"`{key}` long, `{text}` string")
    found = lines.drop_frequent_lines(docs, key, text).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in found) == [(i, 2, 1, f"own {i}") for i in range(12)]


def test_quality_decides_in_every_language(spark):
    """On sf0.1 every language has a proven step, and the SQL agrees on every document."""
    import __spark_entry__ as contract
    from tests.compare import compare, duck

    directory = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, directory, "documents"), queries.table(spark, directory, "labels")
    measured = quality.measures(docs.select("doc_id", "lang", "text"))
    chosen = {r[0]: r for r in quality.cutoffs(measured, labels, "doc_id", "lang").collect()}
    assert {"en", "de", "fr", "es"} <= set(chosen) and all(r.cutoff_symbols_per_word is not None for r in chosen.values())
    judged = queries.QUERIES["op1_quality_rules"](spark, directory)
    assert compare(judged, duck(directory), contract.oracle_sql()["op1_quality_rules"]) == []
    by = {r.lang: r.n for r in judged.where("NOT base_failed AND NOT kept").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert {"en", "de", "fr", "es"} <= set(by)


def test_quality_loses_no_more_than_its_risk(spark):
    """Strata whose good documents are rejected at known rates: none is given a step
    that loses more than the risk, and most get one that loses less."""
    import numpy as np

    rng = np.random.default_rng(12)
    rule = (quality.Rule("score", "n_symbols / n_words", (0.9, 0.7, 0.5, 0.3, 0.1)),)
    losses = (0.0, 0.005, 0.015, 0.03, 0.1)
    rows = []
    for stratum in range(60):
        # the least loss whose cutoff a score exceeds with the given probability
        u = rng.random(600)
        score = np.select([u < losses[1], u < losses[2], u < losses[3], u < losses[4]], [0.8, 0.6, 0.4, 0.2], 0.0)
        rows += [(int(stratum * 1000 + i), f"s{stratum}", 1000, int(1000 * s), 0) for i, s in enumerate(score)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, n_symbols long, n_repeat_words long")
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    chosen = quality.cutoffs(measured, labels, "doc_id", "lang", rule, risk=0.02, delta=0.05).collect()
    assert len(chosen) > 50 and all(r.cutoff_score >= 0.5 for r in chosen)
    assert {r.cutoff_score for r in chosen} & {0.7, 0.5}
