"""Plain one-machine versions of the operators, for small tables only."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

BLANK_WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=BLANK_WORD):
    return pattern.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(docs, items, window=10):
    """docs: [(key, text)], items: [(id, text)] -> [(n_words, n_hit, ids)]."""
    known = collections.defaultdict(set)
    for item, text in items:
        w = words((text or "").translate(LOWER), ALNUM_WORD)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in known}
    out = []
    for _, text in docs:
        w = words((text or "").translate(LOWER), ALNUM_WORD)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                ids = known.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    spans = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            shown, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in shown.split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


def fingerprint(text, shingle=4):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, max_bits=4):
    """For each fingerprint in a list the number of the first one it is linked to."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(every[i] ^ every[i + 1 :]) <= max_bits):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def smallest_keys(docs):
    """docs: [(key, text)] -> per document the smallest key of its component."""
    roots = groups([fingerprint(t) for _, t in docs])
    best = {}
    for root, (key, _) in zip(roots, docs):
        if key is not None:
            best[root] = min(key, best.get(root, key))
    return [best.get(r) for r in roots]


def token_rows(texts, tokenizer, end_id=1):
    """[(start, n_tokens, crc)] of texts in file order."""
    rows, at = [], 0
    for text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        rows.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return rows


def repeats(docs, length):
    """docs: [(key, text)] -> [(n_words, n_removed, kept)]."""
    first = {}
    for key, text in docs:
        w = words(text)
        order = math.inf if key is None else key
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            first[window] = min(order, first.get(window, order))
    out = []
    for key, text in docs:
        w = words(text)
        order = math.inf if key is None else key
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < order:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def backoff_scores(texts, order, backoff=0.4):
    every = [words(t) for t in texts]

    def grams(w):
        return [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]

    own = [grams(w) for w in every]
    total = [sum((o[n] for o in own), collections.Counter()) for n in range(order)]
    size = sum(map(len, every))
    out = []
    for w, mine in zip(every, own):
        rest, score = max(1, size - len(w)), 0.0
        for i in range(len(w)):
            reach = min(i, order - 1)
            for n in range(reach, -1, -1):
                gram = tuple(w[i - n : i + 1])
                count = total[n][gram] - mine[n][gram]
                if count > 0:
                    context = total[n - 1][gram[:-1]] - mine[n - 1][gram[:-1]] if n else rest
                    score += math.log(backoff ** (reach - n) * count / context)
                    break
            else:
                score += math.log(backoff**order / rest)
        out.append((len(w), score))
    return out
