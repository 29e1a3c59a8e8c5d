"""Plain versions of the numbered operators, for small tables."""

import re
import zlib
from functools import reduce

import numpy as np
import xxhash
from public_tokenizers import PATTERN, path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    words = WORDS.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size, num, den):
    """Index of the row with the least doc_id (nulls last) in each row's component, by comparing all pairs of sets."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    best = {}
    for members in groups.values():
        least = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        best |= dict.fromkeys(members, least)
    return [best[i] for i in range(len(rows))], [len(s) for s in sets]


def byte_bpe():
    import base64

    import tiktoken

    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


def passes(kind, piece):
    digits = [int(c) for c in piece if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in p.finditer(text) if passes(k, m[0])]


def simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes = np.zeros(64, int)
    terms = [words[i : i + 5] for i in range(max(len(words) - 4, 1))] if words else []
    for term in terms:
        h = reduce(lambda seed, w: xxhash.xxh64_intdigest(w.encode(), seed), term, 42)
        votes += [1 if h >> b & 1 else -1 for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def likeness(a, b):
    return 1 - (a ^ b).bit_count() / 64


def crc32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def auc(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    good, bad = scores[labels == 1][:, None], scores[labels == 0][None]
    return ((good > bad) + 0.5 * (good == bad)).mean()
