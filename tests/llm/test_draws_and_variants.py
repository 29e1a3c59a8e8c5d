"""Importance resampling, min-max dedup and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import plain
from tidemark.llm import minmax, parity_join, resampling, spelling

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile("[a-zÀ-ÿ]+")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture(params=["small", "made"])
def docs(request):
    return request.getfixturevalue(request.param)


# 11: importance resampling


def features(text, longest):
    words = TOKEN.findall(plain.lowered(text))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, rule):
    bucket = lambda f: zlib.crc32(f.encode()) % rule.buckets
    found = [features(t, rule.run) for _, t in rows]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, rule.run)[1])
    S, T = sum(s.values()) + rule.buckets, sum(t.values()) + rule.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    out = []
    for (d, _), (n, fs) in zip(rows, found, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= rule.least_words))
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = rule.percent * sum(r[4] for r in out) // 100
    return [(*r[:4], i + 1 if i < most else None) for i, r in enumerate(out)]


@pytest.mark.parametrize("rule", [resampling.Draw(), resampling.Draw(run=3, buckets=97, least_words=1, percent=60, seed=3), resampling.Draw(run=1, least_words=0, percent=100)])
def test_draw_equals_a_plain_version(spark, docs, rule):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = resampling.resample(docs, target, rule)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in found.dtypes} == {"bigint"}
    assert ordered(map(tuple, found.collect())) == ordered(resampled(texts_of(docs), [r.text for r in target.collect()], rule))


def test_draw_of_empty_tables(spark, made, nothing):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert resampling.resample(nothing, target).count() == 0
    found = resampling.resample(made, nothing)
    assert ordered(map(tuple, found.collect())) == ordered(resampled(texts_of(made), [], resampling.Draw()))


def test_ranks_go_on_over_partitions(spark):
    rows = [(i if i % 7 else i - 1, 5, i % 3, i % 3, i % 4 > 0) for i in range(2_000)]
    frame = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, fit boolean").repartition(13)
    found = resampling.ranked(frame, resampling.Draw(percent=50)).collect()
    ranks = sorted(r.rank for r in found if r.rank)
    fits = sum(r[4] for r in rows)
    assert len(found) == len(rows) and ranks == list(range(1, fits // 2 + 1))
    drawn = [(-r.score, r.doc_id) for r in sorted((r for r in found if r.rank), key=lambda r: r.rank)]
    assert drawn == sorted((-r[3], r[0]) for r in rows if r[4])[: fits // 2]


def test_drawn_rows_keep_their_columns(spark, small):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = resampling.drawn(small, target)
    ids = {r.doc_id for r in resampling.resample(small, target).collect() if r.rank}
    assert sorted(found.columns) == sorted(small.columns) and {r.doc_id for r in found.collect()} == ids and ids


# 12: min-max dedup


def test_dedup_finds_every_component(docs):
    rows = texts_of(docs)
    best, sizes = plain.components(rows, 4, 80, 100)
    expected = [(d, n, rows[b][0], d == rows[b][0]) for (d, _), b, n in zip(rows, best, sizes, strict=True)]
    assert ordered(map(tuple, minmax.groups(docs).collect())) == ordered(expected)


def near_sets(rng, n, common):
    """Two sets of n hashes with so many in common."""
    pool = rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
    return np.sort(pool[:n]), np.sort(pool[n - common :])


def test_signature_estimates_without_bias():
    rng, errors = np.random.default_rng(3), []
    for n, common in ((50, 40), (300, 150), (3_000, 2_700)):
        true = common / (2 * n - common)
        found = [minmax.likeness(*map(minmax.signature, near_sets(rng, n, common))) for _ in range(60)]
        errors.append(abs(np.mean(found) - true))
        assert np.std(found) < 1.25 * math.sqrt(true * (1 - true) / (2 * minmax.PERMUTATIONS))
    assert max(errors) < 0.02


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(4)
    for n, common in ((9, 8), (90, 80), (900, 800)):  # a similarity of 0.8
        assert all(np.intersect1d(*map(minmax.band_keys, near_sets(rng, n, common))).size for _ in range(300))


def test_dedup_of_a_chain_and_a_crowd(spark):
    """Links that only a chain holds together, and a crowd of near copies around one hot text."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(60)]  # neighbours share 95 of 99 shingles
    base = [f"v{i}" for i in range(120)]
    rows += [(1_000 + i, " ".join(["".join(rng.choices("xyz", k=6)) if j == i % 120 else w for j, w in enumerate(base)])) for i in range(300)]
    rows += [(2_000 + i, " ".join(base)) for i in range(50)]
    best, sizes = plain.components(rows, 4, 80, 100)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {d: (n, rows[b][0]) for (d, _), b, n in zip(rows, best, sizes, strict=True)}
    assert len({c for _, c in found.values()}) == 2


def test_dedup_keeps_one_row(spark, made, nothing):
    assert minmax.groups(nothing).count() == 0 and minmax.keep_one(nothing).count() == 0
    assert ordered((r.doc_id, r.text) for r in minmax.keep_one(made).collect()) == ordered((r.doc_id, r.text) for r in parity_join.keep_one(made, minmax.RULE).collect())


# 13: spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants(rows, rule):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(plain.lowered(text)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % rule.every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= rule.least_chars and k >= rule.least_count}
    around = {w: [o for o in n if near(w, o)] for w in n}
    best = {w: min(os, key=lambda o: (-n[o], o)) for w, os in around.items() if os}
    form = {w: o if n[o] >= rule.ratio * n[w] else None for w, o in best.items()}
    out = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if form.get(w) else None))
    return out


@pytest.mark.parametrize("rule", [spelling.Variants(), spelling.Variants(3, 1, 5, 2)])
def test_variants_equal_a_plain_version(spark, docs, rule):
    rows = [(d, (t or "")[:4_000]) for d, t in texts_of(docs)][:80]
    found = spelling.groups(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string"), rule)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(map(tuple, found.collect())) == ordered(variants(rows, rule))


def test_variants_of_odd_texts(spark, made, nothing):
    assert spelling.groups(nothing).count() == 0
    rule = spelling.Variants(2, 2, 7, 2)
    rows = texts_of(made.where("doc_id is null or doc_id not in (4, 60)"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(map(tuple, spelling.groups(frame, rule).collect())) == ordered(variants(rows, rule))


@pytest.mark.parametrize(("depth", "leaf"), [(6, 4096), (2, 3), (3, 1)])
def test_no_pair_is_lost_by_splitting(spark, depth, leaf):
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(250)}
    words |= {"prefix" * 2 + "".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(60)} | {"z" * 13, "z" * 14}
    found = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), depth, leaf).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == {(a, b) for a in words for b in words if near(a, b)}


def test_active_nodes_of_a_small_trie():
    words = sorted(["abc", "abd", "abcd", "bc", "xabc", "zz"])
    found = {(words[i], words[j]) for i, j in spelling.subtrie_pairs(words)}
    assert found == {(a, b) for a in words for b in words if near(a, b)}


def test_roots_follow_a_long_chain(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "y")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {f"w{i}": "w37" for i in range(37)} | {"x": "y"}


# 3: tokens that always come together


def test_url_templates_are_one_item(spark):
    import time

    from tidemark.llm import url_filter

    names = "&".join(f"name{i}=1" for i in range(30))
    rows = [(i, f"http://a.xyz/go?{names}") for i in range(60)] + [(100 + i, f"http://b.xyz/stay/{i}?{names if i % 2 else 'x=1'}") for i in range(40)]
    rows += [(200, "http://c.xyz/go?name3=5"), (201, "http://a.xyz/"), (202, "http://c.xyz/other?name3=5"), (203, None)]
    labels = spark.createDataFrame([(i, i < 60) for i, _ in rows if i < 200], "page_id long, bad boolean")
    begun = time.perf_counter()
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert time.perf_counter() - begun < 40
    assert all(found[i] == "block" for i in range(60)) and all(found[100 + i] == "allow" for i in range(40))
    assert (found[200], found[201], found[202], found[203]) == ("block", "block", "allow", "allow")
