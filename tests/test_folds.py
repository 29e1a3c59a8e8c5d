"""Ordered folds against slow models written another way, over generated cases."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import folds

word = st.sampled_from(["and", "but", "a", "the", "give", "up", "hello,", "world", "extraordinary", "x;", "time", "after", "is.", "ünïcode"])


@settings(max_examples=300, deadline=None)
@given(st.lists(word, max_size=60))
def test_groups_keep_words_in_order(words):
    for rule in (lambda w: folds.pack_by_bytes(w, 20), folds.comma_breaks, folds.semantic_breaks, folds.fixed_length, folds.comma_parts):
        groups = rule(words)
        assert len(groups) == len(words)
        assert groups == sorted(groups) and (not groups or (groups[0] == 0 and set(groups) == set(range(groups[-1] + 1))))


@settings(max_examples=300, deadline=None)
@given(st.lists(word, max_size=60))
def test_comma_parts_model(words):
    parts, cur = [], []
    for w in words:
        cur.append(w)
        if w[-1] in ",;":
            parts.append(cur)
            cur = []
    parts += [cur] if cur else []
    out = []
    hold = []
    for p in parts:
        if len(p) == 1:
            hold += p
        else:
            out.append(hold + p)
            hold = []
    if hold:
        out = out[:-1] + [out[-1] + hold] if out else [hold]
    groups = folds.comma_parts(words)
    assert [[w for w, g in zip(words, groups, strict=True) if g == k] for k in range(len(out))] == out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_batches_fit(sizes):
    batch = folds.pack_batches(sizes)
    for k in set(batch):
        own = [s for s, b in zip(sizes, batch, strict=True) if b == k]
        assert len(own) == 1 or (len(own) <= 3 and sum(own) <= 10)
    assert batch == sorted(batch)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14))
def test_longest_chain_model(nums):
    best = [1] * len(nums)
    for i in range(len(nums)):
        for j in range(i):
            if nums[i] == nums[j] + 1:
                best[i] = max(best[i], best[j] + 1)
    chain = folds.longest_chain(nums)
    assert len(chain) == max(best, default=0)
    assert all(a < b and nums[b] == nums[a] + 1 for a, b in zip(chain, chain[1:], strict=False))


def test_reflow_bounds():
    rng = random.Random(1)
    for _ in range(300):
        lines = ["".join(rng.choice("字句。，、a!") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 12))]
        out = folds.reflow(lines, True)
        assert "".join(out).replace("，", "") == "".join(lines).replace("，", "")
        assert all(len(x) <= 23 for x in out)


def test_alignment_of_own_words():
    words = [("Hello,", 0.0, 0.4), ("world.", 0.5, 0.9), ("Hello", 1.0, 1.4), ("again.", 1.5, 1.9)]
    assert folds.align(["Hello, world.", "Hello again."], words) == [(0.0, 0.9), (1.0, 1.9)]
    assert folds.align(["Hello", "Hello"], words) == [(0.0, 0.4), (1.0, 1.4)]
    assert folds.align(["zzz", "…"], [("a", 0.0, 1.0)]) == [(0.0, 0.0), (0.0, 0.0)]


def test_short_lines_ascend():
    words = [(f"w{i}", i * 0.3, i * 0.3 + 0.25) for i in range(20)]
    lines = folds.short_lines(words, 0.0, 6.0, 0.0, 8)
    assert len(lines) == 3 and "".join(t for t, _, _ in lines).split() == [w for w, _, _ in words]
    assert all(a <= b for _, a, b in lines) and all(x[2] <= y[1] for x, y in zip(lines, lines[1:], strict=False))


def test_match_pieces():
    words = ["The", "quick", "brown", "fox.", "Jumped"]
    assert folds.match_pieces("quick fox", words, 0) == [1, 3] and folds.match_pieces("none of these", words, 0) == []


def test_merge_short():
    assert folds.merge_short(["a b", "c d", "e f g h i j k l m n o p q r s t u v"], 5, 10) == ["a b c d", "e f g h i j k l m n o p q r s t u v"]
