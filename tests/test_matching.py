"""The protected sentence split and the matching of sentences against stated cases and plain scans."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import matching, splitting


@pytest.mark.parametrize(
    ("text", "most", "wanted"),
    [
        ("Now, I'm Ryan D'Aris, founder and CEO of flowstate.com", 55, ["Now, I'm Ryan D'Aris, founder and CEO of flowstate.com"]),
        ("It costs 3.14 at 10.30 a.m. today. Dr. Who said so!", 70, ["It costs 3.14 at 10.30 a.m. today.", "Dr. Who said so!"]),
        # The decimal 2.5 is taken before versions are looked for, as the order of the patterns has it.
        ("U.S.A. has 1,234,567.8 things; version 2.5.1 is out。好", 70, ["U.S.A. has 1,234,567.8 things; version 2.5.", "1 is out。", "好"]),
        ('"', 70, []),
        ('He left.\n"', 70, ['He left."']),
        ("", 70, []),
        (None, 70, []),
        (" \n ", 70, []),
        ("one, two, three, four and five, six and seven, eight", 20, ["one, two, three,", "four and five, six", "and seven, eight"]),
    ],
)
def test_split_text(text, most, wanted):
    found = splitting.split_text(text, most)
    if most == 20:
        assert " ".join(found).split() == text.split() and all(splitting.effective(s) <= 20 for s in found) and len(found) > 1
    else:
        assert found == wanted


pieces = st.sampled_from(["a", "12", "3", ".", ",", "!", " ", "\n", "Mr", "com", "p.m.", '"', "。", "，", "Abc", ":", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=40).map("".join))
def test_split_keeps_all_but_space_and_leading_quotes(text):
    bare = lambda s: re.sub(r'[\s"]', "", s)
    assert bare("".join(splitting.split_text(text, 10))) == bare(text)


def test_protected_sentences_column(spark):
    rows = spark.createDataFrame([(1, "It is 3.5. Yes."), (2, None), (3, "")], "id int, text string")
    assert [r[1] for r in rows.select("id", splitting.protected_sentences(F.col("text"))).orderBy("id").collect()] == [["It is 3.5.", "Yes."], [], []]


def test_spaced_signs(spark):
    cases = {"你好，世界。 ": "你好 世界", "a，，b": "a b", "3.14，是": "3.14 是", "（x，y）「a，b」c，d": "（x y）「a，b」c d", "(open, to the end.x": "(open, to the end.x", "，a": "a", "": "", "a , b": "a  b", "1.2.3.": "1.2.3"}
    rows = spark.createDataFrame([*cases.items(), (None, None)], "text string, wanted string")
    assert all(r[0] == r[1] for r in rows.select(T.spaced_signs(F.col("text")), "wanted").collect())


def scan(texts, starts, ends, tokens, last):
    """The same by scans over all words and over all runs."""
    n = len(tokens)
    got = []
    for t in tokens:
        hits = [i for i, w in enumerate(texts) if w.lower() == t.lower() and starts[i] >= last]
        got.append((hits[0], starts[hits[0]], ends[hits[0]]) if hits else (0, 0.0, 0.0))
    runs = [(a, b) for a in range(n) for b in range(a, n) if all(got[k + 1][0] - got[k][0] == 1 for k in range(a, b))]
    a, b = min(runs, key=lambda r: (r[0] - r[1], r[0]))
    if (a, b) == (0, n - 1):
        return got[a][1], got[b][2], got[b][2]
    at = lambda j: (j, starts[j], ends[j])
    full = [j for j in range(len(texts)) if texts[j]]
    before, after = [j for j in full if j < got[a][0]][::-1], [j for j in full if j > got[b][0]]
    lo, hi = got[a], got[b]
    for i, j in zip(range(a - 1, -1, -1), before):
        if texts[j].lower() != tokens[i].lower():
            break
        lo = got[i] = at(j)
    for i, j in zip(range(b + 1, n), after):
        if texts[j].lower() != tokens[i].lower():
            break
        hi = got[i] = at(j)
    lo = got[0] if 1 <= lo[0] - got[0][0] <= 9 else lo
    hi = got[-1] if 1 <= got[-1][0] - hi[0] <= 9 else hi
    return max(lo[1], last), hi[2], hi[2] if lo[0] != hi[0] and hi[2] > last else last


few = st.sampled_from(["a", "B", "b", "c", "d", ""])


@settings(max_examples=500, deadline=None)
@given(st.lists(few, min_size=1, max_size=25), st.lists(st.sampled_from(["a", "b", "C", "d", "x"]), min_size=1, max_size=8), st.integers(0, 10))
def test_times_equal_scan(texts, tokens, last):
    starts = [0.4 * i for i in range(len(texts))]
    ends = [s + 0.3 for s in starts]
    assert matching.TimedWords(texts, starts, ends).times(tokens, last * 0.4) == scan(texts, starts, ends, tokens, last * 0.4)


def test_times_go_on():
    words = matching.TimedWords(["one", "two", "one", "two"], [0.0, 1.0, 2.0, 3.0], [0.5, 1.5, 2.5, 3.5])
    assert matching.sentence_times(words, [["One", "two"], [], ["one", "two"], ["three"]]) == [(0.0, 1.5), None, (2.0, 3.5), None]
    assert matching.TimedWords([], [], []).times(["a"], 0.0) == (0.0, 0.0, 0.0)


def test_prefix_matches_equal_scan(spark):
    chars = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "B", 1), (2, 0, "a", 0), (None, 0, "a", 0)], "m int, n int, letter string, reached int")
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, "A"), (1, 2, "ab"), (1, 3, "Ab"), (1, 4, "b"), (2, 0, None), (2, 1, "")], "m int, pos int, word string")
    met = matching.prefix_matches(chars, words, ["m"], "letter", "word", "pos", "reached")
    assert sorted((r["m"], r["n"], r["pos"]) for r in met.collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 4)]
