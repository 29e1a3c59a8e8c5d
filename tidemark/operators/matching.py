"""Times of sentences among the timed words of their medium."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

Names = list[str]
#: A word's number, start and end; a token without a word has the number 0 and no length at 0.
Word = tuple[int, float, float]
NO_WORD: Word = (0, 0.0, 0.0)


def prefix_matches(chars: DataFrame, words: DataFrame, by: Names, char: str, text: str, start: str, last: str) -> DataFrame:
    """Pairs of a sentence's character and each word that it begins, or equals in any case, from the time `last` on.

    Both sides carry the first character in lower case, so that this is an equi-join within `by`; null and empty words
    match nothing.
    """
    a = chars.withColumn("__first", F.lower(char))
    b = words.withColumn("__first", F.lower(F.substring(text, 1, 1)))
    met = a.join(b, [*by, "__first"]).drop("__first")
    return met.where((F.startswith(F.col(text), F.col(char)) | (F.lower(text) == F.lower(char))) & (F.col(start) >= F.col(last)))


class TimedWords:
    """The words of a medium in ascending order of their starts, with the places of each text."""

    def __init__(self, texts: list[str], starts: list[float], ends: list[float]):
        self.texts = [t.lower() for t in texts]
        self.starts, self.ends = starts, ends
        self.places: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            self.places.setdefault(t, []).append(i)

    def word(self, i: int) -> Word:
        return i, self.starts[i], self.ends[i]

    def first(self, token: str, last: float) -> Word:
        """The first word equal to the token, case aside, that starts at `last` or later."""
        found = self.places.get(token.lower(), [])
        k = bisect_left(found, last, key=lambda i: self.starts[i])
        return self.word(found[k]) if k < len(found) else NO_WORD

    def extend(self, tokens: list[str], matched: list[Word], at: int, step: int) -> Word:
        """From token `at` on in one direction, while the next words and tokens agree, put words to tokens; the last one.

        Empty words are passed over.
        """
        reached = matched[at]
        i, j = at + step, reached[0] + step
        while 0 <= i < len(tokens) and 0 <= j < len(self.texts):
            if self.texts[j]:
                if self.texts[j] != tokens[i].lower():
                    break
                reached = matched[i] = self.word(j)
                i += step
            j += step
        return reached

    def times(self, tokens: list[str], last: float, near: int = 10) -> tuple[float, float, float] | None:
        """Start and end of a sentence's tokens and the time then reached; none without tokens.

        Each token takes the first equal word from `last` on. The longest run of successive numbers (the first of
        equals) is the anchor; unless it is the whole sentence, it grows at both ends while words and tokens agree, and
        then up to the outermost tokens if these lie less than `near` words away.
        """
        if not tokens:
            return None
        matched = [self.first(t, last) for t in tokens]
        a, b = longest_run([n for n, _, _ in matched])
        if b - a + 1 == len(tokens):
            return matched[a][1], matched[b][2], matched[b][2]
        begin, end = self.extend(tokens, matched, a, -1), self.extend(tokens, matched, b, 1)
        if 0 < begin[0] - matched[0][0] < near:
            begin = matched[0]
        if 0 < matched[-1][0] - end[0] < near:
            end = matched[-1]
        moves = begin[0] != end[0] and end[2] > last
        return max(begin[1], last), end[2], end[2] if moves else last


def longest_run(nums: list[int]) -> tuple[int, int]:
    """First and last place of the longest run in which each number is one above the one before, the first of equals."""
    best, a = (0, 0), 0
    for i in range(1, len(nums)):
        if nums[i] != nums[i - 1] + 1:
            a = i
        if i - a > best[1] - best[0]:
            best = (a, i)
    return best


def sentence_times(words: TimedWords, sentences: list[list[str]]) -> list[tuple[float, float] | None]:
    """Times of sentences one after the other, each sought from the time reached; one that would go back has none."""
    out, last = [], 0.0
    for tokens in sentences:
        found = words.times(tokens, last)
        kept = found is not None and found[2] >= last
        out.append(found[:2] if kept else None)
        last = found[2] if kept else last
    return out


def indel_distance(a: str, b: str) -> int:
    """Characters to insert or delete to make one text of the other; a replaced one counts twice.

    The longest common subsequence comes from a row of bits for all places of `b` at once, one step a character of `a`.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every
    for c in a:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) + len(b) - 2 * (len(b) - row.bit_count())


@F.pandas_udf(LongType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_distance(x, y) for x, y in zip(a, b, strict=True)])


def closest_run(words: DataFrame, wanted: DataFrame, by: Names, order: Names, num: str, text: str, target: str) -> DataFrame:
    """by, first, last, distance: of each group's runs of words with consecutive numbers the one whose joined text is
    nearest to wanted(by, target) by indel_distance, the first of equals. Groups without words or target are left out."""
    w = W.partitionBy(*by).orderBy(*order)
    run = F.sum(F.when(F.col(num) == F.lag(num).over(w) + 1, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    part = F.struct(*order, F.coalesce(text, F.lit("")).alias("__t"))
    runs = words.withColumn("__run", run).groupBy(*by, "__run").agg(F.array_sort(F.collect_list(part)).alias("__p"), F.min(F.struct(*order, F.col(num).alias("n"))).alias("__a"), F.max(F.struct(*order, F.col(num).alias("n"))).alias("__b"))
    joined = F.array_join(F.transform("__p", lambda p: p["__t"]), "")
    met = runs.join(wanted.where(F.col(target).isNotNull()).select(*by, F.col(target).alias("__target")), by)
    met = met.select(*by, "__run", F.col("__a.n").alias("first"), F.col("__b.n").alias("last"), _indel(joined, F.col("__target")).alias("distance"))
    return met.groupBy(*by).agg(F.min(F.struct("distance", "__run", "first", "last")).alias("b")).select(*by, "b.first", "b.last", "b.distance")
