"""Compositions: sentence grouping in four stages, short origin lines of translated blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import folds, joins, windows

Names = list[str]


def split_recursively(rows: DataFrame, text: str, splitter: Callable[[Column], Column], most: int, depth: int = 5) -> DataFrame:
    """rows with path: texts of over `most` letters and digits as their parts, these again, `depth` times at most.

    splitter gives the parts of a text as an array; a text that it leaves whole (or gives no parts for) stays. path holds
    the part's place at each split, so that it orders the parts of a row. Nothing is shuffled.
    """
    rest = [c for c in rows.columns if c != text]
    now = rows.select(*rest, text, F.array().cast("array<int>").alias("path"))
    for _ in range(depth):
        parts = F.when(T.effective_chars(F.col(text)) > most, splitter(F.col(text)))
        now = now.withColumn("__parts", parts)
        whole = F.col("__parts").isNull() | (F.size("__parts") < 2)
        cut = F.transform("__parts", lambda p, i: F.struct(p.alias("t"), F.concat("path", F.array(i)).alias("path")))
        kept = F.array(F.struct(F.col(text).alias("t"), F.col("path").alias("path")))
        now = now.select(*rest, F.explode(F.when(whole, kept).otherwise(cut)).alias("__p")).select(*rest, F.col("__p.t").alias(text), "__p.path")
    return now


def halves(text: Column) -> Column:
    """A text cut after half of its words: a splitter that needs no outside help."""
    words = F.split(text, " ")
    n = F.ceil(F.size(words) / 2).cast("int")
    return F.when(F.size(words) > 1, F.array(F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, n + 1, F.size(words) - n), " ")))


def grouped_sentences(words: DataFrame, by: Names, order: Names, word: str, splitter: Callable[[Column], Column], most: int = 70, depth: int = 5) -> DataFrame:
    """by, sentence_no, text, start, end (least and largest of order's first column): words as sentences in four stages.

    Sentences end at their marks; one of over `most` letters and digits is cut at its commas (folds.comma_breaks), parts
    that are still too long go to the splitter again and again, and a double quote alone joins the sentence before.
    """

    def rule(places: list, ws: list[str]) -> list[tuple]:
        out: dict[int, tuple[list, list]] = {}
        for k, p, t in zip(folds.comma_breaks(ws, most) if folds.effective(" ".join(ws)) > most else [0] * len(ws), places, ws, strict=True):
            piece = out.setdefault(k, ([], []))
            piece[0].append(p)
            piece[1].append(t)
        return [(k, " ".join(ts), ps[0], ps[-1]) for k, (ps, ts) in out.items()]

    rows = windows.primary_sentences(words, by, order, word)
    kind = rows.schema[order[0]].dataType.simpleString()
    texts = folds.fold(rows, [*by, "sentence_id"], order, [order[0], word], rule, f"piece int, text string, start {kind}, end {kind}", dealt=by)
    parts = split_recursively(texts, "text", splitter, most, depth)
    return windows.merge_lone_quotes(parts, by, ["sentence_id", "piece", "path"], "text", "start", "end")


def short_lines(blocks: DataFrame, words: DataFrame, by: Names, block: str, wanted: str, sentence: str, pos: str, word: str, most: int = 20) -> DataFrame:
    """by, block, part, origin, start, end: the words that say a block, in lines of up to `most` bytes with their own times.

    Blocks are sought by joins.sequence_matches; one that is said nowhere has no lines.
    """
    found = joins.sequence_matches(blocks, words, by, block, wanted, sentence, pos, word, said_as="__said").where("found_in is not null")

    @F.pandas_udf("array<struct<part: int, origin: string, start: double, end: double>>")
    def lines(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_lines(t.tolist(), a.tolist(), b.tolist(), most) for t, a, b in zip(texts, starts, ends, strict=True)])

    return found.select(*by, block, F.explode(lines(F.col("__said.word"), F.col("__said.a"), F.col("__said.b"))).alias("__l")).select(*by, block, "__l.*")


def _lines(texts: list[str], starts: list[float], ends: list[float], most: int) -> list[dict]:
    out: dict[int, list] = {}
    for k, t, a, b in zip(folds.pack_by_bytes(texts, most), texts, starts, ends, strict=True):
        out.setdefault(k, []).append((t, a, b))
    return [{"part": k, "origin": " ".join(t for t, _, _ in ws), "start": ws[0][1], "end": ws[-1][2]} for k, ws in out.items()]
