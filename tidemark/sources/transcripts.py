"""Recognised speech as words: nested JSON of several layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import timecode

WORDS = "struct<language: string, segments: array<struct<text: string, words: array<struct<word: string, start: double, end: double>>>>>"
TOKENS = "struct<result: struct<language: string>, transcription: array<struct<text: string, tokens: array<struct<text: string, timestamps: struct<from: string, to: string>>>>>>"
HOSTED = "struct<language: string, text: string, words: array<struct<word: string, start: double, end: double>>>"


def _dashed(rows: DataFrame, trim: bool) -> DataFrame:
    """Words cut at the first dash: two halves of the time; a third part is lost, as are empty words."""
    parts = F.split("word", "—")
    middle = (F.col("start") + F.col("end")) / 2
    clean = T.trim_punctuation if trim else (lambda c: c)
    one = F.array(F.struct(clean(F.col("word")).alias("word"), F.col("start").alias("start"), F.col("end").alias("end")))
    two = F.array(F.struct(clean(F.get(parts, F.lit(0))).alias("word"), F.col("start").alias("start"), middle.alias("end")), F.struct(clean(F.get(parts, F.lit(1))).alias("word"), middle.alias("start"), F.col("end").alias("end")))
    out = rows.select("media", "seg", "w", F.posexplode(F.when(F.size(parts) > 1, two).otherwise(one)).alias("half", "p")).select("media", "seg", "w", "half", "p.*")
    w = W.partitionBy("media").orderBy("seg", "w", "half")
    return out.withColumn("num", F.row_number().over(w) - 1).select("media", "num", "word", "start", "end")


def words_from_segments(files: DataFrame) -> DataFrame:
    """media, num, word, start, end of files whose segments hold words; unknown keys are ignored, broken JSON gives no words."""
    d = files.select("media", F.from_json("value", WORDS).alias("j"))
    rows = d.select("media", F.posexplode("j.segments").alias("seg", "s")).select("media", "seg", F.posexplode("s.words").alias("w", "x")).select("media", "seg", "w", T.trim(F.col("x.word")).alias("word"), "x.start", "x.end")
    return _dashed(rows, True)


def words_from_tokens(files: DataFrame) -> DataFrame:
    """As words_from_segments for tokens with times as text; tokens in brackets are marks and go."""
    d = files.select("media", F.from_json("value", TOKENS).alias("j"))
    rows = d.select("media", F.posexplode("j.transcription").alias("seg", "s")).select("media", "seg", F.posexplode("s.tokens").alias("w", "x"))
    seconds = lambda c: timecode.srt_millis(F.col(c)) / 1000.0
    rows = rows.where(~F.col("x.text").rlike(r"^\[.*\]$"))
    return _dashed(rows.select("media", "seg", "w", T.trim(F.col("x.text")).alias("word"), seconds("x.timestamps.from").alias("start"), seconds("x.timestamps.to").alias("end")), True)


def words_from_hosted(files: DataFrame) -> DataFrame:
    """As words_from_segments for a flat list of words, whose punctuation stays."""
    d = files.select("media", F.from_json("value", HOSTED).alias("j"))
    rows = d.select("media", F.lit(0).alias("seg"), F.posexplode("j.words").alias("w", "x")).select("media", "seg", "w", F.col("x.word").alias("word"), "x.start", "x.end")
    return _dashed(rows, False)


def full_text(files: DataFrame) -> DataFrame:
    """media, text: the segments' texts joined, dashes as spaces."""
    d = files.select("media", F.from_json("value", WORDS).alias("j"))
    return d.select("media", F.array_join(F.transform("j.segments", lambda s: F.replace(s["text"], F.lit("—"), F.lit(" "))), "").alias("text"))
