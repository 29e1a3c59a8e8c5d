"""Subtitle texts: one value per medium, built from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import timecode, wrapping

Names = list[str]


def in_order(rows: DataFrame, by: Names, order: Names, piece: Column, between: str = "") -> DataFrame:
    """by, value: the pieces of each medium joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, piece.alias("__p"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["__p"]), between).alias("value"))


def srt(blocks: DataFrame, by: Names, order: Names, mode: str) -> DataFrame:
    """SRT of blocks(idx, start_ms, end_ms, origin, target).

    mode: target-first, origin-first, target-only (the origin where there is no target) or origin-only. Blocks without
    text are left out.
    """
    origin, target = F.coalesce("origin", F.lit("")), F.coalesce("target", F.lit(""))
    both = {"target-first": [target, origin], "origin-first": [origin, target], "target-only": [F.when(target != "", target).otherwise(origin)], "origin-only": [origin]}[mode]
    lines = F.array_join(F.filter(F.array(*both), lambda s: s != ""), "\n")
    rows = blocks.withColumn("__lines", lines).where("__lines <> ''")
    times = timecode.srt_line(timecode.srt_from_millis(F.col("start_ms")), timecode.srt_from_millis(F.col("end_ms")))
    return in_order(rows, by, order, F.concat(F.col("idx").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("__lines"), F.lit("\n\n")))


def dub_srt(cues: DataFrame, by: Names, order: Names, start: str, end: str, text: str, idx: str) -> DataFrame:
    """SRT of dubbed cues: seconds rounded half up, an index of 0 or less becomes the cue's place."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    rows = cues.withColumn("__idx", F.when(F.col(idx) <= 0, place).otherwise(F.col(idx)))
    times = timecode.srt_line(timecode.srt_half_up(F.col(start)), timecode.srt_half_up(F.col(end)))
    return in_order(rows, by, order, F.concat(F.col("__idx").cast("string"), F.lit("\n"), times, F.lit("\n"), T.trim(F.col(text)), F.lit("\n\n")))


def interleaved(blocks: DataFrame, shorts: DataFrame, by: Names) -> DataFrame:
    """media, idx, start_ms, end_ms, text: each block's target over its whole time, then its short origin lines, renumbered."""
    a = blocks.select(*by, F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("part"), "start_ms", "end_ms", F.col("target").alias("text"))
    b = shorts.select(*by, F.col("idx").alias("block"), F.lit(1).alias("kind"), "part", "start_ms", "end_ms", F.col("origin").alias("text"))
    rows = a.unionByName(b).withColumn("idx", F.row_number().over(W.partitionBy(*by).orderBy("block", "kind", "part")))
    return rows.select(*by, "idx", "start_ms", "end_ms", "text")


def segment_files(blocks: DataFrame, shorts: DataFrame, by: Names, target_first: bool = True) -> DataFrame:
    """by, file, value: the three files of a segment from one pass over its blocks.

    blocks(by, idx, start_ms, end_ms, origin, target), shorts(by, idx, part, start_ms, end_ms, origin). `bilingual` has
    each block under its own number with both languages; `mixed` each block's target and then its short origin lines;
    `short` these lines alone. The last two are numbered anew from 1, by the parts of the blocks before. write_texts puts
    each file under its own folder.
    """
    times = lambda a, b: timecode.srt_line(timecode.srt_from_millis(a), timecode.srt_from_millis(b))
    entry = lambda number, time, *lines: F.concat(number.cast("string"), F.lit("\n"), time, F.lit("\n"), *[x for line in lines for x in (line, F.lit("\n"))], F.lit("\n"))
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = shorts.groupBy(*by, "idx").agg(F.array_sort(F.collect_list(F.struct("part", times(F.col("start_ms"), F.col("end_ms")).alias("time"), text(F.col("origin")).alias("line")))).alias("__parts"))
    rows = blocks.join(parts, [*by, "idx"], "left").withColumn("__parts", F.coalesce("__parts", F.array().cast(parts.schema["__parts"].dataType)))
    before = W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__place", F.row_number().over(W.partitionBy(*by).orderBy("idx"))).withColumn("__gone", F.coalesce(F.sum(F.size("__parts")).over(before), F.lit(0)))
    time, both = times(F.col("start_ms"), F.col("end_ms")), [text(F.col("target")), text(F.col("origin"))]
    lines = lambda start: F.array_join(F.transform("__parts", lambda p, i: entry(start + i, p["time"], p["line"])), "")
    place = F.col("__place") + F.col("__gone")
    files = {
        "bilingual": entry(F.col("idx"), time, *(both if target_first else both[::-1])),
        "mixed": F.concat(entry(place, time, both[0]), lines(place + 1)),
        "short": lines(F.col("__gone") + 1),
    }
    each = rows.select(*by, "idx", F.explode(F.array(*[F.struct(F.lit(name).alias("file"), value.alias("__v")) for name, value in files.items()])).alias("f")).select(*by, "idx", "f.*")
    return in_order(each, [*by, "file"], ["idx"], F.col("__v"))


def concat_list(pieces: DataFrame, by: Names, order: Names) -> DataFrame:
    """The list of audio files to join: file lines for silences and chunks in order."""
    name = F.when(F.col("piece") == "silence", F.concat(F.lit("silence_chunk_"), F.col("chunk_id").cast("string"))).otherwise(F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")))
    return in_order(pieces, by, order, F.concat(F.lit("file '"), name, F.lit(".wav'\n")))


def dialogue(blocks: DataFrame, major_tags: str = "", minor_tags: str = "", major_alignment: int = 2, minor_alignment: int = 2, wrap: wrapping.Line | None = None) -> DataFrame:
    """ASS Dialogue rows of blocks(start_ms, end_ms, lines): the first line as Major, a second one below as Minor.

    wrap: the first line is wrapped to this width, and blocks in which nothing is left of it go.
    """
    first = F.element_at("lines", 1)
    if wrap:
        blocks = blocks.withColumn("__first", F.array_join(wrapping.wrapped(first, wrap), "\\N")).where("__first <> ''")
        first = F.col("__first")
    major = F.concat(F.lit(f"{major_tags}{{\\an{major_alignment}}}{{\\rMajor}}"), first)
    minor = F.concat(F.lit(f"\\N{minor_tags}{{\\an{minor_alignment}}}{{\\rMinor}}"), F.get("lines", F.lit(1)))
    text = F.concat(major, F.when(F.size("lines") > 1, minor).otherwise(""))
    row = F.concat(F.lit("Dialogue: 0,"), timecode.ass_time(F.col("start_ms")), F.lit(","), timecode.ass_time(F.col("end_ms")), F.lit(",Major,,0,0,0,,"), text)
    return blocks.where(F.size("lines") > 0).withColumn("dialogue", row).drop("__first")


def write_texts(values: DataFrame, path: str) -> None:
    """Write each medium's value under its own folder."""
    values.write.mode("overwrite").partitionBy(*[c for c in values.columns if c != "value"]).option("lineSep", "").text(path)


def replaced(values: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Values with each pair replaced, longer keys first."""
    out = F.col("value")
    for key in sorted(pairs, key=lambda k: (-len(k), k)):
        out = F.replace(out, F.lit(key), F.lit(pairs[key]))
    return values.withColumn("value", out)


def json_report(rows: DataFrame, by: str, order: Names, items: Names, name: str) -> DataFrame:
    """by, value: one JSON object per medium with its version, its key and the given columns of its rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.struct(*items).alias("__item"))))
    report = F.struct(F.lit("1").alias("version"), F.col(by).alias("media"), F.transform(parts, lambda p: p["__item"]).alias(name))
    return rows.groupBy(by).agg(F.to_json(report).alias("value"))


def sentence_dump(sentences: DataFrame, by: Names, order: Names, text: str, start: str, end: str, words: str) -> DataFrame:
    """by, value: a readable list of a medium's sentences with number, text, times and number of words."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    rows = sentences.withColumn("__n", place)
    entry = F.concat(F.lit("Sentence "), F.col("__n").cast("string"), F.lit(":\nText: "), F.col(text), F.lit("\nStart: "), F.col(start), F.lit(", End: "), F.col(end), F.lit("\nWord count: "), F.col(words).cast("string"), F.lit("\n\n"))
    return in_order(rows, by, ["__n"], entry)
