"""Queries of the parsers and writers: the driver's tables are written as captions or JSON and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timecode
from tidemark.operators import windows
from tidemark.plans.catalog import CUE, query
from tidemark.plans.inputs import CUES, cues, table
from tidemark.sinks import subtitles
from tidemark.sources import captions, transcripts

_SRT = "printf('%02d:%02d:%02d,%03d', {m} // 3600000, {m} // 60000 % 60, {m} // 1000 % 60, {m} % 1000)"
_VTT = _SRT.replace(",%03d", ".%03d")
SMALL = f"""{CUES}, small AS (SELECT user_id, event_id, text, value, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS idx, start_ms % 36000000 AS s, end_ms - start_ms AS len FROM cues)"""


def _small(spark, sf_dir):
    rows = windows.renumber(cues(spark, sf_dir), ["user_id"], CUE)
    return rows.select("user_id", "event_id", "text", "value", "idx", (F.col("start_ms") % 36_000_000).alias("start_ms"), (F.col("end_ms") - F.col("start_ms")).alias("len")).withColumn("end_ms", F.col("start_ms") + F.col("len"))


def _srt_files(spark, sf_dir):
    blocks = _small(spark, sf_dir).select("user_id", "idx", "start_ms", "end_ms", F.col("text").alias("origin"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t "), F.col("text"))).alias("target"))
    return subtitles.srt(blocks, ["user_id"], ["idx"], "target-first").withColumnRenamed("user_id", "media")


@query(
    f"""WITH {SMALL} SELECT user_id, string_agg(idx || chr(10) || {_SRT.format(m='s')} || ' --> ' || {_SRT.format(m='(s + len)')} || chr(10) ||
  CASE WHEN event_id % 3 > 0 THEN 't ' || text || chr(10) || text ELSE text END || chr(10) || chr(10), '' ORDER BY idx) AS value FROM small GROUP BY user_id"""
)
def write_srt(spark, sf_dir):
    return _srt_files(spark, sf_dir).withColumnRenamed("media", "user_id")


@query(
    f"""WITH {SMALL} SELECT user_id AS media, idx::INT AS idx, s AS start_ms, s + len AS end_ms,
  CASE WHEN event_id % 3 > 0 THEN 't ' || text || ' ' || text ELSE text END AS text FROM small"""
)
def parse_srt(spark, sf_dir):
    return captions.srt_cues(_srt_files(spark, sf_dir)).select("media", "idx", "start_ms", "end_ms", "text")


@query(
    f"""WITH {SMALL} SELECT user_id AS media, idx::INT AS idx, CASE WHEN event_id % 3 > 0 THEN 't ' || text ELSE text END AS origin,
  CASE WHEN event_id % 3 > 0 THEN text ELSE '' END AS target FROM small"""
)
def parse_srt_pairs(spark, sf_dir):
    return captions.srt_pairs(_srt_files(spark, sf_dir)).select("media", "idx", "origin", "target")


@query(
    f"""WITH {SMALL} SELECT user_id AS media, idx - 1 AS block, 'target' AS side, CASE WHEN event_id % 3 > 0 THEN 't ' || text ELSE text END AS text FROM small
UNION ALL SELECT user_id, idx - 1, 'origin', text FROM small WHERE event_id % 3 > 0"""
)
def demux_srt(spark, sf_dir):
    return captions.demux(captions.srt_blocks(_srt_files(spark, sf_dir)), True).select("media", F.col("block").cast("long"), "side", "text")


def _vtt_files(spark, sf_dir):
    """Cues of two words, the second with an inline time in the middle; before every fifth cue a bare word alone."""
    rows = _small(spark, sf_dir)
    t = lambda c: F.regexp_replace(timecode.srt_from_millis(c), ",", ".")
    middle = F.expr("start_ms + len div 2")
    timed = F.concat(F.lit("cue"), F.col("idx").cast("string"), F.lit("<"), t(middle), F.lit("><c> kind"), (F.col("event_id") % 9).cast("string"), F.lit("</c>"))
    line = F.when(F.col("idx") % 5 == 0, F.concat(F.lit("solo"), (F.col("event_id") % 4).cast("string"))).otherwise(timed)
    cue = F.concat(t(F.col("start_ms")), F.lit(" --> "), t(F.col("end_ms")), F.lit(" align:start\n"), line, F.lit("\n\n"))
    files = subtitles.in_order(rows, ["user_id"], ["idx"], cue)
    return files.select(F.col("user_id").alias("media"), F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.col("value")).alias("value"))


@query(
    f"""WITH {SMALL},
w AS (
  SELECT user_id AS media, idx, 0 AS k, 'cue' || idx AS word, {_VTT.format(m='s')} AS "start", {_VTT.format(m='(s + len // 2)')} AS "end", false AS bare FROM small WHERE idx % 5 <> 0
  UNION ALL SELECT user_id, idx, 1, 'kind' || (event_id % 9), {_VTT.format(m='(s + len // 2)')}, {_VTT.format(m='(s + len)')}, false FROM small WHERE idx % 5 <> 0
  UNION ALL SELECT user_id, idx, 0, 'solo' || (event_id % 4), {_VTT.format(m='s')}, {_VTT.format(m='(s + len)')}, true FROM small WHERE idx % 5 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY media, lower(word) ORDER BY idx, k) = 1 AS f FROM w),
d AS (SELECT *, row_number() OVER (PARTITION BY media, word, "start", "end" ORDER BY idx, k) AS n FROM b WHERE NOT bare OR f)
SELECT media, word, "start", "end", bare FROM d WHERE n = 1"""
)
def parse_vtt_words(spark, sf_dir):
    return captions.caption_words(_vtt_files(spark, sf_dir)).select("media", "word", "start", "end", "bare")


@query(
    f"""WITH {SMALL} SELECT user_id AS media, {_VTT.format(m='s')} AS "start", {_VTT.format(m='(s + len)')} AS "end", idx % 5 <> 0 AS timed,
  CASE WHEN idx % 5 = 0 THEN 'solo' || (event_id % 4) ELSE 'cue' || idx || ' kind' || (event_id % 9) END AS text FROM small"""
)
def parse_vtt_blocks(spark, sf_dir):
    return captions.block_captions(_vtt_files(spark, sf_dir)).select("media", "start", "end", "timed", "text")


@query("SELECT DISTINCT user_id AS media, user_id % 3 = 2 OR (user_id % 3 = 1 AND user_id % 40 * 5 + 4 < 100) AS word_level FROM events")
def detect_vtt(spark, sf_dir):
    """A third of the files have no inline times, in a third they come after up to 195 lines of notes."""
    kind, notes = F.col("media") % 3, F.repeat(F.lit("NOTE\n"), (F.col("media") % 40 * 5).cast("int"))
    bare = F.regexp_replace("value", captions.INLINE, " ")
    files = _vtt_files(spark, sf_dir).withColumn("value", F.when(kind == 0, bare).when(kind == 1, F.concat(notes, "value")).otherwise(F.col("value")))
    return captions.has_word_times(files)


def _json_files(spark, sf_dir):
    rows = _small(spark, sf_dir)
    word = F.when(F.col("idx") % 4 == 0, F.concat(F.lit("a"), F.col("idx").cast("string"), F.lit("—b."))).otherwise(F.concat(F.lit("w"), F.col("idx").cast("string"), F.lit(",")))
    item = F.struct(word.alias("word"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    segs = rows.groupBy("user_id", F.expr("(idx - 1) div 6").alias("seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("w")))), lambda x: x["w"]).alias("words"))
    files = segs.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.struct(F.lit("t—").alias("text"), "words").alias("s")))), lambda x: x["s"]).alias("segments"))
    return files.select(F.col("user_id").alias("media"), F.to_json(F.struct(F.lit("en").alias("language"), "segments")).alias("value"))


@query(
    f"""WITH {SMALL}, t AS (SELECT user_id AS media, idx, s / 1000.0::DOUBLE AS a, (s + len) / 1000.0::DOUBLE AS b FROM small),
p AS (SELECT media, idx, 0 AS half, CASE WHEN idx % 4 = 0 THEN 'a' || idx ELSE 'w' || idx END AS word, a AS "start", CASE WHEN idx % 4 = 0 THEN (a + b) / 2 ELSE b END AS "end" FROM t
  UNION ALL SELECT media, idx, 1, 'b', (a + b) / 2, b FROM t WHERE idx % 4 = 0)
SELECT media, (row_number() OVER (PARTITION BY media ORDER BY idx, half) - 1)::INT AS num, word, "start", "end" FROM p"""
)
def json_words(spark, sf_dir):
    return transcripts.words_from_segments(_json_files(spark, sf_dir))


@query(
    f"""WITH {SMALL} SELECT event_id, 'Dialogue: 0,' || printf('%02d:%02d:%02d.%02d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000 // 10) || ',' ||
  printf('%02d:%02d:%02d.%02d', (s + len) // 3600000, (s + len) // 60000 % 60, (s + len) // 1000 % 60, (s + len) % 1000 // 10) ||
  ',Major,,0,0,0,,{{\\an2}}{{\\rMajor}}' || text || CASE WHEN event_id % 2 = 0 THEN '\\N{{\\an2}}{{\\rMinor}}low' ELSE '' END AS dialogue FROM small"""
)
def ass_dialogue(spark, sf_dir):
    lines = F.when(F.col("event_id") % 2 == 0, F.array("text", F.lit("low"))).otherwise(F.array("text"))
    return subtitles.dialogue(_small(spark, sf_dir).withColumn("lines", lines)).select("event_id", "dialogue")


@query(
    """WITH c AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations),
r AS (SELECT conv_id, turn, 0 AS kind, 0 AS part, 'T' || n AS text FROM c UNION ALL SELECT conv_id, turn, 1, unnest(generate_series(0, 1))::INT, 'o' || unnest(generate_series(0, 1)) FROM c)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, part)::INT AS idx, text FROM r"""
)
def interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.lit(0).alias("start_ms"), F.lit(0).alias("end_ms"), F.concat(F.lit("T"), F.char_length("text").cast("string")).alias("target"))
    shorts = rows.select("conv_id", "idx", "start_ms", "end_ms", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).withColumn("origin", F.concat(F.lit("o"), F.col("part").cast("string")))
    return subtitles.interleaved(rows, shorts, ["conv_id"]).select("conv_id", "idx", "text")
