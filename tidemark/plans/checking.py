"""Queries of style checks, line widths, samples and the remaining scans and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import styles, timecode
from tidemark.operators import projections
from tidemark.plans.catalog import SENTENCES, _sentences, query
from tidemark.plans.inputs import table
from tidemark.plans.parsing import _SRT, SMALL, _small
from tidemark.sinks import subtitles
from tidemark.sources import captions, samples

#: Styles made from the number of an event, e: broken in every field by turns; the braces of JSON are written as ( and ).
_MADE = {
    "raw_ass_style": "case e % 9 when 0 then '\"Style: Major' || repeat(',1', 22) || '\"' when 1 then '\"Style: Minor' || repeat(',1', 22) || '\"' when 2 then '\"Style: Major,1\"' else '\"\"' end",
    "name": "case when e % 31 = 5 then '\"a,b\"' else '\"Major\"' end",
    "font_name": "case when e % 37 = 5 then '\"a\\\\nb\"' else '\"Arial\"' end",
    "primary_color": "case e % 13 when 3 then '\"#12345\"' when 4 then '\" &H0011AAff \"' when 5 then '\"#0011aaFF\"' when 6 then '\"red\"' else '\"#12aB9f\"' end",
    "font_size": "case when e % 11 = 4 then '\"12\"' else cast(e % 210 as string) end",
    "alignment": "cast(e % 10 as string)",
    "outline": "cast(e % 23 as string)",
    "angle": "cast(e % 800 - 400 as string)",
    "fade_in_ms": "cast(e * 7 % 10100 as string)",
    "override_tags": "case e % 5 when 0 then '\"{\\\\\\\\b1}\"' when 1 then '\"b1\"' when 2 then '\"\\\\\\\\b1{\"' else '\"\"' end",
}


def _made(number: str, text: str, unescaped: bool) -> str:
    parts = [f"'\"{name}\": ' || ({value})" for name, value in _MADE.items()]
    body = " || ', ' || ".join(parts).replace("as string", f"as {text}")
    out = f"case when e % 97 = 1 then '[1' when e % 97 = 2 then '{{\"size\": 1}}' else '{{' || {body} || '}}' end"
    return (out.replace("\\\\", "\\") if unescaped else out).replace("e %", f"{number} %").replace("e *", f"{number} *")


@query(
    f"""WITH made AS (SELECT event_id, {_made('event_id', 'varchar', True)} AS j FROM events),
f AS (SELECT event_id, j, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS k FROM made),
v AS (SELECT event_id, ok, json_keys(k) AS names, k->>'raw_ass_style' AS raw, k->>'name' AS name, k->>'font_name' AS font, k->>'primary_color' AS colour,
  json_type(k, '$.font_size') AS kind, try_cast(k->>'font_size' AS INT) AS size, (k->>'alignment')::INT AS alignment, (k->>'outline')::DOUBLE AS outline,
  (k->>'angle')::DOUBLE AS angle, (k->>'fade_in_ms')::INT AS fade, regexp_replace(k->>'override_tags', '^\\{{(.*)\\}}$', '\\1') AS tags FROM f)
SELECT event_id, CASE WHEN NOT ok OR list_contains(names, 'size') OR kind = 'VARCHAR' THEN 'json'
  WHEN raw <> '' AND (len(string_split(raw, ',')) <> 23 OR string_split(raw, ',')[1] <> 'Style: Major') THEN 'raw_ass_style'
  WHEN contains(name, ',') THEN 'name' WHEN contains(font, chr(10)) THEN 'font_name'
  WHEN NOT regexp_full_match(trim(colour), '#[0-9A-Fa-f]{{6}}([0-9A-Fa-f]{{2}})?|&[Hh][0-9A-Fa-f]{{8}}') THEN 'primary_color'
  WHEN size < 1 OR size > 200 THEN 'font_size' WHEN alignment < 1 THEN 'alignment' WHEN outline > 20 THEN 'outline'
  WHEN abs(angle) > 360 THEN 'angle' WHEN fade > 10000 THEN 'fade_in_ms'
  WHEN tags <> '' AND (contains(tags, '{{') OR NOT starts_with(tags, chr(92))) THEN 'override_tags' END AS fault FROM v"""
)
def style_faults(spark, sf_dir):
    made = table(spark, sf_dir, "events").select("event_id", F.expr(_made("event_id", "string", False)).alias("style"))
    return made.select("event_id", styles.style_fault(F.col("style"), "Major").alias("fault"))


@query(
    """WITH m AS (SELECT event_id, event_id * 13 % 2000 AS w, event_id * 29 % 1100 AS h, CASE WHEN event_id % 7 > 0 THEN event_id % 220 END AS ml,
  CASE WHEN event_id % 5 > 0 THEN event_id % 50 END AS mr, CASE WHEN event_id % 3 > 0 THEN event_id % 90 END AS size FROM events),
s AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN floor(w * least(384::DOUBLE / w, 288::DOUBLE / h)) END AS scaled FROM m)
SELECT event_id, greatest((CASE WHEN scaled >= 1 THEN scaled ELSE 384 END - coalesce(ml, 10) - coalesce(mr, 10)) * 0.92::DOUBLE, coalesce(size, 14)::DOUBLE) AS width FROM s"""
)
def wrap_widths(spark, sf_dir):
    e = F.col("event_id")
    width = styles.line_width(e * 13 % 2000, e * 29 % 1100, F.when(e % 7 > 0, e % 220), F.when(e % 5 > 0, e % 50), F.when(e % 3 > 0, e % 90))
    return table(spark, sf_dir, "events").select("event_id", width.alias("width"))


@query(
    """WITH p AS (SELECT doc_id, unnest(generate_series(1, len(k))) AS spot, unnest(k) AS pair FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '[0-9A-F]{4}') AS k FROM documents)),
v AS (SELECT doc_id, spot, ('0x' || pair[3:4] || pair[1:2])::INT AS u FROM p), s AS (SELECT doc_id, spot, CASE WHEN u < 32768 THEN u ELSE u - 65536 END AS value FROM v)
SELECT doc_id, count(*) AS n, sum(value)::BIGINT AS total, sum(value::BIGINT * spot)::BIGINT AS placed, max(abs(value))::INT AS peak FROM s GROUP BY doc_id"""
)
def pcm_levels(spark, sf_dir):
    """Bytes of texts as samples."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media"), F.col("text").cast("binary").alias("content"))
    value = F.col("value").cast("bigint")
    return samples.pcm_samples(files).groupBy(F.col("media").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.sum(value * F.col("at")).alias("placed"), F.max(F.abs("value")).alias("peak")
    )


@query(
    f"""WITH {SMALL}, t AS (SELECT user_id, idx, event_id, CASE WHEN event_id % 2 = 0 THEN s % 3600000 ELSE s END AS s, len FROM small),
w AS (SELECT user_id, idx, 0 AS k, 'cue ' || idx AS word, s AS start_ms, CASE WHEN event_id % 4 = 3 THEN s + len ELSE s + len // 2 END AS end_ms FROM t WHERE idx % 5 > 0
UNION ALL SELECT user_id, idx, 1, 'kind ' || event_id % 9, s + len // 2, s + len FROM t WHERE idx % 5 > 0 AND event_id % 4 < 3)
SELECT user_id AS media, row_number() OVER (PARTITION BY user_id ORDER BY idx, k) - 1 AS num, word, start_ms, end_ms FROM w"""
)
def timed_parts(spark, sf_dir):
    """Cues of two timed parts, of which every other one is written without hours; the second part of some comes after a blank first one, every fifth cue has no inline time."""
    rows = _small(spark, sf_dir)
    start = F.when(F.col("event_id") % 2 == 0, F.col("start_ms") % 3_600_000).otherwise(F.col("start_ms"))
    rows = rows.withColumn("start_ms", start).withColumn("end_ms", start + F.col("len")).withColumn("mid", F.expr("start_ms + len div 2"))

    def t(c):
        full = F.regexp_replace(timecode.srt_from_millis(F.col(c)), ",", ".")
        return F.when((F.col("event_id") % 2 == 0) & (F.col("end_ms") < 3_600_000), F.substring(full, 4, 9)).otherwise(full)

    first, second = F.concat(F.lit("cue "), F.col("idx").cast("string")), F.concat(F.lit("kind "), (F.col("event_id") % 9).cast("string"))
    whole = F.concat(F.lit("<"), t("start_ms"), F.lit("><c> "), first, F.lit("</c>"))
    both = F.concat(first, F.lit(" <"), t("mid"), F.lit("><c> "), second, F.lit("</c>"))
    line = F.when(F.col("idx") % 5 == 0, first).when(F.col("event_id") % 4 == 3, whole).otherwise(both)
    cue = F.concat(t("start_ms"), F.lit(" --> "), t("end_ms"), F.lit(" align:start\n"), line, F.lit("\n\n"))
    files = subtitles.in_order(rows, ["user_id"], ["idx"], cue)
    return captions.timed_parts(files.select(F.col("user_id").alias("media"), F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.col("value")).alias("value")))


@query(
    f"""WITH {SMALL} SELECT user_id, to_json({{'version': '1', 'media': user_id, 'cues': list({{'idx': idx, 'text': text, 'start_ms': s, 'end_ms': s + len}} ORDER BY idx)}})::VARCHAR AS value
FROM small GROUP BY user_id"""
)
def json_reports(spark, sf_dir):
    return subtitles.json_report(_small(spark, sf_dir), "user_id", ["idx"], ["idx", "text", "start_ms", "end_ms"], "cues")


#: Files of style sets made from the number of an event, e: one that many events share and one of its own; some are at fault.
_SHARED = """CASE e % 4 WHEN 1 THEN '{"vertical": {"major": {"font_size": 20}}}'
  WHEN 2 THEN '{"version": 2, "horizontal": {"major": {"primary_color": "#00ff00"}, "minor": {"margin_v": ' || e % 90 || '}}}'
  WHEN 3 THEN '{"horizontal": {"major": {"font_size": ' || e % 230 || '}}}' END"""
_OWN = """CASE e % 5 WHEN 0 THEN '  '
  WHEN 1 THEN '{"vertical": {"minor": {"outline": ' || e % 23 || ', "name": "' || CASE WHEN e % 7 = 3 THEN 'a,b' ELSE 'mine' END || '"}}}'
  WHEN 2 THEN '{"vertical": {"major": {"font_size": ' || e % 210 || '}}, "version": 3}'
  WHEN 3 THEN CASE e % 3 WHEN 0 THEN '{"horizontal": {"left": {}}}' WHEN 1 THEN '{} {}' ELSE '{"horizontal": 3}' END
  ELSE '{"horizontal": {"minor": {"margin_v": ' || e % 2100 || '}}, "vertical": {"major": {"primary_color": ""}}}' END"""


@query(
    f"""WITH m AS (SELECT event_id, event_id AS e, {_SHARED.replace("e %", "event_id %")} AS a, trim({_OWN.replace("e %", "event_id %")}) AS b FROM events),
j AS (SELECT *, CASE WHEN json_valid(b) THEN b ELSE '{{}}' END AS o FROM m),
f AS (SELECT *, CASE WHEN e % 4 = 3 AND (e % 230 > 200 OR e % 230 = 0) THEN 'horizontal.major.font_size' END AS fa,
  CASE WHEN e % 5 = 3 THEN 'json' WHEN contains(o->>'$.vertical.minor.name', ',') THEN 'vertical.minor.name' WHEN (o->>'$.vertical.minor.outline')::INT > 20 THEN 'vertical.minor.outline'
    WHEN (o->>'$.vertical.major.font_size')::INT NOT BETWEEN 1 AND 200 THEN 'vertical.major.font_size' WHEN (o->>'$.horizontal.minor.margin_v')::INT > 2000 THEN 'horizontal.minor.margin_v' END AS fb FROM j),
s AS (SELECT *, coalesce(fa, fb) AS fault FROM f)
SELECT event_id, CASE WHEN fa IS NOT NULL THEN 'shared' WHEN fb IS NOT NULL THEN 'own' END AS source, fault,
  CASE WHEN fault IS NULL THEN coalesce((o->>'$.version')::INT, (a->>'$.version')::INT, 1) END AS version,
  CASE WHEN fault IS NULL THEN coalesce((a->>'$.horizontal.major.font_size')::INT, 14) END AS size,
  CASE WHEN fault IS NULL THEN coalesce(a->>'$.horizontal.major.primary_color', '#FFBF00') END AS colour,
  CASE WHEN fault IS NULL THEN coalesce((o->>'$.horizontal.minor.margin_v')::INT, (a->>'$.horizontal.minor.margin_v')::INT, 30) END AS margin,
  CASE WHEN fault IS NULL THEN coalesce((o->>'$.vertical.major.font_size')::INT, (a->>'$.vertical.major.font_size')::INT, 12) END AS tall_size,
  CASE WHEN fault IS NULL THEN '#FFBF00' END AS tall_colour,
  CASE WHEN fault IS NULL THEN coalesce((o->>'$.vertical.minor.outline')::DOUBLE, 2.0::DOUBLE) END AS tall_outline,
  CASE WHEN fault IS NULL THEN coalesce(o->>'$.vertical.minor.name', 'Minor') END AS tall_name FROM s"""
)
def style_sets(spark, sf_dir):
    # a file of events is few tasks, and a set of styles costs far more than its number: they are dealt out first
    events = table(spark, sf_dir, "events").select("event_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    made = events.select("event_id", F.expr(_SHARED.replace("e %", "event_id %")).alias("a"), F.expr(_OWN.replace("e %", "event_id %")).alias("b"))
    s, at = projections.resolved_styles(made, ["event_id"], "a", "b"), F.col("styles")
    across, tall = at["horizontal"], at["vertical"]
    fields = {"size": across["major"]["font_size"], "colour": across["major"]["primary_color"], "margin": across["minor"]["margin_v"], "tall_size": tall["major"]["font_size"]}
    fields |= {"tall_colour": tall["major"]["primary_color"], "tall_outline": tall["minor"]["outline"], "tall_name": tall["minor"]["name"]}
    return s.select("event_id", "source", "fault", at["version"].alias("version"), *(c.alias(name) for name, c in fields.items()))


@query(
    """WITH w AS (SELECT c_custkey, c_custkey * 13 AS k FROM customer),
j AS (SELECT c_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM w LEFT JOIN orders ON o_orderkey = k)
SELECT 't' || c_custkey * 13 AS task_id, CASE WHEN o_orderkey IS NULL THEN '任务不存在' WHEN o_orderstatus = 'F' THEN '任务失败，原因：' || CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END END AS error,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 101 END AS process_percent, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS title,
  CASE WHEN o_orderstatus <> 'F' THEN 'origin' || CASE WHEN o_orderkey % 2 = 0 THEN ',target' ELSE '' END END AS files FROM j"""
)
def task_states(spark, sf_dir):
    """Orders as tasks, asked for by numbers of customers, some beyond the last order."""
    k, task_id = F.col("o_orderkey"), lambda c: F.concat(F.lit("t"), c.cast("string")).alias("task_id")
    file = lambda name: F.struct(F.lit(name).alias("name"), F.concat(F.lit("/files/"), k.cast("string"), F.lit(f"/{name}.srt")).alias("download_url"))
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("status")
    files = F.when(k % 2 == 0, F.array(file("origin"), file("target"))).otherwise(F.array(file("origin"))).alias("files")
    tasks = table(spark, sf_dir, "orders").select(task_id(k), status, F.when(k % 5 > 0, F.col("o_orderpriority")).alias("fail_reason"), (k % 101).alias("process_percent"), F.col("o_orderpriority").alias("title"), files)
    wanted = table(spark, sf_dir, "customer").select(task_id(F.col("c_custkey") * 13))
    found = projections.task_states(wanted, tasks, ["process_percent", "title", "files"])
    return found.withColumn("files", F.array_join(F.transform("files", lambda f: f["name"]), ","))


@query(
    """WITH f AS (SELECT '/in/' || o_custkey AS folder, o_orderpriority || '-' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.vtt' WHEN 1 THEN '.VTT' ELSE '.srt' END AS name, 'v' || o_orderkey AS value FROM orders)
SELECT folder, folder || '/' || min(name) AS media, arg_min(value, name) AS value FROM f WHERE lower(name) LIKE '%.vtt' GROUP BY folder"""
)
def caption_folders(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat("o_orderpriority", F.lit("-"), k.cast("string"), F.when(k % 3 == 0, ".vtt").when(k % 3 == 1, ".VTT").otherwise(".srt"))
    media = F.concat(F.lit("/in/"), F.col("o_custkey").cast("string"), F.lit("/"), name)
    return captions.first_caption_files(table(spark, sf_dir, "orders").select(media.alias("media"), F.concat(F.lit("v"), k.cast("string")).alias("value")))


@query(
    f"""WITH {SENTENCES}, s AS (SELECT doc_id, sentence_id, string_agg(word, ' ' ORDER BY pos) AS text, min(pos) AS a, max(pos) AS b, count(*) AS n FROM sentences GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) AS i FROM s)
SELECT doc_id, string_agg('Sentence ' || i || ':' || chr(10) || 'Text: ' || text || chr(10) || 'Start: ' || a || ', End: ' || b || chr(10) || 'Word count: ' || n || chr(10) || chr(10), '' ORDER BY i) AS value FROM o GROUP BY doc_id"""
)
def sentence_dump(spark, sf_dir):
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    rows = _sentences(spark, sf_dir).groupBy("doc_id", "sentence_id").agg(said.alias("text"), F.min("pos").cast("string").alias("a"), F.max("pos").cast("string").alias("b"), F.count(F.lit(1)).alias("n"))
    return subtitles.sentence_dump(rows, ["doc_id"], ["sentence_id"], "text", "a", "b", "n")
