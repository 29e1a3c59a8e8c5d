"""Queries of predicates, layout, projections, merges and the remaining writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import layout, timecode
from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.operators import joins, projections, windows
from tidemark.plans.catalog import CUE, _sql_clean_speech, _sql_trim, query
from tidemark.plans.inputs import CUES, LINES, WORDS, cues, lines, table, words
from tidemark.plans.parsing import _SRT, SMALL, _small
from tidemark.sinks import subtitles
from tidemark.sources import captions, transcripts


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _has(x: str, ranges: str) -> str:
    return f"regexp_matches({x}, '[{ranges}]')"


@query(
    f"""WITH {WORDS}, made AS (SELECT doc_id, pos, CASE WHEN pos % 17 = 3 THEN ' Well, ' WHEN pos % 19 = 4 THEN chr(34) ELSE word END AS word FROM words),
n AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM made)
SELECT doc_id, pos, coalesce(lower({_sql_trim('following')}) IN ({_in(P.INTERRUPTIONS)}), false) AS broken, CASE WHEN word = chr(34) THEN '' ELSE word END AS kept FROM n"""
)
def interruptions(spark, sf_dir):
    made = F.when(F.col("pos") % 17 == 3, " Well, ").when(F.col("pos") % 19 == 4, '"').otherwise(F.col("word"))
    rows = words(spark, sf_dir).withColumn("word", made)
    following = F.lead("word").over(windows._w(["doc_id"], ["pos"]))
    return rows.select("doc_id", "pos", P.interrupts(following).alias("broken"), P.quote_dropped(F.col("word")).alias("kept"))


_FIELDS = "list_filter(regexp_split_to_array({x}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id, pos, line, {_FIELDS.format(x='line')} AS w FROM lines)
SELECT doc_id, pos, len(w) >= 3 AND regexp_matches(lower(array_to_string(w, ' ')), '{P.VERB_PATTERN}') AS phrase, len(w) < 3 AS short,
  length(regexp_replace({_sql_trim('line')}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 20 AS few FROM f"""
)
def phrase_checks(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", P.complete_phrase(T.fields(line)).alias("phrase"), P.short_sentence(line).alias("short"), P.too_short(line, 20).alias("few"))


_SAMPLES = ("", "中", "か", "ก", "א", "한", "Ａ", "я", "12 !")


@query(
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END || ([{_in(_SAMPLES)}])[(doc_id % {len(_SAMPLES)})::INT + 1] AS t, CASE WHEN doc_id % 5 = 0 THEN 'ja' ELSE lang END AS l FROM documents)
SELECT doc_id, {_has('t', P.CJK + P.THAI)} AS cjk_or_thai, {_has('t', P.HAN)} AS han, {_has('t', P.WIDE)} AS wide, {_has('t', P.ALPHABETIC)} AS alphabetic, l IN ({_in(P.ASIAN)}) AS by_characters FROM t"""
)
def script_checks(spark, sf_dir):
    sample = F.get(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % len(_SAMPLES)).cast("int"))
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")), sample)
    has = lambda ranges: P.has_script(t, ranges)
    lang = F.when(F.col("doc_id") % 5 == 0, "ja").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", has(P.CJK + P.THAI).alias("cjk_or_thai"), has(P.HAN).alias("han"), has(P.WIDE).alias("wide"), has(P.ALPHABETIC).alias("alphabetic"), P.cut_by_characters(lang).alias("by_characters"))


@query(
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.YouTube.com/watch?t=1&v=v' || page_id || '&x=2' WHEN 1 THEN 'https://www.bilibili.com/video/BV' || page_id || 'aZ/?p=1'
  WHEN 2 THEN 'https://youtube.com/watch?t=1' ELSE url END AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(?:^|&)(v=[^&]*)', 1) AS v FROM u)
SELECT page_id, contains(lower(url), 'youtube.com') AS video, CASE WHEN contains(path, 'watch') THEN CASE WHEN v <> '' THEN substr(v, 3) END ELSE string_split(path, '/')[-1] END AS video_id,
  regexp_extract(url, 'https://(?:www\\.)?bilibili\\.com/(?:video/|video/av[0-9]+/)(BV[a-zA-Z0-9]+)', 1) AS bv FROM p"""
)
def video_addresses(spark, sf_dir):
    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://www.YouTube.com/watch?t=1&v=v"), i, F.lit("&x=2"))).when(k == 1, F.concat(F.lit("https://www.bilibili.com/video/BV"), i, F.lit("aZ/?p=1"))).when(k == 2, "https://youtube.com/watch?t=1").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", P.video_host(url).alias("video"), P.video_id(url).alias("video_id"), P.bv_id(url).alias("bv"))


@query(
    f"""WITH {LINES}, t AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN '[中文翻译] [' || line || '’s] ' WHEN 1 THEN ' [[' || line || '[英文句子]]' ELSE line END AS t FROM lines)
SELECT doc_id, pos, replace(rtrim(ltrim(replace(replace(t, '[中文翻译]', ''), '[英文句子]', ''), ' ['), ' ]'), '’', '''') AS bare FROM t"""
)
def bare_titles(spark, sf_dir):
    k, line = F.col("pos") % 3, F.col("line")
    t = F.when(k == 0, F.concat(F.lit("[中文翻译] ["), line, F.lit("’s] "))).when(k == 1, F.concat(F.lit(" [["), line, F.lit("[英文句子]]"))).otherwise(line)
    return lines(spark, sf_dir).select("doc_id", "pos", layout.bare_title(t).alias("bare"))


@query(f"""SELECT doc_id, array_to_string({_FIELDS.format(x="regexp_replace(text, '[^\\p{L}\\p{N}\\t\\n\\f\\r '']+', ' ', 'g')")}, '|') AS words FROM documents""")
def letter_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.plain_words(F.col("text")), "|").alias("words"))


@query(
    f"""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN upper(s) IN ({_in(T.RESERVED)}) THEN '_' || s ELSE s END AS name FROM (
  SELECT page_id, {_sql_trim("regexp_replace(replace(u, '.', '_'), '[/\\[\\]\\x00?]', '_', 'g')")} AS s FROM (
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' con ' WHEN 1 THEN '  ' WHEN 2 THEN ' [' || url || '] ' ELSE url END AS u FROM pages))"""
)
def safe_names(spark, sf_dir):
    k, url = F.col("page_id") % 5, F.col("url")
    u = F.when(k == 0, " con ").when(k == 1, "  ").when(k == 2, F.concat(F.lit(" ["), url, F.lit("] "))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(u).alias("name"))


@query(f"SELECT doc_id, {_sql_trim('text')} AS plain FROM documents")
def code_fences(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n``` \n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.code_fences_removed(fenced).alias("plain"))


def _sql_width(x: str, size: float) -> str:
    parts, rest = ["0.0::DOUBLE"], x
    for ranges, share in layout.CLASSES:
        left = f"regexp_replace({rest}, '[{ranges}]', '', 'g')"
        parts.append(f"(length({rest}) - length({left})) * {size * share!r}::DOUBLE")
        rest = left
    return " + ".join([*parts, f"length({rest}) * {size * layout.OTHER!r}::DOUBLE"])


@query(f"WITH {LINES} SELECT doc_id, pos, round(({_sql_width('line', 14.0)} + greatest(length(line) - 1, 0) * 0.5::DOUBLE) * 0.9::DOUBLE, 6) AS width FROM lines")
def line_widths(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", F.round(layout.text_width(F.col("line"), 14.0, 0.5, 0.9), 6).alias("width"))


_TRIM_P = "regexp_replace(regexp_replace({x}, '^\\p{{P}}+', ''), '\\p{{P}}+$', '')"


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, pos, line, doc_id % 4 = 0 AS c, CASE WHEN doc_id % 4 = 0 THEN list_filter(string_split(line, ''), lambda x: x <> '') ELSE string_split(line, ' ') END AS w FROM lines),
k AS (SELECT *, greatest(floor(len(w) * 2 / 5), 1)::INT AS cut FROM p),
l AS (SELECT *, CASE WHEN c THEN array_to_string(w[1:cut], '') ELSE array_to_string(w[1:cut], ' ') END AS a, CASE WHEN c THEN array_to_string(w[cut + 1:], '') ELSE array_to_string(w[cut + 1:], ' ') END AS b FROM k)
SELECT doc_id, pos, CASE WHEN len(w) <= 12 THEN line ELSE {_TRIM_P.format(x='a')} END AS first,
  CASE WHEN len(w) > 12 THEN {_TRIM_P.format(x='b')} END AS second FROM l"""
)
def two_fifths(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 4 == 0, "ja").otherwise(F.col("lang"))
    rows = lines(spark, sf_dir).withColumn("cut", layout.two_fifths(F.col("line"), lang, 12))
    return rows.select("doc_id", "pos", F.get("cut", F.lit(0)).alias("first"), F.get("cut", F.lit(1)).alias("second"))


@query(
    f"""WITH {SMALL}, t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1:2:3,' || event_id % 50 WHEN 1 THEN {_SRT.format(m='s')} WHEN 2 THEN '1:2,3' ELSE 'x:1:2,3' END AS t, s FROM small)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3723000 + event_id % 50 WHEN 1 THEN s END AS millis FROM t"""
)
def ass_millis(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("1:2:3,"), (F.col("event_id") % 50).cast("string"))).when(k == 1, timecode.srt_from_millis(F.col("start_ms"))).when(k == 2, "1:2,3").otherwise("x:1:2,3")
    return _small(spark, sf_dir).select("event_id", timecode.ass_millis(t).alias("millis"))


@query(
    f"""WITH {SMALL} SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE s / 1000.0::DOUBLE END AS "start", (s + len) / 1000.0::DOUBLE AS "end" FROM small"""
)
def typed_words(spark, sf_dir):
    raw = lambda c: F.regexp_replace(timecode.srt_from_millis(F.col(c)), ",", ".")
    rows = _small(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, "soon").otherwise(raw("start_ms")).alias("start"), raw("end_ms").alias("end"))
    return projections.typed_words(rows, "start", "end")


@query(f"""WITH {SMALL} SELECT user_id, idx::INT AS idx, {_SRT.format(m='s')} || ' --> ' || {_SRT.format(m='(s + len)')} AS times, text AS origin FROM small""")
def sentence_blocks(spark, sf_dir):
    raw = lambda c: F.regexp_replace(timecode.srt_from_millis(F.col(c)), ",", ".").alias(c)
    rows = _small(spark, sf_dir).select("user_id", F.col("idx").alias("at"), raw("start_ms"), raw("end_ms"), "text")
    return projections.sentence_blocks(rows, ["user_id"], ["at"], "text", "start_ms", "end_ms")


@query(
    f"""WITH {CUES}, t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN '（掌声） ' || text || ' -- & x' ELSE text || '  ™' END AS t FROM cues)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INT AS idx, start_ms AS "start", end_ms AS "end", {_sql_clean_speech('t')} AS text FROM t"""
)
def dub_cues(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("（掌声） "), F.col("text"), F.lit(" -- & x"))).otherwise(F.concat(F.col("text"), F.lit("  ™")))
    return projections.dub_cues(cues(spark, sf_dir).withColumn("text", t), ["user_id"], CUE, "start_ms", "end_ms", "text")


@query(f"WITH {WORDS} SELECT doc_id, (pos // 50)::INT AS chunk, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words GROUP BY doc_id, pos // 50")
def fixed_chunks(spark, sf_dir):
    return projections.fixed_chunks(words(spark, sf_dir), ["doc_id"], ["pos"], "word", 50)


@query(
    f"""WITH {CUES}, t AS (SELECT user_id, start_ms // 60000 AS chunk, start_ms, event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'cue ' || event_id END AS t FROM cues)
SELECT user_id, chunk, coalesce(string_agg(t, ' ' ORDER BY start_ms, event_id) FILTER (WHERE t <> ''), '') AS text FROM t GROUP BY user_id, chunk"""
)
def speech_text(spark, sf_dir):
    t = F.when(F.col("event_id") % 4 == 0, " \n ").otherwise(F.concat(F.lit("  cue\t"), F.col("event_id").cast("string"), F.lit(" ")))
    rows = cues(spark, sf_dir).withColumn("chunk", F.expr("start_ms div 60000")).withColumn("text", t)
    return projections.speech_text(rows, ["user_id", "chunk"], CUE, "text")


@query(
    """WITH t AS (SELECT c_custkey, ['origin-only', 'target-only', 'target-on-top', 'target-on-bottom'][(c_custkey % 4)::INT + 1] AS r, ['en', 'zh_cn', 'fr'][(c_custkey % 3)::INT + 1] AS ui, 'English' AS o, 'N' || c_nationkey AS g FROM customer),
f AS (SELECT c_custkey, 1 AS place, 'origin' AS kind, o, ui FROM t
  UNION ALL SELECT c_custkey, 2, 'target', g, ui FROM t WHERE r <> 'origin-only' UNION ALL SELECT c_custkey, 3, 'bilingual', 'Bilingual', ui FROM t WHERE r LIKE 'target-on-%')
SELECT c_custkey, place, kind, CASE ui WHEN 'en' THEN o || ' Subtitle' WHEN 'zh_cn' THEN CASE WHEN place = 3 THEN '双语字幕' ELSE o || ' 单语字幕' END ELSE '' END AS name FROM f"""
)
def result_files(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % n).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(("origin-only", "target-only", "target-on-top", "target-on-bottom"), 4).alias("r"), pick(("en", "zh_cn", "fr"), 3).alias("ui"), F.lit("English").alias("o"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("t"))
    return projections.result_files(rows, ["c_custkey"], "r", "ui", "o", "t")


@query(f"WITH {LINES} SELECT doc_id, pos, line FROM lines WHERE pos < 100")
def first_lines(spark, sf_dir):
    return projections.first_rows(lines(spark, sf_dir), ["doc_id"], ["pos"], 100).select("doc_id", "pos", "line")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey)::INT AS place FROM supplier")
def voice_order(spark, sf_dir):
    return windows.renumber(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_name", "s_suppkey"], "place").select("s_suppkey", "place")


@query(f"WITH {CUES} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INT AS place FROM cues")
def cue_order(spark, sf_dir):
    return windows.renumber(cues(spark, sf_dir), ["user_id"], CUE, "place").select("user_id", "event_id", "place")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE 'base' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 14 ELSE (p_partkey % 40)::INT END AS size,
  CASE WHEN p_partkey % 5 = 0 THEN true ELSE p_partkey % 2 = 0 END AS bold, CASE WHEN p_partkey % 7 = 0 THEN 'Arial' ELSE 'F' || p_partkey % 3 END AS font FROM part"""
)
def style_merge(spark, sf_dir):
    k, i = F.col("p_partkey"), F.col("p_partkey").cast("string")
    unset = lambda n, value, empty=None: F.when(k % n == 0, empty).otherwise(value)
    inner = lambda name, size, bold: F.struct(name.alias("name"), size.cast("int").alias("size"), bold.cast("boolean").alias("bold"))
    base = F.struct(inner(F.lit("base"), F.lit(14), F.lit(True)).alias("major"), F.lit("Arial").alias("font"))
    over = F.struct(inner(F.when(k % 2 == 0, F.concat(F.lit("p"), i)).otherwise(""), unset(3, k % 40), unset(5, k % 2 == 0)).alias("major"), unset(7, F.concat(F.lit("F"), (k % 3).cast("string")), "").alias("font"))
    rows = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), over.alias("over"))
    done = rows.withColumn("m", projections.merged(F.col("base"), F.col("over"), rows.schema["base"].dataType))
    return done.select("p_partkey", "m.major.name", "m.major.size", "m.major.bold", "m.font")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' || c_custkey END AS origin_srt, CASE WHEN c_custkey % 4 < 2 THEN 'made' ELSE 'kept' END AS target_srt FROM customer"""
)
def output_paths(spark, sf_dir):
    k = F.col("c_custkey")
    made = F.struct(F.lit("new").alias("origin_srt"), F.lit("made").alias("target_srt"))
    kept = F.struct(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("old"), k.cast("string"))).alias("origin_srt"), F.when(k % 4 == 0, "").when(k % 4 > 1, "kept").alias("target_srt"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", made.alias("made"), kept.alias("kept"))
    return rows.select("c_custkey", projections.merged(F.col("made"), F.col("kept"), rows.schema["made"].dataType).alias("m")).select("c_custkey", "m.*")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS providers, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS stages,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 = 1 THEN 'late' END AS error FROM orders"""
)
def manifests(spark, sf_dir):
    k = F.col("o_orderkey")
    provider = F.when(k % 3 > 0, F.create_map(F.lit("asr"), F.lit("x")))
    ok = F.struct(F.lit(True).alias("ok"), F.lit(1).alias("extra"))
    stage = F.when(k % 4 > 0, F.struct(ok.alias("subtitle"), F.struct((k % 2 == 0).alias("ok"), F.when(k % 2 == 1, "late").alias("error")).alias("tts")))
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("1").alias("version"), provider.alias("provider"), stage.alias("stages"))).alias("value"))
    found = projections.manifests(files)
    return found.select("o_orderkey", F.size("provider").alias("providers"), F.size("stages").alias("stages"), F.try_element_at("stages", F.lit("tts"))["error"].alias("error"))


@query("SELECT item_id, 'Cover of ' || left(text, 20) || ' in N' || item_id || ', {{style}}' AS prompt FROM benchmark")
def cover_prompts(spark, sf_dir):
    values = {"title": F.substring("text", 1, 20), "target_language": F.concat(F.lit("N"), F.col("item_id").cast("string"))}
    return table(spark, sf_dir, "benchmark").select("item_id", T.fill_template("Cover of {{title}} in {{target_language}}, {{style}}", values).alias("prompt"))


def _srt_sql(text: str) -> str:
    return f"""WITH {SMALL}, t AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN 't ' || text ELSE '' END AS target FROM small)
SELECT user_id, string_agg(idx || chr(10) || {_SRT.format(m='s')} || ' --> ' || {_SRT.format(m='(s + len)')} || chr(10) || {text} || chr(10) || chr(10), '' ORDER BY idx) AS value FROM t GROUP BY user_id"""


def _srt_of(spark, sf_dir, mode):
    blocks = _small(spark, sf_dir).select("user_id", "idx", "start_ms", "end_ms", F.col("text").alias("origin"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t "), F.col("text"))).alias("target"))
    return subtitles.srt(blocks, ["user_id"], ["idx"], mode)


@query(_srt_sql("CASE WHEN target <> '' THEN target ELSE text END"))
def write_srt_target(spark, sf_dir):
    return _srt_of(spark, sf_dir, "target-only")


@query(_srt_sql("text"))
def write_srt_origin(spark, sf_dir):
    return _srt_of(spark, sf_dir, "origin-only")


@query(_srt_sql("text || CASE WHEN target <> '' THEN chr(10) || target ELSE '' END"))
def write_srt_origin_first(spark, sf_dir):
    return _srt_of(spark, sf_dir, "origin-first")


@query(
    f"""WITH {SMALL} SELECT user_id, string_agg((CASE WHEN event_id % 2 = 0 AND event_id > 0 THEN event_id ELSE idx END) || chr(10) || {_SRT.format(m='s')} || ' --> ' || {_SRT.format(m='(s + len)')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY idx) AS value FROM small GROUP BY user_id"""
)
def write_dub_srt(spark, sf_dir):
    rows = _small(spark, sf_dir).select("user_id", F.col("idx").alias("at"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.concat(F.lit(" "), F.col("text")).alias("text"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-1).alias("no"))
    return subtitles.dub_srt(rows, ["user_id"], ["at"], "start", "end", "text", "no")


@query(
    f"""WITH {SMALL} SELECT user_id, string_agg('file ''' || CASE WHEN idx % 3 = 0 THEN 'silence_chunk_' ELSE 'chunk_' END || idx || '.wav''' || chr(10), '' ORDER BY idx) AS value FROM small GROUP BY user_id"""
)
def concat_lists(spark, sf_dir):
    rows = _small(spark, sf_dir).select("user_id", F.col("idx").alias("chunk_id"), F.when(F.col("idx") % 3 == 0, "silence").otherwise("chunk").alias("piece"))
    return subtitles.concat_list(rows, ["user_id"], ["chunk_id"])


@query("SELECT doc_id, replace(replace(text, 'the', 'THE!'), 'on', '0') AS value FROM documents")
def replaced_words(spark, sf_dir):
    return subtitles.replaced(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")), {"on": "0", "the": "THE!"})


@query(
    """WITH r AS (SELECT conv_id, turn, length(text) || '!' AS t FROM conversations WHERE turn % 3 <> 1) SELECT c.conv_id, c.turn, c.text, r.t FROM conversations c JOIN r USING (conv_id, turn)"""
)
def results_inner(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return joins.by_position(rows, rows.where("turn % 3 <> 1").withColumn("t", F.concat(F.char_length("text").cast("string"), F.lit("!"))), ["conv_id", "turn"], ["t"], keep=False)


def _hosted_files(spark, sf_dir):
    rows = _small(spark, sf_dir)
    word = F.when(F.col("idx") % 4 == 0, F.concat(F.lit("a"), F.col("idx").cast("string"), F.lit("—b."))).otherwise(F.concat(F.lit("w"), F.col("idx").cast("string"), F.lit(",")))
    item = F.struct(word.alias("word"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    files = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("w")))), lambda x: x["w"]).alias("words"))
    return files.select(F.col("user_id").alias("media"), F.to_json(F.struct(F.lit("en").alias("language"), F.lit("t").alias("text"), "words")).alias("value"))


@query(
    f"""WITH {SMALL}, t AS (SELECT user_id AS media, idx, s / 1000.0::DOUBLE AS a, (s + len) / 1000.0::DOUBLE AS b FROM small),
p AS (SELECT media, idx, 0 AS half, CASE WHEN idx % 4 = 0 THEN 'a' || idx ELSE 'w' || idx || ',' END AS word, a AS "start", CASE WHEN idx % 4 = 0 THEN (a + b) / 2 ELSE b END AS "end" FROM t
  UNION ALL SELECT media, idx, 1, 'b.', (a + b) / 2, b FROM t WHERE idx % 4 = 0)
SELECT media, (row_number() OVER (PARTITION BY media ORDER BY idx, half) - 1)::INT AS num, word, "start", "end" FROM p"""
)
def hosted_words(spark, sf_dir):
    return transcripts.words_from_hosted(_hosted_files(spark, sf_dir))


@query(
    f"""WITH {SMALL} SELECT user_id AS media, (row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1)::INT AS num, 'w' || idx AS word, s / 1000.0::DOUBLE AS "start", (s + len) / 1000.0::DOUBLE AS "end" FROM small WHERE idx % 5 <> 0"""
)
def token_words(spark, sf_dir):
    rows = _small(spark, sf_dir)
    text = F.when(F.col("idx") % 5 == 0, "[_BEG_]").otherwise(F.concat(F.lit(" w"), F.col("idx").cast("string"), F.lit(",")))
    times = F.struct(timecode.srt_from_millis(F.col("start_ms")).alias("from"), timecode.srt_from_millis(F.col("end_ms")).alias("to"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(text.alias("text"), times.alias("timestamps")).alias("w")))), lambda x: x["w"])
    files = rows.groupBy("user_id").agg(tokens.alias("tokens"))
    return transcripts.words_from_tokens(files.select(F.col("user_id").alias("media"), F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("text"), "tokens")).alias("transcription"))).alias("value")))


@query(f"WITH {SMALL} SELECT user_id AS media, string_agg('s' || idx || ' x ', '' ORDER BY idx) AS text FROM small GROUP BY user_id")
def asr_text(spark, sf_dir):
    text = F.concat(F.lit("s"), F.col("idx").cast("string"), F.lit("—x "))
    segs = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(text.alias("text")).alias("s")))), lambda x: x["s"])
    files = _small(spark, sf_dir).groupBy("user_id").agg(segs.alias("segments"))
    return transcripts.full_text(files.select(F.col("user_id").alias("media"), F.to_json(F.struct("segments")).alias("value")))


@query(f"""WITH {SMALL} SELECT user_id AS media, idx::INT AS n, CASE WHEN idx % 4 = 0 THEN '' ELSE 'ziel ' || idx END AS target, text AS origin FROM small""")
def reply_triples(spark, sf_dir):
    target = F.when(F.col("idx") % 4 == 0, "[无文本]").otherwise(F.concat(F.lit("[ziel "), F.col("idx").cast("string"), F.lit("]")))
    piece = F.concat(F.col("idx").cast("string"), F.lit("\n"), target, F.lit("\n["), F.col("text"), F.lit("]\n\n"))
    files = subtitles.in_order(_small(spark, sf_dir), ["user_id"], ["idx"], piece)
    return captions.reply_triples(files.withColumnRenamed("user_id", "media"))


@query(
    f"""WITH {SMALL}, t AS (SELECT user_id, idx, CASE WHEN idx % 5 IN (0, 1) THEN chr(34) WHEN idx % 11 = 0 THEN '' ELSE text END AS t, s, s + len AS e FROM small),
g AS (SELECT *, sum(CASE WHEN idx = 1 OR t NOT IN ('', chr(34)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx)::BIGINT AS sentence_no FROM t)
SELECT user_id, sentence_no, string_agg(t, ' ' ORDER BY idx) AS text, arg_min(s, idx) AS "start", arg_max(e, idx)::VARCHAR AS "end" FROM g GROUP BY user_id, sentence_no"""
)
def lone_quotes_merged(spark, sf_dir):
    t = F.when((F.col("idx") % 5).isin(0, 1), '"').when(F.col("idx") % 11 == 0, "").otherwise(F.col("text"))
    return windows.merge_lone_quotes(_small(spark, sf_dir).withColumn("text", t), ["user_id"], ["idx"], "text", "start_ms", "end_ms")


@query(
    f"""WITH {SMALL}, t AS (SELECT user_id, idx, s / 1000.0::DOUBLE AS a, (CASE WHEN idx % 6 = 0 THEN s ELSE s + len END) / 1000.0::DOUBLE AS b, CASE WHEN idx % 7 = 0 THEN 0.0 ELSE 1.1 END::DOUBLE AS speed FROM small),
r AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY idx), 0.0) AS before FROM t)
SELECT user_id, idx, CASE WHEN a < before THEN 'starts before previous end' WHEN b <= a THEN 'end not after start' ELSE 'speed not positive and finite' END AS reason FROM r WHERE a < before OR b <= a OR speed <= 0"""
)
def invalid_plans(spark, sf_dir):
    rows = _small(spark, sf_dir).select("user_id", "idx", (F.col("start_ms") / 1000).alias("a"), (F.when(F.col("idx") % 6 == 0, F.col("start_ms")).otherwise(F.col("end_ms")) / 1000).alias("b"), F.when(F.col("idx") % 7 == 0, 0.0).otherwise(1.1).alias("speed"))
    return windows.invalid_plan(rows, ["user_id"], ["idx"], "a", "b", "speed").select("user_id", "idx", "reason")


_STYLE = "Style: {name},Arial,{size},&H0000BFFF,&H000000FF,&H00000000,&H64000000,1,0,0,0,100,100,0,0,1,2.5,1.5,2,10,10,20,1"


@query(
    "SELECT p_partkey, $$" + layout.HEAD + "$$ || 'Style: Major,Arial,' || p_partkey % 40 || '" + _STYLE.split("{size}")[1] + "' || chr(10) || 'Style: Minor,Arial,9" + _STYLE.split("{size}")[1] + "' || $$" + layout.TAIL + "$$ AS head FROM part"
)
def ass_headers(spark, sf_dir):
    before, after = _STYLE.split("{size}")
    style = lambda name, size: F.concat(F.lit(before.format(name=name)), size.cast("string"), F.lit(after))
    return table(spark, sf_dir, "part").select("p_partkey", layout.ass_header(style("Major", F.col("p_partkey") % 40), style("Minor", F.lit(9))).alias("head"))


@query(
    f"""WITH {WORDS}, w AS (SELECT doc_id, pos, word FROM words WHERE pos % 10 < 3), t AS (SELECT DISTINCT doc_id, pos // 10 AS sentence, left(word, 2) AS head FROM words WHERE pos % 10 = 0 AND length(word) >= 2)
SELECT t.doc_id, t.sentence, count(*) AS n, min(w.pos) AS first, max(w.pos) AS last FROM t JOIN w ON w.doc_id = t.doc_id AND left(w.word, 2) = t.head AND w.pos >= t.sentence * 10 GROUP BY t.doc_id, t.sentence"""
)
def prefix_join(spark, sf_dir):
    rows = words(spark, sf_dir)
    tokens = rows.where((F.col("pos") % 10 == 0) & (F.char_length("word") >= 2)).select("doc_id", F.expr("pos div 10").alias("sentence"), F.substring("word", 1, 2).alias("head"), F.expr("pos div 10 * 10").alias("at"))
    met = joins.prefixed_at_or_after(tokens, rows.where("pos % 10 < 3"), ["doc_id"], "head", "word", "at", "pos", 2)
    return met.groupBy("doc_id", "sentence").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


@query(
    f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '?a=1&v=' || page_id || ' x' WHEN 1 THEN ' a name with blanks ' WHEN 2 THEN '  ' WHEN 3 THEN 'http://host.' || page_id ELSE url END AS u FROM pages),
t AS (SELECT page_id, {_sql_trim('u')} AS u FROM u),
p AS (SELECT *, regexp_matches(u, '(?s)^[^?#]*\\?(?:[^#]*&)?v=') AS has, regexp_extract(u, '(?s)^[^?#]*\\?(?:[^#]*&)?v=([^&#]*)', 1) AS v, regexp_extract(u, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path FROM t),
l AS (SELECT page_id, left(replace(CASE WHEN has THEN v WHEN path <> '' THEN string_split(trim(path, '/'), '/')[-1] ELSE u END, ' ', ''), 16) AS s FROM p),
f AS (SELECT page_id, {_sql_trim("regexp_replace(replace(CASE WHEN " + _sql_trim('s') + " = '' THEN 'task' ELSE s END, '.', '_'), '[/\\[\\]\\x00?]', '_', 'g')")} AS s FROM l)
SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN upper(s) IN ({_in(T.RESERVED)}) THEN '_' || s ELSE s END || '_' || left(sha256(page_id::VARCHAR), 8) AS task FROM f"""
)
def task_ids(spark, sf_dir):
    k, url = F.col("page_id") % 5, F.col("url")
    address = F.when(k == 0, F.concat(url, F.lit("?a=1&v="), F.col("page_id").cast("string"), F.lit(" x"))).when(k == 1, " a name with blanks ").when(k == 2, "  ").when(k == 3, F.concat(F.lit("http://host."), F.col("page_id").cast("string"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", T.task_id(address, F.col("page_id")).alias("task"))
