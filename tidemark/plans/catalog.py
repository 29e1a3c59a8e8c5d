"""Queries over the driver's tables, each with its SQL counterpart where SQL can say it.

The tables hold no captions, so each operator is applied to the nearest table: events as cues, documents and
conversations as text. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import speech, timecode
from tidemark.functions import text as T
from tidemark.operators import joins, windows
from tidemark.plans.inputs import CUES, LINES, WORDS, cues, lines, table, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemark.plans import captioning, checking, parsing, projecting, segmenting, wrapping  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL


CUE = ["start_ms", "event_id"]
CHUNKS = f"""{CUES},
near AS (
  SELECT *, coalesce(start_ms - lag(end_ms) OVER w <= 1500 AND (lag(end_ms - start_ms) OVER w < 2500 OR end_ms - start_ms < 2500), false) AS joins
  FROM cues WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
runs AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM near),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY start_ms, event_id) - 1 AS place FROM runs),
chunks AS (
  SELECT user_id, event_id, start_ms, end_ms, value,
         sum(CASE WHEN place % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk_id
  FROM placed)"""


def _chunks(spark, sf_dir):
    return windows.dub_chunks(cues(spark, sf_dir), ["user_id"], CUE, "start_ms", "end_ms", gap=1500, short=2500)


@query(f"WITH {CHUNKS} SELECT user_id, event_id, chunk_id FROM chunks")
def cue_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("user_id", "event_id", "chunk_id")


FITTED = f"""{CHUNKS},
timed AS (SELECT *, 200 + (event_id * 37) % 4000 AS actual FROM chunks),
spans AS (
  SELECT *, first_value(start_ms) OVER w AS cs, last_value(end_ms) OVER w AS ce, sum(actual) OVER w AS total,
         coalesce(sum(actual) OVER (PARTITION BY user_id, chunk_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM timed WINDOW w AS (PARTITION BY user_id, chunk_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sped AS (SELECT *, greatest(total::DOUBLE / (ce - cs), 1.0::DOUBLE) AS wanted FROM spans),
fitted AS (
  SELECT user_id, event_id, chunk_id, wanted, least(wanted, 1.3::DOUBLE) AS speed,
         cs + gone / least(wanted, 1.3::DOUBLE) AS ns, cs + (gone + actual) / least(wanted, 1.3::DOUBLE) AS ne,
         cs + total / least(wanted, 1.3::DOUBLE) - ce > 0.6 AS overflows FROM sped)"""


def _fitted(spark, sf_dir):
    items = _chunks(spark, sf_dir).withColumn("actual", (200 + (F.col("event_id") * 37) % 4000).cast("double"))
    return windows.fit_timeline(items, ["user_id"], CUE, "start_ms", "end_ms", "actual")


@query(f"WITH {FITTED} SELECT user_id, event_id, chunk_id, ns AS new_start, ne AS new_end, speed, overflows FROM fitted")
def fit_timeline(spark, sf_dir):
    return _fitted(spark, sf_dir).select("user_id", "event_id", "chunk_id", "new_start", "new_end", "speed", "overflows")


@query(
    f"""WITH {FITTED}, per AS (SELECT user_id, chunk_id, max(wanted) AS s, bool_or(overflows) AS o FROM fitted GROUP BY ALL)
SELECT user_id, max(s) AS max_speed, count(*) FILTER (WHERE s > 1.15::DOUBLE) AS n_over_accept, count(*) FILTER (WHERE s > 1.3::DOUBLE) AS n_over_max,
       count(*) FILTER (WHERE o) AS n_overflows FROM per GROUP BY user_id"""
)
def fit_report(spark, sf_dir):
    return windows.chunk_report(_fitted(spark, sf_dir), ["user_id"])


@query(
    """WITH blocks AS (SELECT conv_id, turn, text FROM conversations WHERE coalesce(text, '') <> ''),
ends AS (SELECT *, regexp_matches(text, '[.!?。！？…][\\s\\x0b\\x{85}\\p{Z}]*$') AS e FROM blocks),
runs AS (SELECT *, sum(CASE WHEN coalesce(p, true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM ends)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS place FROM runs)
SELECT conv_id, turn, sum(CASE WHEN place % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM placed"""
)
def sentence_groups_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return windows.sentence_groups(rows, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "group_id")


_ABBREVIATIONS = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
SENTENCES = f"""{WORDS},
marked AS (
  SELECT *, regexp_matches(word, '[.!?。！？]["“”」』]?$') AND lower(word) NOT IN ({_ABBREVIATIONS})
            AND NOT (strlen(word) = 1 AND pos > 0) AS ends FROM words),
sentences AS (
  SELECT doc_id, pos, word, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_id FROM marked)"""


def _sentences(spark, sf_dir):
    return windows.primary_sentences(words(spark, sf_dir), ["doc_id"], ["pos"], "word")


@query(f"WITH {SENTENCES} SELECT doc_id, pos, sentence_id FROM sentences")
def primary_sentence_islands(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "pos", "sentence_id")


@query(
    f"""WITH {SENTENCES} SELECT doc_id, sentence_id, string_agg(word, ' ' ORDER BY pos) AS text, min(pos) AS "start", max(pos) AS "end", count(*) AS n_words
FROM sentences GROUP BY doc_id, sentence_id"""
)
def words_to_sentence(spark, sf_dir):
    rows = _sentences(spark, sf_dir).withColumn("at", F.col("pos"))
    return windows.words_to_sentences(rows, ["doc_id"], ["pos"], "word", "at", "at")


@query(
    f"""WITH {SENTENCES}, s AS (SELECT doc_id, sentence_id, count(*) AS n FROM sentences GROUP BY ALL)
SELECT doc_id, max(n) AS longest, (sum(n) // count(n))::BIGINT AS mean, count(*) FILTER (WHERE n < 3) AS n_short FROM s GROUP BY doc_id"""
)
def sentence_stats(spark, sf_dir):
    rows = _sentences(spark, sf_dir).groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n_words"))
    return windows.sentence_stats(rows, ["doc_id"])


@query(
    """SELECT conv_id, turn,
  CASE WHEN turn_no > 1 THEN b || chr(10) ELSE '' END AS before, coalesce(a, '') AS after FROM (
  SELECT conv_id, turn, row_number() OVER w AS turn_no,
    string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
    string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
)
def context_window(spark, sf_dir):
    return windows.context(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "before", "after")


@query(
    f"""WITH {CUES}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS nxt FROM cues)
SELECT user_id, event_id, start_ms, CASE WHEN end_ms > nxt AND nxt - 50 > start_ms THEN nxt - 50 ELSE end_ms END AS end_ms FROM n"""
)
def overlap_fix(spark, sf_dir):
    return windows.fix_overlaps(cues(spark, sf_dir), ["user_id"], CUE, "start_ms", "end_ms").select("user_id", "event_id", "start_ms", "end_ms")


@query(
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, round(value)::BIGINT AS v FROM events),
e AS (SELECT *, sum(v * v) OVER (PARTITION BY user_id ORDER BY i ROWS 15 PRECEDING) AS energy FROM s)
SELECT user_id, arg_min(i, {'e': energy, 'b': -i}) - 8 AS point FROM e WHERE i > 16 GROUP BY user_id"""
)
def quietest_point(spark, sf_dir):
    events = windows.renumber(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "i")
    samples = events.select("user_id", "i", F.expr("cast(floor(value + 0.5) as bigint)").alias("v"))
    return windows.quietest_point(samples, ["user_id"], "i", "v", 16)


@query(
    f"""WITH {CUES}, m AS (SELECT user_id, (max(end_ms) - min(start_ms)) / 1000.0 AS duration FROM cues GROUP BY user_id),
g AS (SELECT user_id, duration, unnest(generate_series(0, greatest(ceil(duration / 300)::INT - 1, 0))) AS k FROM m),
p AS (SELECT user_id, k, k * 300.0::DOUBLE AS point, duration FROM g WHERE k = 0 OR NOT (k = ceil(duration / 300) - 1 AND duration - k * 300 < 10))
SELECT user_id, k::INT AS k, point FROM p UNION ALL SELECT user_id, (max(k) + 1)::INT, any_value(duration)::DOUBLE FROM p GROUP BY user_id"""
)
def split_plan(spark, sf_dir):
    media = cues(spark, sf_dir).groupBy("user_id").agg(((F.max("end_ms") - F.min("start_ms")) / 1000.0).alias("duration"))
    return windows.split_points(media, "duration").select("user_id", "k", "point")


@query(
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, round(value)::BIGINT AS v FROM events),
m AS (SELECT user_id, count(*) AS d, ceil(count(*) / 20.0)::INT AS n FROM s GROUP BY user_id),
a AS (SELECT user_id, n, i, v, floor((i - 1) / 20.0 + 0.5)::INT AS k FROM s JOIN m USING (user_id)),
l AS (SELECT user_id, k, v, i - (k * 20 - 8) AS i FROM a WHERE k > 0 AND k < n AND i - 1 >= k * 20 - 8 AND i - 1 < k * 20 + 8),
e AS (SELECT *, sum(v * v) OVER (PARTITION BY user_id, k ORDER BY i ROWS 3 PRECEDING) AS energy FROM l),
q AS (SELECT user_id, k, arg_min(i, {'e': energy, 'b': -i}) - 2 AS moved FROM e WHERE i > 4 GROUP BY user_id, k),
g AS (SELECT user_id, d, n, unnest(generate_series(0, n - 1))::INT AS k FROM m),
p AS (SELECT user_id, d, n, k, CASE WHEN k = 0 THEN 0 ELSE k * 20 - 8 + coalesce(moved, 0) END AS point FROM g LEFT JOIN q USING (user_id, k)),
kept AS (SELECT * FROM p WHERE k = 0 OR k < n - 1 OR d - point >= 10)
SELECT user_id, k, point::DOUBLE AS point FROM kept UNION ALL SELECT user_id, (max(k) + 1)::INT, any_value(d)::DOUBLE FROM kept GROUP BY user_id"""
)
def quiet_split_plan(spark, sf_dir):
    """A user's events as one sample a second, cut about every 20 seconds."""
    events = windows.renumber(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "i")
    samples = events.select("user_id", "i", F.expr("cast(floor(value + 0.5) as bigint)").alias("v"))
    media = samples.groupBy("user_id").agg(F.count(F.lit(1)).alias("d"))
    return windows.quiet_split_points(media, samples, ["user_id"], "d", "i", "v", 20.0, 1, 4)


@query(
    f"""WITH {CUES}, p AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), 0) AS prev FROM cues)
SELECT user_id, event_id, 'chunk' AS piece, (end_ms - start_ms)::DOUBLE AS seconds FROM p
UNION ALL SELECT user_id, event_id, 'silence', (start_ms - prev)::DOUBLE FROM p WHERE start_ms > prev"""
)
def silence_rows(spark, sf_dir):
    rows = cues(spark, sf_dir).withColumn("s", F.col("start_ms").cast("double")).withColumn("e", F.col("end_ms").cast("double"))
    return windows.silences(rows, ["user_id"], CUE, "s", "e").select("user_id", "event_id", "piece", "seconds")


@query(
    f"""WITH {LINES}, u AS (SELECT doc_id AS media, 0 AS file_no, pos::BIGINT AS pos FROM lines UNION ALL SELECT conv_id, 1, turn FROM conversations)
SELECT media, file_no, pos, row_number() OVER (PARTITION BY media ORDER BY file_no, pos) AS idx FROM u"""
)
def renumber_union(spark, sf_dir):
    a = lines(spark, sf_dir).select(F.col("doc_id").alias("media"), F.lit(0).alias("file_no"), F.col("pos").cast("long"))
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media"), F.lit(1).alias("file_no"), F.col("turn").alias("pos"))
    return windows.renumber(a.unionByName(b), ["media"], ["file_no", "pos"])


@query(
    f"""WITH {CUES}, n AS (SELECT *, 1 + event_id % 4 AS parts FROM cues), x AS (SELECT *, unnest(generate_series(0, parts - 1)) AS i FROM n)
SELECT user_id, event_id, i::INT AS line, start_ms + (end_ms - start_ms) * i // parts AS slice_start, start_ms + (end_ms - start_ms) * (i + 1) // parts AS slice_end FROM x"""
)
def time_slices(spark, sf_dir):
    rows = cues(spark, sf_dir).withColumn("parts", F.array_repeat(F.col("text"), (1 + F.col("event_id") % 4).cast("int")))
    return windows.time_slices(rows, "start_ms", "end_ms", "parts").select("user_id", "event_id", "line", "slice_start", "slice_end")


@query(f"WITH {WORDS} SELECT doc_id, pos, word FROM words QUALIFY row_number() OVER (PARTITION BY doc_id, word, pos // 40 ORDER BY pos) = 1")
def word_dedup(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("s", F.expr("pos div 40"))
    return windows.dedup_words(rows, ["doc_id"], ["pos"], "word", "s", "s").select("doc_id", "pos", "word")


@query(
    f"""WITH {WORDS}, c AS (SELECT *, pos % 3 = 0 AS bare FROM words),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY pos) = 1 AS f FROM c) WHERE NOT bare OR f)
SELECT doc_id, pos, word, bare FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, word, pos // 40 ORDER BY pos) = 1"""
)
def bare_word_anti(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("s", F.expr("pos div 40")).withColumn("bare", F.col("pos") % 3 == 0)
    return windows.dedup_caption_words(rows, ["doc_id"], ["pos"], "word", "s", "s", "bare").select("doc_id", "pos", "word", "bare")


@query("SELECT lang, text, arg_max(doc_id, {'n': n_chars, 'd': -doc_id}) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY lang, text")
def keep_longest_by_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text", "doc_id", "n_chars")
    return windows.keep_longest(docs, ["lang"], ["doc_id"], "text", F.col("n_chars"))


@query(
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem),
r AS (SELECT *, sum(CASE WHEN l_linenumber = prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY p) AS prev FROM d)),
g AS (SELECT l_orderkey, run, min(l_linenumber) AS first_num, max(l_linenumber) AS last_num, count(*) AS run_length FROM r GROUP BY l_orderkey, run)
SELECT l_orderkey, first_num, last_num, run_length FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY run_length DESC, run) = 1"""
)
def longest_run(spark, sf_dir):
    return windows.longest_run(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_linenumber")


@query(
    f"""WITH {CUES} SELECT a.user_id, a.event_id, b.event_id AS other_id FROM cues a JOIN cues b
ON a.user_id = b.user_id AND b.start_ms BETWEEN a.start_ms - 500 AND a.start_ms + 1000 AND a.event_id <> b.event_id"""
)
def interval_join(spark, sf_dir):
    rows = cues(spark, sf_dir)
    left = rows.select("user_id", "event_id", "start_ms")
    right = rows.select("user_id", F.col("event_id").alias("other_id"), F.col("start_ms").alias("other_ms"))
    met = joins.interval_join(left, right, ["user_id"], "start_ms", "other_ms", 500, 1000)
    return met.where("event_id <> other_id").select("user_id", "event_id", "other_id")


@query(
    f"""WITH {CUES}, v AS (SELECT user_id, start_ms, max(event_id) AS seen FROM cues WHERE text = 'cue view' GROUP BY ALL),
c AS (SELECT user_id, event_id, start_ms FROM cues WHERE text = 'cue click')
SELECT c.user_id, c.event_id, p.seen AS view_before, (SELECT arg_min(n.seen, n.start_ms) FROM v n WHERE n.user_id = c.user_id AND n.start_ms > c.start_ms) AS view_after
FROM c ASOF LEFT JOIN v p ON c.user_id = p.user_id AND c.start_ms >= p.start_ms"""
)
def asof_prev_next(spark, sf_dir):
    rows = cues(spark, sf_dir)
    clicks = rows.where("text = 'cue click'").select("user_id", "event_id", "start_ms")
    views = rows.where("text = 'cue view'").groupBy("user_id", "start_ms").agg(F.max("event_id").alias("seen"))
    before = joins.nearest_before(clicks, views, ["user_id"], "start_ms", "seen", "view_before").select("user_id", "event_id", "start_ms", "view_before")
    known = views.where("seen is not null")  # arg_min passes over null ids, the join before does not
    return joins.nearest_after(before, known, ["user_id"], "start_ms", "seen", "view_after").select("user_id", "event_id", "view_before", "view_after")


@query(
    f"""WITH {WORDS}, {LINES},
wc AS (SELECT DISTINCT doc_id, pos::BIGINT AS pos, unnest(list_filter(string_split(word, ''), lambda x: x <> '')) AS ch FROM words),
sc AS (SELECT DISTINCT doc_id, pos AS sentence, (pos * 5)::BIGINT AS at, unnest(list_filter(string_split(line, ''), lambda x: x <> '')) AS ch FROM lines),
ends AS (SELECT doc_id, ch, min(pos) AS low, max(pos) AS high FROM wc GROUP BY doc_id, ch),
found AS (SELECT sc.doc_id, sc.sentence, wc.pos AS nearest, e.low, e.high FROM sc ASOF LEFT JOIN wc ON sc.doc_id = wc.doc_id AND sc.ch = wc.ch AND sc.at <= wc.pos
  JOIN ends e ON sc.doc_id = e.doc_id AND sc.ch = e.ch)
SELECT doc_id, sentence, coalesce(min(nearest), min(low)) AS first, coalesce(max(high) FILTER (WHERE nearest IS NOT NULL), max(high)) AS last FROM found GROUP BY doc_id, sentence"""
)
def char_overlap_join(spark, sf_dir):
    sentences = lines(spark, sf_dir, dealt=True).select("doc_id", F.col("pos").alias("sentence"), (F.col("pos") * 5).cast("long").alias("at"), "line")
    return joins.shared_character_spans(sentences, words(spark, sf_dir), ["doc_id"], "sentence", "line", "at", "word", "pos")


@query(
    """SELECT a.conv_id, a.turn, a.text, 'T ' || b.text AS translated FROM conversations a
LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.role = 'user'"""
)
def positional_join(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    results = rows.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("T "), "text").alias("translated"))
    return joins.by_position(rows.select("conv_id", "turn", "text"), results, ["conv_id", "turn"], ["translated"])


@query(
    """WITH s AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN string_split(text, chr(10)) ELSE [text] END AS parts FROM conversations)
SELECT conv_id, turn, unnest(generate_series(0, len(parts) - 1))::INT AS piece_no, unnest(parts) AS piece FROM s"""
)
def left_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    pieces = rows.where("role = 'assistant'").select("conv_id", "turn", F.split("text", "\n").alias("parts"))
    return joins.replace_or_keep(rows, pieces, ["conv_id", "turn"], "text", "parts").select("conv_id", "turn", "piece_no", "piece")


LANGUAGES = {"en": "English", "de": "German", "fr": "French"}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Unknown' END AS language FROM documents")
def dimension_default(spark, sf_dir):
    return joins.lookup(table(spark, sf_dir, "documents"), LANGUAGES, "lang", "language", "Unknown").select("doc_id", "language")


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n FROM documents")
def effective_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.effective_chars(F.col("text")).cast("long").alias("n"))


@query(
    """SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\p{Han}]', '', 'g')) AS width, length(text) * 1.0 +
  length(regexp_replace(text, '[^一-鿿぀-ゟ゠-ヿ＀-￯]', '', 'g')) * 0.75 + length(regexp_replace(text, '[^가-힯]', '', 'g')) * 0.5 AS weighted FROM documents"""
)
def text_widths(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.display_width(t).cast("long").alias("width"), T.weighted_length(t).cast("double").alias("weighted"))


_SP = r"[\s\x0b\x{85}\p{Z}]"


def _sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SP}+', ''), '{_SP}+$', '')"


def _sql_clean_caption(x: str) -> str:
    out = f"regexp_replace({x}, '\\[[^\\]]*\\]', '', 'g')"
    out = f"regexp_replace({out}, '\\([^)]*(?i:{'|'.join(T.CUE_WORDS)})[^)]*\\)', '', 'g')"
    out = f"replace(regexp_replace({out}, '[{T.MUSIC_SIGNS}]', '', 'g'), '>>', '')"
    out = f"regexp_replace({out}, '(?i)^\\s*({'|'.join(T.FILLERS)})\\s*[,，]?\\s*', '')"
    for a, b in T.ENTITIES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({_sql_trim(out)}, '\\s+', ' ', 'g')"


@query(f"WITH {LINES} SELECT doc_id, pos, {_sql_clean_caption('line')} AS cleaned FROM lines")
def clean_caption(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.clean_caption(F.col("line")).alias("cleaned"))


def _sql_clean_speech(x: str) -> str:
    out = f"regexp_replace({x}, '(?i)[(（][^()（）]*({'|'.join(T.NOISE_WORDS)})[^()（）]*[)）]', '', 'g')"
    for sign in ("&", "®", "™", "©", "——", "--"):
        out = f"replace({out}, '{sign}', '')"
    return _sql_trim(f"regexp_replace({out}, '\\s+', ' ', 'g')")


@query(f"SELECT doc_id, {_sql_clean_speech('text')} AS cleaned FROM documents")
def clean_speech(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_speech(F.col("text")).alias("cleaned"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query(
    f"""WITH {WORDS} SELECT doc_id, pos, regexp_replace(regexp_replace(word, '^\\p{{P}}+', ''), '\\p{{P}}+$', '') AS trimmed,
  regexp_replace(word, '[\\p{{P}}\\p{{S}}\\s\\x0b\\x{{85}}\\p{{Z}}]', '', 'g') AS base, regexp_replace(word, '[^\\p{{Latin}}\\p{{N}}\\p{{Han}}\\p{{Hangul}}\\p{{Hiragana}}\\p{{Katakana}}]', '', 'g') AS known,
  word <> '' AND NOT contains(word, ' ') AND NOT (lower(word) IN ({", ".join(f"'{c}'" for c in T.AUDIO_CUES)}) OR regexp_matches(word, '[{T.MUSIC_NOTES}]'))
    AND NOT regexp_matches(word, '^[^\\p{{L}}\\p{{N}}]+$') AND strlen(word) <= 15 AS single FROM words"""
)
def word_forms(spark, sf_dir):
    w = F.col("word")
    return words(spark, sf_dir).select("doc_id", "pos", T.trim_punctuation(w).alias("trimmed"), T.base_text(w).alias("base"), T.recognizable(w).alias("known"), T.single_word(w).alias("single"))


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？；\\n\\r]+)', '\\1' || chr(57345), 'g'), chr(57345)), lambda x: {_sql_trim('x')}), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, unnest(generate_series(0, len(parts) - 1))::INT AS k, unnest(parts) AS sentence FROM s"""
)
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence"))


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?；。！？,，;\\n\\r]+)', '\\1' || chr(57345), 'g'), chr(57345)), lambda x: {_sql_trim('x')}), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, len(parts)::INT AS n_clauses, list_max(list_transform(parts, lambda x: length(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g'))))::INT AS longest FROM s"""
)
def clause_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", T.clauses(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n_clauses"), F.array_max(F.transform("parts", T.effective_chars)).cast("int").alias("longest"))


def _sql_count(cls: str) -> str:
    return f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"


def _sql_speech() -> str:
    case = lambda i: "CASE lang " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in speech.PROFILES.items()) + f" ELSE {speech.FALLBACK[i]}::DOUBLE END"
    pauses = f"({_sql_count(',，、;；:：')} * 0.22::DOUBLE + {_sql_count('.。!！?？')} * 0.28::DOUBLE + {_sql_count('…—～')} * 0.34::DOUBLE)"
    runs = "coalesce(list_sum(list_transform(regexp_extract_all(text, '\\p{Lu}{2,}'), lambda x: length(x))), 0)"
    extras = f"({pauses} * {case(2)} + {_sql_count(chr(92) + 'p{Nd}')} * 0.12::DOUBLE * {case(3)} + {runs} * 0.18::DOUBLE * {case(4)})"
    solid = f"length(regexp_replace(text, '{_SP}', '', 'g'))"
    n_words = f"len(list_filter(regexp_split_to_array(text, '{_SP}+'), lambda x: x <> ''))"
    langs = ", ".join(f"'{k}'" for k in speech.PROFILES)
    general = f"greatest({solid} / 8.5::DOUBLE + {n_words} * 0.12::DOUBLE + {_sql_count(chr(92) + 'p{Nd}')} * 0.08::DOUBLE + {_sql_count(chr(92) + 'p{L}')} * 0.01::DOUBLE + {extras}, 0.2::DOUBLE)"
    return f"""SELECT doc_id, round(CASE WHEN {solid} = 0 THEN 0 WHEN lang IN ({langs}) THEN {solid} / {case(0)} + {extras} ELSE {general} END, 6) AS seconds, {case(1)} AS confidence FROM documents"""


@query(_sql_speech())
def speech_estimate(spark, sf_dir):
    t, lang = F.col("text"), F.col("lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(speech.spoken_seconds(t, lang), 6).alias("seconds"), speech.confidence(lang).alias("confidence"))


_HMS = "printf('%02d:%02d:%02d{sep}%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000)"


@query(
    f"""WITH {CUES}, t AS (SELECT event_id, end_ms, end_ms / 1000.0::DOUBLE + (event_id % 7) / 7000.0::DOUBLE AS s FROM cues),
f AS (SELECT *, floor(greatest(s, 0) * 1000 + 0.5)::BIGINT AS a, floor(s)::BIGINT * 1000 + floor((s - floor(s)) * 1000)::BIGINT AS b FROM t)
SELECT event_id, (SELECT {_HMS.format(sep=',')} FROM (SELECT a AS m)) AS half_up, (SELECT {_HMS.format(sep=',')} FROM (SELECT b AS m)) AS truncated,
       printf('%02d:%02d:%02d.%02d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000 // 10) AS ass FROM f"""
)
def time_formats(spark, sf_dir):
    s = F.col("end_ms") / 1000.0 + (F.col("event_id") % 7) / 7000.0
    return cues(spark, sf_dir).select("event_id", timecode.srt_half_up(s).alias("half_up"), timecode.srt_truncated(s).alias("truncated"), timecode.ass_time(F.col("end_ms")).alias("ass"))


@query(
    f"""WITH {CUES}, t AS (SELECT event_id, (end_ms % 20000000 / 1000.0::DOUBLE)::FLOAT AS s FROM cues),
f AS (SELECT event_id, floor(s)::BIGINT * 1000 + trunc(((s - floor(s)::FLOAT)::FLOAT * 1000.0::FLOAT)::FLOAT)::BIGINT AS m FROM t)
SELECT event_id, {_HMS.format(sep=',')} AS float_truncated FROM f"""
)
def time_format_float(spark, sf_dir):
    s = F.col("end_ms") % 20_000_000 / 1000.0
    return cues(spark, sf_dir).select("event_id", timecode.srt_float_truncated(s).alias("float_truncated"))


@query(f"WITH {CUES} SELECT event_id, start_ms AS back_ms, end_ms % 1000 + 8000 AS short_ms, start_ms AS strict_ms FROM cues")
def time_parse(spark, sf_dir):
    rows = cues(spark, sf_dir).withColumn("srt", timecode.srt_from_millis(F.col("start_ms")))
    short = F.concat(F.lit("00:08."), (F.col("end_ms") % 1000).cast("string"))
    return rows.select("event_id", timecode.srt_millis(F.col("srt")).alias("back_ms"), timecode.vtt_millis(short).alias("short_ms"), timecode.strict_millis(F.col("srt")).alias("strict_ms"))


@query("""SELECT conv_id, turn, l[1] AS top, l[-1] AS bottom, array_to_string(l, ' ') AS joined FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)""")
def line_mode(spark, sf_dir):
    l = F.split("text", "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(l, 1).alias("top"), F.element_at(l, -1).alias("bottom"), F.array_join(l, " ").alias("joined"))


@query(
    f"""WITH {CUES}, r AS (SELECT text, row_number() OVER (PARTITION BY text ORDER BY event_id DESC) - 1 AS later, least(greatest((end_ms - start_ms) / 3000.0::DOUBLE, 0.5), 1.5) AS ratio FROM cues)
SELECT text, round(sum(ratio * 0.3::DOUBLE * pow(0.7::DOUBLE, later)) + pow(0.7::DOUBLE, count(*)), 9) AS factor FROM r GROUP BY text"""
)
def calibration(spark, sf_dir):
    rows = cues(spark, sf_dir).withColumn("estimated", F.lit(3000.0)).withColumn("actual", (F.col("end_ms") - F.col("start_ms")).cast("double"))
    return speech.calibrated(rows, "text", ["event_id"], "estimated", "actual").withColumn("factor", F.round("factor", 9))


@query(
    """SELECT event_id, '&H' || CASE WHEN event_id % 2 = 0 THEN printf('%02X', 255 - event_id % 256) ELSE '00' END || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2) AS colour
FROM (SELECT event_id, printf('%06X', event_id * 7919 % 16777216) AS c FROM events)"""
)
def ass_colours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("c", F.format_string("#%06X", F.col("event_id") * 7919 % 16777216))
    with_alpha = F.when(F.col("event_id") % 2 == 0, F.concat("c", F.format_string("%02x", F.col("event_id") % 256))).otherwise(F.col("c"))
    return rows.select("event_id", T.ass_colour(with_alpha).alias("colour"))


@query(
    """WITH p AS (SELECT doc_id, text AS o, regexp_replace(text, '[aeiou]', CASE WHEN doc_id % 3 = 0 THEN '$0' ELSE 'xx' END, 'g') AS t0, lang FROM documents),
q AS (SELECT doc_id, lang, o, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN o WHEN doc_id % 5 = 2 THEN substr(o, 1, 12) ELSE upper(o) END AS t FROM p)
SELECT doc_id, CASE WHEN tt = '' THEN false WHEN oo = tt THEN oo <> '' AND (length(regexp_replace(oo, '[a-zA-Z]', '', 'g')) > strlen(oo) * 0.5
    OR """
    + " OR ".join(f"contains(lower(oo), '{n.lower()}')" for n in T.PROPER_NOUNS)
    + """)
  ELSE (lang <> 'en' OR length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) >= strlen(replace(t, ' ', '')) * 0.5)
    AND ((strlen(tt) >= strlen(oo) * 0.3 AND strlen(tt) <= strlen(oo) * 3) OR strlen(oo) < 10) END AS valid
FROM (SELECT *, """
    + _sql_trim("o")
    + " AS oo, "
    + _sql_trim("t")
    + " AS tt FROM q)"
)
def translation_valid(spark, sf_dir):
    o = F.col("text")
    k = F.col("doc_id") % 5
    t = F.when(k == 0, "").when(k == 1, o).when(k == 2, F.substring(o, 1, 12)).otherwise(F.upper(o))
    return table(spark, sf_dir, "documents").select("doc_id", T.valid_translation(o, t, F.col("lang")).alias("valid"))
