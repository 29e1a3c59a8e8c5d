"""Queries of wrapped lines, over sentences of conversations whose letters are put into Han characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import wrapping as R
from tidemark.plans.catalog import _sql_trim, query
from tidemark.plans.inputs import table
from tidemark.sinks import subtitles

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Particles and pairs among them.
HAN = "的一了小时今天明自己人生目标规则注意未来屏幕分钟"
LINE = R.Line(limit=200.0, size=22.0, spacing=1.5)


def _texts(spark, sf_dir):
    parts = F.split(F.regexp_replace(F.translate("text", LETTERS, HAN), " ", ""), r"\.")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("k", "text"))


def _clean(x: str) -> str:
    return f"regexp_replace({x}, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')"


def _wide(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^一-鿿]', '', 'g')))"


_WIDTH = """CASE WHEN regexp_matches({c}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]') THEN 22 * 0.33::DOUBLE WHEN regexp_matches({c}, '[一-鿿぀-ヿ㐀-䶿가-힯\\x{{ff00}}-\\x{{ffef}}]') THEN 22
  WHEN regexp_matches({c}, '[A-Z]') THEN 22 * 0.66::DOUBLE WHEN regexp_matches({c}, '[a-z0-9]') THEN 22 * 0.56::DOUBLE WHEN regexp_matches({c}, '\\p{{P}}') THEN 22 * 0.38::DOUBLE ELSE 22 * 0.62::DOUBLE END"""
_STICKS = "contains('，,.。！？”\"》', {c})"
_BEST = f"contains('{R.CUT_SIGNS}{R.PARTICLES}', {{c}})"
_TEXTS = f"""texts AS (
  SELECT conv_id, turn, unnest(generate_series(0, len(p) - 1))::INT AS k, unnest(p) AS raw
  FROM (SELECT conv_id, turn, string_split(replace(translate(text, '{LETTERS}', '{HAN}'), ' ', ''), '.') AS p FROM conversations)),
clean AS (SELECT conv_id, turn, k, {_clean(_sql_trim('raw'))} AS text FROM texts),
chars AS (SELECT *, string_split(text, '') AS ch FROM clean WHERE text <> '')"""


def _tail(source: str) -> str:
    """SQL of short_tail over source(conv_id, turn, k, text, ch, lines)."""
    pairs = ", ".join(f"'{p}'" for p in R.KEPT_PAIRS)
    return f"""two AS (SELECT *, lines[len(lines) - 1] || lines[len(lines)] AS joined,
  len(lines) >= 2 AND length(lines[len(lines)]) BETWEEN 1 AND 3 AND length(lines[len(lines) - 1] || lines[len(lines)]) >= 6 AS short FROM {source}),
mid AS (SELECT *, length(joined) // 2 AS most, greatest(1, (length(joined) // 2) * 3 // 5) AS least FROM two),
spots AS (SELECT *, range(most::INT, least::INT - 1, -1) AS spot FROM mid WHERE short),
cuts AS (SELECT conv_id, turn, k, coalesce(list_filter(spot, lambda i: {_BEST.format(c='joined[i:i]')})[1],
  list_filter(spot, lambda i: joined[i:i+1] NOT IN ({pairs}) AND NOT (i >= 2 AND joined[i-1:i+1] = '{R.KEPT_TRIPLE}'))[1], least) AS cut FROM spots),
tailed AS (SELECT conv_id, turn, k, text, ch, CASE WHEN short THEN list_concat(lines[1:len(lines) - 2], [joined[1:cut], joined[cut+1:length(joined)]]) ELSE lines END AS lines
  FROM mid LEFT JOIN cuts USING (conv_id, turn, k))"""


_BALANCED = f"""{_tail('wrapped')},
aims AS (SELECT *, len(lines) = 2 AND len(ch) >= 2 AND {_wide('lines[1]')} >= {_wide('lines[2]')} AS wide,
  greatest(1, {_wide("array_to_string(lines, '')")} * 2 // 5) AS target FROM tailed),
offs AS (SELECT *, CASE WHEN wide THEN list_transform(range(1, len(ch)), lambda i: abs({_wide('text[1:i]')} - target) - CASE WHEN {_BEST.format(c='ch[i]')} THEN 2 ELSE 0 END) END AS off FROM aims),
anew AS (SELECT *, list_position(off, list_min(off)) AS cut FROM offs),
sides AS (SELECT *, {_clean('text[1:cut]')} AS a, {_clean('text[cut+1:length(text)]')} AS b FROM anew),
done AS (SELECT conv_id, turn, k, text, CASE WHEN wide AND a <> '' AND {_wide('a')} < {_wide('b')} THEN [a, b] ELSE lines END AS lines FROM sides)"""
_WRAPPED = f"""WITH RECURSIVE {_TEXTS},
sized AS (SELECT *, list_sum(list_transform(ch, lambda c: {_WIDTH.format(c='c')})) + 1.5 * (len(ch) - 1) <= 200
  OR NOT regexp_matches(text, '[一-鿿぀-ヿ㐀-䶿가-힯\\x{{ff00}}-\\x{{ffef}}\\x{{0e00}}-\\x{{0e7f}}]') AS fits FROM chars),
fold AS (SELECT conv_id, turn, k, text, ch, 1 AS i, []::VARCHAR[] AS lines, ch[1] AS held, {_WIDTH.format(c='ch[1]')}::DOUBLE AS w FROM sized WHERE NOT fits
  UNION ALL SELECT conv_id, turn, k, text, ch, i + 1, CASE WHEN opens THEN list_append(lines, {_clean('held')}) ELSE lines END,
    CASE WHEN opens THEN ch[i + 1] ELSE held || ch[i + 1] END, CASE WHEN opens THEN n ELSE w + n END
  FROM (SELECT *, NOT {_STICKS.format(c='ch[i + 1]')} AND held <> '' AND w + n > 200 AS opens FROM (SELECT *, {_WIDTH.format(c='ch[i + 1]')}::DOUBLE AS n FROM fold WHERE i < len(ch)))),
wrapped AS (SELECT conv_id, turn, k, text, ch, list_append(lines, {_clean('held')}) AS lines FROM fold WHERE i = len(ch)),
{_BALANCED},
every AS (SELECT conv_id, turn, k, lines FROM done UNION ALL SELECT conv_id, turn, k, [text] FROM sized WHERE fits)"""


@query(f"{_WRAPPED} SELECT conv_id, turn, k, array_to_string(lines, '|') AS lines, len(lines)::INT AS n FROM every")
def wrapped_lines(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("lines", R.wrapped(F.col("text"), LINE)).where(F.size("lines") > 0)
    return rows.select("conv_id", "turn", "k", F.array_join("lines", "|").alias("lines"), F.size("lines").alias("n"))


@query(
    f"""WITH RECURSIVE {_TEXTS},
sized AS (SELECT *, {_wide('text')} AS whole FROM chars), aimed AS (SELECT *, ceil(whole / 20.0)::INT AS rows FROM sized),
fold AS (SELECT conv_id, turn, k, text, ch, whole // rows AS each, rows, 1 AS i, []::VARCHAR[] AS lines, ch[1] AS held, {_wide('ch[1]')} AS w FROM aimed WHERE whole > 20
  UNION ALL SELECT conv_id, turn, k, text, ch, each, rows, i + 1, CASE WHEN opens THEN list_append(lines, {_clean('held')}) ELSE lines END,
    CASE WHEN opens THEN ch[i + 1] ELSE held || ch[i + 1] END, CASE WHEN opens THEN n ELSE w + n END
  FROM (SELECT *, NOT {_STICKS.format(c='ch[i + 1]')} AND w + n > each AND len(lines) < rows - 1 AS opens FROM (SELECT *, {_wide('ch[i + 1]')} AS n FROM fold WHERE i < len(ch)))),
wrapped AS (SELECT conv_id, turn, k, text, ch, list_append(lines, {_clean('held')}) AS lines FROM fold WHERE i = len(ch)),
{_tail('wrapped')}
SELECT conv_id, turn, k, array_to_string(lines, '|') AS lines FROM tailed UNION ALL SELECT conv_id, turn, k, text FROM aimed WHERE whole <= 20"""
)
def even_lines(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("lines", R.even_lines(F.col("text"), 10)).where(F.size("lines") > 0)
    return rows.select("conv_id", "turn", "k", F.array_join("lines", "|").alias("lines"))


@query(
    f"""{_WRAPPED} SELECT conv_id, turn, k, 'Dialogue: 0,00:00:0' || (k % 7) || '.00,00:00:09.00,Major,,0,0,0,,{{\\an2}}{{\\rMajor}}' || array_to_string(lines, '\\N') AS dialogue FROM every"""
)
def wrapped_dialogue(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("conv_id", "turn", "k", ((F.col("k") % 7) * 1000).cast("long").alias("start_ms"), F.lit(9000).cast("long").alias("end_ms"), F.array("text").alias("lines"))
    return subtitles.dialogue(rows, wrap=LINE).select("conv_id", "turn", "k", "dialogue")
