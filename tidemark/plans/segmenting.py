"""Queries of the ordered folds; those that SQL has no plain way to say are held against other models by the tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import folds, grouping, matching, splitting
from tidemark.plans.catalog import SENTENCES, _sentences, _sql_trim, query
from tidemark.plans.inputs import CUES, LINES, cues, lines, table, words


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_PAIRS, _TRIPLES = ([p for p in folds.PHRASES if p.count(" ") == k] for k in (1, 2))
_EFFECTIVE = "length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_ENDED = "({x} <> '' AND contains('。！？.!?…', right({x}, 1)))"
_MARK = r"[!-/:-@\[-`{{-~\x{{2000}}-\x{{206f}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]".replace("{{", "{").replace("}}", "}")
#: comma, semantic and fixed piece of every word: one recursion over the words of a sentence carries all three rules.
BREAKS = f"""{SENTENCES},
near AS (SELECT doc_id, sentence_id, pos, word, lower(word) AS low, lead(lower(word)) OVER s AS n1, lead(lower(word), 2) OVER s AS n2, lag(lower(word)) OVER s AS b1
  FROM sentences WINDOW s AS (PARTITION BY doc_id, sentence_id ORDER BY pos)),
flags AS (SELECT doc_id, sentence_id, pos, word, low IN {_in(folds.BAD_ENDS)} AS bad, low IN {_in(folds.BREAK_WORDS)} AS brk, right(word, 1) IN {_in(folds.PAUSES)} AS pause, strlen(word) + 1 AS bytes,
  coalesce(low || ' ' || n1 IN {_in(_PAIRS)}, false) OR coalesce(low || ' ' || n1 || ' ' || n2 IN {_in(_TRIPLES)}, false) AS s1, coalesce(b1 || ' ' || low || ' ' || n1 IN {_in(_TRIPLES)}, false) AS s2 FROM near),
packed AS (SELECT doc_id, sentence_id, min(pos) AS p0, count(*) AS n, sum({_EFFECTIVE.format(x='word')}) AS eff, list(bad ORDER BY pos) AS bad, list(brk ORDER BY pos) AS brk, list(pause ORDER BY pos) AS pause,
  list(bytes ORDER BY pos) AS bytes, list(s1 ORDER BY pos) AS s1, list(s2 ORDER BY pos) AS s2 FROM flags GROUP BY ALL),
walk AS (SELECT *, 0 AS i, 0 AS f, 0 AS f_held, 0 AS f_next, 0 AS m, 0 AS m_held, 0::BIGINT AS m_used, 0 AS m_next, 0 AS c, 0 AS c_held, 0 AS c_next FROM packed
  UNION ALL SELECT doc_id, sentence_id, p0, n, eff, bad, brk, pause, bytes, s1, s2, i + 1,
    f_next, CASE WHEN f_close THEN 0 ELSE f_held + 1 END, CASE WHEN f_close THEN f_next + 1 ELSE f_next END,
    CASE WHEN m_cut AND brk[i + 1] THEN m_next + 1 ELSE m_next END, CASE WHEN m_cut THEN CASE WHEN brk[i + 1] THEN 1 ELSE 0 END ELSE m_held + 1 END,
    CASE WHEN m_cut THEN CASE WHEN brk[i + 1] THEN bytes[i + 1] ELSE 0 END ELSE m_used + bytes[i + 1] END, CASE WHEN m_cut THEN m_next + 1 ELSE m_next END,
    c_next, CASE WHEN pause[i + 1] AND c_held >= 2 THEN 0 ELSE c_held + 1 END, CASE WHEN pause[i + 1] AND c_held >= 2 THEN c_next + 1 ELSE c_next END
  FROM (SELECT *, f_held >= 17 OR (f_held >= 11 AND NOT bad[i + 1] AND (i + 1 = n OR NOT (s1[i + 1] OR (s2[i + 1] AND f_held >= 1)))) OR (i + 1 = n AND f_held < 11) AS f_close,
    m_held >= 2 AND i + 1 < n AND ((brk[i + 1] AND m_used + bytes[i + 1] >= 60) OR m_used + bytes[i + 1] >= 85) AS m_cut FROM walk WHERE i < n)),
loose AS (SELECT *, max(CASE WHEN i = n AND f_held > 0 AND f_next > 0 THEN f_next END) OVER w AS f_loose, max(CASE WHEN i = n AND m_held BETWEEN 1 AND 2 AND m_next > 0 THEN m_next END) OVER w AS m_loose,
  max(c) OVER w AS c_top FROM walk WHERE i > 0 WINDOW w AS (PARTITION BY doc_id, sentence_id)),
kept AS (SELECT doc_id, sentence_id, p0, n, i, eff, c, c_top, CASE WHEN f = f_loose THEN f - 1 ELSE f END AS f, CASE WHEN m = m_loose THEN m - 1 ELSE m END AS m FROM loose),
sizes AS (SELECT doc_id, sentence_id, f, count(*) AS k FROM kept GROUP BY ALL),
joint AS (SELECT doc_id, sentence_id, f, sum(CASE WHEN k > 3 OR f = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sentence_id ORDER BY f) - 1 AS fixed FROM sizes),
three AS (SELECT doc_id, sentence_id, p0 + i - 1 AS pos, n, eff, c, c_top, fixed::INT AS fixed,
  CASE WHEN n <= 5 THEN 0 WHEN max(m) OVER (PARTITION BY doc_id, sentence_id) > 0 THEN m ELSE fixed END::INT AS semantic FROM kept JOIN joint USING (doc_id, sentence_id, f)),
breaks AS (SELECT doc_id, sentence_id, pos, fixed, semantic, CASE WHEN c_top > 0 THEN c WHEN eff > 70 THEN semantic ELSE 0 END::INT AS comma FROM three)"""


def _contextual(source: str, to: str) -> str:
    """SQL of contextual_breaks over source(doc_id, sentence_id, pos, word): to(doc_id, sentence_id, pos, piece)."""
    return f"""{to}_kinds AS (SELECT *, lower(word) IN {_in(folds.OPENERS)} AS o, lower(word) IN {_in(folds.JOINERS)} AS j, lower(word) IN {_in(folds.RELATIVES)} AS r, lower(word) IN {_in(folds.VERBS)} AS v, {_EFFECTIVE.format(x='word')} AS e FROM {source}),
{to}_held AS (SELECT doc_id, sentence_id, min(pos) AS p0, count(*) AS n, list(o ORDER BY pos) AS o, list(j ORDER BY pos) AS j, list(r ORDER BY pos) AS r, list(v ORDER BY pos) AS v, list(e ORDER BY pos) AS e FROM {to}_kinds GROUP BY doc_id, sentence_id),
{to}_walk AS (SELECT *, 0 AS i, 1 AS a, 0 AS piece FROM {to}_held
  UNION ALL SELECT doc_id, sentence_id, p0, n, o, j, r, v, e, i + 1, CASE WHEN cuts THEN i + 1 ELSE a END, CASE WHEN cuts THEN piece + 1 ELSE piece END
  FROM (SELECT *, n > 5 AND i + 1 < n AND i + 2 - a >= 5 AND (o[i + 1] OR (whole AND j[i + 1] AND list_sum(e[a:i]) <= 70 AND list_sum(e[i + 1:n]) <= 70) OR (whole AND r[i + 1] AND i + 2 - a >= 10 AND list_sum(e[a:i]) > 70)) AS cuts
    FROM (SELECT *, i + 1 - a >= 3 AND list_contains(v[a:i - 1], true) AS whole FROM {to}_walk WHERE i < n))),
{to}_sized AS (SELECT doc_id, sentence_id, p0 + i - 1 AS pos, piece, count(*) OVER (PARTITION BY doc_id, sentence_id, piece) AS k FROM {to}_walk WHERE i > 0),
{to} AS (SELECT doc_id, sentence_id, pos, CASE WHEN min(k) OVER (PARTITION BY doc_id, sentence_id) >= 3 THEN piece ELSE 0 END::INT AS piece FROM {to}_sized)"""


def _places(rows):
    return rows.select("doc_id", "sentence_id", "pos", "piece")


@query(
    f"""WITH RECURSIVE {SENTENCES},
s AS (SELECT doc_id, sentence_id, list(word ORDER BY pos) AS w, min(pos) AS p0 FROM sentences GROUP BY ALL),
r AS (SELECT doc_id, sentence_id, w, p0, 0 AS i, 0 AS g, strlen(w[1])::BIGINT AS used FROM s
  UNION ALL SELECT doc_id, sentence_id, w, p0, i + 1, CASE WHEN used + 1 + strlen(w[i + 2]) <= 20 THEN g ELSE g + 1 END,
                   CASE WHEN used + 1 + strlen(w[i + 2]) <= 20 THEN used + 1 + strlen(w[i + 2]) ELSE strlen(w[i + 2]) END FROM r WHERE i + 1 < len(w)),
m AS (SELECT *, max(g) OVER (PARTITION BY doc_id, sentence_id) AS top, count(*) OVER (PARTITION BY doc_id, sentence_id, g) AS n FROM r)
SELECT doc_id, sentence_id, p0 + i AS pos, (CASE WHEN g = top AND top > 0 AND n = 1 AND length(w[i + 1]) <= 12 THEN g - 1 ELSE g END)::INT AS piece FROM m"""
)
def greedy_pack(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", lambda w: folds.pack_by_bytes(w, 20), "piece"))


@query(
    f"WITH RECURSIVE {BREAKS} SELECT doc_id, sentence_id, pos, comma AS piece FROM breaks"
)
def comma_split(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", folds.comma_breaks, "piece"))


@query(
    f"WITH RECURSIVE {BREAKS} SELECT doc_id, sentence_id, pos, fixed AS piece FROM breaks"
)
def fixed_split(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", folds.fixed_length, "piece"))


@query(
    f"""WITH RECURSIVE {CUES},
o AS (SELECT user_id, event_id, start_ms, end_ms, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS p FROM cues),
r AS (SELECT user_id, event_id, end_ms, p, 0 AS piece, 1 AS held FROM o WHERE p = 1
  UNION ALL SELECT o.user_id, o.event_id, o.end_ms, o.p, CASE WHEN o.start_ms - r.end_ms >= 800 AND r.held >= 3 THEN r.piece + 1 ELSE r.piece END,
                   CASE WHEN o.start_ms - r.end_ms >= 800 AND r.held >= 3 THEN 1 ELSE r.held + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.p = r.p + 1)
SELECT user_id, event_id, piece FROM r"""
)
def min_length_gaps(spark, sf_dir):
    rule = lambda e, s, t: list(zip(e, folds.gap_breaks(s, t, 800), strict=True))
    return folds.fold(cues(spark, sf_dir), ["user_id"], ["start_ms", "event_id"], ["event_id", "start_ms", "end_ms"], rule, "event_id long, piece int")


@query(
    f"""WITH RECURSIVE {SENTENCES},
z AS (SELECT doc_id, sentence_id, least(count(*), 12) AS n FROM sentences GROUP BY ALL),
s AS (SELECT doc_id, list(n ORDER BY sentence_id) AS n FROM z GROUP BY doc_id),
r AS (SELECT doc_id, n, 0 AS i, -1 AS batch, 0 AS take FROM s
  UNION ALL SELECT doc_id, n, i + take, batch + 1, t FROM (SELECT *, CASE WHEN i + take + 3 <= len(n) AND n[i+take+1] + n[i+take+2] + n[i+take+3] <= 10 THEN 3
      WHEN i + take + 2 <= len(n) AND n[i+take+1] + n[i+take+2] <= 10 THEN 2 ELSE 1 END AS t FROM r WHERE i + take < len(n)))
SELECT doc_id, (i + unnest(generate_series(0, take - 1)))::BIGINT AS sentence_id, batch::INT AS batch FROM r WHERE take > 0"""
)
def batch_pack(spark, sf_dir):
    sizes = _sentences(spark, sf_dir).groupBy("doc_id", "sentence_id").agg(F.least(F.count(F.lit(1)), F.lit(12)).alias("n"))
    rule = lambda k, n: list(zip(k, folds.pack_batches(n), strict=True))
    return folds.fold(sizes, ["doc_id"], ["sentence_id"], ["sentence_id", "n"], rule, "sentence_id long, batch int")


@query(
    f"""WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(generate_series(1, len(x))) AS k, unnest(x) AS line FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS x FROM conversations)),
t AS (SELECT conv_id, list(line ORDER BY turn, k) AS l FROM p WHERE line <> '' GROUP BY conv_id),
r AS (SELECT conv_id, l, 0 AS i, '' AS held, []::VARCHAR[] AS given, 0 AS k FROM t
  UNION ALL SELECT conv_id, l, i + 1, CASE WHEN full_ THEN '' ELSE now END, list_concat(first, CASE WHEN full_ THEN [now] ELSE []::VARCHAR[] END), k + len(given)
  FROM (SELECT *, length(now) >= 22 OR ({_ENDED.format(x='now')} AND length(now) >= 15) AS full_ FROM (
    SELECT *, CASE WHEN held = '' OR cuts OR wide THEN line ELSE held || joint || line END AS now, CASE WHEN held = '' THEN []::VARCHAR[] WHEN cuts THEN [held] WHEN wide THEN [held || joint] ELSE []::VARCHAR[] END AS first FROM (
      SELECT *, {_ENDED.format(x='held')} AND (NOT {_ENDED.format(x='line')} OR length(held) >= 15) AS cuts, length(held) + length(joint) + length(line) > 22 AS wide FROM (
        SELECT *, l[i + 1] AS line, CASE WHEN {_ENDED.format(x='held')} OR regexp_matches(held, '{_MARK}$') THEN '' ELSE ',' END AS joint FROM r WHERE i < len(l)))))),
e AS (SELECT conv_id, k + unnest(generate_series(0, len(given) - 1)) AS k, unnest(given) AS line FROM r WHERE len(given) > 0
  UNION ALL SELECT conv_id, k + len(given), held FROM r WHERE i = len(l) AND held <> '')
SELECT conv_id, k::INT AS k, line FROM e"""
)
def reflow_lines(spark, sf_dir):
    rule = lambda texts: list(enumerate(folds.reflow([x for t in texts for x in (t or "").split("\n") if x], False)))
    return folds.fold(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["text"], rule, "k int, line string")


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS p FROM lineitem),
one AS (SELECT l_orderkey, l_linenumber, p FROM d)
SELECT l_orderkey, max(len) AS chain FROM (
  WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, p, 1 AS len FROM one
    UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.p, r.len + 1 FROM r JOIN one o ON o.l_orderkey = r.l_orderkey AND o.p > r.p AND o.l_linenumber = r.l_linenumber + 1)
  SELECT l_orderkey, len FROM r) GROUP BY l_orderkey"""
)
def longest_chain(spark, sf_dir):
    rule = lambda nums: [(len(folds.longest_chain(nums)),)]
    return folds.fold(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"], ["l_linenumber"], rule, "chain int")


@query()
def sentence_alignment(spark, sf_dir):
    def rule(ids, places, texts):
        timed = [(w, p * 0.4, p * 0.4 + 0.3) for w, p in zip(texts, places, strict=True)]
        sentences: dict[int, list[str]] = {}
        for k, w in zip(ids, texts, strict=True):
            sentences.setdefault(k, []).append(w)
        times = folds.align([" ".join(ws) for ws in sentences.values()], timed)
        return [(k, a, b) for k, (a, b) in zip(sentences, times, strict=True)]

    return folds.fold(_sentences(spark, sf_dir), ["doc_id"], ["pos"], ["sentence_id", "pos", "word"], rule, "sentence_id long, start double, end double")


@query(
    f"WITH RECURSIVE {BREAKS} SELECT doc_id, sentence_id, pos, semantic AS piece FROM breaks"
)
def semantic_split(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", folds.semantic_breaks, "piece"))


@query(
    f"""WITH {SENTENCES},
m AS (SELECT *, coalesce(sum((right(word, 1) IN {_in(folds.PAUSES)})::INT) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM sentences),
z AS (SELECT doc_id, sentence_id, part, (count(*) > 1)::INT AS many FROM m GROUP BY ALL),
g AS (SELECT *, coalesce(sum(many) OVER (PARTITION BY doc_id, sentence_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(many) OVER (PARTITION BY doc_id, sentence_id) AS every FROM z)
SELECT doc_id, sentence_id, pos, least(before, greatest(every - 1, 0))::INT AS piece FROM m JOIN g USING (doc_id, sentence_id, part)"""
)
def comma_parts(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", folds.comma_parts, "piece"))


@query(
    f"""WITH RECURSIVE {LINES}, t AS (SELECT doc_id, list({_sql_trim('line')} ORDER BY pos) AS l FROM lines GROUP BY doc_id),
r AS (SELECT doc_id, l, 0 AS i, '' AS held, NULL::VARCHAR AS given, 0 AS k FROM t
  UNION ALL SELECT doc_id, l, i + 1, CASE WHEN closes THEN '' ELSE now END, CASE WHEN closes THEN now END, CASE WHEN given IS NULL THEN k ELSE k + 1 END
  FROM (SELECT *, l[i + 1] <> '' AND NOT (coalesce(l[i + 2], '') <> '' AND {_EFFECTIVE.format(x='now')} < 20 AND {_EFFECTIVE.format(x="(now || ' ' || l[i + 2])")} <= 70) AS closes
    FROM (SELECT *, CASE WHEN l[i + 1] = '' THEN held WHEN held = '' THEN l[i + 1] ELSE held || ' ' || l[i + 1] END AS now FROM r WHERE i < len(l))))
SELECT doc_id, k, given AS line FROM r WHERE given IS NOT NULL"""
)
def merge_short_lines(spark, sf_dir):
    rule = lambda texts: list(enumerate(folds.merge_short(texts, 20, 70)))
    return folds.fold(lines(spark, sf_dir), ["doc_id"], ["pos"], ["line"], rule, "k int, line string")


@query(
    f"""WITH {SENTENCES},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id, sentence_id) AS n FROM sentences),
z AS (SELECT *, CASE WHEN n <= 10 THEN n // 2 + 1 WHEN n <= 15 THEN n // 3 + 1 WHEN n <= 20 THEN n // 4 + 1 WHEN n <= 25 THEN n // 5 + 1 ELSE 5 END AS size FROM o)
SELECT doc_id, sentence_id, (i // size)::INT AS k, string_agg(word || ' ', '' ORDER BY pos) AS line, min(pos) * 0.4::DOUBLE AS "start", max(pos) * 0.4::DOUBLE + 0.3::DOUBLE AS "end" FROM z GROUP BY doc_id, sentence_id, k"""
)
def short_line_times(spark, sf_dir):
    """Words of 0.3 s every 0.4 s, in lines of some five words."""

    def rule(places, texts):
        timed = [(w, p * 0.4, p * 0.4 + 0.3) for w, p in zip(texts, places, strict=True)]
        made = folds.short_lines(timed, timed[0][1], timed[-1][2], 0.0, 5)
        return [(k, *line) for k, line in enumerate(made)]

    return folds.fold(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], ["pos", "word"], rule, "k int, line string, start double, end double")


@query(f"""WITH RECURSIVE {BREAKS} SELECT doc_id, sentence_id, comma AS piece, min(pos)::INT AS "first", max(pos)::INT AS "last" FROM breaks GROUP BY ALL""")
def piece_words(spark, sf_dir):
    """Each comma piece of a sentence, sought among its words from the last word matched on."""

    def rule(places, texts):
        pieces: dict[int, list[str]] = {}
        for k, w in zip(folds.comma_breaks(texts), texts, strict=True):
            pieces.setdefault(k, []).append(w)
        out, start = [], 0
        for k, ws in pieces.items():
            hits = folds.match_pieces(" ".join(ws), texts, start)
            start = hits[-1] + 1 if hits else start
            out.append((k, places[hits[0]] if hits else None, places[hits[-1]] if hits else None))
        return out

    return folds.fold(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], ["pos", "word"], rule, "piece int, first int, last int")


@query()
def protected_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(splitting.protected_sentences(F.col("text"))).alias("k", "sentence"))


_SIGNS, _WHITE = T.SINGLE_SIGNS, r"\s\x0b\x{85}\p{Z}"
_TOKENS = (
    r"「[^」]*」?|『[^』]*』?|“[^”]*”?|‘[^’]*’?|《[^》]*》?|<[^>]*>?|【[^】]*】?|〔[^〕]*〕?|\([^)]*\)?|\[[^\]]*\]?|\{[^}]*\}?"
    r"|\p{Nd}+(?:\.\p{Nd}+)*|[SIGNS]|[^「『“‘《<【〔(\[{SIGNS\p{Nd}]+"
).replace("SIGNS", _SIGNS)
_SPACED = rf"regexp_replace(regexp_replace(x, '([{_WHITE}])' || chr(57345) || '+', '\1', 'g'), chr(57345) || '+', ' ', 'g')"


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[{_SIGNS}{_WHITE}]+$', ''), '{_TOKENS}') AS k FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(k, lambda x: CASE WHEN regexp_full_match(x, '[{_SIGNS}]') THEN chr(57345) ELSE x END), '') AS x FROM t)
SELECT doc_id, {_sql_trim(_SPACED)} AS text FROM j"""
)
def spaced_signs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.spaced_signs(F.col("text")).alias("text"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(generate_series(0, len(k) - 1))::INT AS pos, unnest(k) AS word
  FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS k FROM conversations)),
c AS (SELECT conv_id, turn, unnest(generate_series(0, len(k) - 1))::INT AS n, unnest(k) AS letter
  FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^\\p{Latin}\\p{N}\\p{Han}\\p{Hangul}\\p{Hiragana}\\p{Katakana}]', '', 'g'), ''), lambda x: x <> '') AS k FROM conversations))
SELECT conv_id, turn, n, pos FROM c JOIN w USING (conv_id, turn) WHERE (starts_with(word, letter) OR lower(word) = lower(letter)) AND pos >= 2"""
)
def prefix_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    told = rows.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    letters = F.filter(F.split(T.recognizable(F.col("text")), ""), lambda c: c != "")
    chars = rows.select("conv_id", "turn", F.posexplode(letters).alias("n", "letter"), F.lit(2).alias("reached"))
    return matching.prefix_matches(chars, told, ["conv_id", "turn"], "letter", "word", "pos", "reached").select("conv_id", "turn", "n", "pos")


@query()
def sentence_word_times(spark, sf_dir):
    """Words of 0.3 s every 0.4 s; the sentences are those of the whole text, of which every seventh word is another one."""

    def rule(ids, places, texts):
        timed = matching.TimedWords(texts, [p * 0.4 for p in places], [p * 0.4 + 0.3 for p in places])
        sentences: dict[int, list[str]] = {}
        for k, p, w in zip(ids, places, texts, strict=True):
            sentences.setdefault(k, []).append("another" if p % 7 == 5 else w)
        times = matching.sentence_times(timed, list(sentences.values()))
        return [(k, *(t or (None, None))) for k, t in zip(sentences, times, strict=True)]

    return folds.fold(_sentences(spark, sf_dir), ["doc_id"], ["pos"], ["sentence_id", "pos", "word"], rule, "sentence_id long, start double, end double")


@query(f"WITH RECURSIVE {SENTENCES}, {_contextual('sentences', 'context')} SELECT doc_id, sentence_id, pos, piece FROM context")
def contextual_split(spark, sf_dir):
    return _places(folds.number(_sentences(spark, sf_dir), ["doc_id", "sentence_id"], ["pos"], "word", folds.contextual_breaks, "piece"))


@query(
    """WITH RECURSIVE w AS (SELECT conv_id, turn, unnest(range(len(k)))::INT AS pos, unnest(k) AS word FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS k FROM conversations)),
g AS (SELECT conv_id, turn, string_agg(word, '' ORDER BY pos) FILTER (pos BETWEEN 3 AND 6) || 'x' AS target FROM w GROUP BY ALL HAVING target IS NOT NULL),
r AS (SELECT conv_id, turn, pos // 4 AS run, min(pos) AS first, max(pos) AS last, string_agg(word, '' ORDER BY pos) AS text FROM w WHERE pos % 4 <> 3 GROUP BY ALL),
t AS (SELECT conv_id, turn, run, first, last, string_split(text, '') AS a, string_split(target, '') AS b FROM r JOIN g USING (conv_id, turn)),
d AS (SELECT *, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS row_ FROM t
  UNION ALL SELECT conv_id, turn, run, first, last, a, b, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(b) + 1), lambda y: list_max(c[1:y])))
  FROM (SELECT *, list_transform(range(1, len(b) + 1), lambda x: greatest(row_[x + 1], CASE WHEN a[i + 1] = b[x] THEN row_[x] + 1 ELSE 0 END)) AS c FROM d WHERE i < len(a)))
SELECT conv_id, turn, first, last, (len(a) + len(b) - 2 * row_[len(b) + 1])::BIGINT AS distance FROM d WHERE i = len(a)
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY distance, run) = 1"""
)
def closest_run(spark, sf_dir):
    """Words of a turn but each fourth are runs of three; the text sought is that of its fourth to seventh word and an x."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("pos", "word"))
    some = rows.where("pos between 3 and 6").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("p"))
    wanted = some.select("conv_id", "turn", F.concat(F.array_join(F.transform("p", lambda x: x["word"]), ""), F.lit("x")).alias("target"))
    return matching.closest_run(rows.where("pos % 4 <> 3"), wanted, ["conv_id", "turn"], ["pos"], "pos", "word", "target")


_LONG = "list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')))) > 70 AND len(w) > 1 AND len(path) < 5"


@query(
    f"""WITH RECURSIVE {BREAKS},
pieces AS (SELECT b.doc_id, b.sentence_id, CASE WHEN p.eff > 70 THEN comma ELSE 0 END AS piece, list(word ORDER BY b.pos) AS w, min(b.pos) AS start FROM breaks b JOIN sentences s USING (doc_id, sentence_id, pos) JOIN packed p USING (doc_id, sentence_id) GROUP BY ALL),
parts AS (SELECT doc_id, sentence_id, piece, start, []::INT[] AS path, w FROM pieces
  UNION ALL SELECT doc_id, sentence_id, piece, start, list_append(path, k), CASE WHEN k = 0 THEN w[1:(len(w) + 1) // 2] ELSE w[(len(w) + 1) // 2 + 1:len(w)] END FROM (SELECT *, unnest([0, 1]) AS k FROM parts WHERE {_LONG})),
leaves AS (SELECT *, array_to_string(w, ' ') AS text, array_to_string(w, ' ') IN ('"', '“', '”', '') AND row_number() OVER o > 1 AS alone FROM parts WHERE NOT ({_LONG}) WINDOW o AS (PARTITION BY doc_id ORDER BY sentence_id, piece, path)),
numbered AS (SELECT *, sum((NOT alone)::INT) OVER (PARTITION BY doc_id ORDER BY sentence_id, piece, path) AS k FROM leaves)
SELECT doc_id, string_agg(text, ' ' ORDER BY sentence_id, piece, path) AS text, arg_min(start, (sentence_id, piece, path)) AS start FROM numbered GROUP BY doc_id, k"""
)
def grouped_sentences(spark, sf_dir):
    """Over-long parts are cut into halves, five times at most."""
    return grouping.grouped_sentences(words(spark, sf_dir), ["doc_id"], ["pos"], "word", grouping.halves).select("doc_id", "text", "start")


@query(
    f"""WITH RECURSIVE {SENTENCES},
z AS (SELECT doc_id, sentence_id, count(*) AS n FROM sentences GROUP BY ALL),
s AS (SELECT doc_id, list(n ORDER BY sentence_id) AS n FROM z GROUP BY doc_id),
r AS (SELECT doc_id, n, 0 AS i, 0 AS take, 0::BIGINT AS batch, 0::BIGINT AS used FROM s
  UNION ALL SELECT doc_id, n, i + take, t, batch + used, CASE WHEN t = 1 THEN (n[i + take + 1] + 9) // 10 ELSE 1 END FROM (SELECT *, CASE WHEN i + take + 3 <= len(n) AND n[i+take+1] + n[i+take+2] + n[i+take+3] <= 10 THEN 3
      WHEN i + take + 2 <= len(n) AND n[i+take+1] + n[i+take+2] <= 10 THEN 2 ELSE 1 END AS t FROM r WHERE i + take < len(n))),
e AS (SELECT doc_id, n, i, take, batch, used, unnest(range(take)) AS k FROM r WHERE take > 0),
f AS (SELECT *, unnest(range(CASE WHEN take = 1 THEN used ELSE 1 END)) AS j FROM e)
SELECT doc_id, (i + k)::BIGINT AS sentence_id, (batch + j)::INT AS batch, (j * 10)::INT AS first_block, least(10, n[i + k + 1] - j * 10)::INT AS blocks FROM f"""
)
def batch_slices(spark, sf_dir):
    """A sentence's words stand for its blocks; sentences of over ten are met and cut."""
    sizes = _sentences(spark, sf_dir).groupBy("doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"))
    rule = lambda ids, n: [(ids[i], k, j, m) for i, k, j, m in folds.pack_blocks(n)]
    return folds.fold(sizes, ["doc_id"], ["sentence_id"], ["sentence_id", "n"], rule, "sentence_id long, batch int, first_block int, blocks int")


def _gapped(source: str, to: str, least: int) -> str:
    """SQL of gap_breaks over source(doc_id, sentence_id, pos, gap), with n, the number of words, and k, of the piece's."""
    return f"""{to}_list AS (SELECT doc_id, sentence_id, list(gap ORDER BY pos) AS g, count(*) AS n, min(pos) AS p0 FROM {source} GROUP BY doc_id, sentence_id),
{to}_walk AS (SELECT *, 1 AS i, 1 AS held, 0 AS piece FROM {to}_list
  UNION ALL SELECT doc_id, sentence_id, g, n, p0, i + 1, CASE WHEN cuts THEN 1 ELSE held + 1 END, CASE WHEN cuts THEN piece + 1 ELSE piece END FROM (SELECT *, g[i + 1] >= {least} AND held >= 3 AS cuts FROM {to}_walk WHERE i < n)),
{to} AS (SELECT doc_id, sentence_id, p0 + i - 1 AS pos, i, n, piece, count(*) OVER (PARTITION BY doc_id, sentence_id, piece) AS k FROM {to}_walk)"""


_PAUSE = "CASE WHEN length(word) % 11 = 0 THEN 900 WHEN length(word) % 7 = 0 THEN 500 ELSE 0 END"


@query(
    f"""WITH RECURSIVE {SENTENCES},
spaced AS (SELECT *, pos * 400 + coalesce(sum({_PAUSE}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sentences),
apart AS (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY doc_id, sentence_id ORDER BY pos) - 300, 0) AS gap FROM spaced),
{_gapped('apart', 'rough', 500)},
marks AS (SELECT doc_id, sentence_id, pos, n > 30 AS large, CASE WHEN n <= 30 THEN 0 WHEN max(piece) OVER (PARTITION BY doc_id, sentence_id) = 0 THEN (i - 1) // 50 ELSE piece END AS chunk FROM rough),
chunks AS (SELECT doc_id, sentence_id * 1000 + chunk AS sentence_id, pos, word, gap, large FROM apart JOIN marks USING (doc_id, sentence_id, pos)),
{BREAKS.removeprefix(SENTENCES + "," + chr(10)).replace("FROM sentences", "FROM chunks")},
{_contextual('chunks', 'context')},
{_gapped('chunks', 'gaps', 800)},
every AS (SELECT c.doc_id, c.sentence_id, c.pos, x.piece AS by_context, g.piece AS by_gap, b.fixed, max(x.piece) OVER w AS n_context, max(g.piece) OVER w AS n_gap, large AND min(g.k) OVER w < 3 AS unfit
  FROM chunks c JOIN context x USING (doc_id, sentence_id, pos) JOIN gaps g USING (doc_id, sentence_id, pos) JOIN breaks b USING (doc_id, sentence_id, pos) WINDOW w AS (PARTITION BY c.doc_id, c.sentence_id)),
chosen AS (SELECT doc_id, sentence_id // 1000 AS sentence_id, sentence_id AS part, pos, CASE WHEN n_context > 0 THEN by_context WHEN n_gap > 0 AND NOT unfit THEN by_gap ELSE fixed END AS piece FROM every)
SELECT doc_id, sentence_id, pos, (dense_rank() OVER (PARTITION BY doc_id, sentence_id ORDER BY part, piece) - 1)::INT AS piece FROM chosen"""
)
def smart_split(spark, sf_dir):
    """Words of 0.3 s every 0.4 s, with pauses after those of some lengths; over 30 words are split in layers."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    pause = F.when(F.char_length("word") % 11 == 0, 900).when(F.char_length("word") % 7 == 0, 500).otherwise(0)
    rows = _sentences(spark, sf_dir).withColumn("start", F.col("pos") * 400 + F.coalesce(F.sum(pause).over(w), F.lit(0))).withColumn("end", F.col("start") + 300)

    def rule(places, texts, starts, ends):
        return list(zip(places, folds.smart_breaks(texts, starts, ends, 800, 500, 30), strict=True))

    return _places(folds.fold(rows, ["doc_id", "sentence_id"], ["pos"], ["pos", "word", "start", "end"], rule, "pos int, piece int", dealt=["doc_id"]))
