"""Stated cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import speech, timecode
from tidemark.functions import text as T
from tidemark.operators import folds, joins, windows
from tidemark.sinks import subtitles
from tidemark.sources import captions, transcripts


def one(spark, expr, **values):
    """The value of an expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def cues(spark, *pairs):
    return spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "media string, pos int, start double, end double")


@pytest.mark.parametrize(
    ("pairs", "cap", "sizes"),
    [([(0, 0.8), (1.0, 2.2), (5.0, 6.0)], 5, [2, 1]), ([(0, 3.0), (3.2, 6.2)], 5, [1, 1]), ([(0, 0.5), (0.6, 1.1), (1.2, 1.7)], 2, [2, 1])],
)
def test_chunks(spark, pairs, cap, sizes):
    found = windows.dub_chunks(cues(spark, *pairs), ["media"], ["pos"], "start", "end", cap=cap).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in found] == sizes


def fit(spark, pairs, actual, **limits):
    rows = cues(spark, *pairs).withColumn("chunk_id", F.lit(1)).withColumn("actual", F.element_at(F.array(*map(F.lit, actual)), F.col("pos") + 1))
    return windows.fit_timeline(rows, ["media"], ["pos"], "start", "end", "actual", **limits).orderBy("pos").collect()


def test_fit_in_proportion(spark):
    a, b = fit(spark, [(10, 12), (12, 15)], [1.0, 3.0])
    assert (a.new_start, a.new_end, b.new_start, b.new_end, a.speed) == (10, 11, 11, 14, 1)


def test_fit_over_limit(spark):
    (r,) = fit(spark, [(0, 2)], [4.0], accept=1.1, high=1.25)
    assert (r.report_speed, r.speed, r.over_max, r.overflows) == (2, 1.25, True, True) and r.new_end > 2
    (r,) = fit(spark, [(0, 1)], [1.2])
    assert r.speed == pytest.approx(1.2)
    with pytest.raises(ValueError, match="speed limits"):
        fit(spark, [(0, 1)], [1.0], low=1.4, high=1.3)


def test_greedy_pack():
    assert folds.pack_by_bytes(["Every", "hour", "you", "spend", "scrolling,"], 20) == [0, 0, 0, 0, 0]


@pytest.mark.parametrize(("text", "ms"), [("00:00:04.240", 4240), ("01:02.5", 62005), ("00:00:01.8", 1008), ("nonsense", None)])
def test_vtt_time(spark, text, ms):
    assert one(spark, timecode.vtt_millis(F.col("t")), t=text) == ms


@pytest.mark.parametrize("text", ["00:60:00,000", "00:00:60,000", "00:00:00,1000", "-01:00:00,000", "00:00:00.000"])
def test_strict_time_rejects(spark, text):
    assert one(spark, timecode.strict_millis(F.col("t")), t=text) is None


def test_srt_line_pair(spark):
    for a, b, want in ((0.2, 1.45, "00:00:00,200 --> 00:00:01,450"), (2.0, 3.01, "00:00:02,000 --> 00:00:03,010"), (-1.0, 0.0, "00:00:00,000 --> 00:00:00,000")):
        assert one(spark, timecode.srt_line(timecode.srt_half_up(F.col("a")), timecode.srt_half_up(F.col("b"))), a=a, b=b) == want
    assert one(spark, timecode.srt_millis(F.col("t")), t="00:00:00,080") == 80


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("（掌声）  你好——世界 & ™ ", "你好世界"), ("COVID-19", "COVID-19"), ("e-mail", "e-mail"), ("re-enter", "re-enter"), ("（你好）", "（你好）"), ("(普通说明)", "(普通说明)")],
)
def test_clean_speech(spark, raw, clean):
    assert one(spark, T.clean_speech(F.col("t")), t=raw) == clean


def test_silence_only(spark):
    assert one(spark, T.silence_only(F.col("t")), t="（音乐）") is True
    assert one(spark, T.silence_only(F.col("t")), t="你好") is False


@pytest.mark.parametrize(("raw", "clean"), [("umbrella", "brella"), ("Um, yes", "yes"), ("hmm ok", "ok"), ("a🎵b", "ab"), ("[music] hi (soft music) &amp; you", "hi & you"), (">> go", "go")])
def test_clean_caption(spark, raw, clean):
    assert one(spark, T.clean_caption(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(("text", "length"), [("中", 1.75), ("か", 1.75), ("한", 1.5), ("ก", 1.0), ("Ａ", 1.75), ("a", 1.0)])
def test_weighted_length(spark, text, length):
    assert one(spark, T.weighted_length(F.col("t")), t=text) == length


@pytest.mark.parametrize(("colour", "ass"), [("#3366CC", "&H00CC6633"), ("#3366CC80", "&H7FCC6633")])
def test_ass_colour(spark, colour, ass):
    assert one(spark, T.ass_colour(F.col("c")), c=colour) == ass


def test_speech(spark):
    seconds = lambda t, lang: one(spark, speech.spoken_seconds(F.col("t"), F.col("l")), t=t, l=lang)
    assert seconds("你好，世界。2026", "zh_cn") > seconds("你好世界", "zh_cn")
    assert seconds("  ", "en") == 0 and seconds("x", "xx") == pytest.approx(0.2477, abs=1e-3)
    for lang in speech.PROFILES:
        assert seconds("hello 世界", lang) > 0 and one(spark, speech.confidence(F.col("l")), l=lang) >= 0.75


@pytest.mark.parametrize(("speed", "chain"), [(3.0, "atempo=2.000,atempo=1.500"), (0.25, "atempo=0.500,atempo=0.500"), (1.0, "atempo=1.000"), (0.0, None), (-1.0, None), (float("inf"), None), (float("nan"), None)])
def test_tempo(spark, speed, chain):
    assert one(spark, speech.tempo_chain(F.col("s")), s=speed) == chain


def test_calibration_clamps(spark):
    rows = spark.createDataFrame([("en", 1, 1.0, 100.0), ("de", 1, 1.0, 0.01), ("fr", 1, 1.0, 1.5), ("fr", 2, 1.0, 0.5)], "lang string, n int, e double, a double")
    found = {r.lang: r.factor for r in speech.calibrated(rows, "lang", ["n"], "e", "a").collect()}
    assert found == {"en": pytest.approx(1.15), "de": pytest.approx(0.85), "fr": pytest.approx(1.15 * 0.7 + 0.15)}


def files(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "media string, value string")


def test_srt_strict(spark):
    text = "1\r\n00:00:01,000 --> 00:00:03,500\r\n第一行\r\n第二行\r\n\r\n2\r\n00:00:04,000-->00:00:05,250\r\n最后一句"
    rows = captions.srt_cues(files(spark, "﻿" + text)).orderBy("block").collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in rows] == [(1, 1000, 3500, "第一行 第二行"), (2, 4000, 5250, "最后一句")]


@pytest.mark.parametrize("body", ["1\nno time\nx", "1\n00:00:02,000 --> 00:00:02,000\nx", "1\n00:00:02,000 --> 00:00:01,000\nx", "x\n00:00:01,000 --> 00:00:02,000\nx", "1"])
def test_srt_strict_fails(spark, body):
    assert captions.srt_cues(files(spark, body), strict=False).first().problem
    with pytest.raises(Exception, match="in block 0"):
        captions.srt_cues(files(spark, body)).collect()


def test_empty_files(spark):
    none = files(spark, "", " \n ")
    assert captions.srt_cues(none).count() == captions.caption_words(none).count() == captions.block_captions(none).count() == 0
    assert transcripts.words_from_segments(files(spark, "{}", "not json")).count() == 0


def test_rolling_captions(spark):
    vtt = """WEBVTT

00:00:01.000 --> 00:00:03.000 align:start
hello<00:00:01.500><c> there</c><00:00:02.000><c> friend</c>

00:00:03.000 --> 00:00:03.010
hello there friend

00:00:03.010 --> 00:00:05.000
hello there friend
combined.
"""
    words = captions.caption_words(files(spark, vtt)).orderBy("pos", "k").collect()
    assert [(w.word, w.start[6:], w.end[6:], w.bare) for w in words] == [("hello", "01.000", "01.500", False), ("there", "01.500", "02.000", False), ("friend", "02.000", "03.000", False), ("combined.", "03.010", "05.000", True)]
    assert captions.has_word_times(files(spark, vtt)).first().word_level is True
    blocks = captions.block_captions(files(spark, vtt))
    assert [r.text for r in blocks.orderBy("cue").collect()] == ["hello there friend", "hello there friend", "hello there friend combined."]
    (cue,) = captions.rolling_cues(blocks).collect()
    assert (cue.text, cue.start_ms, cue.end_ms) == ("hello there friend", 1000, 3010)


def test_rolling_cues_equal_a_plain_version(spark):
    rng, rows = random.Random(8), []
    for m in ("a", "b"):
        for cue in range(90):
            lines = [" ".join(rng.choice(["go", "On", "on", "then", "the", "n", "Go on then"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([1, 1, 2]))]
            rows.append((m, cue, f"00:00:{cue // 2:02d}.{cue % 2 * 500:03d}", f"00:01:{cue // 2:02d}.000", lines, rng.random() < 0.4, " ".join(lines)))
    match = lambda a, b: bool(a and b) and (a in b or b in a or (len(a.split()) > 2 < len(b.split()) and a.lower().split()[:3] == b.lower().split()[:3]))
    ms = lambda t: int(t[3:5]) * 60_000 + int(t[6:8]) * 1000 + int(t[9:])
    expected = []
    for m in ("a", "b"):
        own, best = [r for r in rows if r[0] == m], {}
        for i, (_, _, s, e, lines, timed, text) in enumerate(own):
            if not timed and len(lines) == 1:
                start = next((p[2] for p in own[:i][::-1] if match(text, p[6])), s)
                end = next((p[2] for p in own[i + 1 :] if not p[5] and p[4][0] == text), e)
                if text not in best or ms(end) - ms(start) > best[text][1] - best[text][0]:
                    best[text] = (ms(start), ms(end), i)
        cues = sorted((a, i, b, t) for t, (a, b, i) in best.items())
        for k, (a, _, b, t) in enumerate(cues):
            following = cues[k + 1][0] if k + 1 < len(cues) else b
            expected.append((m, t, a, following - 50 if b > following and following - 50 > a else b))
    frame = spark.createDataFrame(rows, "media string, cue int, start string, end string, lines array<string>, timed boolean, text string")
    assert sorted(map(tuple, captions.rolling_cues(frame).collect())) == sorted(expected)


def test_dash_words(spark):
    js = '{"language":"en","segments":[{"text":"x","words":[{"word":"a—b","start":1.0,"end":2.0},{"word":" c—d—e","start":2.0,"end":4.0}]}],"extra":1}'
    rows = transcripts.words_from_segments(files(spark, js)).orderBy("num").collect()
    assert [(r.word, r.start, r.end) for r in rows] == [("a", 1, 1.5), ("b", 1.5, 2), ("c", 2, 3), ("d", 3, 4)]
    tok = '{"result":{"language":"en"},"transcription":[{"text":"x","tokens":[{"text":"[_BEG_]","timestamps":{"from":"00:00:00,000","to":"00:00:00,000"}},{"text":" hi","timestamps":{"from":"00:00:01,500","to":"00:00:02,000"}}]}]}'
    (r,) = transcripts.words_from_tokens(files(spark, tok)).collect()
    assert (r.num, r.word, r.start, r.end) == (0, "hi", 1.5, 2.0)


def test_reply_triples(spark):
    rows = captions.reply_triples(files(spark, "1\n[一]\n[one]\n\n2\n[无文本]\n[two]")).orderBy("n").collect()
    assert [(r.n, r.target, r.origin) for r in rows] == [(1, "一", "one"), (2, "", "two")]


def test_silence_before_chunk(spark):
    rows = windows.silences(cues(spark, (0, 3), (7, 8)), ["media"], ["pos"], "start", "end").orderBy("pos", "part").collect()
    assert [(r.piece, r.seconds) for r in rows] == [("chunk", 3), ("silence", 4), ("chunk", 1)]


def test_split_points(spark):
    points = lambda d: [r.point for r in windows.split_points(spark.createDataFrame([("m", float(d))], "media string, d double"), "d").orderBy("k").collect()]
    assert points(301) == [0, 301] and points(620) == [0, 300, 600, 620] and points(600) == [0, 300, 600] and points(5) == [0, 5]


def test_split_points_move_to_quiet_places(spark):
    rng, rate, window = random.Random(4), 10, 15
    lengths = {"a": 6300, "b": 3000, "c": 3120, "d": 50, "e": 3019, "f": 6009}
    media = {m: [rng.randint(-9, 9) for _ in range(n)] for m, n in lengths.items()}
    for i in range(3040, 3070):
        media["c"][i] = 0  # quiet after the grid point: the tail is 12 s from the grid, under 10 s from there

    def plain(v):
        end, n = len(v) / rate, max(1, math.ceil(len(v) / rate / 300))
        points = [300.0 * k for k in range(n)]
        for k in range(1, n):
            heard, best = v[(300 * k - 8) * rate : (300 * k + 8) * rate], (math.inf, 0)
            for i in range(window + 1, len(heard) + 1):
                energy = sum(x * x for x in heard[i - window : i])
                best = (energy, i - window // 2) if energy <= best[0] else best
            points[k] = 300 * k - 8 + best[1] / rate
        return [*(points[:-1] if n > 1 and end - points[-1] < 10 else points), end]

    frame = spark.createDataFrame([(m, len(v) / rate) for m, v in media.items()], "media string, d double")
    samples = spark.createDataFrame([(m, i + 1, x) for m, v in media.items() for i, x in enumerate(v)], "media string, i long, v long")
    rows = windows.quiet_split_points(frame, samples, ["media"], "d", "i", "v", 300.0, rate, window).orderBy("media", "k").collect()
    for m, v in media.items():
        assert [r.k for r in rows if r.media == m] == list(range(len(plain(v)))) and [r.point for r in rows if r.media == m] == pytest.approx(plain(v))
    assert len(plain(media["c"])) == 2


def test_quietest_is_latest(spark):
    flat = spark.createDataFrame([("m", i, 5) for i in range(1, 41)], "media string, i long, v long")
    assert windows.quietest_point(flat, ["media"], "i", "v", 8).first().point == 40 - 4


def test_lone_quotes(spark):
    rows = spark.createDataFrame([("m", 0, "He said", 0, 1), ("m", 1, '"', 1, 2), ("m", 2, "Next", 2, 3)], "media string, pos int, text string, start int, end int")
    found = windows.merge_lone_quotes(rows, ["media"], ["pos"], "text", "start", "end").orderBy("sentence_no").collect()
    assert [(r.text, r.end) for r in found] == [('He said "', "2"), ("Next", "3")]


def test_sequence_match(spark):
    said = [["Go", "on,", "then"], ["Well,", "go", "on", "then"], ["go", "on", "then"]]
    words = [("m", s, i, w, 10.0 * s + i, 10.0 * s + i + 0.9) for s, ws in enumerate(said) for i, w in enumerate(ws)]
    words += [("n", 0, 0, "go", 0.0, 1.0)]
    blocks = [("m", 1, ["go", "ON"], 9.2, 12.0), ("m", 2, ["'Then.'"], None, None), ("m", 3, ["go", "on", "then"], 20.4, 23.0), ("m", 4, ["go", "on"], 5.0, 6.0), ("m", 5, [], 0.0, 1.0), ("m", 6, ["go", "on"], 10.0, 10.2), ("k", 7, ["go"], None, None)]
    found = joins.sequence_matches(spark.createDataFrame(blocks, "media string, id int, wanted array<string>, start double, end double"), spark.createDataFrame(words, "media string, sentence int, pos int, word string, start double, end double"), ["media"], "id", "wanted", "sentence", "pos", "word")
    rows = {r.id: (r.found_in, r.first, r.last, r.first_time, r.last_time) for r in found.collect()}
    none = (None,) * 5
    assert rows == {1: (1, 1, 2, 11, 12.9), 2: (0, 2, 2, 2, 2.9), 3: (2, 0, 2, 20, 22.9), 4: none, 5: none, 6: none, 7: none}


def test_first_word_at_or_after(spark):
    tokens = spark.createDataFrame([("m", 0, "Go", 2), ("m", 1, "stop", 9)], "media string, k int, text string, t int")
    words = spark.createDataFrame([("m", "go", 1, 10), ("m", "GO", 2, 11), ("m", "go", 3, 12), ("m", "stop", 4, 13)], "media string, text string, t int, num int")
    found = {r.k: r.word_num for r in joins.first_at_or_after(tokens, words, ["media"], "text", "t", "num").collect()}
    assert found == {0: 11, 1: None}


def test_srt_modes(spark):
    rows = spark.createDataFrame([("m", 1, 0, 1000, "one", "eins"), ("m", 2, 1000, 2000, "two", None), ("m", 3, 2000, 3000, "", "")], "media string, idx int, start_ms int, end_ms int, origin string, target string")
    value = lambda mode: subtitles.srt(rows, ["media"], ["idx"], mode).first().value
    assert value("target-first").startswith("1\n00:00:00,000 --> 00:00:01,000\neins\none\n\n2\n")
    assert "\neins\n\n2" in value("target-only") and value("target-only").endswith("two\n\n") and "eins" not in value("origin-only")
    (d,) = subtitles.dub_srt(rows.where("idx = 1").withColumn("idx", F.lit(0)).withColumn("s", F.lit(0.2)), ["media"], ["s"], "s", "s", "origin", "idx").collect()
    assert d.value.startswith("1\n00:00:00,200")
