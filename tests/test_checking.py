"""Stated cases of style checks and of the scans of samples and timed parts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import styles
from tidemark.operators import projections
from tidemark.sinks import subtitles
from tidemark.sources import captions, samples

STYLES = [
    (None, "json"),
    ("", "json"),
    ("{}", None),
    ('{"alignment": "2"}', "json"),
    ('{"alignment": 10}', "alignment"),
    ('{"spacing": -100.5}', "spacing"),
    ('{"size": 3}', "json"),
    ('{"back_color": "&h0011AAff", "override_tags": " {\\\\b1} "}', None),
    ('{"override_tags": "{}"}', None),
]


@pytest.mark.parametrize("style, fault", STYLES)
def test_first_fault_of_a_style(spark, style, fault):
    made = spark.createDataFrame([(style,)], "style string")
    assert made.select(styles.style_fault(F.col("style"), "Major")).first()[0] == fault


def test_samples_of_odd_and_empty_files(spark):
    made = spark.createDataFrame([(1, b"\x01\x00\xff\xff\x07"), (2, b""), (3, None), (4, b"\x00\x80")], "media long, content binary")
    found = samples.pcm_samples(made).orderBy("media", "at").collect()
    assert [tuple(r) for r in found] == [(1, 1, 1), (1, 2, -1), (4, 1, -32768)]


def test_parts_without_a_cue_begin_at_zero(spark):
    text = "WEBVTT\n<00:02.000>a b<00:03.500>\n\n00:05.000 --> 01:00:06.000\nplain\nc <00:05.250> <00:05.500>d\n"
    made = spark.createDataFrame([(1, text), (2, None), (3, "")], "media long, value string")
    found = captions.timed_parts(made).orderBy("num").collect()
    assert [tuple(r)[1:] for r in found] == [(0, "a b", 0, 3500), (1, "c", 5000, 5250), (2, "d", 5250, 3606000)]


SETS = [
    (None, "json"),
    ("[]", "json"),
    ("{}", None),
    ("{} x", "json"),
    ("{}, {}", "json"),
    ("{}] 1", "json"),
    ("{}} 1", "json"),
    (" {} \n", None),
    ('{"horizontal": null, "version": 0}', None),
    ('{"version": "1"}', "json"),
    ('{"tall": {}}', "json"),
    ('{"vertical": {"minor": {"size": 3}}}', "json"),
    ('{"vertical": {"minor": {"bold": 3}}}', "json"),
    ('{"vertical": {"minor": []}}', "json"),
    ('{"vertical": {"minor": {"margin_l": 2001}}, "horizontal": {"minor": {"raw_ass_style": "Style: Major"}}}', "horizontal.minor.raw_ass_style"),
    ('{"vertical": {"minor": {"margin_l": 2001}}, "horizontal": {"minor": {"bold": 3}}}', "json"),
]


@pytest.mark.parametrize("text, fault", SETS)
def test_first_fault_of_a_set(spark, text, fault):
    made = spark.createDataFrame([(text,)], "text string")
    assert made.select(styles.set_fault(F.col("text"))).first()[0] == fault


def test_defaults_are_no_fault(spark):
    for screen in styles.SCREENS:
        for role, expected in styles.ROLES.items():
            one = styles.default_set()[screen][role]
            assert spark.range(1).select(styles.style_fault(F.to_json(one), expected)).first()[0] is None


def test_files_of_styles_are_laid_over_the_defaults(spark):
    shared = '{"version": 4, "horizontal": {"minor": {"font_size": 50, "bold": false}}}'
    own = '{"version": 0, "horizontal": {"minor": {"font_size": 60, "name": ""}}}'
    rows = [(1, None, None), (2, shared, " "), (3, shared, own), (4, "", own), (5, "x", "y"), (6, None, '{"vertical": 1}')]
    found = {r.k: r for r in projections.resolved_styles(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b").collect()}
    picked = {k: (r.source, r.fault, r.styles and (r.styles.version, r.styles.horizontal.minor.font_size, r.styles.horizontal.minor.bold, r.styles.horizontal.minor.name)) for k, r in found.items()}
    assert picked == {
        1: (None, None, (1, 10, True, "Minor")),
        2: (None, None, (4, 50, False, "Minor")),
        3: (None, None, (4, 60, False, "Minor")),
        4: ("shared", "json", None),
        5: ("shared", "json", None),
        6: ("own", "json", None),
    }
    assert found[1].styles.vertical.major.margin_v == 92 and found[1].styles.vertical.minor.outline == 2.0


def test_states_of_unknown_and_failed_tasks(spark):
    tasks = spark.createDataFrame([("a", 3, None, 5), ("b", 2, "old", 100), ("c", 3, "full", 7)], "task_id string, status int, fail_reason string, pct int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "task_id string")
    found = {r.task_id: (r.error, r.pct) for r in projections.task_states(wanted, tasks, ["pct"]).collect()}
    failed, unknown = projections.FAILED_TASK, projections.UNKNOWN_TASK
    assert found == {"a": (failed, None), "b": (None, 100), "c": (failed + "full", None), "d": (unknown, None), None: (unknown, None)}


def test_samples_of_more_than_one_slice(spark):
    n = samples.SLICE + 3
    made = spark.createDataFrame([("x", bytes(range(256)) * (n // 128) + b"\x05\x00" * (n % 128))], "media string, content binary")
    found = samples.pcm_samples(made).agg(F.count("at"), F.max("at"), F.countDistinct("at"), F.max_by("value", "at")).first()
    assert tuple(found) == (n, n, n, 5)


def test_dump_of_sentences_in_order(spark):
    made = spark.createDataFrame([(1, 2, "b c", "3", "4", 2), (1, 1, "a", "1", "2", 1)], "m long, i long, t string, a string, b string, n long")
    assert subtitles.sentence_dump(made, ["m"], ["i"], "t", "a", "b", "n").first().value == (
        "Sentence 1:\nText: a\nStart: 1, End: 2\nWord count: 1\n\nSentence 2:\nText: b c\nStart: 3, End: 4\nWord count: 2\n\n"
    )
