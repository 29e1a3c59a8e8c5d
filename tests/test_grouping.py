"""Stated cases of the contextual split, recursive splits, closest runs, files of a segment, batches and progress."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import folds, grouping, matching, splitting, windows
from tidemark.sinks import subtitles
from tidemark.sources import captions


def test_contextual_breaks():
    cut = lambda text, **k: folds.contextual_breaks(text.split(), **k)
    assert cut("we all went home early however nobody was there yet") == [0] * 5 + [1] * 5
    assert cut("too short however") == [0, 0, 0]
    assert cut("the cat is here and the dog went away too") == [0] * 4 + [1] * 6
    assert cut("the old cat is here again and the dog went away too") == [0] * 6 + [1] * 6
    assert cut("the old grey cat sleeps again and the dog went away too") == [0] * 12  # no verb is held
    assert cut("the old cat is here again and the dog went away too", limit=19) == [0] * 12  # what remains is too long
    assert cut("the old cat is here again with all of its friends who came by", limit=20) == [0] * 11 + [1] * 3
    assert cut("we all went home early however nobody finally") == [0] * 5 + [1] * 3
    assert cut("") == []


def test_distance_counts_a_replacement_twice():
    rng = random.Random(6)
    assert matching.indel_distance("kitten", "sitting") == 5 and matching.indel_distance("", "ab") == 2 and matching.indel_distance("", "") == 0
    for _ in range(200):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (0 if x == y else 2)))
            row = new
        assert matching.indel_distance(a, b) == row[-1]


def test_closest_run(spark):
    words = spark.createDataFrame([("m", 1, "ab"), ("m", 2, "c"), ("m", 5, "ab"), ("m", 6, "c"), ("m", 9, "x"), ("n", 1, None)], "media string, num int, text string")
    wanted = spark.createDataFrame([("m", "abd"), ("n", "q"), ("k", "z"), ("n2", None)], "media string, target string")
    found = {r.media: (r.first, r.last, r.distance) for r in matching.closest_run(words, wanted, ["media"], ["num"], "num", "text", "target").collect()}
    assert found == {"m": (1, 2, 2), "n": (1, 1, 1)}


def test_recursive_split(spark):
    text = " ".join(f"word{i}" for i in range(13))
    rows = spark.createDataFrame([(1, text), (2, "short"), (3, "x" * 200), (4, ""), (5, None)], "id int, text string")
    found = grouping.split_recursively(rows, "text", grouping.halves, 20).orderBy("id", "path").collect()
    assert " ".join(r.text for r in found if r.id == 1) == text and max(len(r.text.split()) for r in found if r.id == 1) <= 4
    assert [(r.text, r.path) for r in found if r.id > 1] == [("short", []), ("x" * 200, []), ("", []), (None, [])]
    once = grouping.split_recursively(rows, "text", grouping.halves, 20, depth=1)
    assert once.where("id = 1").count() == 2


def test_files_of_a_segment(spark):
    blocks = spark.createDataFrame([("m", 3, 0, 2000, "o3", "t3"), ("m", 4, 2000, 4000, "o4", None)], "media string, idx int, start_ms long, end_ms long, origin string, target string")
    shorts = spark.createDataFrame([("m", 3, 1, 1000, 2000, "b"), ("m", 3, 0, 0, 1000, "a"), ("m", 4, 0, 2000, 3000, "c")], "media string, idx int, part int, start_ms long, end_ms long, origin string")
    found = {r.file: r.value for r in subtitles.segment_files(blocks, shorts, ["media"]).collect()}
    numbers = lambda v: [int(x) for x in re.findall(r"^([0-9]+)\n[0-9:,]+ -->", v, re.M)]
    assert numbers(found["bilingual"]) == [3, 4] and numbers(found["mixed"]) == [1, 2, 3, 4, 5] and numbers(found["short"]) == [1, 2, 3]
    assert found["short"].startswith("1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n") and "t3\no3\n\n" in found["bilingual"]
    below = {r.file: r.value for r in subtitles.segment_files(blocks, shorts, ["media"], target_first=False).collect()}
    assert "o3\nt3\n\n" in below["bilingual"]


def test_oversize_sentences_are_cut_into_batches():
    assert folds.pack_blocks([3, 3, 3, 25, 4, 7]) == [(0, 0, 0, 3), (1, 0, 0, 3), (2, 0, 0, 3), (3, 1, 0, 10), (3, 2, 10, 10), (3, 3, 20, 5), (4, 4, 0, 4), (5, 5, 0, 7)]
    assert folds.pack_blocks([]) == []


def test_progress(spark):
    steps = [("m", i, s) for i, s in enumerate(["split", "split", "transcribe", "other", "translate", "transcribe", "translate"])]
    rows = spark.createDataFrame(steps, "media string, at int, step string").withColumn("segments", F.lit(2))
    found = [r.percent for r in windows.progress(rows, ["media"], ["at"], "step", "segments").orderBy("at").collect()]
    assert found == [18, 22, 37, 37, 56, 71, 90]


def test_country_endings():
    split = lambda t, **k: splitting.split_text(t, patterns=splitting.kept_patterns(**k))
    assert split("This is the end.we go on") == ["This is the end.", "we go on"]
    assert split("See example.fr today.") == ["See example.fr today."]
    assert split("See example.fr today.", endings=["uk"]) == ["See example.", "fr today."]
    assert split("See example.com today.", endings=[]) == ["See example.com today."]


def test_task_names(spark):
    cases = {
        "https://x.org/watch?t=3&v=abcDEF": "abcDEF", "https://x.org/watch?v=&t=1": "task", "https://x.org/video/BV1 xx/?p=1": "BV1xx", "local:/data/some very long file name.mp4": "someverylongfile",
        " https://x.org ": "https:__x_org", "https://x.org/": "task", "": "task", None: "task", "https://x.org/a.b/con": "_con", "x?u=v=1": "x",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "address string, name string")
    assert [r for r in rows.withColumn("found", T.task_name(F.col("address"))).collect() if r.found != r.name] == []


def test_first_caption_file_of_a_folder(spark):
    files = [("f/b.vtt", "2"), ("f/a.VTT", "1"), ("f/0.srt", "x"), ("g/h/z.vtt", "3"), ("e/x.txt", "y")]
    found = captions.first_caption_files(spark.createDataFrame(files, "media string, value string"))
    assert sorted(map(tuple, found.collect())) == [("f", "f/a.VTT", "1"), ("g/h", "g/h/z.vtt", "3")]


def test_smart_breaks():
    words = [f"w{i}" for i in range(12)]
    starts = [i + (2.0 if i >= 5 else 0.0) for i in range(12)]
    assert folds.smart_breaks(words, starts, [s + 0.9 for s in starts]) == [0] * 5 + [1] * 7
    steady = [float(i) for i in range(12)]
    assert folds.smart_breaks(words, steady, [s + 0.9 for s in steady]) == folds.fixed_length(words)
    assert folds.smart_breaks([], [], []) == []
    many = [f"w{i}" for i in range(230)]
    found = folds.smart_breaks(many, [float(i) for i in range(230)], [i + 0.9 for i in range(230)])
    assert found == sorted(found) and found[49] != found[50] and found[199] != found[200] and len(found) == 230


def test_scratch_folder_without_a_setting():
    from types import SimpleNamespace

    from tidemark import session

    unset = SimpleNamespace(get=lambda *_: None)
    made = lambda master, app: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master, applicationId=app))
    one, other = session.shared_dir(made("local[4]", "app-1")), session.shared_dir(made("local[4]", "app-2"))
    assert one != other and one == session.shared_dir(made("local[4]", "app-1")) and one.startswith("file:///")
    try:
        session.shared_dir(made("spark://x", "app-3"))
    except ValueError:
        return
    raise AssertionError("a cluster without a shared folder was taken")
