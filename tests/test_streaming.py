"""The ordered stream of segments against the batch fold, with files in two orders and a stop in between."""

import random

import pytest

from tidemark.streaming import segments as S


def made():
    rng, rows = random.Random(3), []
    for media in (1, 2, 3):
        at = 0.0
        for segment in range(6):
            words = [rng.choice(["go", "on", "then", "well,", "stop"]) for _ in range(rng.randint(0, 9))]
            starts = [at + 0.5 * i for i in range(len(words))]
            cut = rng.randint(0, len(words))
            rows.append((media, segment, [" ".join(words[:cut]), "nowhere x", " ".join(words[cut:])] if words else [], words, starts, [s + 0.4 for s in starts]))
            at += 0.5 * len(words)
    return rows


def put(spark, folder, rows):
    for row in rows:
        spark.createDataFrame([row], S.SEGMENT).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_stream_equals_batch_and_goes_on(spark, tmp_path, order):
    rows = made()
    batch = sorted(map(tuple, S.align_segments(spark.createDataFrame(rows, S.SEGMENT)).collect()))
    assert batch and any(b > a for *_, a, b in batch)
    fed = [r for r in rows if r[1] % 2 == 0] + [r for r in rows if r[1] % 2] if order == "forward" else rows[::-1]
    source, state, sink = (str(tmp_path / n) for n in ("in", "state", "out"))
    half = len(fed) // 2
    put(spark, source, fed[:half])
    S.run_files(spark, source, state, sink, 3)
    some = sorted(map(tuple, spark.read.schema(S.TIMES).parquet(sink).collect()))
    assert len(some) < len(batch) and set(some) <= set(batch)
    put(spark, source, fed[half:] + fed[:2])  # two of them come again
    S.run_files(spark, source, state, sink, 3)
    assert sorted(map(tuple, spark.read.schema(S.TIMES).parquet(sink).collect())) == batch


def test_streamed_query_equals_the_fold(spark):
    from tidemark.plans import captioning

    data = "/root/testdata/sf0.001"
    batch = S.align_segments(captioning._segments(spark, data)).select("media", "segment", "sentence", "start", "end")
    found = captioning.streamed_alignment(spark, data)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
