"""Segments of media aligned in the order of their numbers, whatever order they come in.

A medium is transcribed in numbered segments that finish in any order. The times of a segment's sentences depend on the
time that the segments before it have reached. As a stream, the state of a medium holds the next number, the time
reached and the segments that came too early; a segment is given out once all before it are. The state is keyed by
medium and kept in RocksDB, so that a query goes on from its checkpoint after a stop or a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import folds
from tidemark.session import WRITING, drop_path, materialize, scratch_path

#: A segment: its medium, its number from 0, its sentences, and its words with their times in columns of equal length.
SEGMENT = "media long, segment long, sentences array<string>, words array<string>, starts array<double>, ends array<double>"
TIMES = "media long, segment long, sentence long, start double, end double"
#: The state is kept by RocksDB; a batch's shuffle files go once it is done, as the checkpoint stands in for them.
STORE = WRITING | {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: About so many batches stream a table, each of which has its share of it in shuffle files.
BATCHES = 8


def _times(sentences, words, starts, ends, last: float) -> tuple[list[tuple[float, float]], float]:
    timed = [(w, float(a), float(b)) for w, a, b in zip(words, starts, ends, strict=True)]
    return folds.align_from([str(s) for s in sentences], timed, last)


class InOrder(StatefulProcessor):
    """Gives out the sentences of a medium's segments in order; one that comes a second time is passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "segment long, last double")
        content = "sentences array<string>, words array<string>, starts array<double>, ends array<double>"
        self.early = handle.getMapState("early", "segment long", content)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, last = self.reached.get() if self.reached.exists() else (0, 0.0)
        came: dict[int, tuple] = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.segment >= at:
                    came.setdefault(int(r.segment), (r.sentences, r.words, r.starts, r.ends))
        out, begun = [], at
        while True:
            if at in came:
                content = came.pop(at)
                stored = self.early.containsKey((at,)) and self.early.getValue((at,))
                content = stored or content
            elif self.early.containsKey((at,)):
                content = self.early.getValue((at,))
            else:
                break
            self.early.removeKey((at,))
            times, last = _times(*content, last)
            out += [(key[0], at, k, a, b) for k, (a, b) in enumerate(times)]
            at += 1
        for number, content in came.items():
            if not self.early.containsKey((number,)):
                self.early.updateValue((number,), tuple(list(x) for x in content))
        if at != begun:
            self.reached.update((at, last))
        yield pd.DataFrame(out, columns=["media", "segment", "sentence", "start", "end"]).astype({"media": "int64", "segment": "int64", "sentence": "int64", "start": "float64", "end": "float64"})


def align_stream(segments: DataFrame) -> DataFrame:
    """media, segment, sentence, start, end of a stream of segments (SEGMENT), each given once, in order by medium.

    Segments that are missing hold back those after them. A segment without sentences has no rows but lets the next one
    go on; a null list counts as empty only where the caller has made it so. The session's state store must be RocksDB.
    """
    return segments.groupBy("media").transformWithStateInPandas(InOrder(), T.StructType.fromDDL(TIMES), "append", "none")


def align_segments(segments: DataFrame) -> DataFrame:
    """The same for a table of segments: media, segment, sentence, start, end. Numbers must run from 0 without gaps."""

    def rule(numbers, sentences, words, starts, ends):
        out, last = [], 0.0
        for number, *content in zip(numbers, sentences, words, starts, ends, strict=True):
            times, last = _times(*content, last)
            out += [(number, k, a, b) for k, (a, b) in enumerate(times)]
        return out

    columns = ["segment", "sentences", "words", "starts", "ends"]
    return folds.fold(segments, ["media"], ["segment"], columns, rule, "segment long, sentence long, start double, end double")


def run_files(spark: SparkSession, source: str, checkpoint: str, sink: str, files_a_trigger: int = 4) -> None:
    """Stream the segment files at source to sink until none is left, and stop; a later call goes on with new files."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files_a_trigger).parquet(source)
        query = align_stream(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_table(segments: DataFrame, parts: int = 2) -> DataFrame:
    """align_stream over a table: it is written to the shared folder and streamed from there, a few files at a time.

    Segments are written in `parts` by a hash of their number, so that those of a medium come in any order. They are
    picked in the tasks that made them, as dealing them out by file would put all of them on disk once more.
    """
    spark = segments.sparkSession
    source, state, sink = (scratch_path(spark, name) for name in ("segments", "segment-state", "segment-times"))
    part, files = F.pmod(F.xxhash64("segment"), F.lit(parts)), 0
    for k in range(parts):
        files += len(materialize(segments.where(part == k), "segments", keep=f"{source}/{k}", compression="zstd").inputFiles())
    run_files(spark, f"{source}/*", state, sink, max(4, files // BATCHES))
    for path in (source, state):  # all segments are given out: nothing goes on from here
        drop_path(spark, path)
    return spark.read.schema(TIMES).parquet(sink)
