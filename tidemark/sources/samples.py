"""Decoded audio as tables: one row per file in, one row per sample out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as K

#: Samples in a batch that a file gives at a time.
SLICE = 1 << 18


def pcm_samples(files: DataFrame) -> DataFrame:
    """media, at, value: the signed 16-bit little-endian samples of files(media, content), counted from 1.

    An odd last byte is no sample. Null and empty contents give no rows. A task holds the bytes of the files of one
    batch and SLICE samples of one of them.
    """
    rows = files.select("media", "content")
    kind = K.StructType([rows.schema["media"], K.StructField("at", K.IntegerType()), K.StructField("value", K.IntegerType())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                content = batch.column(1)[row].as_buffer()
                if content is None or content.size < 2:
                    continue
                values = np.frombuffer(content, "<i2", count=content.size // 2)
                for low in range(0, len(values), SLICE):
                    part = values[low : low + SLICE].astype(np.int32)
                    media = batch.column(0).take(pa.array(np.full(len(part), row)))
                    at = np.arange(low + 1, low + 1 + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([media, pa.array(at), pa.array(part)], names=kind.names)

    return rows.mapInArrow(run, kind)
