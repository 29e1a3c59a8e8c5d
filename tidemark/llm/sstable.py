"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier: blocks of prefix-compressed entries, a sparse index
with the last key of each block, a Bloom filter over the keys, properties, and a fixed footer:

    block      entries of (shared, unshared, value length as varints; key suffix; value), restarts every 16 entries
    index      last key, offset and length of each block
    bloom      10 bits a key, 7 probes by double hashing
    properties documents and ids in the shard
    footer     offsets and lengths of index, bloom and properties, then a magic number

A key is one byte (0: null identifier) and the identifier as a big-endian integer with its sign bit flipped, so that
byte order is number order. A value is the document's ids as little-endian unsigned integers of 16 bits where all ids
allow it, else of 32 bits; the lowest bit of the value length's varint says which (1: 32 bits).
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import vocab
from tidemark.session import materialize, scratch_path

MAGIC = b"TMSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES, RESTART, BITS_A_KEY, PROBES = 64 << 10, 16, 10, 7
MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard; entries come in ascending key order, equal keys after each other."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.block, self.index, self.keys = bytearray(), [], []
        self.last, self.in_block, self.n_ids = b"", 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.last:
            raise ValueError(f"key out of order: {doc_id}")
        shared = len(os.path.commonprefix((self.last, key))) if self.in_block % RESTART else 0
        wide = np.frombuffer(ids, "<u4")
        value = ids if len(wide) and wide.max() > 0xFFFF else wide.astype("<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value) << 1 | (value is ids)) + key[shared:] + value
        self.last, self.in_block, self.n_ids = key, self.in_block + 1, self.n_ids + len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        where = (self.at, len(data))
        self.sink.write(data)
        self.at += len(data)
        return where

    def _end_block(self) -> None:
        if self.in_block:
            self.index.append((self.last, *self._put(bytes(self.block))))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._end_block()
        bits = max(64, BITS_A_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = self._put(b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index))
        bloom_at = self._put(struct.pack("<Q", bits) + bytes(bloom))
        props = self._put(struct.pack("<QQ", len(self.keys), self.n_ids))
        self._put(FOOTER.pack(*index, *bloom_at, *props, MAGIC))
        return len(self.keys), self.n_ids


class ShardReader:
    """Reads a shard block by block; `get` looks one identifier up."""

    def __init__(self, source):
        self.source = source
        self.end = source.size()
        foot = self._at(self.end - FOOTER.size, FOOTER.size)
        *places, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        index = self._at(places[0], places[1])
        self.index = [(index[i : i + 9], *struct.unpack_from("<QQ", index, i + 9)) for i in range(0, len(index), 25)]
        bloom = self._at(places[2], places[3])
        (self.bits,), self.bloom = struct.unpack_from("<Q", bloom), bloom[8:]
        self.n_docs, self.n_ids = struct.unpack("<QQ", self._at(places[4], places[5]))

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    @staticmethod
    def entries(block: bytes):
        at, key = 0, b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            unshared, at = _read_varint(block, at)
            length, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + unshared]
            at += unshared
            value = block[at : at + (length >> 1)]
            yield key, value if length & 1 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            at += length >> 1

    def __iter__(self):
        """(identifier, ids) of all documents in key order."""
        for _, offset, length in self.index:
            for key, ids in self.entries(self._at(offset, length)):
                yield doc_of(key), ids

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of each row with this identifier: Bloom filter, then binary search over the sparse index."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for _, offset, length in self.index[bisect.bisect_left(self.index, key, key=lambda e: e[0]) :]:
            for k, ids in self.entries(self._at(offset, length)):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def open_shard(path: str) -> ShardReader:
    system, where = fs.FileSystem.from_uri(path)
    return ShardReader(system.open_input_file(where))


def write_shards(docs: DataFrame, directory: str, path: str | None = None, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text), append `end_id` to each and write shards; returns shard, path, n_docs, n_ids.

    Documents are dealt out by ranges of doc_id and sorted within each, so that shards in order of their number hold
    ascending identifiers (nulls first; equal identifiers in order of their text). Each attempt of a task writes its
    own file and renames it when whole, so lost executors leave no broken shard. An empty range writes no shard.
    """
    path = path or vocab.default_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = struct.pack("<I", end_id)

    def write(batches):
        shard, writer, sink = TaskContext.get().partitionId(), None, None
        system, where = fs.FileSystem.from_uri(directory)
        part, final = f"{where}/.{shard}-{uuid.uuid4().hex}", f"{where}/shard-{shard:06d}.sst"
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(where, recursive=True)
                sink = system.open_output_stream(part)
                writer = ShardWriter(sink)
            for doc, text in vocab.rows_of(batch, "doc_id", "text"):
                writer.add(doc, vocab.encode_bytes(text or "", path) + tail)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            system.move(part, final)
            yield vocab.batch_of(MANIFEST, [(shard, f"{directory}/shard-{shard:06d}.sst", n_docs, n_ids)])

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(count, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, "shard long, path string, n_docs long, n_ids long")
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards of a manifest.

    The ids before a shard are a running sum over the manifest, which has one row per shard.
    """
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.select("shard", before.alias("base"))

    def read(batches):
        for batch in batches:
            for shard, where in vocab.rows_of(batch, "shard", "path"):
                rows, start = [], 0
                for doc, ids in open_shard(where):
                    rows.append((doc, shard, start, len(ids) // 4, vocab.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 4096:
                        yield vocab.batch_of(READ, rows)
                        rows = []
                yield vocab.batch_of(READ, rows)

    count = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("shard", "path").repartitionByRange(count, "shard").mapInArrow(read, "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, directory: str | None = None, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write shards and read every document back: doc_id, start, n_tokens, ids_crc32.

    A null text is a document with the end id alone. Null and repeated doc_ids keep all their rows. An empty table
    writes no shard and gives no rows. Other columns are ignored. The broadcast side has one row per shard.
    """
    directory = directory or scratch_path(docs.sparkSession, "shards")
    manifest = materialize(write_shards(docs, directory, path, end_id), "manifest")
    return read_shards(manifest)
