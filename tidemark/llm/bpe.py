"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merging one pre-token keeps its symbols in a doubly linked list. Each rank that some adjacent pair has owns a bucket of
list positions; a bitmap of two levels marks the ranks that own one: words of 256 ranks, and above them a word with one
bit for each. Find-first-set from the top level down picks the lowest rank. Its bucket is taken in text order, and an
entry is skipped as stale if its position has been merged away or its pair has another rank by now. A merge costs a
constant number of word operations, so a pre-token of n bytes takes O(n) steps after its set-up, whatever its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocab

OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


#: Pre-tokens whose ids a worker keeps (about 200 bytes each).
CACHED = 1_000_000
#: Bits of a bitmap word as a power of two.
WORD = 8
MASK = (1 << WORD) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair first, leftmost among equals, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair_rank: list[int] = [-1] * n
    buckets: dict[int, list[int]] = {}  # rank -> positions of the pairs that had it when they were put there
    top, low = 0, {}  # which words have bits; the words
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair_rank[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> WORD
                low[word] = low.get(word, 0) | 1 << (rank & MASK)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << WORD | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        low[word] = bits
        if not bits:
            top &= top - 1
        bucket = buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        for i in bucket:
            if pair_rank[i] != rank:  # merged away, or its pair has changed
                continue
            j = after[i]
            k = after[j]
            merged = parts[i] = parts[i] + parts[j]
            parts[j] = None
            pair_rank[j] = pair_rank[i] = -1
            after[i] = k
            h = before[i]
            if k < n:
                before[k] = i
            for at, pair in ((i, merged + parts[k] if k < n else b""), (h, parts[h] + merged if h >= 0 else b"")):
                if not pair:
                    continue
                new = get(pair)
                if new is None:
                    pair_rank[at] = -1
                elif new != pair_rank[at]:
                    pair_rank[at] = new
                    if new in buckets:
                        buckets[new].append(at)
                    else:
                        buckets[new] = [at]
                        word = new >> WORD
                        low[word] = low.get(word, 0) | 1 << (new & MASK)
                        top |= 1 << word
    return [ranks[p] for p in parts if p is not None]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.safe = pattern == vocab.byte_pattern()
        self.cache = vocab.PieceCache(lambda p: np.array(merge(p.encode(), ranks), "<u4").tobytes(), CACHED)
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cut = vocab.BYTE_PIECES.findall if self.safe and vocab.SAFE.fullmatch(text) else self.cut
        return b"".join(map(self.cache.__getitem__, cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def coder(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe(read_ranks(f.read()), pattern)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: bool = False) -> DataFrame:
    """Encode every text, decode the ids, and return counts and digests; with `keep`, ids and decoded text as well.

    A null text counts as empty: no ids, and the digest of no bytes. Null doc_ids, ties, repeated rows and empty
    tables need no care: each row gives one row. Other columns are ignored. Ids with surrogates cannot occur in a
    Spark string.
    """
    path = path or vocab.default_path("byte_bpe_50k.tiktoken")
    pattern = pattern or vocab.byte_pattern()
    schema = OUT
    if keep:
        schema = schema.append(pa.field("ids", pa.list_(pa.int64()))).append(pa.field("decoded", pa.binary()))

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            out = []
            for doc, text in vocab.rows_of(batch, "doc_id", "text"):
                ids = bpe.encode(text or "")
                back = bpe.decode(ids)
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                out.append((*row, np.frombuffer(ids, "<u4").tolist(), back) if keep else row)
            yield vocab.batch_of(schema, out)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * keep
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
