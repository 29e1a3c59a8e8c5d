"""Order-preserving packing by dynamic programming over window cuts.

Documents follow each other in ascending doc_id. Possible cuts are the ends of documents, the ends of sentences and,
in a sentence of over LONG_SENTENCE ids, every LONG_SENTENCE-th id. A window between two cuts costs its padding plus a
truncation penalty for the cut at its end (none at the end of a document). With position p and d(j) the least cost up
to cut j,

    d(j) = penalty(j) + limit - p(j) + min over i with p(j) - p(i) <= limit of (d(i) + p(i)),

and that minimum over a sliding window is kept in a monotone queue. A window whose length is a power of two is not
padded; the few cuts i at such a distance are tried beside the queue.
"""

from __future__ import annotations

import functools
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocab

OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
LONG_SENTENCE = 256
SENTENCE_PENALTY, FORCED_PENALTY = 3.0, 12.0
#: Documents of so many ids are packed at a time; the last windows are left open for the next documents.
SEGMENT_IDS = 400_000


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, limit: int = 2048) -> list[int]:
    """Indexes of the chosen cuts, first and last included; positions ascend by steps of at most `limit` from 0."""
    n = len(positions)
    p = positions.tolist()
    pen = penalties.tolist()
    exact: dict[int, list[int]] = {}  # cuts at a power of two before a cut
    length = 1
    while length < limit:
        at = np.searchsorted(positions, positions - length)
        for j in np.flatnonzero(positions[np.minimum(at, n - 1)] == positions - length).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        length *= 2
    cost, parent = [0.0] * n, [0] * n
    queue = deque([(0.0, 0)])  # d(i) + p(i), ascending, with i
    for j in range(1, n):
        low = p[j] - limit
        while p[queue[0][1]] < low:
            queue.popleft()
        least, best = queue[0]
        least += limit - p[j]
        for i in exact.get(j, ()):
            if cost[i] <= least:
                least, best = cost[i], i
        cost[j], parent[j] = least + pen[j], best
        value = cost[j] + p[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = parent[j]
        cuts.append(j)
    return cuts[::-1]


@functools.cache
def ending_tokens(path: str) -> np.ndarray:
    """By id, whether the token's text ends with a full stop, question or exclamation mark, or holds a line feed."""
    known = vocab.library(path).get_vocab()
    out = np.zeros(max(known.values()) + 2, bool)
    for token, i in known.items():
        out[i] = token.endswith((".", "!", "?")) or "Ċ" in token
    return out


class Packer:
    """Packs documents as they come; `rows` yields pieces of closed windows."""

    def __init__(self, limit: int, ends: np.ndarray, base: int):
        self.limit, self.ends, self.sequence = limit, ends, base
        self.docs: deque[tuple] = deque()  # doc_id, ids, ids before the open part
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Possible cuts over the open parts of the held documents, with their penalties."""
        parts = [ids[gone:] for _, ids, gone in self.docs]
        whole = np.concatenate(parts)
        cut = self.ends[whole]
        doc_ends = np.cumsum([len(p) for p in parts])
        cut[doc_ends - 1] = True
        places = np.flatnonzero(cut) + 1
        penalties = np.full(len(places), SENTENCE_PENALTY)
        penalties[np.searchsorted(places, doc_ends)] = 0
        gaps = np.diff(places, prepend=0)
        long = gaps > LONG_SENTENCE
        if long.any():
            more = np.concatenate([np.arange(e - g + LONG_SENTENCE, e, LONG_SENTENCE) for e, g in zip(places[long], gaps[long], strict=True)])
            places, penalties = np.concatenate([places, more]), np.concatenate([penalties, np.full(len(more), FORCED_PENALTY)])
            order = np.argsort(places, kind="stable")
            places, penalties = places[order], penalties[order]
        return np.concatenate([[0], places]), np.concatenate([[0.0], penalties])

    def rows(self, last: bool):
        if not self.held:
            return
        places, penalties = self._cuts()
        cuts = choose_cuts(places, penalties, self.limit)
        windows = [(int(places[a]), int(places[b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        if not last:  # the last windows may end better with what follows
            windows = windows[: max(0, len(windows) - 8)]
        at = 0  # where the first held document's open part begins
        for begin, end in windows:
            offset = 0
            while begin + offset < end:
                doc_id, ids, gone = self.docs[0]
                take = min(len(ids) - gone, end - begin - offset)
                yield doc_id, gone, take, vocab.crc32(ids[gone : gone + take].tobytes()), len(ids), self.sequence, offset
                offset += take
                if gone + take == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, ids, gone + take)
            self.sequence += 1
            at = end
        self.held -= at


def pack(docs: DataFrame, path: str | None = None, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are dealt out by ranges of doc_id; each range is packed in order by one task, holding at most
    SEGMENT_IDS ids besides the document at hand, and its sequence numbers begin at its range number times 2^32.
    A null text is a document with the end id alone. Null doc_ids come first; repeated rows are packed each. An empty
    table gives no rows; other columns are ignored.
    """
    path = path or vocab.default_path("byte_bpe_50k.json")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        packer = Packer(limit, ending_tokens(path), TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, text in vocab.rows_of(batch, "doc_id", "text"):
                packer.add(doc, np.frombuffer(vocab.encode_bytes(text or "", path) + tail, "<u4"))
                if packer.held > SEGMENT_IDS:
                    yield vocab.batch_of(OUT, list(packer.rows(False)))
        yield vocab.batch_of(OUT, list(packer.rows(True)))

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(count, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
