"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a common
boundary inside their overlap: a white-space position where both encodings end one token and begin the next, with the
same tokens on both sides of it. The vocabulary drops white space and no token or special string spans it, so such a
boundary is stable: what stands before it cannot change what follows. Without one, the overlap is widened; a stretch
without any white space is in the end encoded whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vocab

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _spans(text: str, start: int, end: int, path: str) -> list[tuple[int, int, int]]:
    e = vocab.library(path).encode(text[start:end], add_special_tokens=False)
    return [(a + start, b + start, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


def splice(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], text: str, low: int, high: int, agree: int = 2):
    """(tokens kept of left, first token kept of right) at a stable common boundary in (low, high), or None.

    Both sides must hold the same tokens from the boundary to the end of the overlap less one token, at least
    `agree` of them or else all that the overlap has, and the gap before the boundary must hold white space.
    """
    ends = {}
    for k, (a, b, i) in enumerate(left):
        if a > low and a < high:
            ends.setdefault(a, k)
    for j, (a, _, _) in enumerate(right):
        k = ends.get(a)
        if k is None or text[a - 1] not in " \t\n\r":
            continue
        same = 0
        while k + same < len(left) and j + same < len(right) and left[k + same] == right[j + same] and left[k + same][1] < high:
            same += 1
        if same >= agree:
            return k, j
    return None


def count_huge(text: str, path: str, chunk: int = 16_384, overlap: int = 256) -> int:
    """Token count of one text, encoded chunk by chunk; equal to the count of the whole text."""
    if len(text) <= chunk + overlap:
        return len(vocab.library(path).encode(text, add_special_tokens=False).ids)
    start, total = 0, 0
    end = min(len(text), chunk)
    left, first = _spans(text, start, end, path), 0
    while end < len(text):
        wide, joined = overlap, None
        while joined is None and end - wide > start:
            begin = end - wide
            right_end = min(len(text), begin + chunk + wide)
            right = _spans(text, begin, right_end, path)
            joined = splice(left, right, text, begin, end)
            wide *= 4
        if joined is None:  # no stable boundary in the whole chunk: encode it longer
            end = min(len(text), end + 2 * (end - start))
            left = _spans(text, start, end, path)
            first = next((k for k, t in enumerate(left) if t[0] >= resume), len(left)) if start else 0
            continue
        kept, first_right = joined
        total += kept - first
        resume = right[first_right][0]
        start, end, left, first = begin, right_end, right, first_right
    return total + len(left) - first


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id, repeated rows and ties stay as they are; an empty
    table gives no rows. Other columns are ignored, whatever their names. Texts longer than `chunk` characters are
    counted in overlapping chunks, so that memory does not grow with more than the text itself.
    """
    path = path or vocab.default_path("word_bpe_49k.json")

    def count(batches):
        for batch in batches:
            out = []
            for doc, text in vocab.rows_of(batch, "doc_id", "text"):
                text = text or ""
                if len(text) > chunk:
                    n = count_huge(text, path, chunk, overlap)
                elif vocab.plain(text, path):
                    n = vocab.count_words(text, path)
                else:
                    n = len(vocab.library(path).encode(text, add_special_tokens=False).ids)
                out.append((doc, len(text.encode()), n, n > limit))
            yield vocab.batch_of(OUT, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
