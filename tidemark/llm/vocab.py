"""Vocabulary files and per-worker encoders with bounded caches.

Each Python worker loads a vocabulary once. A text whose characters all lie in SAFE (printable ASCII, line feeds and
Latin-1 letters) is cut into pre-tokens by the vocabulary's own pattern, written for these: over these characters every regex engine and
every Unicode version cuts alike, so the ids of a pre-token can be cached. Any other text, and any text with a special
string, goes whole to the library.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SAFE = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
#: The letters among SAFE, and the vocabularies' patterns written for SAFE texts alone.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
CACHED_PIECES = 600_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PieceCache(dict):
    """piece -> value by `make`; starts anew beyond `most` pieces, so that memory is bounded."""

    def __init__(self, make: Callable[[str], object], most: int = CACHED_PIECES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


def plain(text: str, path: str) -> bool:
    """Whether the pre-tokens of a text may be encoded one by one."""
    return SAFE.fullmatch(text) is not None and not any(s in text for s in special_strings(path))


@functools.cache
def byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write a byte: printable ones stand for themselves, the rest follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


@functools.cache
def _byte_encoder(path: str):
    tok = library(path)
    merge, letters = tok.model.tokenize, byte_letters()

    def ids_of(piece: str) -> bytes:  # a pre-token needs the library's merges alone
        ids = [token.id for token in merge(piece.encode().decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    return tok, BYTE_PIECES.findall, PieceCache(ids_of)


def encode_bytes(text: str, path: str) -> bytes:
    """Ids of a whole text by a byte-level vocabulary, as little-endian unsigned 32-bit integers."""
    tok, cut, cache = _byte_encoder(path)
    if plain(text, path):
        return b"".join(map(cache.__getitem__, cut(text)))
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def _word_counter(path: str):
    tok = library(path)
    cache = PieceCache(lambda p: len(tok.encode(p, add_special_tokens=False).ids))
    return WORD_PIECES.findall, cache


def count_words(text: str, path: str) -> int:
    """Token count of a plain text by the lower-casing word vocabulary."""
    cut, cache = _word_counter(path)
    return sum(map(cache.__getitem__, cut(text.lower())))


def forget() -> None:
    """Give back the memory of encoders that an earlier stage has left in this worker."""
    for kept in (_byte_encoder, _word_counter, library, special_strings):
        kept.cache_clear()


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def rows_of(batch: pa.RecordBatch, *names: str):
    """Tuples of Python values, one per row."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
