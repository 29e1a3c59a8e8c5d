"""crc32 of a text's UTF-8 bytes in DuckDB SQL, which has no such function."""

from __future__ import annotations


def _table() -> list[int]:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: Code points as UTF-8 bytes.
_BYTES = """flatten(list_transform(list_transform(string_split({text}, ''), lambda ch: unicode(ch)), lambda u: CASE
  WHEN u < 128 THEN [u]
  WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)]
  WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)]
  ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END))"""
#: An expression over a text that is not empty, to be formatted with `text`.
CRC_SQL = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({_BYTES}, lambda b: b::BIGINT)), lambda c, b: xor({_table()}[1 + (xor(c, b) & 255)], c >> 8)))"
