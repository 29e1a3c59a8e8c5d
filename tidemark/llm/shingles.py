"""Hashed word shingles in numpy, for whole texts of any length."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(11)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z hash as a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time.
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & ((1 << 64) - 1)
    return np.multiply.accumulate(out)


POWERS, UNDO = _powers(BASE, CHUNK + 1), _powers(INVERSE, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most CHUNK bytes: a polynomial over its bytes."""
    solid = ~SPACE[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * POWERS[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * UNDO[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, A-Z as a-z."""
    if len(data) <= CHUNK:
        return _hash_words(np.frombuffer(data, np.uint8))[0]
    out, at = [], 0
    while at < len(data):
        if SPACE[data[at]]:
            at += 1
            continue
        end = min(len(data), at + CHUNK)
        while end < len(data) and end > at and not SPACE[data[end]]:
            end -= 1
        if end == at:  # one word of over CHUNK bytes
            end = at + CHUNK
            while end < len(data) and not SPACE[data[end]]:
                end += 1
            word = np.frombuffer(data[at:end].lower(), np.uint8)
            parts = [_hash_words(word[i : i + CHUNK])[0] for i in range(0, len(word), CHUNK)]
            solid = np.concatenate(parts)
            out.append(mix(np.array([np.bitwise_xor.reduce(solid * POWERS[1 : len(solid) + 1])], np.uint64)))
        else:
            out.append(_hash_words(np.frombuffer(data[at:end], np.uint8))[0])
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    total = np.full(n - width + 1, width * 0x2545F4914F6CDD1D & ((1 << 64) - 1), np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * np.uint64(PLACE[k])
    return np.unique(mix(total))


def text_sets(texts: list[str | None], size: int):
    """Shingle set of each text; short texts are hashed together."""
    group: list[bytes] = []
    held = 0

    def flush():
        data = np.frombuffer(b"\n".join(group), np.uint8)
        words, starts = _hash_words(data) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(g) + 1 for g in group)]))
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield shingle_set(words[a:b], size)
        group.clear()

    for text in texts:
        data = (text or "").encode()
        if held + len(data) + 1 > CHUNK and group:
            yield from flush()
            held = 0
        if len(data) >= CHUNK:
            yield shingle_set(word_hashes(data), size)
        else:
            group.append(data)
            held += len(data) + 1
    if group:
        yield from flush()
