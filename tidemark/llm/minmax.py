"""Near-duplicate removal by min-max hashing.

A text's set holds its distinct word shingles. Under each of PERMUTATIONS random permutations of the 64-bit hashes both
the least and the greatest value of a set are kept, so that a signature of 2 * PERMUTATIONS values costs half the hash
evaluations of a plain one. Two sets of similarity J agree on the least value with probability J, and so on the
greatest; the share of agreeing values is an unbiased estimate of J (`likeness`), of lower variance than that of as many
independent values, since the two of one permutation seldom fail together.

The minima are cut into bands of ROWS values of different permutations, and so are the maxima. Sets that agree on a band
are candidates. At the threshold of 0.8 a band of five agrees with probability 0.33, and none of forty does with
probability 1.3e-7; above the threshold it is less. Candidates are decided on the full sets, by the leaders and the
comparison of blocks in which components meet that `parity_join` describes: no block gives all pairs of its members, a
hot band gets leaders within each task, and no link between two candidates' components is lost.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import parity_join, shingles

#: Permutations; each gives a minimum and a maximum.
PERMUTATIONS = 100
#: Values in a band.
ROWS = 5
#: Shingles permuted at a time.
CHUNK = 1024
#: Sets of 4-word shingles with a similarity of at least 0.8 link.
RULE = parity_join.Rule(words=4, num=80, den=100)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each permutation, as columns."""
    rng = np.random.default_rng(12)
    factor, mask = rng.integers(0, 1 << 64, (2, PERMUTATIONS, 1), dtype=np.uint64)
    return factor | np.uint64(1), mask


def signature(items: np.ndarray) -> np.ndarray:
    """The minima and then the maxima of a set's hashes under all permutations; the set must not be empty."""
    factor, mask = _permutations()
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(items), CHUNK):
        moved = (items[None, at : at + CHUNK] ^ mask) * factor
        np.minimum(low, moved.min(1), out=low)
        np.maximum(high, moved.max(1), out=high)
    return np.concatenate([low, high])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the similarity of two sets from their signatures."""
    return float((a == b).mean())


def band_keys(items: np.ndarray, rule: parity_join.Rule = RULE) -> np.ndarray:
    """Keys of the bands of a set: minima and maxima lie in bands of their own."""
    bands = signature(items).reshape(-1, ROWS)
    key = shingles.mix(np.arange(1, len(bands) + 1, dtype=np.uint64))
    for values in bands.T:
        key = shingles.mix(key ^ values) + values
    return shingles.mix(key)


def groups(docs: DataFrame, rule: parity_join.Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Kept is the row of least doc_id of each component. A null, empty or blank text has an empty set, links with nothing
    and stays. Rows that repeat a doc_id are rows of their own; a null doc_id takes part and stays only where its
    component has no other. An empty table gives no rows; other columns are ignored.
    """
    found = parity_join.join_documents(docs, rule, band_keys)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rule: parity_join.Rule = RULE) -> DataFrame:
    """The documents without near copies, with all their columns; see parity_join.keep_one."""
    return parity_join.keep_one(docs, rule, band_keys)
