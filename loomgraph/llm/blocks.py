"""What the vector operators share: valid vectors, query sets in blocks of bounded size, running lists of the best partners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that the vectors of one block of queries hold, about: 8 MB of doubles are broadcast.
BLOCK_NUMBERS = 1 << 20


def finite(vec: Column) -> Column:
    """True for a vector that isn't null and has no null or non-finite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, components one after the other) of an Arrow column of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.diff(column.offsets.to_numpy()), flat


def by_length(lengths: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)]


def in_blocks(queries: DataFrame, key: str, numbers: int) -> Iterator[DataFrame]:
    """The query rows in blocks of about BLOCK_NUMBERS / numbers rows, by a hash of their key.

    A block is what is broadcast at once; `numbers` is how many a row holds at most.
    """
    n = queries.count()
    blocks = max(1, -(-n * max(1, numbers) // BLOCK_NUMBERS))
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries


class Best:
    """The k best (score, id) of each of n rows seen so far: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int, kind: type = np.int64):
        self.n, self.k = n, k
        self.held = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.full = np.zeros(n, bool)
        self.least = np.zeros(n, kind)

    def may_enter(self, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where scores (a line for each of these rows) could be among the k best of their row."""
        return ~self.full[rows, None] | (scores >= self.least[rows, None])

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(row):
            self.new.append((row, score, ids))
            self.waiting += len(row)
        if self.waiting > max(1 << 15, self.n * self.k):
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of the best so far."""
        if self.new:
            row, score, ids = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
            order = np.lexsort((ids, -score, row))
            row, score, ids = row[order], score[order], ids[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(self.n))[row]
            keep, last = place < self.k, place == self.k - 1
            self.full[row[last]], self.least[row[last]] = True, score[last]
            self.held, self.new, self.waiting = (row[keep], score[keep], ids[keep]), [], 0
        return self.held
