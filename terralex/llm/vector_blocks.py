"""Vectors of Arrow batches as matrices, and the best entries of many groups gathered block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a batch that meet the resident block at once, at first and at most.
FIRST_ROWS, MOST_ROWS = 32, 512
WAITING = 1 << 20


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix in double precision) of the lists of each length."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), at, flat[starts[at][:, None] + np.arange(dims)].astype(np.float64)


def key_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the keys change; rows must come sorted by them."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((cols[1:] != cols[:-1]).any(1)), [len(cols)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield tuple(cols[lo].tolist()), b.slice(lo, hi - lo)


def steps(n: int) -> Iterator[slice]:
    """Slices over n rows, short ones first: by the long ones the limits of ``Best`` are known."""
    at, size = 0, FIRST_ROWS
    while at < n:
        yield slice(at, at + size)
        at, size = at + size, min(2 * size, MOST_ROWS)


class Best:
    """The k best entries of every group, higher scores first, then smaller ids.

    Entries below a group's k-th are turned away at once; the others wait until there are many, then
    one sort settles all groups. Memory is k entries a group and a fixed number waiting.
    """

    def __init__(self, groups: int, k: int, dtype: type):
        lowest = -np.inf if dtype is np.float64 else np.iinfo(dtype).min
        self.k = k
        self.score = np.full((groups, k), lowest, dtype)
        self.id = np.full((groups, k), np.iinfo(np.int64).max)
        self.tag = np.full((groups, k), -1, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    @property
    def limit(self) -> np.ndarray:
        """Each group's k-th score so far."""
        return self.score[:, -1]

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, tags: np.ndarray | None = None) -> None:
        last = self.limit[group]
        fits = (score > last) | ((score == last) & (ids < self.id[group, -1]))
        if fits.any():
            self.parts.append((group[fits], score[fits], ids[fits], np.zeros(int(fits.sum()), np.int64) if tags is None else tags[fits]))
            self.waiting += len(self.parts[-1][0])
            if self.waiting > min(WAITING, 4 * self.score.size):
                self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        touched = np.unique(np.concatenate([p[0] for p in self.parts]))
        held = (np.repeat(touched, self.k), self.score[touched].ravel(), self.id[touched].ravel(), self.tag[touched].ravel())
        group, score, ids, tags = (np.concatenate(c) for c in zip(held, *self.parts))
        # Scores fall while ids rise; ~ turns integers around without overflow.
        order = np.lexsort((tags, ids, -score if score.dtype == np.float64 else ~score, group))
        group = group[order]
        first = np.concatenate([[0], 1 + np.flatnonzero(group[1:] != group[:-1])])
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))
        keep = rank < self.k
        at, place = group[keep], rank[keep]
        self.score[at, place], self.id[at, place], self.tag[at, place] = score[order][keep], ids[order][keep], tags[order][keep]
        self.parts, self.waiting = [], 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, id, tag) of all entries."""
        self.settle()
        group, place = np.nonzero(self.tag >= 0)
        return group, self.score[group, place], self.id[group, place], self.tag[group, place]
