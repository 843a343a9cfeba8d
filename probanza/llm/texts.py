"""Helpers that several operators share: bounded text blocks, bounded caches, written tables, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probanza.session import written

#: Bytes of text that a task turns into arrays at a time; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Entries of one generation of a worker's cache; it holds two generations at most.
CACHE_ENTRIES = 1 << 19


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, in order."""
    texts = batch.column(column)
    sizes = np.array(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Cache(dict):
    """A map from text pieces to values that ``make`` derives on a miss.

    Two generations bound it: when the young one is full it becomes the old one, and pieces that
    are still in use move up again. ``fixed`` entries always stay.
    """

    def __init__(self, make: Callable, fixed: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__(fixed or {})
        self.make, self.fixed, self.entries, self.old = make, fixed or {}, entries, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) - len(self.fixed) >= self.entries:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[piece] = value
        return value


def checked_broadcast(df: DataFrame, limit_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast where a narrow, written table has at most ``limit_rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= limit_rows else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder: cuts lineage and survives lost executors."""
    return written(df, f"llm-{label}")
