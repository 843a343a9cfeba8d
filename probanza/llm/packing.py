"""Hierarchical packing of token sequences into windows of several lengths.

Every task packs the documents of its own split as they come, a group of ``GROUP_TOKENS`` tokens
at a time, so no token is shuffled and memory is bounded by a group and the longest document. The
tiers are the powers of two from ``window`` down. A document gives as many full windows as it has;
its rest is routed to the smallest tier that holds it. From the longest tier down, each rest opens
a window, whose gap is filled with the longest shorter rest that fits, again and again; the last
gap is closed by cutting a rest, whose remainder is routed anew. What fills no window goes on to
the next group; at the end of a split it is cut at its binary digits into shorter windows. So
every sequence is a window of some tier and nothing is padded.

Sequences of a group are dealt to step groups of about ``STEP_TOKENS`` tokens, longest first and
each to the step with the fewest tokens, so steps carry nearly equal work.

A piece is (document, start, length) with its ids. Null text is empty: its document has the end id
alone. Repeated rows and null ids are documents like any other; other columns are ignored; an
empty table gives no rows. Sequence and step numbers hold the split's number in their upper bits.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probanza.llm.encode import encoder
from probanza.llm.texts import blocks

WINDOW = 4096
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 32 * WINDOW

_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, "
    "step_id long, ids binary"
)

Piece = tuple[int, int, int]  # length, document, start


def pack(rests: list[Piece], window: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows made of ``rests`` (none above ``window``), and what is left for the next group."""
    pool, windows = sorted(rests), []
    while pool:
        open_ = [pool.pop()]  # the longest: tiers come in falling order
        size = 1 << (open_[0][0] - 1).bit_length()
        gap = size - open_[0][0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:  # all are longer than the gap: cut the longest
                length, doc, start = pool.pop()
                piece = (gap, doc, start)
                insort(pool, (length - gap, doc, start + gap))
            open_.append(piece)
            gap -= piece[0]
        if not gap:
            windows.append(open_)
        elif not last:
            return windows, open_
        else:
            windows += _binary(open_, size - gap)
    return windows, []


def _binary(pieces: list[Piece], total: int) -> list[list[Piece]]:
    """The pieces, in order, cut into windows of the powers of two that add up to ``total``."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        window = []
        while need:
            length, doc, start = left.pop()
            take = min(length, need)
            window.append((take, doc, start))
            if take < length:
                left.append((length - take, doc, start + take))
            need -= take
        if window:
            out.append(window)
    return out


def steps_of(sizes: list[int], step_tokens: int) -> list[int]:
    """A step for every sequence: longest first, each to the step with the fewest tokens."""
    heap = [(0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, k = heapq.heappop(heap)
        out[i] = k
        heapq.heappush(heap, (tokens + sizes[i], k))
    return out


class Packer:
    """Packs a stream of documents; holds one group of them at most."""

    def __init__(self, part: int, window: int = WINDOW, group: int = GROUP_TOKENS, step: int = STEP_TOKENS):
        self.window, self.group, self.step = window, group, step
        self.sequences = self.steps = part << 32
        self.docs: dict[int, tuple[object, bytes]] = {}
        self.whole: list[Piece] = []
        self.rests: list[Piece] = []
        self.next_doc = self.tokens = 0

    def add(self, doc_id: object, ids: bytes) -> None:
        n, key = len(ids) // 4, self.next_doc
        self.docs[key], self.next_doc = (doc_id, ids), key + 1
        full = n // self.window
        self.whole += [(self.window, key, k * self.window) for k in range(full)]
        if n % self.window:
            self.rests.append((n % self.window, key, full * self.window))
        self.tokens += n

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        windows, left = pack(self.rests, self.window, last)
        sequences = [[p] for p in self.whole] + windows
        sizes = [sum(p[0] for p in s) for s in sequences]
        steps = steps_of(sizes, self.step)
        rows: list[tuple] = []
        for sequence, size, step in zip(sequences, sizes, steps, strict=True):
            offset = 0
            for length, doc, start in sequence:
                doc_id, ids = self.docs[doc]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, len(ids) // 4, self.sequences, offset, size, self.steps + step, part))
                offset += length
            self.sequences += 1
        self.steps += max(steps, default=-1) + 1
        self.docs = {d: self.docs[d] for _, d, _ in left}
        self.whole, self.rests, self.tokens = [], left, 0
        if rows:
            *numbers, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())],
                names=[c.split()[0] for c in _PIECES.split(", ")],
            )


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece, with its ids and its place in a sequence; see the module for the method."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        worker, packer = encoder(tokenizer_path), Packer(TaskContext.get().partitionId(), window)
        for batch in batches:
            for block in blocks(batch):
                for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, worker.ids32(text) + end)
                    if packer.tokens >= packer.group:
                        yield from packer.flush(last=False)
        yield from packer.flush(last=True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def packing_report(pieces: DataFrame) -> DataFrame:
    """The packed rows with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length", "step_id",
    )
