"""Hard negatives by a vertical scan: dimensions are read one by one, and bounds on the rest rule rows out.

**Vectors.** A component x becomes floor(SCALE * x); a score is the whole-number inner product with
an anchor. Rows stand in blocks of up to ``BLOCK_ROWS``: a column per dimension with its least and
largest value, and the ids and labels. Each block goes to one place, followed by all anchors in
groups of ``GROUP``; anchors are a stated query set and the scan holds one block at a time.

**Scan.** For an anchor, a block's dimensions are read in descending magnitude of the anchor's
components. After each ``STEP`` dimensions a candidate's score lies between its partial score plus the
least and plus the largest that the other dimensions can still add, by their extremes in the block.
The candidate bitmap keeps the rows that can still be within a wanted window of scores, less those that
``k`` rows surely within it outrank. What is left at the last dimension has its exact score.

**Two passes.** The first looks for the best ``k`` rows of an anchor's label (one window without
bounds); the second for the best ``k`` rows of other labels within the window of each positive:
``low`` % to 100 % of its score. A block hands over at most ``k`` rows a window; Spark ranks those.

Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Ties go to the
smaller id. A positive with a negative score has no window.

Rows with a null id, label or vector, a null or non-finite component, or a component of ``LIMIT`` or
more in magnitude (whose scores a long might not hold) take no part; where a vector is shorter than
another the missing components count as 0. Rows that repeat an id are rows of their own: a repeated
anchor gives its lines once for each row, and its copy is among its positives. Other columns are
ignored; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probanza.llm.texts import checked_broadcast, stored

SCALE = 256
LIMIT = float(1 << 17)
BLOCK_ROWS = 16_384
GROUP = 64
STEP = 8

_BLOCK = "made long, n long, dims long, columns binary, ids binary, labels binary"
_FOUND = "block long, row long, slot int, id long, score long"
_ANCHOR = "block long, row long, chunk long, id long, label long, query binary, windows array<struct<low:long,high:long>>"


@dataclass
class Block:
    """Rows as columns: ``columns[d]`` holds dimension d of all rows."""

    columns: np.ndarray
    ids: np.ndarray
    labels: np.ndarray

    def __post_init__(self):
        self.least, self.most = (f(axis=1, initial=0) for f in (self.columns.min, self.columns.max))


def vertical_scan(block: Block, query: np.ndarray, candidates: np.ndarray, windows: list[tuple[int, int]], k: int, step: int = STEP) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores its first ``k`` candidates (largest score, then smallest id): rows and scores.

    ``candidates`` is a bitmap of rows; the scan clears those that it rules out.
    """
    dims = min(len(query), len(block.columns))
    order = np.argsort(-np.abs(query[:dims]), kind="stable")
    order = order[query[order] != 0]
    ends = query[order] * block.least[order], query[order] * block.most[order]
    rest_low, rest_high = (np.append(np.cumsum(pick(*ends)[::-1])[::-1], 0) for pick in (np.minimum, np.maximum))
    rows = np.flatnonzero(candidates)
    score = np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(order), step):
        part = order[at : at + step]
        for d in part.tolist():
            score += query[d] * block.columns[d, rows]
        done = at + len(part)
        low, high = score + rest_low[done], score + rest_high[done]
        able = np.zeros(len(rows), dtype=bool)
        for least, most in windows:
            inside = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                inside &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            able |= inside
        if not able.all():
            candidates[rows[~able]] = False
            rows, score = rows[able], score[able]
        if not len(rows):
            break
    found = []
    for least, most in windows:
        own = np.flatnonzero((score >= least) & (score <= most))
        own = own[np.lexsort((block.ids[rows[own]], -score[own]))[:k]]
        found.append((rows[own], score[own]))
    return found


def _whole(column: pa.Array) -> list[np.ndarray]:
    """Each vector's components as whole numbers."""
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    whole = np.floor(SCALE * values.astype(np.float64)).astype(np.int64)
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, non-finite or too large."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)))


def vector_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vector) as blocks, numbered from 0 by ``block``."""

    def run(batches):
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block():
            nonlocal made, held
            dims = max(len(v) for _, _, v in held)
            columns = np.zeros((dims, len(held)), dtype=np.int64)
            for i, (_, _, v) in enumerate(held):
                columns[: len(v), i] = v
            small = columns.astype("<i2" if np.abs(columns).max(initial=0) < 1 << 15 else "<i4")
            row = {
                "made": made, "n": len(held), "dims": dims, "columns": small.tobytes(),
                "ids": np.array([h[0] for h in held], "<i8").tobytes(), "labels": np.array([h[1] for h in held], "<i8").tobytes(),
            }
            made, held = made + 1, []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for one in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), _whole(batch.column("vector")), strict=True):
                held.append(one)
                if len(held) == BLOCK_ROWS:
                    yield block()
        if held:
            yield block()

    made = stored(rows.select("id", "label", "vector").mapInArrow(run, _BLOCK), "vector-blocks")
    number = (F.row_number().over(Window.orderBy("made")) - 1).cast("long")  # a row per block, without its vectors
    return made.join(checked_broadcast(stored(made.select("made", number.alias("block")), "block-numbers")), "made").drop("made")


_BLOCK_SCHEMA = pa.schema([(n, pa.binary() if kind == "binary" else pa.int64()) for n, kind in (c.split() for c in _BLOCK.split(", "))])


def _read_block(row: dict) -> Block:
    width = len(row["columns"]) // max(1, row["dims"] * row["n"])
    columns = np.frombuffer(row["columns"], dtype="<i2" if width == 2 else "<i4").reshape(row["dims"], row["n"])
    return Block(columns.astype(np.int64), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"))


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``, with one window that holds all scores."""
    all_scores = [{"low": -(1 << 62), "high": 1 << 62}]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _read_block(row)
                out = [
                    {"block": row["block"], "row": i, "chunk": k // GROUP, "id": int(block.ids[i]), "label": int(block.labels[i]),
                     "query": block.columns[:, i].astype("<i8").tobytes(), "windows": all_scores}
                    for k, i in enumerate(np.flatnonzero(block.ids % every == 0).tolist())
                ]
                yield from (pa.RecordBatch.from_pylist(out[a : a + 1024], schema=_ANCHOR_SCHEMA) for a in range(0, len(out), 1024))

    return blocks.mapInArrow(run, _ANCHOR)


_ANCHOR_SCHEMA = pa.schema([
    ("block", pa.int64()), ("row", pa.int64()), ("chunk", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("query", pa.binary()),
    ("windows", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
])
_FOUND_SCHEMA = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def scan(blocks: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """block, row (of the anchor), slot (of its window), id, score: the first ``k`` of each window in each block."""
    n_blocks = blocks.count()
    grouped = anchors.groupBy(F.col("block").alias("_block"), "chunk").agg(
        F.collect_list(F.struct("block", "row", "label", "query", "windows")).alias("anchors")  # at most GROUP rows
    )
    to_all = grouped.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_blocks - 1)).cast("long"))).alias("at"), "anchors")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("dims", "long"), ("columns", "binary"), ("ids", "binary"), ("labels", "binary"))]
    place = blocks.select(F.col("block").alias("at"), F.lit(None).cast(grouped.schema["anchors"].dataType).alias("anchors"), "n", "dims", "columns", "ids", "labels")
    dealt = place.unionByName(to_all.select("at", "anchors", *nothing)).repartition("at").sortWithinPartitions("at", F.col("n").desc_nulls_last())

    def run(batches):
        at = block = None
        for batch in batches:
            out: list[dict] = []
            for row in _rows(batch):
                if row["n"] is not None:
                    at, block = row["at"], _read_block(row)
                    continue
                for anchor in row["anchors"]:
                    candidates = (block.labels == anchor["label"]) == same_label
                    if anchor["block"] == at:
                        candidates[anchor["row"]] = False
                    windows = [(w["low"], w["high"]) for w in anchor["windows"]]
                    found = vertical_scan(block, np.frombuffer(anchor["query"], "<i8"), candidates, windows, k)
                    out += [
                        {"block": anchor["block"], "row": anchor["row"], "slot": slot, "id": i, "score": s}
                        for slot, (rows, scores) in enumerate(found)
                        for i, s in zip(block.ids[rows].tolist(), scores.tolist(), strict=True)
                    ]
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND_SCHEMA)

    return dealt.mapInArrow(run, _FOUND)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, so that only one block of a batch is held as Python values."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("block", "row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, k: int = 5, low: int = 80) -> DataFrame:
    """Hard negatives of all anchors (ids divisible by ``every``) among ``rows`` (id, label, vector)."""
    valid = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    blocks = stored(vector_blocks(valid), "numbered-blocks")
    anchors = stored(anchors_of(blocks, every), "anchors")
    positives = stored(_first(scan(blocks, anchors, True, k), k), "positives")
    # The window is low * positive <= 100 * negative <= 100 * positive; a negative score leaves it empty.
    lowest = F.call_function("div", F.col("score") * low + 99, F.lit(100)).alias("low")
    windows = positives.filter("score >= 0").groupBy("block", "row").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", lowest, F.col("score").alias("high")))), lambda w: F.struct(w["low"], w["high"])
        ).alias("windows")
    )
    second = anchors.drop("windows").join(windows, ["block", "row"])
    negatives = _first(scan(blocks, stored(second, "windows"), False, k), k)
    positive = positives.select("block", "row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = negatives.join(positive, ["block", "row", "slot"]).join(anchors.select("block", "row", F.col("id").alias("anchor_id")), ["block", "row"])
    return named.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings``; a seventh of the labels are moved to the next of ten first."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings.select(vec_id.alias("id"), moved.alias("label"), F.col("embedding").alias("vector")))
