"""Token ids as binary files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

**Ids.** Each whole text (null: empty) is encoded by the tokenizers library without added special
tokens; an end id follows. Ids are counted over all documents, and an id is written as its rank by
count (ties: smaller id first), so that frequent ids take one byte.

**File.** ``data-*.tvb`` holds a stream per document in ascending ``doc_id`` (nulls last; equal
ids by length and content). A stream of n ranks has ceil(n / 4) control bytes (two bits a rank, the lowest
first: its number of data bytes less one; unused places are 0), then the data bytes, each rank's
low byte first. The reader looks up each control byte in a table of four lengths and gathers all
ranks of a stream at once.

**Tables.** ``blocks`` (one row for about ``BLOCK_BYTES`` of streams: file, offset, size, ids
before it in the file, and each document's id, length and bytes) and ``ranks`` (rank to id) are
Parquet. A task writes its file under a name of its own and hands over its block rows; Spark
commits those, so a file of a task that was lost or repeated is never read. Files are written and
read by path through ``pyarrow.fs`` (local, HDFS, S3, GCS); input is read by Spark.

Repeated rows are written once each; an empty table gives no files and no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probanza.llm.encode import encoder
from probanza.llm.texts import blocks
from probanza.session import scratch_path

#: Bytes of one block; a longer stream is a block of its own.
BLOCK_BYTES = 1 << 19

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """A stream (control bytes, then data bytes) for each of the lists of ranks that lie one behind the other."""
    size = np.zeros(len(ranks), dtype=np.uint8)  # data bytes less one
    for k in range(1, 4):
        size += ranks >> np.uint32(8 * k) > 0
    quads = -(-lengths // 4)
    ends, control_ends = np.cumsum(lengths), np.cumsum(quads)
    padded = np.zeros(4 * int(quads.sum()), dtype=np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(4 * (control_ends - quads) - (ends - lengths), lengths)] = size
    control = (padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6).tobytes()
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) <= size[:, None]].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(size + np.int64(1))])[ends]
    out, c0, d0 = [], 0, 0
    for c1, d1 in zip(control_ends.tolist(), data_ends.tolist(), strict=True):
        out.append(control[c0:c1] + data[d0:d1])
        c0, d0 = c1, d1
    return out


def decode_ranks(payload: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranks of all streams (``sizes`` in bytes, ``lengths`` in ranks) that lie one behind the other."""
    quads = -(-lengths // 4)
    begins, control_begins = np.cumsum(sizes) - sizes, np.cumsum(quads) - quads
    at = np.arange(int(quads.sum())) + np.repeat(begins - control_begins, quads)
    length = _LENGTHS[payload[at]].reshape(-1)
    ends = np.cumsum(lengths)
    used = np.arange(int(lengths.sum())) + np.repeat(4 * control_begins - (ends - lengths), lengths)
    is_data = np.ones(len(payload), dtype=bool)
    is_data[at] = False
    out = np.zeros((len(used), 4), dtype=np.uint8)
    out[np.arange(4, dtype=np.uint8) < length[used][:, None]] = payload[is_data]
    return out.view("<u4").reshape(-1)


def _open(folder: str):
    """The file system and path of a folder given as a URI or a local path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (little-endian, in the encoder's width) of every whole text, with the end id."""

    def run(batches):
        worker = encoder(tokenizer_path)
        end = np.array([end_id], dtype=worker.dtype).tobytes()
        for batch in batches:
            for block in blocks(batch):
                ids = [worker.ids(t) + end for t in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array([len(i) // len(end) for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n", "ids"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def _joined(ids: pa.Array, dtype: str) -> np.ndarray:
    """The ids of all documents of a batch, one behind the other, without a copy."""
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset :][: len(ids) + 1]
    return np.frombuffer(ids.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(dtype)


def rank_table(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, rank) by count over all documents; one row per task and id is shuffled, one per id is kept."""

    def tally(batches):
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = batch.column("ids")
            if len(ids):
                one = np.bincount(_joined(ids, dtype))
                if len(one) > len(counts):
                    one[: len(counts)] += counts
                    counts = one
                else:
                    counts[: len(one)] += one
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    total = ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = total.orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    rows = [(r["id"], k) for k, r in enumerate(order)]
    return ids.sparkSession.createDataFrame(rows, "id long, rank long")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encode all documents and write files and tables below ``folder``."""
    spark = docs.sparkSession
    staged = f"{folder}/staged"
    encoded(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(staged)
    ids = spark.read.parquet(staged)
    dtype = encoder(tokenizer_path).dtype
    rank_table(ids, dtype).write.parquet(f"{folder}/ranks")
    found = _ids_by_rank(spark, folder)
    rank_of = np.zeros(int(found.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[found] = np.arange(len(found), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        place, path = _open(folder)
        name, sink = f"data-{part:06d}-{uuid.uuid4().hex}.tvb", None
        at = before = 0
        held: list[tuple] = []
        size = 0

        def block():
            nonlocal at, before, held, size
            sink.write(b"".join(c for _, _, c in held))
            doc_ids, lengths, coded = zip(*held, strict=True)
            row = {
                "part": part, "file": name, "offset": at, "size": size, "before": before, "n_ids": sum(lengths),
                "doc_ids": doc_ids, "lengths": lengths, "sizes": [len(c) for c in coded],
            }
            at, before, held, size = at + size, before + row["n_ids"], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for some in blocks(batch, "ids", BLOCK_BYTES):
                lengths = some.column("n").to_numpy()
                coded = encode_ranks(table.value[_joined(some.column("ids"), dtype)], lengths)
                if sink is None:
                    place.create_dir(path, recursive=True)
                    sink = place.open_output_stream(f"{path}/{name}")
                for doc_id, n, stream in zip(some.column("doc_id").to_pylist(), lengths.tolist(), coded, strict=True):
                    if held and size + len(stream) > BLOCK_BYTES:
                        yield block()
                    held.append((doc_id, n, stream))
                    size += len(stream)
        if held:
            yield block()
        if sink is not None:
            sink.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("doc_id").asc_nulls_last()
    ordered = ids.repartitionByRange(parts, first, "n").sortWithinPartitions(first, "n", F.xxhash64("ids"))
    ordered.select("doc_id", "n", "ids").mapInArrow(write, _BLOCKS).write.parquet(f"{folder}/blocks")


_BLOCKS = (
    "part long, file string, offset long, size long, before long, n_ids long, "
    "doc_ids array<long>, lengths array<long>, sizes array<long>"
)
_BLOCK_SCHEMA = pa.schema([
    (name, pa.string() if kind == "string" else pa.list_(pa.int64()) if kind.startswith("array") else pa.int64())
    for name, kind in (c.split() for c in _BLOCKS.split(", "))
])


def _ids_by_rank(spark: SparkSession, folder: str) -> np.ndarray:
    """The id of every rank; at most the vocabulary."""
    rows = spark.read.parquet(f"{folder}/ranks").collect()
    out = np.zeros(len(rows), dtype="<u4")
    for r in rows:
        out[r["rank"]] = r["id"]
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, decoded from the files.

    The totals of the files (one row each) give where each begins.
    """
    table = spark.read.parquet(f"{folder}/blocks")
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    begins = {r["part"]: b for r, b in zip(totals, np.cumsum([0, *(r["n"] for r in totals)]).tolist(), strict=False)}
    shared = spark.sparkContext.broadcast((_ids_by_rank(spark, folder), begins))

    def run(batches):
        ids_of, begins = shared.value
        place, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with place.open_input_file(f"{path}/{row['file']}") as file:
                    payload = np.frombuffer(file.read_at(row["size"], row["offset"]), dtype=np.uint8)
                lengths = np.array(row["lengths"], dtype=np.int64)
                ids = ids_of[decode_ranks(payload, np.array(row["sizes"], dtype=np.int64), lengths)]
                streams = pa.Array.from_buffers(
                    pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * lengths)])), pa.py_buffer(ids)]
                )
                starts = np.cumsum(row["lengths"]) - row["lengths"] + begins[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                     streams.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
