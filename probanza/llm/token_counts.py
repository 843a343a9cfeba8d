"""Token counts by a two-tier lookup on the map side.

A first pass finds frequent pre-tokens: each task keeps a bounded summary (the ``hot_size`` most
frequent, pruned as it fills) and hands over one row; summaries merge in two levels. The merged
table maps pre-tokens to their number of tokens, has at most ``hot_size`` entries whatever the
input, and is broadcast. The second pass splits each whole text into pre-tokens, adds up their
lengths from the table, and encodes what is not in it through the worker's bounded cache. Only
pre-tokens of up to ``LONGEST`` characters enter summaries, table and cache; longer ones are encoded
where they occur. The table changes the speed only, never a count.

A text with characters beyond ASCII and Latin letters is first cut where a character that is surely
no white space meets a space or line feed; no pre-token crosses such a place. Its Latin parts are
split as above, and each other part (a word with its marks and the space before it) is looked up,
cached and encoded as it is, so all scripts that write spaces go through the table. Only a text
that spells a special token goes to the library whole.

Null text counts as empty (0 bytes, 0 tokens). Rows are kept as they are: repeated rows and null
ids give a row each. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probanza.llm.encode import pre_token_ids
from probanza.llm.texts import Cache, blocks

#: Most entries of the broadcast table; about 20 bytes each.
HOT_SIZE = 1 << 15
#: Characters (of at most four bytes) of the longest pre-token that summaries, table and cache hold.
LONGEST = 64
#: Parts with other characters are encoded by the library, so that classes of characters never differ.
_NOT_LATIN = re.compile("[^\x09-\x0d\x20-\x7eÀ-ɏ]")
#: Between a character that no version of Unicode counts as white space, and a space or line feed.
_CUT = re.compile(
    "(?<=[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff])(?=[ \n])"
)


class PieceCounter:
    """Counts tokens of whole texts with a table of frequent pre-tokens, a cache, and the library."""

    def __init__(self, path: str, pattern: str, frequent: dict[str, int]):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall
        self.lengths = Cache(self.length, frequent)

    def length(self, piece: str) -> int:
        return self.encoded(piece) if _NOT_LATIN.search(piece) else len(pre_token_ids(self.tokenizer, piece))

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None where it must go to the library whole."""
        if any(s in text for s in self.special):
            return None
        if not _NOT_LATIN.search(text):
            return self.split(text)
        return [p for part in _CUT.split(text) for p in ([part] if _NOT_LATIN.search(part) else self.split(part))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = self.pieces(text)
        if pieces is None:
            return self.encoded(text)
        if max(map(len, pieces), default=0) > LONGEST:
            return sum(self.length(p) if len(p) > LONGEST else self.lengths[p] for p in pieces)
        return sum(map(self.lengths.__getitem__, pieces))


def _pack(counts: Counter, size: int) -> dict:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return {"pieces": [p for p, _ in top], "counts": [n for _, n in top]}


_SUMMARY = "part long, pieces array<string>, counts array<long>"


def frequent_pieces(docs: DataFrame, path: str, pattern: str, size: int = HOT_SIZE) -> list[str]:
    """At most ``size`` frequent pre-tokens of all texts, from one bounded summary per task."""

    def summarise(batches):
        from pyspark import TaskContext

        reader, counts = PieceCounter(path, pattern, {}), Counter()
        for batch in batches:
            for block in blocks(batch):
                for text in block.column("text").to_pylist():
                    counts.update(p for p in (text and reader.pieces(text)) or () if len(p) <= LONGEST)
                if len(counts) > 4 * size:
                    counts = Counter(dict(counts.most_common(size)))
        packed = _pack(counts, size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, **packed}])

    def merge(batches):
        counts, part = Counter(), 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                counts.update(dict(zip(row["pieces"], row["counts"], strict=True)))
                if len(counts) > 4 * size:
                    counts = Counter(dict(counts.most_common(size)))
        yield pa.RecordBatch.from_pylist([{"part": part, **_pack(counts, size)}])

    one = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(summarise, _SUMMARY)
    few = one.repartition(16, F.pmod("part", F.lit(16))).mapInArrow(merge, _SUMMARY)
    rows = few.repartition(1).mapInArrow(merge, _SUMMARY).collect()  # one row of at most ``size`` pieces
    return [p for row in rows for p in row["pieces"]]


def token_counts(
    docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024, hot_size: int = HOT_SIZE
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    ``tokenizer_path`` names a byte-level tokenizer file of the tokenizers library, ``pattern`` the
    expression by which it splits texts; special strings inside texts count as it counts them.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    frequent = frequent_pieces(docs, tokenizer_path, pattern, hot_size)
    lengths = list(map(PieceCounter(tokenizer_path, pattern, {}).length, frequent))
    table = spark.sparkContext.broadcast((frequent, np.array(lengths, dtype=np.int64)))

    def run(batches):
        pieces, lengths = table.value
        worker = PieceCounter(tokenizer_path, pattern, dict(zip(pieces, lengths.tolist(), strict=True)))
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pc.cast(pc.binary_length(texts), pa.int64()).fill_null(0),
                        pa.array([worker.count(t) for t in texts.to_pylist()], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
