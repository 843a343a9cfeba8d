"""Language identification with bit-sliced Bloom filters over character n-grams.

**Learning.** From at most about ``SAMPLE_DOCS`` documents of each language (a documented bound:
rows whose hash falls below the share that gives this many), n-grams of one to four lower-case
letters, with a mark at word edges, are counted. A language keeps its ``PROFILE`` most frequent
n-grams among those at least ``SHARE`` times as frequent as in the language where they are most
frequent. All profiles are put into one filter: every cell holds a bit per language, so one
look-up of ``HASHES`` cells and their AND gives all languages that hold an n-gram.

**Deciding.** Over all n-grams of a whole text each language's hits are counted, less the false
positives that its share of set cells predicts. The most corrected hits win (ties: the first in
alphabetical order); the score is their share of all languages' corrected hits.

A text that is null or has no letter is ``und`` with score 0; so is every text when no row has a
language. A text with letters but without a hit gets the language of most n-grams learned and
score 0. Rows stay as they are, repeated or with null ids; long texts are handled whole, a block
of text at a time; other columns are ignored. The filter's size is fixed and is broadcast.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probanza.llm.texts import blocks

SAMPLE_DOCS = 2000
PROFILE = 1 << 14
SHARE = 0.25
CELL_BITS = 20
HASHES = 3
ORDERS = (1, 2, 3, 4)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the n-gram hashes with the number of their text; and which texts have a letter."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass") + b"\0" * 4, dtype="<u4")
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    letter = _letters()[points]
    marked = np.where(letter, points, 0).astype(np.uint64)
    has = np.zeros(len(low), dtype=bool)
    has[owner[letter]] = True
    out, n = [], len(points)
    for k in orders:
        if n < k + 1:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            continue
        size = n - k + 1
        # A gram is k letters, or k - 1 letters with the mark of a word's edge before or behind them.
        inner = letter[1 : size + 1].copy() if k > 2 else np.ones(size, dtype=bool)
        for j in range(2, k - 1):
            inner &= letter[j : size + j]
        ends = letter[:size] | letter[k - 1 :] if k > 1 else letter[:size]
        keep = inner & ends & (owner[:size] == owner[k - 1 :])
        code = np.full(size, k, dtype=np.uint64)
        for j in range(k):
            code *= np.uint64(_MIX[0])
            code += marked[j : size + j]
            code ^= code >> np.uint64(31)
        out.append((code[keep], owner[:size][keep]))
    return out, has


def cells(codes: np.ndarray, bits: int = CELL_BITS, hashes: int = HASHES) -> list[np.ndarray]:
    """The filter cells of n-gram hashes."""
    first = codes * np.uint64(_MIX[1])
    second = (codes * np.uint64(_MIX[2])) | np.uint64(1)
    return [((first + second * np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(hashes)]


class BitSlicedFilter:
    """One Bloom filter per language, kept side by side: cell c holds a bit for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], bits: int = CELL_BITS, hashes: int = HASHES):
        self.languages, self.bits, self.hashes = sorted(profiles), bits, hashes
        self.default = max(self.languages, key=lambda n: (len(profiles[n]), n), default="und")
        width = min((w for w in (8, 16, 32, 64) if w >= len(self.languages)), default=64)
        self.width = width
        self.slices = [np.zeros(1 << bits, dtype=f"u{width // 8}") for _ in range(-(-len(self.languages) // width))]
        for k, name in enumerate(self.languages):
            own = self.slices[k // width]
            for c in cells(profiles[name], bits, hashes):
                own[c] |= own.dtype.type(1 << k % width)
        #: The probability that an n-gram outside a profile is reported.
        self.false_rate = np.array(
            [np.mean((self.slices[k // width] >> (k % width)) & 1) ** hashes for k in range(len(self.languages))]
        )

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        """The languages of every n-gram, as bits, a slice at a time."""
        where = cells(codes, self.bits, self.hashes)
        out = []
        for own in self.slices:
            mask = own[where[0]]
            for c in where[1:]:
                mask &= own[c]
            out.append(mask)
        return out

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        per_order, has = grams(texts)
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for codes, owner in per_order:
            total += np.bincount(owner, minlength=len(texts))
            for s, mask in enumerate(self.masks(codes)):
                for k in range(min(self.width, len(self.languages) - s * self.width)):
                    bit = (mask >> mask.dtype.type(k)) & mask.dtype.type(1)
                    hits[s * self.width + k] += np.bincount(owner, weights=bit, minlength=len(texts))
        rate = self.false_rate[:, None]
        corrected = np.maximum(0.0, (hits - rate * total) / np.maximum(1e-9, 1 - rate))
        best, sums = corrected.argmax(axis=0), corrected.sum(axis=0)
        return [
            ("und", 0.0) if not has[i]
            else (self.default, 0.0) if sums[i] <= 0
            else (self.languages[best[i]], float(corrected[best[i], i] / sums[i]))
            for i in range(len(texts))
        ]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE) -> BitSlicedFilter:
    """Profiles of all languages of the rows outside the held-out fold, put into one filter."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(F.broadcast(sizes), "lang").filter(chance * F.col("n") < sample_docs).select("lang", "text")

    def count(batches):
        for batch in batches:
            for block in blocks(batch):
                names = block.column("lang").to_pylist()
                for name in sorted(set(names)):
                    per_order, _ = grams([t for t, n in zip(block.column("text").to_pylist(), names, strict=True) if n == name])
                    codes, n = np.unique(np.concatenate([c for c, _ in per_order]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "code", "n"],
                    )

    counts = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.toPandas()  # distinct n-grams of the bounded sample
    counts["rate"] = counts["n"] / counts.groupby("lang")["n"].transform("sum")
    counts = counts[counts["rate"] >= SHARE * counts.groupby("code")["rate"].transform("max")]
    counts = counts.sort_values(["lang", "rate", "code"], ascending=[True, False, True])
    top = counts.groupby("lang").head(profile)
    return BitSlicedFilter({name: g["code"].to_numpy().view(np.uint64) for name, g in top.groupby("lang")})


def identify(docs: DataFrame, model: BitSlicedFilter) -> DataFrame:
    """``docs`` with lang_pred and score behind their columns; only the text decides.

    The columns of the input are kept as one struct ``row``, so that names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "_text"):
                found = shared.value.decide(block.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [block.column("row"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("_text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def predict(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = learn(docs, sample_docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
