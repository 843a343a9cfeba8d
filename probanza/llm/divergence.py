"""How far the sources of a language differ in their words, by exact integer shares.

**Terms** are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A
language keeps the terms of at least ``least_docs`` of its documents (V of them). In a group (a
language and source, or a whole language) with N occurrences of kept terms, a term with n of them has
the share p = 1 + floor(SCALE * (n + 1) / (N + V)); p against q diverges by floor((p - q)^2 / q).

**Counting.** A task cuts about ``BLOCK_BYTES`` of texts, ordered by group, into terms by byte
classes. Terms are dealt by length: up to 8 bytes are packed into one unsigned 64-bit word, up to 16
into two (first byte highest, so that words sort as bytes do); these are sorted by a stable radix sort
on 16-bit digits. Longer terms go into a bucket for each length, sorted as fixed-width bytes. As sorting
is stable, equal terms stay in document order, so one pass over the runs counts occurrences and
documents per group. Spark adds up the counts of all blocks.

**Pairs.** Every source of a language is set against every other. Most terms are absent from most
sources, so a pair's sum over all V terms is that of a term absent from both, V times, corrected for
the terms of either source (from the number of its terms with each share) and for those of both (the
only step that meets sources term by term).

Result: lang, source, part, item, value, rank. Part ``pair``: every other source of the language, with
the sum of divergences from it (0 if V = 0). Part ``term``: the first ``top`` kept terms of the group
that are more frequent there than in the whole language. Ranks are by value, largest first, then item.

Null text, lang and source are read as ''; documents without terms still make their group known.
Repeated rows are documents of their own. Texts and terms may have any length. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probanza.llm.texts import blocks, stored

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Bytes of text that a task sorts at a time; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000

_COUNTS = "lang string, source string, term string, n long, n_docs long"
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every term of texts that lie one behind the other in ``data``."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[begins] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return start, end - start, np.searchsorted(begins, start, side="right") - 1


def packed_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Terms of at most ``8 * n_words`` bytes as unsigned words, first byte highest; ``data`` is padded by as many bytes."""
    raw = data[start[:, None] + np.arange(8 * n_words)].view(">u8").astype(np.uint64)
    unused = np.uint64(8) * (np.uint64(8 * n_words) - length.astype(np.uint64))
    raw[:, -1] &= np.uint64(0xFFFFFFFFFFFFFFFF) << unused
    return [raw[:, k].copy() for k in range(n_words)]


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by their words, the first word counting most; sixteen bits a pass."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        word = word[order]
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                step = np.argsort(digit, kind="stable")
                order, word = order[step], word[step]
    return order


def run_counts(differs: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and documents of every run of one term in one group; rows are sorted by term, then document."""
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = differs | (group[1:] != group[:-1])
    new_doc = fresh.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(fresh)
    return first, np.diff(first, append=len(doc)), np.add.reduceat(new_doc.astype(np.int64), first)


def _strings(raw: np.ndarray) -> pa.Array:
    """Rows of zero-padded bytes as strings."""
    used = raw != 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(raw[used]))


def counted(data: np.ndarray, begins: np.ndarray, group_of: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, groups, occurrences, documents) of texts that are ordered by group, one tuple per bucket of lengths."""
    start, length, doc = terms_of(data, begins)
    data = np.concatenate([_LOWER[data], np.zeros(16, dtype=np.uint8)])
    for n_words in (1, 2):
        own = (length <= 8 * n_words) & (length > 8 * (n_words - 1))
        if not own.any():
            continue
        words = packed_words(data, start[own], length[own], n_words)
        order = radix_order(words)
        words, docs = [w[order] for w in words], doc[own][order]
        differs = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        first, n, n_docs = run_counts(differs, docs, group_of[docs])
        raw = np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(len(first), -1)
        yield _strings(raw), group_of[docs[first]], n, n_docs
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]).tolist():
        own = long[length[long] == size]
        raw = np.ascontiguousarray(np.stack([data[s : s + size] for s in start[own].tolist()]))
        order = np.argsort(raw.view(f"S{size}").ravel(), kind="stable")
        raw, docs = raw[order], doc[own][order]
        first, n, n_docs = run_counts((raw[1:] != raw[:-1]).any(axis=1), docs, group_of[docs])
        yield _strings(raw[first]), group_of[docs[first]], n, n_docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs of the blocks of all documents; Spark has yet to add them up."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, limit=BLOCK_BYTES):
                known: dict[tuple[str, str], int] = {}
                names = zip(block.column("lang").to_pylist(), block.column("source").to_pylist(), strict=True)
                group_of = np.array([known.setdefault(name, len(known)) for name in names], dtype=np.int64)
                order = np.argsort(group_of, kind="stable")
                group_of = group_of[order]
                texts = block.column("text").take(order).cast(pa.large_binary())
                begins = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: len(texts) + 1]
                whole = texts.buffers()[2]
                data = np.frombuffer(whole, dtype=np.uint8)[begins[0] : begins[-1]] if whole else np.zeros(0, np.uint8)
                langs, sources = (pa.array([name[i] for name in known], pa.string()) for i in (0, 1))
                for terms, groups, n, n_docs in counted(data, begins[:-1] - begins[0], group_of):
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(groups)), sources.take(pa.array(groups)), terms, pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())],
                        names=["lang", "source", "term", "n", "n_docs"],
                    )

    return docs.mapInArrow(run, _COUNTS)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact at any count."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, (total + kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    per_group = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    counts = stored(per_group, "term-counts")
    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    kept = per_lang.filter(F.col("n_docs") >= least_docs).drop("n_docs")
    used = stored(counts.drop("n_docs").join(kept, ["lang", "term"]), "kept-terms")

    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = used.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    by_lang = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(by_lang, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.na.fill(0, ["v", "total", "lang_total"]), "groups")  # a row per language and source
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).alias("absent")

    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), absent,
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("lang_p"),
    )
    shares = stored(shares, "shares")
    return _pairs(groups.select("lang", "source", "v", absent), shares).unionByName(_terms(shares, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("absent_q"))
    both_absent = divergence(F.col("absent"), F.col("absent_q"))
    apart = F.col("source") != F.col("item")
    base = groups.join(other, "lang").filter(apart).select(
        "lang", "source", "item", F.coalesce(F.col("v") * both_absent, F.lit(0)).alias("value")
    )
    alike = shares.groupBy("lang", "source", "absent", "p").agg(F.count(F.lit(1)).alias("k"))
    one = alike.join(other, "lang").filter(apart)
    own = (F.col("k") * (divergence(F.col("p"), F.col("absent_q")) - both_absent)).alias("value")
    turned = (F.col("k") * (divergence(F.col("absent_q"), F.col("p")) - divergence(F.col("absent_q"), F.col("absent")))).alias("value")
    sides = F.explode(F.array(F.struct("source", "item", own), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), turned)))
    one = one.select("lang", sides.alias("x")).select("lang", "x.*")
    holders = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("of")).filter(F.size("of") > 1)
    met = holders.select("lang", "of", F.explode("of").alias("a")).select("lang", "a", F.explode("of").alias("b")).filter("a.source <> b.source")
    a, b, a0, b0 = F.col("a.p"), F.col("b.p"), F.col("a.absent"), F.col("b.absent")
    both = met.select(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"),
        (divergence(a, b) - divergence(a, b0) - divergence(a0, b) + divergence(a0, b0)).alias("value"),
    ).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    summed = base.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed, "pair")


def _terms(shares: DataFrame, top: int) -> DataFrame:
    ahead = shares.filter("p > lang_p").select(
        "lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("lang_p")).alias("value")
    )
    return _ranked(ahead, "term").filter(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(first).alias("rank"))
