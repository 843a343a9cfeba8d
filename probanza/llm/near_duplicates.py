"""Similarity join of documents on word n-gram Jaccard, by MinHash banding and verification on full sets.

**Classes.** Documents with the same set of five-word shingles are one class, counted on the map
side; only one member goes on, so copies are never paired.

**Banding.** Rows and bands are chosen so that a pair at the threshold shares a band with the
target probability. Classes meet by band hash; each is linked with the smallest class of its
buckets (a star, not all pairs), and connected stars form families.

**Verification.** A family is cut into blocks; every pair of blocks is one small group, in which
all pairs of classes are compared on their full sets by a matrix product. A group hands over how
many links each class has and a spanning forest, not the pairs, so no link between different
texts is lost and no row is made per pair. The forests of all groups give the final groups.

Result: doc_id, class_id (smallest doc_id with the same shingles), n_copies (documents of the
class), n_links (other classes with Jaccard >= threshold) and group_id (smallest doc_id linked
directly or through others).

A text of one to four words is one shingle; texts without words (null, empty) form one class
without links. Repeated rows count as copies; a null id never becomes a class or group id unless
it is the only one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probanza.llm.components import components
from probanza.llm.shingles import set_key, shingle_sets
from probanza.llm.texts import blocks, checked_broadcast, stored

THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 320
#: Classes and shingles that a block is meant to hold.
BLOCK_CLASSES = 64
BLOCK_SHINGLES = 1 << 17
_SEED = 20240501


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Rows and bands: the most rows for which enough bands for the recall fit into ``max_hashes``."""
    best = (1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else (1, 1)
    for rows in range(2, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if rows * bands <= max_hashes:
            best = (rows, bands)
    return best


def band_hashes(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """One hash per set and band of the set's minima under ``rows * bands`` hash functions."""
    rng = np.random.default_rng(_SEED)
    odd = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        code = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((flat ^ flip[k]) * odd[k], starts)
            code = (code ^ least) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        out[:, band] = code
    return out.view(np.int64)


def signed(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """doc_id, key (of the shingle set), n_shingles, bands of every document."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                sets = shingle_sets(block.column("text").to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                hashed = band_hashes([sets[i] for i in full], rows, bands) if full else np.zeros((0, bands), np.int64)
                ends = np.zeros(len(sets) + 1, dtype=np.int32)
                ends[1:][full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(hashed.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), lists],
                    names=["doc_id", "key", "n_shingles", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, bands array<long>")


def families(classes: DataFrame) -> DataFrame:
    """(node, comp) of the classes that share a band hash with another, linked through such buckets."""
    in_band = classes.select("node", F.explode("bands").alias("band"))
    hubs = in_band.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = in_band.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(stars)


def _links(sets: list[np.ndarray], blocks_of: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Which pairs are similar; in a group of two blocks only pairs across them, even where one is empty."""
    n = len(sets)
    codes, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(codes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), dtype=np.float64)
    step = max(1, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    size = np.array([len(s) for s in sets])
    similar = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(similar, False)
    if across:
        similar &= blocks_of[:, None] != blocks_of[None, :]
    return similar


def _forest(similar: np.ndarray) -> np.ndarray:
    """For each member the first member it is connected with."""
    label = np.arange(len(similar))
    while True:
        near = np.where(similar, label[None, :], len(similar)).min(axis=1)
        fresh = np.minimum(label, near)
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return label
        label = fresh


def verified(docs: DataFrame, classes: DataFrame, family: DataFrame, threshold: float) -> DataFrame:
    """(node, hub, n_links): per block pair, a class's links and a class it is connected with (null: none)."""
    sized = family.join(classes.select("node", "first_id", "key", "n_shingles"), "node")
    totals = sized.groupBy(F.col("comp").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("long")
    members = stored(
        sized.join(totals.select("c", parts.alias("parts")), F.col("comp") == F.col("c"))
        .select("node", "comp", "first_id", "key", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).alias("block")),
        "members",
    )
    text = docs.select("doc_id", "text").join(checked_broadcast(members), F.col("doc_id").eqNullSafe(F.col("first_id")))

    def sets(batches):
        for batch in batches:
            for block in blocks(batch):
                found = shingle_sets(block.column("text").to_pylist())
                same = [set_key(s) == k for s, k in zip(found, block.column("key").to_pylist(), strict=True)]
                kept = block.select(["node", "comp", "parts", "block"]).filter(pa.array(same))
                values = pa.array([s.tobytes() for s, ok in zip(found, same, strict=True) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, values], names=["node", "comp", "parts", "block", "codes"])

    full = text.select("text", "key", "node", "comp", "parts", "block").mapInArrow(
        sets, "node long, comp long, parts long, block long, codes binary"
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = full.select("node", "comp", "block", "codes", other)
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")

    def compare(rows: list[dict]) -> pa.RecordBatch | None:
        by_node = {r["node"]: r for r in rows}  # repeated rows of one document
        rows, across = list(by_node.values()), rows[0]["i"] != rows[0]["j"]
        if len(rows) < 2 or (across and len({r["block"] for r in rows}) < 2):
            return None
        found = [np.frombuffer(r["codes"], dtype=np.uint64) for r in rows]
        similar = _links(found, np.array([r["block"] for r in rows]), across, threshold)
        links, first = similar.sum(axis=1), _forest(similar)
        hit = np.flatnonzero(links)
        nodes = np.array([r["node"] for r in rows])
        hubs = pa.array(nodes[first[hit]], mask=first[hit] == hit)
        return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), hubs, pa.array(links[hit])], names=["node", "hub", "n_links"])

    def groups(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["comp"], row["i"], row["j"])
                if own != key and held:
                    if (out := compare(held)) is not None:
                        yield out
                    held = []
                key = own
                held.append(row)
        if held and (out := compare(held)) is not None:
            yield out

    return dealt.select("comp", "i", "j", "node", "block", "codes").mapInArrow(groups, "node long, hub long, n_links long")


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, key, class_id, n_copies, n_links, group_id, group_node (one per group): see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, bands = plan_bands(threshold, recall)
    sign = stored(signed(docs, rows, bands), "signed")
    per_key = sign.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
    )
    classes = stored(per_key.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(verified(docs, classes, families(classes), threshold), "verified")
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.filter("hub IS NOT NULL").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    linked = links.join(groups, "node").join(classes.select("node", "first_id"), "node")
    lowest = linked.groupBy(F.col("comp").alias("c")).agg(F.min("first_id").alias("group_id"), F.min("node").alias("first_node"))
    linked = linked.join(lowest, F.col("comp") == F.col("c")).select("node", "n_links", "group_id", "comp")
    per_class = classes.select("key", "node", "first_id", "n_copies").join(linked, "node", "left").select(
        "key", F.col("first_id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "first_id").alias("group_id"), F.coalesce("comp", "node").alias("group_node"),
    )
    return sign.select("doc_id", "key").join(stored(per_class, "per-class"), "key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, group_id of every document."""
    return similarity_join(docs, threshold).drop("key", "group_node")


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and the key of the shingle set."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "_text"):
                keys = [set_key(s) for s in shingle_sets(block.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(keys, pa.binary())], names=["row", "key"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("_text"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, key binary")


def one_per_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Where an id occurs in several rows, ids do not tell rows apart; such rows (usually none) are
    chosen by their shingle sets, one of equal rows staying.
    """
    found = stored(similarity_join(docs, threshold), "groups")
    clash = stored(found.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "clash")
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col("id"))
    lost = found.filter(~F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("id")).unionByName(clash)
    kept = docs.join(checked_broadcast(stored(lost, "lost")), same_id, "left_anti")
    if clash.isEmpty():
        return kept
    chosen = found.join(clash, same_id, "left_semi").filter(F.col("doc_id").eqNullSafe(F.col("group_id")))
    chosen = chosen.groupBy("group_node").agg(F.min("group_id").alias("id"), F.min("key").alias("_key"))
    rows = keyed(docs.join(checked_broadcast(clash), same_id, "left_semi"))
    picked = rows.join(chosen, (F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))) & (F.col("key") == F.col("_key")))
    return kept.unionByName(picked.dropDuplicates(["group_node"]).select("row.*"))
