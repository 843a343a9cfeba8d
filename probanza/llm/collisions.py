"""Near duplicates of embeddings by counting collisions of one-dimensional projections.

**Classes.** Equal vectors are one class, counted on the map side; only one member goes on.

**Projections.** A vector of length 1 is projected onto M random Gaussian directions, so a value is
standard normal and two vectors at cosine c have values that correlate by c. Near the middle of a
projection all vectors lie close together and a window there tells nothing, so only the two outer
parts, of a share f each, are searched: a vector has about 2 M f places, whatever M is. In a part, sorted
by value, a collision is another vector inside the window of half-width ``w`` around the vector asked for.

**Calibration.** p, the chance that a pair just at the threshold collides in one part, comes from the
bivariate normal distribution; M is the least number of directions for which at least ``COLLISIONS``
of 2 M parts collide with probability ``RECALL``. f falls with the square root of the number of
classes, so that parts grow as slowly as the number of directions does.

**Counting and verification.** A vector meets others in the parts that it is in; it brings along its
places in all parts, so collisions of a pair are counted at once, wherever it meets. The first part in
which a pair collides is the one that counts it. Pairs with enough collisions are verified by their cosine
in double precision. A part of more than ``BLOCK`` vectors is cut into blocks and each pair of blocks is a
task's group, so a large group of near copies costs comparisons but no row per pair: a group hands over
how many links each vector has and which vector it is connected with.

Result: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept
(vec_id = component_id). Every link has a cosine of at least the threshold; a pair at the threshold is
found with probability ``RECALL``, a nearer one with a higher one; equal vectors always are.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do
vectors of different lengths. Repeated rows are linked with each other; a row without an id is named
by a reachable one, if any (else null). Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probanza.llm.components import components
from probanza.llm.texts import checked_broadcast, stored

THRESHOLD = 0.95
RECALL = 0.999
#: Parts in which a pair has to collide before its cosine is computed.
COLLISIONS = 2
#: Vectors of a block, and collisions that are expanded at a time.
BLOCK = 4096
STRIP = 1 << 21
#: Directions that are drawn and applied at a time.
CHUNK = 512
#: Classes with more than this share of the rows are joined to their rows in parts.
HOT_SHARE, SALTS = 0.002, 64
_SEED = 20260131


@dataclass(frozen=True)
class Plan:
    directions: int
    least_value: float
    window: float
    collisions: int


def collision_chance(cosine: float, least_value: float, window: float) -> float:
    """Chance that both values of a pair exceed ``least_value`` and differ by at most ``window``."""
    x = np.linspace(least_value, least_value + 8, 8001)
    rest = math.sqrt(max(1e-12, 1 - cosine * cosine))
    cdf = np.vectorize(NormalDist().cdf)
    inside = cdf((x + window - cosine * x) / rest) - cdf((np.maximum(least_value, x - window) - cosine * x) / rest)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float(np.trapezoid(density * inside, x))


def plan_projections(n: int, threshold: float = THRESHOLD, recall: float = RECALL, collisions: int = COLLISIONS) -> Plan:
    """Directions, outer part and window for ``n`` classes."""
    share = min(0.02, 1 / (3 * math.sqrt(max(1, n))))
    least_value = NormalDist().inv_cdf(1 - share)
    window = 2.5 * math.sqrt(2 - 2 * threshold)
    p = collision_chance(threshold, least_value, window)

    def missed(parts: int) -> float:
        return sum(math.exp(math.lgamma(parts + 1) - math.lgamma(k + 1) - math.lgamma(parts - k + 1) + k * math.log(p) + (parts - k) * math.log1p(-p)) for k in range(collisions))

    low, high = collisions, 2 * collisions
    while missed(high) > 1 - recall:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > 1 - recall else (low, mid)
    return Plan(-(-high // 2), least_value, window, collisions)


@lru_cache(maxsize=64)
def _directions(dims: int, chunk: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dims, chunk]).standard_normal((dims, CHUNK), dtype=np.float32)


def places(unit: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, part and value (as a magnitude) of every place of vectors of length 1 in outer parts, by row, then part."""
    rows, parts, values = [], [], []
    single = unit.astype(np.float32)
    for chunk in range(-(-plan.directions // CHUNK)):
        value = single @ _directions(unit.shape[1], chunk)[:, : plan.directions - chunk * CHUNK]
        row, column = np.nonzero(np.abs(value) > plan.least_value)
        hit = value[row, column]
        rows.append(row)
        parts.append(2 * (chunk * CHUNK + column) + (hit < 0))
        values.append(np.abs(hit))
    row, part, value = map(np.concatenate, (rows, parts, values))
    order = np.lexsort((part, row))
    return row[order], part[order], value[order]


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows of length 1 in double precision."""
    raw = np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def placed(classes: DataFrame, plan: Plan) -> DataFrame:
    """node, copies, dims, vector (length 1), parts, values of every class."""

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist(), dtype=np.int64)
            for size in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == size))
                for at in range(0, own.num_rows, 1024):
                    some = own.slice(at, 1024)
                    unit = unit_vectors(some.column("vector"))
                    row, part, value = places(unit, plan)
                    ends = pa.array(np.searchsorted(row, np.arange(len(unit) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), some.column("copies"), some.column("dims"), pa.array([u.tobytes() for u in unit], pa.binary()),
                         pa.ListArray.from_arrays(ends, pa.array(part, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float32()))],
                        names=["node", "copies", "dims", "vector", "parts", "values"],
                    )

    return classes.select("node", "copies", "dims", "vector").mapInArrow(
        run, "node long, copies long, dims int, vector binary, parts array<int>, values array<float>"
    )


@dataclass
class Meeting:
    """Vectors of whole groups, one group behind the other."""

    group: np.ndarray  # ascending
    own_part: np.ndarray  # the part that a vector's group stands for
    side: np.ndarray  # block of a vector; in groups of two blocks only pairs across them count
    across: np.ndarray
    row: np.ndarray  # of a place
    part: np.ndarray
    value: np.ndarray


def colliding_pairs(m: Meeting, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) with enough collisions whose first common part is that of their group, in strips of places."""
    order = np.lexsort((m.value, m.part, m.group[m.row]))
    row, part, value = m.row[order], m.part[order], m.value[order].astype(np.float64)
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (part[1:] != part[:-1]) | (m.group[row[1:]] != m.group[row[:-1]])
    segment = np.cumsum(fresh) * 64.0  # values are below 40, so windows stay inside their segment
    key = segment + value
    back = np.argsort(row, kind="stable")  # places by vector again
    low = np.searchsorted(key, key[back] - plan.window, side="left")
    size = np.searchsorted(key, key[back] + plan.window, side="right") - low
    asking = row[back]
    ends = np.cumsum(size)
    by_row = ends[np.searchsorted(asking, np.arange(len(m.group)), side="right") - 1]
    first = 0
    while first < len(m.group):
        done = by_row[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(by_row, done + STRIP, side="right")))
        a, b = np.searchsorted(asking, [first, last])
        if b > a:
            count = size[a:b]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(low[a:b], count) + offset
            left, right = np.repeat(asking[a:b], count), row[at]
            keep = (right > left) & ~(m.across[left] & (m.side[left] == m.side[right]))
            left, right, of = left[keep], right[keep], part[at[keep]]
            pair = left * np.int64(len(m.group)) + right
            by_pair = np.argsort(pair, kind="stable")
            pair, of = pair[by_pair], of[by_pair]
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            if len(start):
                left, right = left[by_pair][start], right[by_pair][start]
                times, least = np.diff(start, append=len(pair)), np.minimum.reduceat(of, start)
                good = (times >= plan.collisions) & (least == m.own_part[left])
                yield left[good], right[good]
        first = last


def linked(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of pairs of unit vectors reach the threshold, in double precision."""
    out = np.zeros(len(left), dtype=bool)
    step = max(1, (1 << 22) // vectors.shape[1])
    for at in range(0, len(left), step):
        out[at : at + step] = np.einsum("ij,ij->i", vectors[left[at : at + step]], vectors[right[at : at + step]]) >= threshold
    return out


def join_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Make ``label`` (of each member the least it is connected with) hold for further links."""
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label[:] = label[label]


def meetings(plan: Plan, threshold: float) -> Callable:
    """The function that compares whole groups of dealt rows: node, n_links, hub."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        node, copies, own_part, i, j, side = (table.column(c).to_numpy() for c in ("node", "copies", "part", "i", "j", "side"))
        dims = int(table.column("dims")[0].as_py())
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(-1, dims)
        fresh = np.ones(len(node), dtype=bool)
        fresh[1:] = (own_part[1:] != own_part[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        lists = table.column("parts").combine_chunks()
        row = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        values = table.column("values").combine_chunks().flatten().to_numpy()
        meeting = Meeting(np.cumsum(fresh), own_part, side, i != j, row, lists.flatten().to_numpy(), values)
        links, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for left, right in colliding_pairs(meeting, plan):
            near = linked(vectors, left, right, threshold)
            left, right = left[near], right[near]
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            join_labels(label, left, right)
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[label[hit]])], names=["node", "n_links", "hub"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for cut in _group_cuts(batch):  # a group's rows lie one behind the other
                if held and rows >= BLOCK and _key(held[-1], -1) != _key(cut, 0):
                    yield compare(pa.Table.from_batches(held))
                    held, rows = [], 0
                elif held and held[-1].column("dims")[0] != cut.column("dims")[0]:
                    yield compare(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(cut)
                rows += cut.num_rows
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


_GROUP_KEY = ("dims", "part", "i", "j")


def _key(batch: pa.RecordBatch, at: int) -> tuple:
    at %= batch.num_rows
    return tuple(batch.column(c)[at].as_py() for c in _GROUP_KEY)


def _group_cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut between groups, in slices of about ``BLOCK`` rows where groups are small."""
    keys = np.stack([batch.column(c).to_numpy() for c in _GROUP_KEY])
    changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
    dims = np.flatnonzero(keys[0, 1:] != keys[0, :-1]) + 1
    start = 0
    while start < batch.num_rows:
        later = changes[np.searchsorted(changes, min(start + BLOCK, batch.num_rows)) :]
        stop = int(later[0]) if len(later) else batch.num_rows
        new_dims = dims[dims > start]
        stop = min(stop, int(new_dims[0])) if len(new_dims) else stop
        tail = changes[(changes > start) & (changes < stop)]
        if stop == batch.num_rows and len(tail):  # the last group may go on in the next batch
            yield batch.slice(start, int(tail[-1]) - start)
            start = int(tail[-1])
        yield batch.slice(start, stop - start)
        start = stop


def class_links(classes: DataFrame, plan: Plan, threshold: float) -> DataFrame:
    """node, n_links, hub: a class's links in each group, and the class it is connected with."""
    where = stored(placed(classes, plan), "placed")
    sizes = where.select("dims", F.explode("parts").alias("part")).groupBy("dims", "part").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")).drop("n"), "large-parts")
    met = where.withColumn("part", F.explode("parts")).join(checked_broadcast(large), ["dims", "part"], "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    met = met.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    dealt = met.select(
        "dims", "part", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "copies", "vector", "parts", "values"
    )
    dealt = dealt.repartition(*_GROUP_KEY).sortWithinPartitions(*_GROUP_KEY, "node")
    return dealt.mapInArrow(meetings(plan, threshold), "node long, n_links long, hub long")


def usable(vector: Column) -> Column:
    """Whether a vector can have a cosine: not null, all components finite, not all of them zero."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def near_dedup(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: see the module."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    valid = rows.filter(usable(F.col("vector")))
    digest = F.concat(*(F.hex(F.xxhash64(F.lit(k), "vector")) for k in (1, 2)))
    keyed = stored(valid.select("vec_id", digest.alias("key"), "vector"), "vectors")
    grouped = keyed.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    grouped = grouped.withColumn("dims", F.size("vector")).withColumn("node", F.monotonically_increasing_id())
    classes = stored(grouped, "vector-classes")
    plan = plan_projections(classes.count(), threshold, recall)
    found = stored(class_links(classes, plan, threshold), "vector-links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    edges = found.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    member = stored(components(edges), "vector-groups")
    per_class = classes.select("node", "key", "first_id", "copies").join(links, "node", "left").join(member, "node", "left")
    per_class = per_class.withColumn("comp", F.coalesce("comp", "node"))
    lowest = per_class.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = stored(
        per_class.join(lowest, "comp").select("key", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "per-class",
    )
    out = _to_rows(keyed.select("vec_id", "key"), named).unionByName(
        rows.filter(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _to_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id: each row gets its class's; classes of many rows are spread over several tasks."""
    total = named.agg(F.sum("copies").alias("n")).scalar()
    hot = named.filter(F.col("copies") > total * HOT_SHARE).select("key", F.lit(True).alias("hot"))  # at most 1 / HOT_SHARE
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    salts = F.when(F.col("copies") > total * HOT_SHARE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(named.withColumn("salt", F.explode(salts)), ["key", "salt"]).select("vec_id", "n_links", "component_id")
