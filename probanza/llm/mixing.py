"""Mixing sources to target weights by a Pfair schedule.

Documents of a source, in a fixed random order, form blocks of ``block_docs``. With weight w the
k-th block of a source (from 0) is released at floor(k / w) and due at ceil((k + 1) / w); slots go
to the released block with the earliest deadline (ties: the first source). In every prefix of the
slots a source is less than one block away from its share until the first sources end. Decimal
weights are exact; others (square roots) become whole numbers of a unit that moves a share by
less than a millionth of a block over a million blocks, and by 0.3 blocks over 600 million. No
step rounds them again, so nothing adds up from frame to frame, and the number of sources does
not matter.

The slots are cut into frames that are scheduled on their own, in parallel. What each source must
have had at the end T of a frame is worked out from that frame alone: the blocks due by T, and of
those released before T and due after it the first by deadline that fit, until T slots are full. A
block released inside the frame fits where the earliest deadline first rule reaches it by T when it
starts with the frame; blocks released earlier always fit. (Blocks that fit form a matroid whose
greedy choice leaves the fewest early deadlines behind, and the fluid schedule shows that a right
choice exists; so both frames that meet at T can keep all windows.) Nothing is dropped: a source
that ends leaves its later slots out. Once sources with half of the weights have ended, a new
epoch starts with the weights of those that are left, so empty slots stay few.

A source's order is by a hash of the document; hash ranges cut it into buckets, so that a source
with a third of all rows is ranked by many tasks: counts per bucket give each bucket's first rank.
The driver sees one row per source and epoch.

Weights may be given per source (missing ones share what is left); without any, a source's weight
is the square root of its number of documents. Null is a source of its own. Repeated rows keep a
place each; columns of the input are carried as one struct, so names cannot clash; an empty table
gives no rows. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probanza.llm.texts import checked_broadcast, stored

BLOCK_DOCS = 16
#: Slots that one task schedules at a time.
FRAME = 1024
#: Documents that one ranking task is meant to hold.
BUCKET_DOCS = 20_000

_PLAN = "array<struct<start:long,length:long,unit:long,src:array<struct<s:string,a:long,first:long,blocks:long,done:long>>>>"


def units(weights: list[float], blocks: int) -> list[int]:
    """Weights as whole numbers whose products with any number of slots of ``blocks`` blocks fit a long.

    Weights that are short decimals keep their exact ratios; others are moved by less than 2^-bits of the whole.
    """
    bits = 61 - (2 * blocks + 2 * len(weights)).bit_length()
    exact = [Fraction(repr(w)) for w in weights]
    scale = math.lcm(*[e.denominator for e in exact])
    whole = [int(e * scale) for e in exact]
    if sum(whole) >> bits == 0:
        return whole
    total = sum(whole)
    parts = [divmod(e << bits, total) for e in whole]
    out = [max(1, quotient) for quotient, _ in parts]
    short = max(0, (1 << bits) - sum(out))  # given to the largest remainders, so the whole is a power of two
    for i in sorted(range(len(out)), key=lambda i: -parts[i][1])[:short]:
        out[i] += 1
    return out


def had_by(units_: list[int], end: int, frame: int) -> list[int]:
    """Blocks that each source has had when slot ``end`` begins; frames end at multiples of ``frame``."""
    whole = sum(units_)
    start = (end - 1) // frame * frame
    waiting = [(k * whole // a, i, k) for i, a in enumerate(units_) for k in [-(-start * a // whole)]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    upto = [-(-start * a // whole) for a in units_]
    for t in range(start, end):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * whole // units_[i]), i, k))
        if ready:
            _, i, k = heapq.heappop(ready)
            upto[i] = k + 1
            heapq.heappush(waiting, ((k + 1) * whole // units_[i], i, k + 1))
    out = [end * a // whole for a in units_]
    open_ = [
        (-(-(out[i] + 1) * whole // a), i) for i, a in enumerate(units_)
        if end * a % whole and (out[i] * whole // a < start or upto[i] > out[i])
    ]
    for _, i in sorted(open_)[: end - sum(out)]:
        out[i] += 1
    return out


def epochs(names: list[str], units_: list[int], blocks: list[int], frame: int) -> list[dict]:
    """The plan: for each epoch its slots and, for each source left, its unit weight, first block and blocks at the end."""
    had, start, out = [0] * len(names), 0, []
    while left := [i for i in range(len(names)) if had[i] < blocks[i]]:
        whole = sum(units_[i] for i in left)
        gone, length = 0, 0
        for length, i in sorted((-(-(blocks[i] - had[i]) * whole // units_[i]), i) for i in left):
            gone += units_[i]
            if 2 * gone >= whole:
                break
        done = had_by([units_[i] for i in left], length, frame)
        src = [{"s": names[i], "a": units_[i], "first": had[i], "blocks": blocks[i], "done": d} for i, d in zip(left, done, strict=True)]
        out.append({"start": start, "length": length, "unit": whole, "src": src})
        for i, d in zip(left, done, strict=True):
            had[i] += d
        start += length
    return out


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _earliest_first(start: str, stop: str, low: str, high: str | None) -> str:
    """SQL: slots from start to stop, each to the released block with the earliest deadline; counts ``k`` and the list ``out``."""
    limit = f"acc.k[i] < {high}[i] AND " if high else ""
    ready = f"""array_min(transform(src, (x, i) -> IF({limit}acc.k[i] * unit div x.a <= t,
        struct(((acc.k[i] + 1) * unit + x.a - 1) div x.a AS d, i AS i), NULL)))"""
    # Only the second pass, which has limits, keeps the list.
    added = "IF(p.i IS NULL, acc.out, concat(acc.out, array(struct(t AS t, p.i AS i, acc.k[p.i] AS k))))" if high else "acc.out"
    step = f"named_struct('k', transform(acc.k, (n, i) -> IF(i = p.i, n + 1, n)), 'out', {added})"
    return f"""aggregate(sequence({start}, {stop} - 1),
        named_struct('k', {low}, 'out', cast(array() AS array<struct<t:bigint,i:int,k:bigint>>)), (acc, t) -> {_let("p", ready, step)})"""


def _had_by(start: str, end: str) -> str:
    """SQL form of ``had_by`` for the frame from start to end."""
    low = f"transform(src, x -> ({start} * x.a + unit - 1) div unit)"
    opened = f"""filter(transform(src, (x, i) -> IF({end} * x.a % unit <> 0 AND (q[i] * unit div x.a < {start} OR r[i] > q[i]),
        struct(((q[i] + 1) * unit + x.a - 1) div x.a AS d, i AS i), NULL)), y -> y IS NOT NULL)"""
    more = f"cast({end} - aggregate(q, 0L, (sum, n) -> sum + n) AS int)"
    chosen = f"transform(slice(array_sort({opened}), 1, {more}), y -> y.i)"
    counts = _let("c", chosen, "transform(q, (n, i) -> n + IF(array_contains(c, i), 1L, 0L))")
    whole = _let("r", f"{_earliest_first(start, end, low, None)}.k", counts)
    return _let("q", f"transform(src, x -> {end} * x.a div unit)", whole)


def scheduled(spark: SparkSession, plan: list[dict], frame: int) -> DataFrame:
    """(source, k, slot) of every block of the plan; each frame is worked out by itself."""
    frames = sum(-(-e["length"] // frame) for e in plan)
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), _PLAN)))
    rows = rows.withColumn("f", F.expr(f"explode(sequence(0L, (length - 1) div {frame}))"))
    rows = rows.withColumns({
        "t0": F.col("f") * frame, "t1": F.least((F.col("f") + 1) * frame, "length"), "before": F.greatest(F.lit(0), (F.col("f") - 1) * frame)
    }).repartition(max(1, min(frames, 10_000)), "start", "f")
    low = f"IF(t0 = 0, transform(src, x -> 0L), {_had_by('before', 't0')})"
    high = f"IF(t1 = length, transform(src, x -> x.done), {_had_by('t0', 't1')})"
    filled = _let("lo", low, _let("hi", high, f"{_earliest_first('t0', 't1', 'lo', 'hi')}.out"))
    placed = rows.select("start", "src", F.expr(filled).alias("out")).select("start", "src", F.explode("out").alias("o"))
    own = F.expr("src[o.i]")
    placed = placed.select(
        own["s"].alias("s2"), (own["first"] + F.col("o.k")).alias("k2"), (F.col("start") + F.col("o.t")).alias("slot"), own["blocks"].alias("n")
    )
    return placed.filter("k2 < n").drop("n")


def _name(source):
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def target_weights(sizes: dict[str, int], weights: dict[str | None, float] | None) -> dict[str, float]:
    """A weight for every source present; sources without one share what is left equally."""
    if not weights:
        return {s: math.sqrt(n) for s, n in sizes.items()}
    given = {"" if s is None else f"={s}": w for s, w in weights.items()}
    rest = [s for s in sizes if s not in given]
    left = max(0.0, 1.0 - sum(given.values())) / max(1, len(rest))
    return {s: max(given.get(s, left), 1e-9) for s in sizes}


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    frame: int = FRAME,
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns to carry, else all), source_block, slot and place: the mixture is ordered by slot, then place."""
    spark = docs.sparkSession
    sizes = {r["s"]: r["n"] for r in docs.groupBy(_name(F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    wanted = target_weights(sizes, weights)
    blocks = [-(-sizes[s] // block_docs) for s in names]
    plan = epochs(names, units([wanted[s] for s in names], sum(blocks)), blocks, frame) if names else []
    slots = checked_broadcast(stored(scheduled(spark, plan, frame), "slots"))

    bits = max(8, math.ceil(math.log2(max(1, sum(sizes.values()) / BUCKET_DOCS))))
    hashed = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), _name(F.col("source")).alias("s"), hashed.alias("h"),
        F.col("doc_id").alias("id"),
    ).withColumn("b", F.shiftrightunsigned("h", 64 - bits))
    counts = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")
    first = counts.select(F.col("s").alias("s_"), F.col("b").alias("b_"), upto.alias("first"))
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "id")) - 1
    placed = rows.withColumn("r", rank.cast("long"))
    placed = placed.join(first, (F.col("s") == F.col("s_")) & (F.col("b") == F.col("b_"))).withColumn("r", F.col("r") + F.col("first"))
    placed = placed.select("row", "s", F.floor(F.col("r") / block_docs).alias("block"), (F.col("r") % block_docs).alias("place"))
    found = placed.join(slots, (F.col("s") == F.col("s2")) & (F.col("block") == F.col("k2")))
    return found.select("row", F.col("block").alias("source_block"), "slot", "place")


def in_order(mixture: DataFrame) -> DataFrame:
    """The mixture range-partitioned and sorted by slot and place, as it is to be written."""
    parts = int(mixture.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixture.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place")


def mixing_report(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """doc_id, source, source_block, slot and place of every document, in the order of the mixture."""
    return in_order(mixed(docs, weights, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "source_block", "slot", "place"))
