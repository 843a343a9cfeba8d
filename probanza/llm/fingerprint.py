"""Document fingerprints from closed syncmers over words.

Of all runs of ``K`` words a text keeps those whose smallest run of ``S`` words (by hash) is the
first or the last within them. Whether a run is kept depends on its own words only, so shared
passages give the same anchors in any surroundings. A fingerprint holds all anchors of the text,
every occurrence with its word position, in text order; an anchor is a 64-bit hash.

The likeness of two fingerprints compares all anchors of both, the n-th occurrence in one text with
the n-th in the other: the shared ones count where they keep their order from one to the next in
both texts, and their share is given as twice the shared part over the sum of both (0: nothing in
common, 1: equal). Both lists are sorted together by hash, so the work grows with their length, not
with its square.

A text shorter than ``K`` words has one anchor, the hash of the whole text at position 0; null is
an empty text. Equal texts have equal fingerprints. Only DataFrame functions are used.

``with_next`` gives every document the next one by descending id. Ranges of ids are dealt out by
bounds taken from the ids; the first document of each range also closes the range before it, so
no window spans more than one range. Null ids come last, equal ids are ordered by text; after the
last document comes the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
_SPACE = "[ \\t-\\r]+"


def with_anchors(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: array of (p, h, n), all anchors of the text column in text order; n counts equal ones from 0."""
    words, inner, picked, runs, nth = (f"{out}_{x}" for x in ("words", "inner", "picked", "runs", "nth"))
    n = F.size(words)
    rows = rows.withColumn(words, F.array_remove(F.split(text, _SPACE), ""))
    hashes = F.transform(F.sequence(F.lit(1), n - (S - 1)), lambda i: F.xxhash64(F.slice(words, i, S)))
    rows = rows.withColumn(inner, F.when(n >= K, hashes))
    last = K - S

    def closed(i: Column) -> Column:
        first, end = F.get(inner, i), F.get(inner, i + last)
        return F.least(first, end) <= F.least(*[F.get(inner, i + j) for j in range(1, last)])

    starts = F.filter(F.sequence(F.lit(0), n - K), closed)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, K)).alias("h"), i.alias("p")))
    rows = rows.withColumn(picked, F.when(n >= K, F.sort_array(hashed)))
    # Where runs of equal hashes begin; each run counts from 0.
    begins = F.transform(picked, lambda x, k: F.when((k == 0) | (F.get(picked, k - 1)["h"] != x["h"]), k))
    rows = rows.withColumn(runs, F.filter(begins, lambda k: k.isNotNull()))
    after = lambda j: F.coalesce(F.get(runs, j + 1), F.size(picked))
    rows = rows.withColumn(nth, F.flatten(F.transform(runs, lambda k, j: F.sequence(F.lit(0), after(j) - k - 1))))
    placed = F.zip_with(picked, nth, lambda x, k: F.struct(x["p"].alias("p"), x["h"].alias("h"), k.alias("n")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64(text).alias("h"), F.lit(0).alias("n")))
    rows = rows.withColumn(out, F.when(F.size(picked) > 0, F.sort_array(placed)).otherwise(whole))
    return rows.drop(words, inner, picked, runs, nth)


def as_text(anchors: str) -> Column:
    """A fingerprint as a string: position and hash of each anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.concat(x["p"].cast("string"), F.lit(":"), F.lower(F.hex(x["h"])))), " ")


def with_likeness(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with the likeness of two anchor columns."""
    both, pairs = f"{out}_both", f"{out}_pairs"

    def sided(anchors: str, side: int) -> Column:
        return F.transform(anchors, lambda x: F.struct(
            x["h"].alias("h"), x["n"].alias("n"), F.lit(side).alias("side"), x["p"].alias("p")))

    def shared(x: Column, k: Column) -> Column:
        after = F.get(both, k + 1)
        return F.when((after["h"] == x["h"]) & (after["n"] == x["n"]), F.struct(x["p"].alias("a"), after["p"].alias("b")))

    rows = rows.withColumn(both, F.sort_array(F.concat(sided(a, 0), sided(b, 1))))
    found = F.filter(F.transform(both, shared), lambda x: x.isNotNull())
    rows = rows.withColumn(pairs, F.sort_array(found))  # in the order of the first text
    kept = F.size(F.filter(pairs, lambda x, k: (k == 0) | (x["b"] > F.get(pairs, k - 1)["b"])))
    share = kept / (F.size(both) - F.size(pairs))
    return rows.withColumn(out, 2 * share / (1 + share)).drop(both, pairs)


def with_next(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, Window]:
    """doc_id, text, next_text of every document and its range's window; rows with ``closing`` are to be dropped."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.max("doc_id").alias("m"), F.percentile_approx("doc_id", [*shares, 1.0]).alias("q")).first()
    bounds = sorted({b for b in [*(found["q"] or []), found["m"]] if b is not None}, reverse=True)
    last = max(0, len(bounds) - 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if bounds:
        # Binary search for the last bound (they fall) that is not below the id.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, last.bit_length())))])
        table = F.lit(bounds)
        search = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            F.coalesce(F.get(table, at + step) >= F.col("doc_id"), F.lit(False)), at + step).otherwise(at))
        rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), last).otherwise(search))
        head = F.coalesce(F.get(table, F.col("range")) == F.col("doc_id"), F.lit(False))
        own = F.struct(F.col("range"), F.lit(False).alias("closing"))
        before = F.struct(F.when(F.col("range") == 0, last).otherwise(F.col("range") - 1).alias("range"), F.lit(True).alias("closing"))
        rows = rows.select("doc_id", "text", F.explode(F.when(head, F.array(own, before)).otherwise(F.array(own))).alias("to"))
        rows = rows.select("doc_id", "text", "to.range", "to.closing")
    else:
        rows = rows.withColumns({"range": F.lit(0), "closing": F.lit(False)})
    window = Window.partitionBy("range").orderBy("closing", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(window), F.lit(""))), window


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last third replaced by the beginning of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, window = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = with_anchors(with_anchors(rows, "text", "own"), "edited", "other")
    rows = rows.withColumn("following", F.coalesce(F.lead("own").over(window), F.col("own")))
    rows = rows.filter(~F.col("closing"))
    rows = with_likeness(with_likeness(rows, "own", "other", "near_edited"), "own", "following", "near_next")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), "near_edited", "near_next",
    )
