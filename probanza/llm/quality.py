"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every text is measured in its own row: words, characters of words, symbols, marks, repeated lines,
and words that lie in 8-word windows found twice or more. A text fails the base rules with fewer
than 20 words or with more than 30 % repeated words. The other rules have no fixed cutoffs: rates
per thousand are put into log-linear histograms (exact below 64, then 32 buckets to a power of
two, so a quantile is off by 1/32 at most), which merge by adding counts. They are built on the
map side per (language, source), summed up to languages and to the whole corpus, and a group with
fewer than ``LEAST`` documents uses the next wider one. A text is rejected where a rate lies
outside the quartiles by more than ``REACH`` times their distance and a slack.

The measured rows are written once, then joined with the thresholds; the join is Spark's choice by
the written size of the thresholds, and a hot source is only ever counted, never gathered.

Null text has no words and fails the base rules. Null languages and sources are groups of their
own. Repeated rows and null ids are measured like others; other columns are carried as one struct,
so names cannot clash; an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probanza.llm.texts import stored

LEAST = 50
REACH = 3
#: Rate and slack per thousand words (or lines, for repeated lines; characters, for length).
SLACK = {"length": 1000, "symbols": 100, "marks": 200, "dup_lines": 300, "repeats": 200}
_SPACE = "[ \\t-\\r]+"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def _bucket(x: Column) -> Column:
    """The lower edge of the sketch's bucket: the six highest binary digits are kept."""
    shift = F.length(F.bin(x)) - 6
    return F.when(x < 64, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift))


def _covered(windows: Column) -> Column:
    """Words covered by 8-word windows that begin at these ascending places."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(-8).alias("last"))
    step = lambda a, i: F.struct((a["total"] + F.least(F.lit(8), i - a["last"])).alias("total"), i.alias("last"))
    return F.aggregate(windows, zero, step, lambda a: a["total"])


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to carry, else all), language, source and the measures of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"),
    )
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", _SPACE), ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0),
        "n_symbols": count("#*$%&|<>").cast("long"), "n_marks": count("!?").cast("long"),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long"),
    })
    n = F.size("words")
    rows = rows.withColumns({
        "n_words": n.cast("long"), "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "hashes": F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("words", i, 8))))
        .otherwise(F.array().cast("array<long>")),
    })
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(repeated, pairs))
    again = F.filter(
        "pairs",
        lambda x, k: (F.get("pairs", k - 1)["h"] == x["h"]) | (F.get("pairs", k + 1)["h"] == x["h"]),
    )
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_covered(places), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("row", "lang", "source", *_MEASURES, failed.alias("base_failed"))


def _rates() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    over = lambda a, b: F.floor(F.lit(1000) * F.col(a) / b).cast("long")
    return {
        "length": over("word_chars", words), "symbols": over("n_symbols", words), "marks": over("n_marks", words),
        "dup_lines": over("n_dup_lines", lines), "repeats": over("n_repeat_words", words),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """Histogram counts per language, source, rate and bucket, of the texts that pass the base rules."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), _bucket(v).alias("bucket")) for k, v in _rates().items()])
    cells = rows.filter(~F.col("base_failed")).select("lang", "source", F.explode(rates).alias("cell"))
    return cells.groupBy("lang", "source", "cell.rate", "cell.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source, and for every rate its fences (lo_, hi_), from the narrowest group that is large enough."""
    level = F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None)).alias("lang"),
                 (F.col("source") if k < 1 else F.lit(None)).alias("source"))
        for k in range(3)
    ]))
    merged = counts.select(level.alias("g"), "rate", "bucket", "n").groupBy("g", "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("g", "rate")
    merged = merged.withColumns({
        "up_to": F.sum("n").over(whole.orderBy("bucket")), "all": F.sum("n").over(whole),
    })
    quartiles = merged.groupBy("g", "rate").agg(
        F.min(F.when(4 * F.col("up_to") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("up_to") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"), F.max("all").alias("n"),
    )
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("rate")]
    reach = REACH * (F.col("q3") - F.col("q1")) + slack
    fences = quartiles.select("g", "rate", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"), "n")
    wide = fences.groupBy("g").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("rate") == r, F.col(e))).alias(f"{e}_{r}") for r in SLACK for e in ("lo", "hi")],
    ).select("g.*", "n", *[f"{e}_{r}" for r in SLACK for e in ("lo", "hi")])
    edges = F.struct(*[F.col(f"{e}_{r}") for r in SLACK for e in ("lo", "hi")])
    own = wide.filter("level = 0").select("lang", "source", F.when(F.col("n") >= LEAST, edges).alias("own"))
    lang = wide.filter("level = 1").select(F.col("lang").alias("l"), F.when(F.col("n") >= LEAST, edges).alias("by_lang"))
    every = wide.filter("level = 2").select(edges.alias("every"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every), F.lit(True), "left")
    return joined.select("lang", "source", F.coalesce("own", "by_lang", "every").alias("fence")).select("lang", "source", "fence.*")


def judged(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row``, the measures, base_failed and kept of every document."""
    rows = stored(measured(docs, carry), "quality")
    fences = stored(thresholds(sketches(rows)), "fences").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{e}_{r}" for r in SLACK for e in ("lo", "hi")]
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = ~F.col("base_failed")
    for name, value in _rates().items():
        fits = value <= F.col(f"hi_{name}")
        inside = inside & F.coalesce(fits & (value >= F.col("lo_length")) if name == "length" else fits, F.lit(True))
    return rows.join(fences, same, "left").select("row", *_MEASURES, "base_failed", inside.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    return judged(docs, ["doc_id"]).select("row.doc_id", *_MEASURES, "base_failed", "kept")
