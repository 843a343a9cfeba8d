"""URL filters: host and path rules, and a ratio of two character language models for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains where the url's path
begins with the rule's, and the longest rule decides. URLs that a rule decides teach two smoothed
variable-order Markov models, one of allowed and one of blocked URLs: after each context of up to
``ORDER`` bytes the next byte's probability is its count mixed with the estimate of the next
shorter context.

The counts are exact, whatever the input holds: a byte with its ``ORDER`` predecessors (or the
begin of the URL) is one integer of 9 bits a symbol, and a table holds each integer that occurs in
any URL with its counts in both models, aggregated in the tasks first. Shorter contexts are sums
of that table. A level's counts are summed by context and joined to the level below on their last
symbols, so a key meets at most 257 rows; each level is written, so that no plan holds more than
one. The last level gives each integer the difference of both log-likelihoods, in units of 2^-32,
and a URL's score is their sum over its bytes, divided by their number: distinct URLs (by a hash of
128 bits) are scored once, by a join on the integer that is broadcast below a checked size only. A
logistic curve fitted to the scores of the URLs of a fold that the models never saw, each weighted
by its pages, turns the score into a probability of being allowed, and URLs without a rule are
allowed from a half on.

A null or empty url, or one without ``://``, has an empty host and path and no rule; its verdict is
the method's (a null or an empty url scores 0). Where rules decide no URL the models are empty and
everything else is allowed. Repeated rows and null ids stay; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probanza.llm.texts import blocks, checked_broadcast, stored
from probanza.operators.joins import lookup_join

ORDER = 5
#: Bits of a symbol: 0 before the begin of a URL, else a byte and one.
SYMBOL = 9
#: Weight of the shorter context's estimate, in counts.
BACKOFF = 4.0
#: The share of the ruled URLs kept for calibration, as a remainder of four of crc32(url).
FOLD = 3
#: Scores are summed as whole numbers of this unit, so their sums do not depend on the order of rows.
UNIT = 1 << 32
#: Bytes of URLs that are turned into grams at a time.
GRAM_BYTES = 250_000

Rule = tuple[str, str, str]  # verdict, host, path


def parse_rules(rules: dict[str, str]) -> list[Rule]:
    """``{"example.com/en/": "block"}`` as (verdict, host, path), longest first."""
    cut = [(v, *r.partition("/")[::2]) for r, v in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0]))]
    return [(verdict, host, f"/{path}") for verdict, host, path in cut]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` in lower case, and the path behind it."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct of rule and verdict; null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in reversed(rules):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all URLs: it and its predecessors as one integer, and its URL's row."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls.to_pylist()]
    sizes = np.array([len(r) + ORDER for r in raw], dtype=np.int64)
    joined = np.frombuffer(b"".join(b"\0" * ORDER + r for r in raw), dtype=np.uint8).astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(joined), dtype=bool)
    for j in range(ORDER):
        real[starts + j] = False
    joined[~real] = 0
    at = np.flatnonzero(real)
    grams = np.zeros(len(at), dtype=np.int64)
    for j in range(ORDER + 1):
        grams |= joined[at - j] << (SYMBOL * j)
    return grams, np.repeat(np.arange(len(raw)), sizes)[at]


def gram_counts(urls: DataFrame) -> DataFrame:
    """(g, good, bad) of every gram of all rows (url, label): rows of label 1 and 0 count as good and bad, others not."""

    def count(batches):
        for batch in batches:
            for block in blocks(batch, "url", GRAM_BYTES):
                grams, owner = _grams(block.column("url"))
                label = block.column("label").to_numpy(zero_copy_only=False)[owner]
                found, where = np.unique(grams, return_inverse=True)
                sums = [np.bincount(where, weights=label == v, minlength=len(found)).astype(np.int64) for v in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["g", "good", "bad"])

    rows = urls.select("url", "label").mapInArrow(count, "g long, good long, bad long")
    return rows.groupBy("g").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def gram_ratios(counts: DataFrame) -> DataFrame:
    """(g, ratio): log-likelihood of the last byte in the model of good URLs less that in the other, in units.

    ``counts`` is a written table, and so is every level on the way.
    """
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    levels = [counts]
    for k in range(ORDER - 1, -1, -1):
        level = levels[0].groupBy(F.col("g").bitwiseAND((1 << SYMBOL * (k + 1)) - 1).alias("g")).agg(*sums)
        levels.insert(0, stored(level, f"url-grams-{k}"))
    shorter = None
    context = Window.partitionBy(F.shiftright("g", SYMBOL))
    for k, level in enumerate(levels):
        known = level.withColumns({f"n_{m}": F.sum(m).over(context) for m in ("good", "bad")})
        if shorter is None:
            known = known.withColumns({"p_good": F.lit(1 / 256), "p_bad": F.lit(1 / 256)})
        else:
            shorter = stored(shorter, f"url-odds-{k - 1}")
            known = known.withColumn("last", F.col("g").bitwiseAND((1 << SYMBOL * k) - 1)).join(shorter, "last")
        shorter = known.select(
            F.col("g").alias("last"),
            *[((F.col(m) + BACKOFF * F.col(f"p_{m}")) / (F.col(f"n_{m}") + BACKOFF)).alias(f"p_{m}") for m in ("good", "bad")],
        )
    return shorter.select(F.col("last").alias("g"), F.round((F.log("p_good") - F.log("p_bad")) * UNIT).cast("long").alias("ratio"))


def url_scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(h1, h2, score) of every distinct URL that has a byte; ``urls`` has h1, h2 and url."""

    def spread(batches):
        for batch in batches:
            for block in blocks(batch, "url", GRAM_BYTES):
                grams, owner = _grams(block.column("url"))
                keys = [block.column(h).take(pa.array(owner)) for h in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(grams)], names=["h1", "h2", "g"])

    once = urls.groupBy("h1", "h2").agg(F.first("url").alias("url"))
    found = once.mapInArrow(spread, "h1 long, h2 long, g long").join(checked_broadcast(ratios), "g")
    mean = F.sum("ratio") / F.count(F.lit(1)) / UNIT
    return found.groupBy("h1", "h2").agg(mean.alias("score"))


def _logistic(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighing the same, by Newton's method."""
    if not good.any() or good.all():
        return 1.0, 0.0
    for value in (True, False):
        weight = np.where(good == value, weight / weight[good == value].sum(), weight)
    x, beta = np.stack([score, np.ones_like(score)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        gradient = x @ (weight * (good - p)) - 1e-3 * beta
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(beta[0]), float(beta[1])


def calibrated(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from (allowed, score, pages) of the held-out URLs."""
    bins = scored.groupBy("allowed", F.round("score", 2).alias("score")).agg(F.sum("pages").alias("pages")).collect()
    if not bins:
        return 1.0, 0.0
    # At most the bins of a bounded score, for two classes.
    return _logistic(
        np.array([r["score"] for r in bins]), np.array([r["allowed"] for r in bins]), np.array([float(r["pages"]) for r in bins])
    )


def url_filter(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, with the score and probability of the models."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"), parse_rules(rules)))
    rows = rows.withColumn("fold", F.crc32(F.col("url").cast("binary")) % 4 == FOLD)
    some = F.length("url") > 0
    hashes = [F.when(some, F.xxhash64(F.lit(seed), F.col("url"))).alias(h) for h, seed in (("h1", 1), ("h2", 2))]
    rows = rows.select("*", *hashes)

    label = F.when(F.col("found").isNull() | F.col("fold"), -1).otherwise((F.col("found.verdict") == "allow").cast("int")).cast("int")
    counts = stored(gram_counts(rows.filter(some).select("url", label.alias("label"))), "url-grams")
    ratios = stored(gram_ratios(counts), "url-ratios")
    scores = stored(url_scores(rows.filter(some).select("h1", "h2", "url"), ratios), "url-scores")

    allowed = F.first(F.col("found.verdict") == "allow").alias("allowed")
    held_out = rows.filter("fold AND found IS NOT NULL").groupBy("h1", "h2").agg(allowed, F.count(F.lit(1)).alias("pages"))
    keyed = rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"), "h1", "h2")
    scored = lookup_join(keyed, scores, ["h1", "h2"]).withColumn("score", F.coalesce("score", F.lit(0.0)))
    slope, offset = calibrated(held_out.join(scores, ["h1", "h2"]))
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(offset))))
    own = F.when(chance >= 0.5, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score", chance.alias("allowed_probability")
    )
