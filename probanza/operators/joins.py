"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.002
SALTS = 64


def hot_keys(rows: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows; at most ``1 / share`` of them."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("rows")).scalar()
    return counts.filter(F.col("_rows") > total * share).select(*on)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str] | str,
    how: str = "left",
    keys_from: DataFrame | None = None,
    share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``fact`` to ``dim``, which has one row (or few) per key.

    Rows of hot keys, and rows without a key, are spread over ``salts`` tasks; the dim rows of the
    hot keys are repeated once per salt. The list of hot keys is bounded by ``1 / share``, so it
    may be broadcast. ``keys_from`` may name a cheaper frame in which to look for hot keys, such as
    the fact table before its text filters.
    """
    on = [on] if isinstance(on, str) else list(on)
    found = hot_keys(fact if keys_from is None else keys_from, on, share)
    hot = F.broadcast(found.withColumn("_hot", F.lit(True)))
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    spread = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int")
    left = fact.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing, spread).otherwise(F.lit(0))
    )
    repeats = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, on, "left").withColumn("_salt", F.explode(repeats))
    return left.drop("_hot").join(right.drop("_hot"), on + ["_salt"], how).drop("_salt")


def with_share(counts: DataFrame, count: str, share: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Add each row's percentage of the total count, over all rows or within ``by``.

    The totals are aggregated apart and joined back, so no window gathers all rows in one task.
    """
    amount = F.col(count).cast("double") * 100
    if not by:
        total = counts.agg(F.sum(count).alias("total")).scalar()
        return counts.withColumn(share, F.round(amount / total, digits))
    totals = counts.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.sum(count).alias("_total"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return counts.join(totals, same).select(*counts.columns, F.round(amount / F.col("_total"), digits).alias(share))
