"""Primary keys, foreign keys and join discovery.

Every operator first counts rows per key. That aggregate combines on the map side, so joins only
ever see one row per key and a key that fills a third of a table is one row like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.session import written

Edge = tuple[str, str, str, str]


def rows_per_key(df: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """(join_key, rows); rows without a key are counted under a NULL key, which never joins."""
    return df.groupBy(C.key_of(F.col(f"`{key}`")).alias("join_key")).agg(F.count(F.lit(1)).alias(rows))


# --- primary keys ---------------------------------------------------------------------------------
def key_profile(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """Rows, non-blank keys, distinct keys and repeats of a candidate key."""
    known = F.col("join_key").isNotNull()
    totals = rows_per_key(df, key).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(known, F.col("rows"))), F.lit(0)).alias("non_null_rows"),
        F.count("join_key").alias("distinct_values"),
    )
    repeats = F.col("non_null_rows") - F.col("distinct_values")
    return totals.select(
        F.lit(dataset).alias("dataset"),
        F.lit(key).alias("candidate_primary_key"),
        "*",
        repeats.alias("duplicate_rows"),
        C.pct(repeats, F.col("total_rows")).alias("duplicate_key_rate_pct"),
    )


def key_profiles(tables: dict[str, DataFrame], keys: dict[str, str], label: str | None = None) -> DataFrame:
    """The profiles of all tables' keys; with a ``label`` each is written under it before the next one is computed."""
    return reduce(DataFrame.unionByName, [_in_turn(key_profile(tables[t], t, k), label) for t, k in keys.items() if t in tables])


def _in_turn(df: DataFrame, label: str | None) -> DataFrame:
    """``df``, written at once where a label is given, so its shuffle does not lie on disk beside the next one's."""
    return df if label is None else written(df, label)


def duplicate_validation(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Total, distinct, and their difference per table; missing keys count as duplicates here."""
    parts = []
    for t, key in keys.items():
        counts = tables[t].groupBy(F.col(f"`{key}`").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("k").alias("distinct_pk")).select(
                F.lit(t).alias("dataset"),
                "total_rows",
                "distinct_pk",
                (F.col("total_rows") - F.col("distinct_pk")).alias("duplicate_pk_rows"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def exact_duplicate_rows(df: DataFrame, dataset: str) -> DataFrame:
    """Rows beyond the first of every group of equal rows, by SHA-256 of the whole row."""
    whole = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    counts = df.select(whole.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_rows"),
    ).select(F.lit(dataset).alias("dataset"), "*")


def id_repeats(df: DataFrame, dataset: str) -> DataFrame:
    """Repeated occurrences of identifiers, per identifier column (foreign keys repeat by nature)."""
    from probanza.operators.profile import named, value_histogram

    ids = named(df.columns, vocab.ID_COLUMN)
    counts = value_histogram(df, ids, lambda c: C.key_of(c)).filter(F.col("value").isNotNull())
    return counts.groupBy(F.lit(dataset).alias("dataset"), "column_name").agg(
        F.sum(F.col("rows") - 1).alias("id_repeat_occurrences")
    )


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Identifier columns of a column profile without gaps; unique ones may be primary keys."""
    unique = F.col("distinct_values") == F.col("rows")
    return profile.filter(C.matches("column_name", vocab.ID_COLUMN) & (F.col("missing_rows") == 0)).select(
        "dataset",
        "column_name",
        "distinct_values",
        C.pct(F.col("distinct_values"), F.col("rows"), 4).alias("unique_pct"),
        unique.alias("candidate_primary_key"),
    )


# --- foreign keys ---------------------------------------------------------------------------------
def edge_facts(tables: dict[str, DataFrame], edges: list[Edge] | tuple[Edge, ...], label: str | None = None) -> DataFrame:
    """One row of counts per edge (child, child key, parent, parent key); one shuffle per parent key.

    With a ``label`` the rows of each parent are written under it before the next parent's are computed.
    """
    by_parent: dict[tuple[str, str], list[Edge]] = {}
    for edge in dict.fromkeys(edges):
        by_parent.setdefault(edge[2:], []).append(edge)
    return reduce(DataFrame.unionByName, [_in_turn(_facts_of_parent(tables, p, es), label) for p, es in by_parent.items()])


def _facts_of_parent(tables: dict[str, DataFrame], parent: tuple[str, str], edges: list[Edge]) -> DataFrame:
    """Counts of all edges to one parent key.

    The key columns of the parent and of all its children become (key, source) rows; rows per key
    and source combine on the map side. A blank key is counted under NULL and matches nothing.
    """
    sources = [parent, *((child, child_key) for child, child_key, _, _ in edges)]
    stacked = [
        tables[t].select(C.key_of(F.col(f"`{key}`")).alias("join_key"), F.lit(i).alias("source"))
        for i, (t, key) in enumerate(sources)
    ]
    per_key = reduce(DataFrame.unionByName, stacked).groupBy("join_key").agg(
        *(C.count_where(F.col("source") == i).alias(f"n{i}") for i in range(len(sources)))
    )
    known, held = F.col("join_key").isNotNull(), F.col("n0")

    def rows(name: str, n: Column, condition: Column | None = None) -> Column:
        counted = n if condition is None else F.when(condition, n)
        return F.coalesce(F.sum(counted), F.lit(0)).alias(name)

    totals = [
        rows("parent_rows", held),
        rows("parent_non_null", held, known),
        C.count_where(known & (held > 0)).alias("parent_distinct"),
    ]
    facts = []
    for i, edge in enumerate(edges, 1):
        n = F.col(f"n{i}")
        here = known & (n > 0)
        measures = {
            "child_rows": rows(f"child_rows_{i}", n),
            "non_null_child_keys": rows(f"non_null_{i}", n, known),
            "distinct_child_keys": C.count_where(here).alias(f"distinct_{i}"),
            "matched_distinct_keys": C.count_where(here & (held > 0)).alias(f"matched_{i}"),
            "matched_rows": rows(f"matched_rows_{i}", n, known & (held > 0)),
            "repeated_child_keys": C.count_where(known & (n > 1)).alias(f"repeated_{i}"),
        }
        names = zip(("child_dataset", "child_key", "parent_dataset", "parent_key"), edge)
        totals += measures.values()
        columns = ("child_rows", "non_null", "distinct", "matched", "matched_rows", "repeated")
        facts.append(
            F.struct(
                *(F.lit(v).alias(c) for c, v in names),
                *(F.col(f"{c}_{i}").alias(m) for c, m in zip(columns, measures)),
                "parent_rows",
                "parent_non_null",
                "parent_distinct",
            )
        )
    return per_key.agg(*totals).select(F.inline(F.array(*facts)))


def _usable(tables: dict[str, DataFrame], edge: Edge) -> bool:
    child, child_key, parent, parent_key = edge
    return (
        child in tables
        and parent in tables
        and child_key in tables[child].columns
        and parent_key in tables[parent].columns
    )


def fk_profiles(tables: dict[str, DataFrame], edges: tuple[Edge, ...], label: str | None = None) -> DataFrame:
    """Match and orphan rates over distinct keys, and the parent's duplicate rate, per usable edge.

    Without any non-blank child key the rates are NULL (unknown), never 0. ``label`` is that of ``edge_facts``.
    """
    facts = edge_facts(tables, [e for e in edges if _usable(tables, e)], label)
    distinct, matched = F.col("distinct_child_keys"), F.col("matched_distinct_keys")
    child = F.concat_ws(".", "child_dataset", "child_key")
    parent = F.concat_ws(".", "parent_dataset", "parent_key")
    return facts.select(
        F.concat(child, F.lit("->"), parent).alias("record_id"),
        "child_dataset",
        "child_key",
        "parent_dataset",
        "parent_key",
        F.col("child_rows").alias("child_row_count"),
        "non_null_child_keys",
        "distinct_child_keys",
        "matched_distinct_keys",
        (distinct - matched).alias("unmatched_distinct_keys"),
        C.pct_or_null(matched, distinct).alias("match_rate_pct"),
        C.pct_or_null(distinct - matched, distinct).alias("orphan_rate_pct"),
        C.pct(F.col("parent_non_null") - F.col("parent_distinct"), F.col("parent_rows")).alias(
            "parent_duplicate_key_rate_pct"
        ),
        F.when(distinct == 0, "UNKNOWN_NO_NONNULL_KEYS").otherwise("KNOWN").alias("rate_status"),
        F.when(distinct == 0, "NO_NONNULL_CHILD_KEYS").otherwise("OBSERVED RELATIONSHIP").alias("status"),
    )


def fk_profile(tables: dict[str, DataFrame], edge: Edge) -> DataFrame:
    return fk_profiles(tables, (edge,))


def fk_row_profiles(tables: dict[str, DataFrame], edges: tuple[Edge, ...]) -> DataFrame:
    """Child rows that match, miss, or have no key; a missing table or column is MISSING EVIDENCE."""
    filled, matched = F.col("non_null_child_keys"), F.col("matched_rows")
    blank = F.col("child_rows") - filled
    facts = edge_facts(tables, [e for e in edges if _usable(tables, e)]).select(
        F.col("child_dataset").alias("child_table"),
        F.col("child_key").alias("child_column"),
        F.col("parent_dataset").alias("parent_table"),
        F.col("parent_key").alias("parent_column"),
        "child_rows",
        "matched_rows",
        (filled - matched).alias("orphan_rows"),
        C.pct(filled - matched, filled, 4).alias("orphan_rate"),
        blank.alias("null_rows"),
        C.pct(blank, F.col("child_rows"), 4).alias("null_rate"),
        F.lit("observed").alias("status"),
    )
    absent = [(*e, "MISSING EVIDENCE") for e in edges if not _usable(tables, e)]
    if not absent:
        return facts
    schema = "child_table string, child_column string, parent_table string, parent_column string, status string"
    return facts.unionByName(facts.sparkSession.createDataFrame(absent, schema), allowMissingColumns=True)


def relationship_status(tables: dict[str, DataFrame], edges: tuple[Edge, ...]) -> DataFrame:
    """Match rate, share of repeated child keys, and VERIFIED from 95 per cent on, per usable edge."""
    facts = edge_facts(tables, [e for e in edges if _usable(tables, e)])
    distinct, matched = F.col("distinct_child_keys"), F.col("matched_distinct_keys")
    verified = (distinct > 0) & (matched >= distinct * 0.95)
    return facts.select(
        "child_dataset",
        "child_key",
        "parent_dataset",
        "parent_key",
        matched.alias("matched_child_keys"),
        (distinct - matched).alias("unmatched_child_keys"),
        C.pct(matched, distinct, 4).alias("match_rate_pct"),
        C.pct(distinct - matched, distinct, 4).alias("orphan_rate_pct"),
        C.pct(F.col("repeated_child_keys"), distinct, 4).alias("duplicate_join_key_rate_pct"),
        F.when(verified, "VERIFIED RELATIONSHIP").otherwise("LIKELY RELATIONSHIP").alias("status"),
    )


def unmatched_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys that the parent lacks, with their rows."""
    known = rows_per_key(child, child_key).filter(F.col("join_key").isNotNull())
    return known.join(rows_per_key(parent, parent_key).select("join_key"), "join_key", "left_anti")


def matched_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct child keys that the parent has, with their rows."""
    known = rows_per_key(child, child_key).filter(F.col("join_key").isNotNull())
    return known.join(rows_per_key(parent, parent_key).select("join_key"), "join_key", "left_semi")


def key_reconciliation(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, prefix: str
) -> DataFrame:
    """Distinct keys on both sides, exact matches, and matching pairs once a prefix is removed.

    Pairs are counted as products of the keys per bare key, so they are never produced. A key
    column that the data lacks makes every figure NULL (unknown).
    """
    spark = child.sparkSession
    figures = ("distinct_child_keys", "distinct_parent_keys", "exact_matches", "normalized_matches")
    if child_key not in child.columns or parent_key not in parent.columns:
        return spark.range(1).select(
            *(F.lit(None).cast("bigint").alias(f) for f in figures), F.lit("UNKNOWN_MISSING_COLUMN").alias("status")
        )

    def keys(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select(F.col(f"`{key}`").cast("string").alias("k")).filter("k is not null").distinct().select(
            "k", F.lit(side).alias("side")
        )

    both = keys(child, child_key, "child").unionByName(keys(parent, parent_key, "parent"))
    on_child, on_parent = F.col("side") == "child", F.col("side") == "parent"
    per_key = both.groupBy("k").agg(
        C.count_where(on_child).alias("child"), C.count_where(on_parent).alias("parent")
    )
    per_bare_key = per_key.groupBy(C.without_prefix("k", prefix).alias("bare")).agg(
        F.sum("child").alias("child"),
        F.sum("parent").alias("parent"),
        F.sum(F.col("child") * F.col("parent")).alias("exact"),
    )
    return per_bare_key.agg(
        F.coalesce(F.sum("child"), F.lit(0)).alias("distinct_child_keys"),
        F.coalesce(F.sum("parent"), F.lit(0)).alias("distinct_parent_keys"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_matches"),
        F.coalesce(F.sum(F.col("child") * F.col("parent")), F.lit(0)).alias("normalized_matches"),
    ).select("*", F.lit("MEASURED").alias("status"))


def multiplicity(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Histogram of children per matched parent, with the match rate and the kind of relationship."""
    per_key = rows_per_key(child, child_key)
    known = per_key.filter(F.col("join_key").isNotNull())
    matched = matched_keys(child, child_key, parent, parent_key)
    total = known.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    hit = matched.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    most = matched.agg(F.max("rows").alias("n")).scalar()
    histogram = matched.groupBy(F.col("rows").alias("children_per_parent")).agg(F.count(F.lit(1)).alias("parents"))
    return histogram.select(
        "children_per_parent",
        "parents",
        total.alias("child_nonempty"),
        hit.alias("matched"),
        C.pct(hit, total, 4).alias("join_success_pct"),
        F.when(most > 1, "one-to-many").otherwise("one-to-one-or-sparse").alias("relationship"),
    )


#: Tables that one word of a value's bitmap tells apart.
WORD = 62
#: Longer identifiers travel as digests of this many bytes.
LONG_KEY = 64


def discover_joins(tables: dict[str, DataFrame], pattern: str = vocab.ID_COLUMN) -> DataFrame:
    """Every ordered pair of tables whose equally named identifiers share values.

    All identifiers are stacked once. Each value gets a bitmap of the tables that hold it, as one word for
    every ``WORD`` tables, in a plain hash aggregate on the map side and after one shuffle. Counting the
    bitmaps leaves a frame bounded by the number of table sets; it is written once, and only it is expanded
    into pairs.
    """
    from probanza.operators.profile import named

    names = sorted(tables)
    words = [f"_w{i}" for i in range(-(-len(names) // WORD))]
    stacked = []
    for i, t in enumerate(names):
        ids = named(tables[t].columns, pattern)
        if ids:
            cells = tables[t].select(*(C.key_of(F.col(f"`{c}`")).alias(c) for c in ids))
            long = cells.unpivot([], [F.col(f"`{c}`") for c in ids], "key_column", "value").filter("value is not null")
            value = F.when(F.length("value") <= LONG_KEY, F.col("value")).otherwise(F.sha2("value", 256)).alias("value")
            bits = [F.lit(1 << i % WORD if k == i // WORD else 0).cast("long").alias(w) for k, w in enumerate(words)]
            stacked.append(long.select("key_column", value, *bits))
    held = reduce(DataFrame.unionByName, stacked).groupBy("key_column", "value").agg(*(F.bit_or(w).alias(w) for w in words))
    counted = written(held.groupBy("key_column", *words).agg(F.count(F.lit(1)).alias("n")), "table-sets")
    holds = [F.when(F.col(words[i // WORD]).bitwiseAND(1 << i % WORD) != 0, F.lit(t)) for i, t in enumerate(names)]
    sets = counted.select("key_column", "n", F.array_compact(F.array(*holds)).alias("members"))
    sides = sets.select("key_column", "n", F.explode("members").alias("child"), "members")
    sizes = sides.groupBy("key_column", "child").agg(F.sum("n").alias("distinct_keys"))
    pairs = (
        sides.select("key_column", "n", "child", F.explode("members").alias("parent"))
        .filter(F.col("child") != F.col("parent"))
        .groupBy("key_column", "child", "parent")
        .agg(F.sum("n").alias("matched_distinct"))
    )
    child_sizes = sizes.withColumnRenamed("distinct_keys", "child_distinct")
    parent_sizes = sizes.select("key_column", F.col("child").alias("parent"), F.col("distinct_keys").alias("parent_distinct"))
    found = pairs.join(child_sizes, ["key_column", "child"]).join(parent_sizes, ["key_column", "parent"])
    return found.select(
        "child",
        "key_column",
        "parent",
        "child_distinct",
        "parent_distinct",
        "matched_distinct",
        (F.col("child_distinct") - F.col("matched_distinct")).alias("unmatched_distinct"),
        C.pct(F.col("matched_distinct"), F.col("child_distinct"), 4).alias("join_success_pct"),
    )


def join_order() -> list:
    """Best containment first, then names."""
    return [F.desc("join_success_pct"), F.asc("child"), F.asc("key_column"), F.asc("parent")]


