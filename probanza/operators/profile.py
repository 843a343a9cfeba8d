"""Column and table profiles.

Counts over rows come from one aggregate per table. Distinct values come from a value histogram
(column, value, rows), which combines on the map side, so a value that fills a third of a table
reaches the shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from probanza.functions import columns as C
from probanza.functions import vocab

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


# --- names ----------------------------------------------------------------------------------------
def named(columns: list[str], pattern: str) -> list[str]:
    """Column names that match a pattern, case ignored."""
    import re

    return [c for c in columns if re.search(pattern, c, re.I)]


def columns_frame(spark: SparkSession, tables: dict[str, list[str]]) -> DataFrame:
    """(dataset, column_name, position) of every column."""
    rows = [(t, c, i) for t, cols in tables.items() for i, c in enumerate(cols, 1)]
    return spark.createDataFrame(rows, "dataset string, column_name string, position int")


def observed_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column_name, position, column_type, filled_rows) of every column, with one aggregate over each table's rows."""
    parts = []
    for t, df in tables.items():
        filled = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)))
        cells = [
            F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("position"), F.lit(kind).alias("column_type"), F.col(f"_{i}").alias("filled_rows"))
            for i, (c, kind) in enumerate(df.dtypes)
        ]
        parts.append(filled.select(F.lit(t).alias("dataset"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def pii_columns(columns: DataFrame) -> DataFrame:
    """Columns whose names suggest personal data or free text, with risk and handling."""
    name = F.col("column_name")
    direct = C.matches(name, vocab.PII_DIRECT_COLUMN)
    return columns.filter(C.matches(name, vocab.PII_COLUMN)).select(
        "dataset",
        "column_name",
        F.when(direct, "PII or free-text").otherwise("sensitive free text").alias("risk"),
        F.lit("Restrict access; hash or redact in derived artifacts").alias("handling"),
    )


def column_flags(columns: DataFrame) -> DataFrame:
    """Name-based roles of every column: keys, status, language, and what an identifier identifies."""
    name = F.lower("column_name")
    is_id = C.matches(name, vocab.RECON_ID)
    subjects = [(C.matches(name, words) & is_id).alias(flag) for flag, words in vocab.RECON_SUBJECTS.items()]
    return columns.select(
        "dataset",
        "column_name",
        is_id.alias("primary_key_candidate"),
        is_id.alias("foreign_key_candidate"),
        C.matches(name, vocab.RECON_STATUS).alias("status_category_reason_field"),
        C.matches(name, vocab.RECON_LANGUAGE).alias("language_related_field"),
        *subjects,
    )


def semantic_hints(name: Column) -> Column:
    """Array of hints that a column name gives."""
    return F.array_compact(F.array(*(F.when(C.matches(name, p), hint) for hint, p in vocab.HINT_COLUMNS)))


def schema_hashes(columns: DataFrame) -> DataFrame:
    """SHA-256 per dataset over its pipe-joined column names in order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    joined = F.array_join(F.transform(ordered, lambda s: s["column_name"]), "|")
    return columns.groupBy("dataset").agg(F.sha2(joined, 256).alias("schema_sha256"))


# --- counts over rows -----------------------------------------------------------------------------
def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("dataset"), "rows") for t, df in tables.items()],
    )


def volume_vs_expected(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Observed against expected rows; NULL where nothing is expected."""
    contract = counts.sparkSession.createDataFrame(list(expected.items()), "dataset string, expected_rows bigint")
    gap = F.col("rows") - F.col("expected_rows")
    return counts.join(F.broadcast(contract), "dataset", "left").select(
        "dataset",
        F.col("rows").alias("observed_rows"),
        "expected_rows",
        gap.alias("absolute_difference"),
        F.round(gap.cast("double") / F.col("expected_rows") * 100, 4).alias("percentage_difference"),
    )


def missing_tables(observed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Expected tables that were not observed."""
    contract = observed.sparkSession.createDataFrame([(t,) for t in expected], "dataset string")
    return contract.join(observed.select("dataset"), "dataset", "left_anti")


def null_blank_counts(df: DataFrame, dataset: str) -> DataFrame:
    """NULLs and blanks of every column, apart, in one pass."""
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        counts += [C.count_where(F.col(f"`{c}`").isNull()).alias(f"n{i}"), C.count_where(C.blank(f"`{c}`")).alias(f"b{i}")]
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_rows"), F.col(f"b{i}").alias("blank_rows"))
        for i, c in enumerate(df.columns)
    ]
    long = df.agg(*counts).select("rows", F.inline(F.array(*cells)))
    return long.select(
        F.lit(dataset).alias("dataset"),
        "column_name",
        "rows",
        "null_rows",
        "blank_rows",
        C.pct(F.col("null_rows"), F.col("rows")).alias("null_pct"),
        C.pct(F.col("blank_rows"), F.col("rows")).alias("blank_pct"),
    )


def quality_severity(column_name: Column, missing_rows: Column, missing_pct: Column, graded: bool = True) -> Column:
    """CRITICAL for identifiers with gaps, then by share; the ungraded form knows no HIGH."""
    level = F.when(C.matches(column_name, vocab.ID_COLUMN) & (missing_rows > 0), "CRITICAL")
    if graded:
        level = level.when(missing_pct >= 10, "HIGH")
    return level.when(missing_rows > 0, "MEDIUM").otherwise("LOW")


# --- value histogram ------------------------------------------------------------------------------
def value_histogram(
    df: DataFrame, columns: list[str] | None = None, normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(column_name, value, rows) of the named columns; ``normalise`` acts on the text value."""
    columns = columns or df.columns
    clean = normalise or (lambda c: c)
    cells = df.select(*(clean(F.col(f"`{c}`").cast("string")).alias(c) for c in columns))
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-NULL values of every column.

    Integers are folded to bitmaps of 32,768 values, which the map side unites; other values travel as
    128-bit digests of their text. No text is shuffled.
    """
    columns = columns or df.columns
    whole = [c for c, kind in df.select(*(F.col(f"`{c}`") for c in columns)).dtypes if kind in ("tinyint", "smallint", "int", "bigint")]
    parts = []
    if whole:
        cells = df.select(*(F.col(f"`{c}`").cast("bigint").alias(c) for c in whole)).unpivot([], [F.col(f"`{c}`") for c in whole], "column_name", "value")
        bitmaps = cells.groupBy("column_name", F.bitmap_bucket_number("value").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits")
        )
        parts.append(bitmaps.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).alias("distinct_values")))
    rest = [c for c in columns if c not in whole]
    if rest:
        cells = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in rest)).unpivot([], [F.col(f"`{c}`") for c in rest], "column_name", "value")
        digest = [F.when(F.col("value").isNotNull(), F.xxhash64(F.lit(k), "value")).alias(f"_{k}") for k in (1, 2)]
        known = cells.select("column_name", *digest).distinct()
        parts.append(known.groupBy("column_name").agg(F.count("_1").alias("distinct_values")))
    return reduce(DataFrame.unionByName, parts)


#: Bits of a sketch's index; its estimate has a relative standard error of about 1.04 / sqrt(2**SKETCH_BITS).
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


def distinct_sketches(df: DataFrame, columns: list[str], by: list[Column]) -> DataFrame:
    """A mergeable sketch of the distinct values of every column for each ``by``: (by, column_name, sketch).

    Sketches of new partitions are appended to stored ones; nothing is read again.
    """
    cells = df.select(*by, *(F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(columns)))
    keys = [c for c in cells.columns[: len(by)]]
    wide = cells.groupBy(*keys).agg(*(F.hll_sketch_agg(f"_{i}", SKETCH_BITS).alias(f"_{i}") for i in range(len(columns))))
    named_cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)))
    return wide.select(*keys, F.inline(named_cells))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch): the union of all sketches of a group."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def approximate_distinct(df: DataFrame, dataset: str, by: list[Column] | None = None) -> DataFrame:
    """Distinct values per column, exact for identifiers and by merged sketches for the rest, method named.

    ``by`` may name the partition of a row; the sketches of partitions are then united.
    """
    ids = named(df.columns, r"_id$")
    rest = [c for c in df.columns if c not in ids]
    exact = distinct_counts(df, ids).withColumn("distinct_method", F.lit("exact")) if ids else None
    if not rest:
        return exact.select(F.lit(dataset).alias("dataset"), "*")
    sketches = distinct_sketches(df, rest, by or [F.lit(0).alias("part")])
    approx = merged_sketches(sketches, ["column_name"]).select(
        "column_name", F.hll_sketch_estimate("sketch").alias("distinct_values"), F.lit("hll_sketch").alias("distinct_method")
    )
    both = approx.unionByName(exact) if exact else approx
    return both.select(F.lit(dataset).alias("dataset"), "*")


def column_profile(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Missing, distinct, cardinality, inferred type, hints and extremes of every column."""
    histogram = value_histogram(df, columns, C.strip)
    value, rows = F.col("value"), F.col("rows")
    present = value != ""
    as_number = F.when(value.rlike(_NUMBER), value.try_cast("double"))
    finite = F.when(~F.isnan(as_number) & (F.abs(as_number) != float("inf")), as_number)
    as_time = F.when(C.matches("column_name", r"date|time"), C.parse_ts_lenient(value))
    marked = histogram.select("column_name", "rows", present.alias("present"), finite.alias("num"), as_time.alias("ts"))
    summary = marked.groupBy("column_name").agg(
        F.sum(rows).alias("rows"),
        F.coalesce(F.sum(F.when(~F.col("present"), rows)), F.lit(0)).alias("missing_rows"),
        C.count_where(F.col("present")).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("num").isNotNull(), rows)), F.lit(0)).alias("numeric_rows"),
        C.count_where(F.col("ts").isNotNull()).alias("time_values"),
        F.min("num").alias("numeric_min"),
        F.max("num").alias("numeric_max"),
        F.min("ts").alias("time_min"),
        F.max("ts").alias("time_max"),
    )
    enough = F.col("numeric_rows") >= F.greatest(F.lit(1.0), F.col("distinct_values") * 0.9)
    return summary.select(
        F.lit(dataset).alias("dataset"),
        "column_name",
        "rows",
        "missing_rows",
        C.pct(F.col("missing_rows"), F.col("rows"), 4).alias("missing_pct"),
        "distinct_values",
        F.round(F.col("distinct_values") / F.col("rows"), 6).alias("cardinality_ratio"),
        F.when(enough, "numeric").when(F.col("time_values") > 0, "timestamp").otherwise("text").alias("inferred_type"),
        semantic_hints(F.col("column_name")).alias("semantic_hints"),
        "numeric_min",
        "numeric_max",
        "time_min",
        "time_max",
    )


def example_values(df: DataFrame, columns: list[str] | None = None, k: int = 3, pattern: str = vocab.PII_COLUMN) -> DataFrame:
    """The k smallest distinct values of every column that holds no personal data."""
    safe = [c for c in (columns or df.columns) if c not in named(columns or df.columns, pattern)]
    shortened = value_histogram(df, safe, lambda c: F.nullif(C.strip(c), F.lit("")))
    ranked = shortened.filter(F.col("value").isNotNull()).withColumn(
        "rank", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    )
    return ranked.filter(F.col("rank") <= k).select("column_name", F.col("rank").cast("bigint").alias("rank"), "value")


def protected_distinct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column, personal data replaced by its SHA-256 before counting."""
    columns = columns or df.columns
    pii = set(named(columns, vocab.PII_COLUMN))
    safe = df.select(
        *(
            (F.sha2(key, 256) if c in pii else key).alias(c)
            for c in columns
            for key in [F.nullif(C.strip(F.col(f"`{c}`")), F.lit(""))]
        )
    )
    return distinct_counts(safe, columns)


def text_profile(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Usable rows, lengths, distinct texts and duplicate rate; whole texts travel as digests only."""
    cells = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "text")
    texts = long.groupBy("column_name", F.sha2("text", 256).alias("digest")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.length("text")).alias("chars"),
        F.bool_or(C.nonempty("text")).alias("usable"),
    )
    known = F.col("digest").isNotNull()
    summary = texts.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("usable"), F.col("rows"))), F.lit(0)).alias("usable_rows"),
        F.sum(F.when(known, F.col("rows") * F.col("chars"))).alias("all_chars"),
        F.sum(F.when(known, F.col("rows"))).alias("known_rows"),
        F.coalesce(F.max("chars"), F.lit(0)).cast("bigint").alias("max_characters"),
        F.count("digest").alias("distinct_text_values"),
    )
    usable, different = F.col("usable_rows"), F.col("distinct_text_values")
    return summary.select(
        F.lit(dataset).alias("dataset"),
        "column_name",
        "usable_rows",
        C.pct(usable, F.col("rows"), 4).alias("usable_pct"),
        F.coalesce(F.round(F.col("all_chars") / F.col("known_rows"), 2), F.lit(0.0)).alias("avg_characters"),
        "max_characters",
        "distinct_text_values",
        C.pct(usable - different, usable, 4).alias("duplicate_text_rate_pct"),
    )


def physical_types(df: DataFrame, dataset: str) -> DataFrame:
    """Type of the first known value of every column; NULL-only columns are UNKNOWN."""
    seen = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.when(F.col(f"`{c}`") > 0, kind).otherwise("UNKNOWN").alias("inferred_type"),
        )
        for c, kind in df.dtypes
    ]
    return seen.select(F.lit(dataset).alias("dataset"), F.inline(F.array(*cells)))


# --- semantic type from sampled values ------------------------------------------------------------
def semantic_types(samples: DataFrame, by: list[str]) -> DataFrame:
    """Semantic type per column from its name and all its cells (``column_name``, ``value``).

    Long values travel as digests, so distinct counts never shuffle whole texts.
    """
    value = F.nullif(C.strip("value"), F.lit(""))
    name = F.lower(F.col("column_name"))
    short = F.when(F.length(value) > 32, F.sha2(value, 256)).otherwise(value)

    def all_match(pattern: str) -> Column:
        return F.bool_and(value.rlike("(?i)" + pattern))

    facts = samples.groupBy(*by).agg(
        F.count(value).alias("filled"),
        F.count_distinct(short).alias("different"),
        *(
            all_match(p).alias(n)
            for n, p in {
                "is_bool": vocab.BOOLEAN_VALUE,
                "is_int": vocab.INTEGER_VALUE,
                "is_dec": vocab.DECIMAL_VALUE,
                "is_date": vocab.DATE_VALUE,
                "is_ts": vocab.TIMESTAMP_VALUE,
            }.items()
        ),
    )
    kind = (
        F.when(C.matches(name, vocab.RECON_ID), "identifier")
        .when(C.matches(name, vocab.RECON_LANGUAGE), "categorical")
        .when(C.matches(name, vocab.RECON_TIME), F.when(F.col("is_date"), "date").otherwise("timestamp"))
        .when(C.matches(name, vocab.RECON_STATUS), "categorical")
        .when(F.col("filled") == 0, "string")
        .when(F.col("is_bool"), "boolean")
        .when(F.col("is_int"), "integer")
        .when(F.col("is_dec"), "decimal")
        .when(F.col("is_date"), "date")
        .when(F.col("is_ts"), "timestamp")
        .when(C.matches(name, vocab.RECON_TEXT), "string")
        .when(F.col("different") <= 20, "categorical")
        .otherwise("string")
    )
    return facts.select(
        *by,
        F.col("filled").alias("observed_nonempty_values"),
        F.col("different").alias("observed_distinct_values_capped"),  # the published name; nothing is cut off
        kind.alias("semantic_type"),
    )


# --- distributions --------------------------------------------------------------------------------
def distribution(df: DataFrame, dataset: str, columns: list[str], family: str = "") -> DataFrame:
    """Category counts and shares of several columns in long form; blank counts as UNKNOWN."""
    counts = value_histogram(df, columns, lambda c: C.blank_to(c)).select(
        F.lit(dataset).alias("dataset"),
        F.col("column_name").alias("field"),
        F.col("value").alias("category"),
        "rows",
    )
    # Each row has one category in every field, so a field's counts add up to the table's rows.
    totals = counts.groupBy(F.col("field").alias("_field")).agg(F.sum("rows").alias("_total"))
    shares = counts.join(F.broadcast(totals), F.col("field") == F.col("_field"))  # a row per column
    return shares.select(*counts.columns, C.pct(F.col("rows"), F.col("_total")).alias("percentage"), F.lit(family).alias("distribution_family"))


def top_categories(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent categories per field, ties by category."""
    order = Window.partitionBy(*by).orderBy(F.desc("rows"), F.asc("category"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint")
    )
