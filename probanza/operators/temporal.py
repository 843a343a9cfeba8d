"""Time profiles: ordering, lag, partition alignment, gaps, splits and entity repetition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.operators import metrics as M
from probanza.session import written


# --- exact median ---------------------------------------------------------------------------------
#: Bits of a value that one round of the selection tells apart; a round counts at most 2**DIGIT cells a group.
DIGIT = 16
_SIGN = -(1 << 63)


def exact_median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact median of an integer column per group; see ``median_of_rows``. NULL weighs nothing."""
    return median_of_rows(*narrow_rows(df, value, by or []), by or [])


def narrow_rows(df: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, int | None, int | None]:
    """(by, v) written once, with the least and the largest value, which are noted while it is written."""
    seen = Observation()
    v = F.col(value).cast("bigint").alias("v")
    rows = written(df.select(*by, v).observe(seen, F.min("v").alias("low"), F.max("v").alias("high")), "values")
    return rows, seen.get["low"], seen.get["high"]


def median_of_rows(rows: DataFrame, low: int | None, high: int | None, by: list[str]) -> DataFrame:
    """(by, median) of ``rows`` (by, v) by radix selection; NULL for a group without values.

    A round counts rows by the next ``DIGIT`` bits, from the highest bits in which values can differ,
    finds the digits that hold the two middle rows, and goes on with the rows of those digits. Cells are
    bounded by the digit, not by the number of distinct values, and no window orders them.
    """
    if low is None:
        groups = rows.select(*by).distinct() if by else rows.agg(F.count(F.lit(1)).alias("_rows"))
        return groups.select(*by, F.lit(None).cast("double").alias("median"))
    narrow = high - low < 1 << 63
    # Distances from the lowest value, or, where those exceed a long, the values in the order of unsigned ones.
    place = F.col("v") - F.lit(low) if narrow else F.col("v").bitwiseXOR(_SIGN)
    left = rows.select(*by, place.alias("_at"))
    targets = first = None
    for later in range(max(1, -(-(high - low).bit_length() // DIGIT) if narrow else 64 // DIGIT) - 1, -1, -1):
        shift = DIGIT * later
        digit = F.shiftrightunsigned("_at", shift).bitwiseAND((1 << DIGIT) - 1).alias("_digit")
        if targets is None:
            cells = _ordered(left.groupBy(*by, digit).agg(F.count(F.lit(1)).alias("_n")), by)
            cells = cells.withColumn("_cells", F.filter("_cells", lambda c: c["digit"].isNotNull()))
            total = F.aggregate("_cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
            ends = F.posexplode(F.array(F.floor((total - 1) / 2), F.floor(total / 2))).alias("_end", "_rank")
            cells = cells.select(*by, "_cells", ends).withColumn("_prefix", F.lit(0).cast("long"))
        else:
            wanted = targets.withColumnsRenamed({c: f"_{c}" for c in by})
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.shiftrightunsigned("_at", shift + DIGIT) == F.col("_prefix")]
            keys = [*by, "_end", "_rank", "_prefix"]
            cells = _ordered(left.join(wanted, reduce(Column.__and__, same)).groupBy(*keys, digit).agg(F.count(F.lit(1)).alias("_n")), keys)
        found = cells.withColumn("_found", _digit_of_rank(F.col("_cells"), F.col("_rank")))
        prefix = F.shiftleft("_prefix", DIGIT) + F.col("_found.digit")
        targets = found.select(*by, "_end", F.col("_found.rank").alias("_rank"), prefix.alias("_prefix"))
        targets = written(targets, "median-digits") if later else targets  # two rows a group
        first = targets if first is None else first
    value = F.col("_prefix") + F.lit(low) if narrow else F.col("_prefix").bitwiseXOR(_SIGN)
    middle = targets.groupBy(*by).agg((F.sum(value.cast("decimal(20,0)")) / 2).cast("double").alias("median"))
    if not by:
        return middle
    groups = first.filter("_end = 0").select(*by)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return groups.join(middle.withColumnsRenamed({c: f"_{c}" for c in by}), reduce(Column.__and__, same), "left").select(*by, "median")


def _ordered(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The counted digits of each group in order; at most 2**DIGIT of them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("_digit").cast("long").alias("digit"), F.col("_n").alias("n"))))
    return counts.groupBy(*keys).agg(listed.alias("_cells"))


def _digit_of_rank(cells: Column, rank: Column) -> Column:
    """The digit whose rows hold the one of this rank (from 0), and its rank among them."""
    start = F.struct(rank.cast("long").alias("rank"), F.lit(None).cast("long").alias("digit"))
    return F.aggregate(
        cells, start,
        lambda s, c: F.when(s["digit"].isNotNull(), s)
        .when(s["rank"] < c["n"], F.struct(s["rank"].alias("rank"), c["digit"].alias("digit")))
        .otherwise(F.struct((s["rank"] - c["n"]).alias("rank"), s["digit"].alias("digit"))),
    )


# --- calendar -------------------------------------------------------------------------------------
def missing_days(days: DataFrame, day: str) -> DataFrame:
    """Calendar days between the first and the last represented day that have no data."""
    present = days.select(F.col(day).alias("day")).filter("day is not null").distinct()
    span = present.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(present, "day", "left_anti")


def daily_counts(df: DataFrame, dataset: str, event: Column) -> DataFrame:
    """Events per day with its year and month; rows without a date are left out."""
    days = df.select(C.day_of(event).alias("event_date")).filter("event_date is not null")
    return days.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"),
        "event_date",
        F.date_format("event_date", "yyyy").alias("year"),
        F.date_format("event_date", "yyyy-MM").alias("month"),
        "rows",
    )


def column_time_ranges(df: DataFrame, dataset: str, columns: list[str], run_date: str) -> DataFrame:
    """First, last, malformed and future values of every time column, in one pass."""
    parsed = df.select(
        *(x for i, c in enumerate(columns) for x in (F.col(f"`{c}`").alias(f"r{i}"), C.parse_ts(f"`{c}`").alias(f"t{i}")))
    )
    counts = []
    for i, _ in enumerate(columns):
        ts = F.col(f"t{i}")
        counts += [
            F.min(ts).alias(f"lo{i}"),
            F.max(ts).alias(f"hi{i}"),
            C.count_where(C.nonempty(f"r{i}") & ts.isNull()).alias(f"bad{i}"),
            C.count_where(C.after_run_date(ts, run_date)).alias(f"future{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"lo{i}").alias("min_timestamp"),
            F.col(f"hi{i}").alias("max_timestamp"),
            F.col(f"bad{i}").alias("malformed_rows"),
            F.col(f"future{i}").alias("future_rows"),
        )
        for i, c in enumerate(columns)
    ]
    return parsed.agg(*counts).select(F.lit(dataset).alias("dataset"), F.inline(F.array(*cells)))


def earliest_in_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last, over rows, of each row's earliest date column (NULLs skipped)."""
    parsed = [C.parse_ts(f"`{c}`") for c in columns]
    earliest = F.least(*parsed) if len(parsed) > 1 else parsed[0]
    return df.select(earliest.alias("x")).agg(F.min("x").alias("date_min"), F.max("x").alias("date_max"))


# --- process against event ------------------------------------------------------------------------
def process_event(df: DataFrame, process: str | None, event: str, path: str | None = None) -> DataFrame:
    """Parsed columns that the time operators share: p, e, malformed, and the partition parts."""
    part = (lambda name, n: C.partition_part(path, name, n)) if path else (lambda name, n: F.lit(None).cast("int"))
    event_ts = C.parse_ts(event)
    parsed = df.select(
        (C.parse_ts(process) if process else F.lit(None).cast("timestamp_ntz")).alias("p"),
        event_ts.alias("e"),
        (C.nonempty(event) & event_ts.isNull()).alias("malformed"),
        part("year", 4).alias("py"),
        part("month", 2).alias("pm"),
        part("day", 2).alias("pd"),
    )
    return parsed.withColumn("timed", C.both_timed("p", "e"))


def ordering_tally(df: DataFrame, process: str, event: str) -> DataFrame:
    """Rows per comparison granularity and ordering class."""
    parsed = process_event(df, process, event)
    return parsed.groupBy(
        C.granularity("p", "e", F.col("timed")).alias("granularity"),
        C.comparison("p", "e", F.col("timed")).alias("compared"),
    ).agg(F.count(F.lit(1)).alias("rows")).select("granularity", C.ordering_label("compared").alias("ordering"), "rows")


def lag_profiles(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Smallest, largest and median lag in seconds of each (table, process, event), granularity-aware.

    The lags of all tables are parsed and written once, and every later step covers all tables.
    """
    lags = [
        process_event(df, process, event).select(F.lit(name).alias("dataset"), C.lag_seconds("p", "e", F.col("timed")).alias("lag"))
        for name, (df, process, event) in tables.items()
    ]
    rows, low, high = narrow_rows(reduce(DataFrame.unionByName, lags), "lag", ["dataset"])
    ends = rows.groupBy("dataset").agg(F.min("v").alias("lag_min"), F.max("v").alias("lag_max"))
    medians = median_of_rows(rows, low, high, ["dataset"])
    return ends.join(medians, "dataset").select("dataset", "lag_min", "lag_max", F.col("median").alias("lag_median"))


def partition_alignment(df: DataFrame, event: str, path: str) -> DataFrame:
    """Rows whose event date equals, or differs from, the date in their path."""
    aligned, mismatched = _alignment()
    counts = process_event(df, None, event, path).agg(
        C.count_where(aligned).alias("aligned_rows"), C.count_where(mismatched).alias("mismatched_rows")
    )
    both = F.col("aligned_rows") + F.col("mismatched_rows")
    return counts.select("*", C.pct(F.col("mismatched_rows"), both).alias("mismatch_rate_pct"))


def _alignment() -> tuple[Column, Column]:
    dated = F.col("e").isNotNull()
    parts = ((F.col("py"), F.year("e"), False), (F.col("pm"), F.month("e"), False), (F.col("pd"), F.dayofmonth("e"), True))
    same = [F.coalesce(have == want, F.lit(optional)) for have, want, optional in parts]
    different = [F.coalesce(have != want, F.lit(False)) for have, want, _ in parts]
    aligned = dated & reduce(Column.__and__, same)
    mismatched = dated & (F.col("py").isNull() | reduce(Column.__or__, different))
    return aligned, mismatched


def temporal_profile(
    df: DataFrame, dataset: str, event: str, process: str | None, run_date: str, path: str | None = None
) -> DataFrame:
    """The time metrics of one event table in long form.

    One pass folds the table to (event day, partition date, timed, order): a frame bounded
    by the calendar, from which every count follows. Only the median reads the lags again.
    """
    parsed = process_event(df, process, event, path)
    aligned, mismatched = _alignment()
    timed = F.col("timed")
    cells = parsed.select(
        "*",
        C.day_of("e").alias("day"),
        C.comparison("p", "e", timed).alias("compared"),
        C.lag_seconds("p", "e", timed).alias("lag"),
    ).groupBy("day", "py", "pm", "pd", "timed", "compared").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("e").alias("lo"),
        F.max("e").alias("hi"),
        C.count_where(F.col("malformed")).alias("malformed"),
        C.count_where(C.after_run_date("e", run_date)).alias("future"),
        C.count_where(aligned).alias("aligned"),
        C.count_where(mismatched).alias("mismatched"),
        F.min("lag").alias("lag_min"),
        F.max("lag").alias("lag_max"),
    )

    def rows_where(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    compared = F.col("compared")

    partitioned = F.col("py").isNotNull()
    day_text = F.format_string("%04d-%02d-%02d", "py", "pm", F.coalesce("pd", F.lit(1)))
    partition_day = F.when(partitioned & F.col("pm").isNotNull(), day_text.try_cast("date"))
    zero = F.lit(0)
    wide = cells.agg(
        F.min("lo").alias("event_min"),
        F.max("hi").alias("event_max"),
        F.count_distinct("day").alias("event_days"),
        F.coalesce(F.sum("future"), zero).alias("future"),
        F.coalesce(F.sum("malformed"), zero).alias("malformed"),
        F.count_distinct(F.when(partitioned, F.struct("py", "pm", "pd"))).alias("partition_dates"),
        F.min(partition_day).alias("first_partition"),
        F.max(partition_day).alias("last_partition"),
        F.count_distinct(partition_day).alias("partition_days"),
        F.coalesce(F.sum("aligned"), zero).alias("aligned"),
        F.coalesce(F.sum("mismatched"), zero).alias("mismatched"),
        rows_where(compared.isNotNull() & timed, "both_timestamp"),
        rows_where(compared.isNotNull() & ~timed, "calendar_day"),
        rows_where(compared > 0, "event_before_process"),
        rows_where(compared < 0, "process_before_event"),
        rows_where(compared == 0, "same_calendar_day"),
        rows_where(compared.isNull(), "unknown"),
        F.min("lag_min").alias("lag_min"),
        F.max("lag_max").alias("lag_max"),
    )
    days_between = F.datediff("last_partition", "first_partition") + 1
    wide = wide.withColumn("missing_partition_dates", days_between - F.col("partition_days"))
    if process:
        lags = parsed.select(C.lag_seconds("p", "e", timed).alias("lag"))
        wide = wide.withColumn("lag_median", exact_median(lags, "lag").scalar())
    return M.long_form(
        wide.withColumn("dataset", F.lit(dataset)), ["dataset"], _profile_metrics(bool(process), run_date)
    )


def _profile_metrics(has_process: bool, run_date: str) -> list[Column]:
    partitioned = F.col("partition_dates") > 0
    compared = F.col("aligned") + F.col("mismatched")
    if_partitioned = lambda c: F.when(partitioned, c)
    na = "NOT_APPLICABLE"
    items = [
        M.label("event_min", F.col("event_min"), "timestamp"),
        M.label("event_max", F.col("event_max"), "timestamp"),
        M.number("distinct_event_dates", F.col("event_days")),
        M.number("partition_dates_represented", if_partitioned(F.col("partition_dates")), missing=na),
        M.number(
            "missing_partition_dates", if_partitioned(F.col("missing_partition_dates")), missing=na,
            note="Days without data between the first and the last represented partition date",
        ),
        M.number("future_timestamps_vs_runtime_date", F.col("future"), note=f"Compared with run date {run_date}"),
        M.number("malformed_timestamps", F.col("malformed")),
        M.number("partition_aligned_rows", if_partitioned(F.col("aligned")), missing=na),
        M.number("partition_mismatched_rows", if_partitioned(F.col("mismatched")), missing=na),
        M.number(
            "partition_mismatch_rate_pct", if_partitioned(C.pct(F.col("mismatched"), compared)), "percent", missing=na
        ),
    ]
    if not has_process:
        nothing, names = F.lit(None).cast("double"), (
            "temporal_comparison_granularity", "event_before_process_count", "process_before_event_count",
            "same_calendar_day_count", "temporal_comparison_unknown_count", "event_process_lag_min",
            "event_process_lag_max", "event_process_lag_median", "true_temporal_ordering_risk",
        )
        note = "The dataset has no process date in scope"
        return items + [M.number(n, nothing, missing=na, note=note) for n in names]
    tally = F.concat_ws(
        "; ",
        F.concat(F.lit("both-timestamp rows="), F.col("both_timestamp")),
        F.concat(F.lit("calendar-day rows="), F.col("calendar_day")),
    )
    risk = F.when(F.col("process_before_event") > 0, "PRESENT").otherwise("NOT_OBSERVED")
    return items + [
        M.label("temporal_comparison_granularity", tally, "definition"),
        M.number("event_before_process_count", F.col("event_before_process")),
        M.number("process_before_event_count", F.col("process_before_event")),
        M.number("same_calendar_day_count", F.col("same_calendar_day")),
        M.number("temporal_comparison_unknown_count", F.col("unknown")),
        M.number("event_process_lag_min", F.col("lag_min"), "seconds"),
        M.number("event_process_lag_max", F.col("lag_max"), "seconds"),
        M.number("event_process_lag_median", F.col("lag_median"), "seconds"),
        M.label("true_temporal_ordering_risk", risk, status="DERIVED"),
    ]


# --- entities over time ---------------------------------------------------------------------------
def entity_days(df: DataFrame, entity: str, event: Column) -> DataFrame:
    """Rows, first and last event day per entity; blank entities and undated rows are left out."""
    keyed = df.select(C.key_of(entity).alias("entity"), C.day_of(event).alias("day"))
    return keyed.filter("entity is not null and day is not null").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def entity_summary(entities: DataFrame) -> DataFrame:
    """Repetition of entities and their spread over simulated calendar tertiles, in one aggregate.

    As published, an entity that stays inside the middle tertile also counts as spanning; it is
    reported apart as ``middle_only`` as well.
    """
    bounds = entities.agg(F.min("first_day").alias("lo"), F.max("last_day").alias("hi"))
    span = F.datediff("hi", "lo")
    cut1 = bounds.select(F.date_add("lo", F.floor(span / 3.0).cast("int")).alias("c")).scalar()
    cut2 = bounds.select(F.date_add("lo", F.floor(span * 2 / 3.0).cast("int")).alias("c")).scalar()
    train, holdout = F.col("last_day") <= cut1, F.col("first_day") > cut2
    middle = (F.col("first_day") > cut1) & (F.col("last_day") <= cut2)
    return entities.select(
        "n",
        train.alias("train"),
        (~train & holdout).alias("holdout"),
        (~train & ~holdout).alias("spans"),
        middle.alias("middle"),
    ).agg(
        F.count(F.lit(1)).alias("unique_entities"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
        C.count_where(F.col("n") > 1).alias("entities_with_multiple_rows"),
        C.count_where(F.col("train")).alias("train_only"),
        C.count_where(F.col("holdout")).alias("holdout_only"),
        C.count_where(F.col("spans")).alias("spanning"),
        C.count_where(F.col("middle")).alias("middle_only"),
    )


def repeat_structure(entities: DataFrame) -> DataFrame:
    """Entities, rows beyond each one's first, and entities with several rows."""
    return entity_summary(entities).select("unique_entities", "repeated_rows", "entities_with_multiple_rows")


def tertile_overlap(entities: DataFrame) -> DataFrame:
    """Entities per simulated calendar tertile, and those that count as spanning several."""
    return entity_summary(entities).select("train_only", "holdout_only", "spanning", "middle_only")


def split_cutoffs(df: DataFrame, event: Column, shares: tuple[float, ...] = (0.70, 0.85)) -> DataFrame:
    """First and last instant and the instants at the given shares of the span."""
    span = df.select(event.alias("e")).agg(
        F.count("e").alias("dated_rows"), F.min("e").alias("first_event"), F.max("e").alias("last_event")
    )
    cuts = [
        (F.col("first_event") + (F.col("last_event") - F.col("first_event")) * F.lit(s)).alias(f"cutoff_{round(s * 100)}")
        for s in shares
    ]
    return span.select("*", *cuts)


def yearly_entities(df: DataFrame, entity: str, event: Column) -> DataFrame:
    """Distinct entities per year (a missing entity counts as one)."""
    pairs = df.select(F.year(event).cast("bigint").alias("year"), F.col(entity).alias("entity")).filter("year is not null")
    return pairs.distinct().groupBy("year").agg(F.count(F.lit(1)).alias("customers"))


def coverage(parent: DataFrame, key: str, event: Column, child: DataFrame, child_key: str) -> DataFrame:
    """Distinct dated parents that have at least one child."""
    dated = parent.select(C.key_of(key).alias("k"), event.alias("e")).filter("k is not null and e is not null")
    children = child.select(C.key_of(child_key).alias("k")).filter("k is not null").distinct()
    return dated.select("k").distinct().join(children, "k", "left_semi").agg(F.count(F.lit(1)).alias("covered_parents"))


def child_before_parent(
    child: DataFrame, child_key: str, child_ts: Column, parent: DataFrame, parent_key: str, parent_ts: Column
) -> DataFrame:
    """Pairs with both dates, and pairs whose child day lies before the parent day.

    Both sides are counted per key and day first. Per key a running count of child rows by day then
    gives the earlier ones for each parent day, so no pair is ever produced.
    """

    def per_day(df: DataFrame, key: str, ts: Column, side: str) -> DataFrame:
        keyed = df.select(C.key_of(key).alias("k"), C.day_of(ts).alias("day")).filter("k is not null and day is not null")
        return keyed.groupBy("k", "day").agg(F.count(F.lit(1)).alias(side))

    days = per_day(child, child_key, child_ts, "children").unionByName(
        per_day(parent, parent_key, parent_ts, "parents"), allowMissingColumns=True
    )
    merged = days.groupBy("k", "day").agg(
        F.coalesce(F.sum("children"), F.lit(0)).alias("children"), F.coalesce(F.sum("parents"), F.lit(0)).alias("parents")
    )
    earlier = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    counted = merged.select(
        "k",
        "children",
        "parents",
        (F.col("parents") * F.coalesce(F.sum("children").over(earlier), F.lit(0))).alias("bad"),
    )
    per_key = counted.groupBy("k").agg(
        (F.sum("children") * F.sum("parents")).alias("pairs"), F.sum("bad").alias("bad")
    )
    return per_key.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs_with_both_dates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("child_before_parent_pairs"),
    )
