"""Date and time operators: T1-T16."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.operators import temporal as X
from probanza.operators import workflow as W
from suite.domain import driver_table, table, tables, with_tables
from suite.joins import ne, ts
from suite.profiles import label_sql, metric_rows, metric_union, number_sql, union
from suite.registry import register

_CALLS = "call_center_interactions"


def d(c: str) -> str:
    return f"CAST({c} AS DATE)"


def timed(c: str) -> str:
    return f"({c} <> CAST(CAST({c} AS DATE) AS TIMESTAMP))"


GRANULARITY = f"CASE WHEN p IS NULL OR e IS NULL THEN 'UNKNOWN' WHEN {timed('p')} AND {timed('e')} THEN 'BOTH_TIMESTAMP' ELSE 'CALENDAR_DAY' END"
ORDERING = f"""CASE WHEN p IS NULL OR e IS NULL THEN 'UNKNOWN' WHEN {timed('p')} AND {timed('e')} AND p = e THEN 'SAME_CALENDAR_DAY'
  WHEN {timed('p')} AND {timed('e')} AND p < e THEN 'PROCESS_BEFORE_EVENT' WHEN {timed('p')} AND {timed('e')} THEN 'EVENT_BEFORE_PROCESS'
  WHEN {d('p')} < {d('e')} THEN 'PROCESS_BEFORE_EVENT' WHEN {d('p')} > {d('e')} THEN 'EVENT_BEFORE_PROCESS' ELSE 'SAME_CALENDAR_DAY' END"""
LAG = f"CASE WHEN {timed('p')} AND {timed('e')} THEN date_diff('second', e, p) ELSE date_diff('day', {d('e')}, {d('p')}) * 86400 END"


def pairs(t: str, event: str) -> str:
    return f"SELECT {ts('process_date')} AS p, {ts(event)} AS e, {ne(event)} AS filled FROM {t}"


_RANGES = {"transactions": ["transaction_date", "process_date"], "complaints": ["creation_date", "resolution_date", "closing_date"]}


@register(
    "t01_time_ranges",
    with_tables(*_RANGES)
    + "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS dataset, '{c}' AS column_name, min({ts(c)}) AS min_timestamp, max({ts(c)}) AS max_timestamp,
        count(*) FILTER ({ne(c)} AND {ts(c)} IS NULL) AS malformed_rows, count(*) FILTER ({ts(c)} > TIMESTAMP '2001-06-30 23:59:59') AS future_rows FROM {t}"""
        for t, cs in _RANGES.items()
        for c in cs
    ),
)
def time_ranges(spark, sf):
    t = tables(spark, sf, *_RANGES)
    return union(X.column_time_ranges(t[n], n, cs, "2001-06-30") for n, cs in _RANGES.items())


@register(
    "t02_lenient_parse",
    """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + CASE o_orderstatus WHEN 'O' THEN INTERVAL 10 HOUR ELSE INTERVAL 0 HOUR END AS parsed
    FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def lenient_parse(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), day, F.lit("T10:00:00Z\t")))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy/MM/dd"))
        .otherwise(day)
    )
    return driver_table(spark, sf, "orders").select("o_orderkey", C.parse_ts_lenient(raw).alias("parsed"))


@register(
    "t03_has_time",
    with_tables("transactions")
    + f"""SELECT transaction_id, count(*) AS rows, count(*) FILTER (coalesce({timed('e')}, false)) AS timed FROM
      (SELECT transaction_id, {ts('transaction_date')} AS e FROM transactions) GROUP BY 1""",
)
def has_time(spark, sf):
    parsed = table(spark, sf, "transactions").select("transaction_id", C.parse_ts("transaction_date").alias("e"))
    return parsed.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("rows"), C.count_where(C.has_time("e")).alias("timed")
    )


@register(
    "t04_granularity",
    with_tables(_CALLS)
    + f"SELECT interaction_id, {GRANULARITY} AS granularity FROM (SELECT interaction_id, {ts('process_date')} AS p, {ts('interaction_date')} AS e FROM {_CALLS})",
)
def granularity(spark, sf):
    parsed = table(spark, sf, _CALLS).select(
        "interaction_id", C.parse_ts("process_date").alias("p"), C.parse_ts("interaction_date").alias("e")
    )
    return parsed.select("interaction_id", C.granularity("p", "e").alias("granularity"))


@register(
    "t05_ordering_tally",
    with_tables("transactions", _CALLS, "complaints")
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, {GRANULARITY} AS granularity, {ORDERING} AS ordering, count(*) AS rows FROM ({pairs(t, e)}) GROUP BY ALL"
        for t, e in (("transactions", "transaction_date"), (_CALLS, "interaction_date"), ("complaints", "creation_date"))
    ),
)
def ordering_tally(spark, sf):
    events = {"transactions": "transaction_date", _CALLS: "interaction_date", "complaints": "creation_date"}
    t = tables(spark, sf, *events)
    return union(
        X.ordering_tally(t[n], "process_date", e).select(F.lit(n).alias("dataset"), "*") for n, e in events.items()
    )


@register(
    "t05_ship_before_order",
    """SELECT CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 'PROCESS_BEFORE_EVENT' WHEN CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) THEN 'EVENT_BEFORE_PROCESS'
      ELSE 'SAME_CALENDAR_DAY' END AS ordering, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def ship_before_order(spark, sf):
    lines = driver_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("p"))
    orders = driver_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("e"))
    days = lines.groupBy("l_orderkey", "p").agg(F.count(F.lit(1)).alias("n")).join(orders, "l_orderkey")
    return days.groupBy(C.ordering_class("p", "e").alias("ordering")).agg(F.sum("n").alias("rows"))


@register(
    "t06_lag_profile",
    with_tables("transactions", _CALLS)
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, min(l) AS lag_min, max(l) AS lag_max, median(l) AS lag_median FROM (SELECT {LAG} AS l FROM ({pairs(t, e)}) WHERE p IS NOT NULL AND e IS NOT NULL)"
        for t, e in (("transactions", "transaction_date"), (_CALLS, "interaction_date"))
    ),
)
def lag_profile(spark, sf):
    events = {"transactions": "transaction_date", _CALLS: "interaction_date"}
    t = tables(spark, sf, *events)
    return X.lag_profiles({n: (t[n], "process_date", e) for n, e in events.items()})


_PATHS = f"""SELECT *, 'root/{_CALLS}/year=' || strftime(x, '%Y') || '/month=' || strftime(x, '%m') ||
   CASE WHEN channel = 'App' THEN '' ELSE '/day=' || strftime(x + CASE WHEN detected_sentiment = 'negative' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%d') END || '/f.csv' AS path
   FROM (SELECT *, coalesce({ts('interaction_date')}, TIMESTAMP '2024-01-15') AS x FROM {_CALLS})"""


def _with_paths(calls):
    """Interactions with a partition path; some paths lack the day, some name the next day."""
    x = F.coalesce(C.parse_ts("interaction_date"), F.lit("2024-01-15").cast("timestamp_ntz"))
    shifted = F.date_add(F.to_date(x), F.when(F.col("detected_sentiment") == "negative", 1).otherwise(0))
    day = F.when(F.col("channel") == "App", "").otherwise(F.concat(F.lit("/day="), F.date_format(shifted, "dd")))
    month = F.concat(F.lit(f"root/{_CALLS}/year="), F.date_format(x, "yyyy"), F.lit("/month="), F.date_format(x, "MM"))
    return calls.withColumn("path", F.concat(month, day, F.lit("/f.csv")))


@register(
    "t07_partition_date",
    with_tables(_CALLS)
    + f"""SELECT interaction_id, try_cast(regexp_extract(path, 'year=([0-9]{{4}})', 1) || '-' || regexp_extract(path, 'month=([0-9]{{2}})', 1) || '-' ||
      CASE WHEN path LIKE '%day=%' THEN regexp_extract(path, 'day=([0-9]{{2}})', 1) ELSE '01' END AS DATE) AS partition_date FROM ({_PATHS})""",
)
def partition_date(spark, sf):
    calls = _with_paths(table(spark, sf, _CALLS))
    return calls.select("interaction_id", C.partition_date("path").alias("partition_date"))


@register(
    "t08_partition_alignment",
    with_tables(_CALLS)
    + f""", z AS (SELECT {ts('interaction_date')} AS e, try_cast(regexp_extract(path, 'year=([0-9]{{4}})', 1) AS INT) AS y, try_cast(regexp_extract(path, 'month=([0-9]{{2}})', 1) AS INT) AS m,
      try_cast(regexp_extract(path, 'day=([0-9]{{2}})', 1) AS INT) AS dd FROM ({_PATHS})),
    k AS (SELECT count(*) FILTER (e IS NOT NULL AND y = year(e) AND m = month(e) AND (dd IS NULL OR dd = day(e))) AS a,
      count(*) FILTER (e IS NOT NULL AND (y IS NULL OR y <> year(e) OR m <> month(e) OR (dd IS NOT NULL AND dd <> day(e)))) AS b FROM z)
    SELECT a AS aligned_rows, b AS mismatched_rows, round(b / (a + b) * 100, 6) AS mismatch_rate_pct FROM k""",
)
def partition_alignment(spark, sf):
    return X.partition_alignment(_with_paths(table(spark, sf, _CALLS)), "interaction_date", "path")


def _entities(t: str, event: str) -> str:
    return f"""SELECT trim(customer_id) AS k, count(*) AS n, min({d(ts(event))}) AS f, max({d(ts(event))}) AS l FROM {t}
      WHERE {ne('customer_id')} AND {ts(event)} IS NOT NULL GROUP BY 1"""


_SPLIT = """, b AS (SELECT min(f) + CAST(floor(date_diff('day', min(f), max(l)) / 3.0) AS INT) AS c1, min(f) + CAST(floor(2 * date_diff('day', min(f), max(l)) / 3.0) AS INT) AS c2 FROM pc)"""


@register(
    "t09_tertile_overlap",
    with_tables("complaints")
    + f""", pc AS ({_entities('complaints', 'creation_date')}){_SPLIT}
    SELECT count(*) FILTER (l <= c1) AS train_only, count(*) FILTER (NOT l <= c1 AND f > c2) AS holdout_only,
      count(*) FILTER (NOT l <= c1 AND NOT f > c2) AS spanning, count(*) FILTER (f > c1 AND l <= c2) AS middle_only FROM pc, b""",
)
def tertile_overlap(spark, sf):
    return X.tertile_overlap(X.entity_days(table(spark, sf, "complaints"), "customer_id", C.parse_ts("creation_date")))


@register(
    "t10_split_cutoffs",
    """WITH s AS (SELECT count(ts) AS n, min(ts) AS a, max(ts) AS b FROM events)
    SELECT n AS dated_rows, a AS first_event, b AS last_event, a + to_microseconds(CAST(round((epoch_us(b) - epoch_us(a)) * 0.70) AS BIGINT)) AS cutoff_70,
      a + to_microseconds(CAST(round((epoch_us(b) - epoch_us(a)) * 0.85) AS BIGINT)) AS cutoff_85 FROM s""",
)
def split_cutoffs(spark, sf):
    return X.split_cutoffs(driver_table(spark, sf, "events"), F.col("ts"))


@register(
    "t11_represented_and_missing_days",
    with_tables("call_transcripts")
    + """, x AS (SELECT DISTINCT CAST(process_date AS DATE) AS day FROM call_transcripts WHERE detected_language = 'es')
    SELECT (SELECT count(*) FROM x) AS represented_days, count(*) AS missing_days FROM (SELECT unnest(generate_series((SELECT min(day) FROM x), (SELECT max(day) FROM x), INTERVAL 1 DAY)) AS g)
    WHERE CAST(g AS DATE) NOT IN (SELECT day FROM x)""",
)
def represented_and_missing_days(spark, sf):
    spanish = table(spark, sf, "call_transcripts").filter("detected_language = 'es'")
    days = spanish.select(C.day_of(C.parse_ts("process_date")).alias("day"))
    missing = X.missing_days(days, "day").agg(F.count(F.lit(1)).alias("n")).scalar()
    return days.agg(F.count_distinct("day").alias("represented_days")).select("represented_days", missing.alias("missing_days"))


@register(
    "t12_earliest_in_row",
    with_tables("complaints")
    + f"""SELECT min(x) AS date_min, max(x) AS date_max FROM (SELECT least({ts('creation_date')}, {ts('resolution_date')}, {ts('closing_date')}) AS x FROM complaints)""",
)
def earliest_in_row(spark, sf):
    return X.earliest_in_row(table(spark, sf, "complaints"), ["creation_date", "resolution_date", "closing_date"])


@register(
    "t13_date_parts",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd, strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS rows
    FROM orders GROUP BY ALL""",
)
def date_parts(spark, sf):
    day = F.col("o_orderdate")
    return driver_table(spark, sf, "orders").groupBy(
        F.year(day).cast("bigint").alias("y"),
        F.month(day).cast("bigint").alias("m"),
        F.dayofmonth(day).cast("bigint").alias("dd"),
        F.date_format(day, "yyyy-MM").alias("ym"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "t14_repeat_structure",
    with_tables("complaints")
    + f""", pc AS ({_entities('complaints', 'creation_date')})
    SELECT count(*) AS unique_entities, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows, count(*) FILTER (n > 1) AS entities_with_multiple_rows FROM pc""",
)
def repeat_structure(spark, sf):
    return X.repeat_structure(X.entity_days(table(spark, sf, "complaints"), "customer_id", C.parse_ts("creation_date")))


def _ready_sql(w: str, t: str, key: str, event: str, outcome: str) -> tuple[str, list[str]]:
    cte = f""", pc{w} AS ({_entities(t, event)}), b{w} AS (SELECT min(f) + CAST(floor(date_diff('day', min(f), max(l)) / 3.0) AS INT) AS c1,
        min(f) + CAST(floor(2 * date_diff('day', min(f), max(l)) / 3.0) AS INT) AS c2 FROM pc{w}),
      o{w} AS (SELECT {ORDERING} AS o, e FROM ({pairs(t, event)})),
      x{w} AS (SELECT count(*) AS n, count(*) FILTER ({ne(outcome)}) AS oc, count(*) FILTER ({ne(key)}) - count(DISTINCT trim({key})) FILTER ({ne(key)}) AS dup,
        (SELECT count(*) FROM pc{w}) AS u, (SELECT CAST(sum(n - 1) AS BIGINT) FROM pc{w}) AS rr, (SELECT count(*) FROM pc{w} WHERE n > 1) AS mu,
        (SELECT count(*) FROM pc{w}, b{w} WHERE NOT l <= c1 AND NOT f > c2) AS sp, (SELECT count(*) FROM o{w} WHERE o = 'PROCESS_BEFORE_EVENT') AS pb,
        (SELECT count(*) FROM o{w} WHERE o = 'SAME_CALENDAR_DAY') AS sd FROM {t})"""
    x = f"x{w}"
    parts = [
        number_sql(w, "scale.total_relevant_interactions_or_cases", "n", frm=x),
        number_sql(w, "scale.duplicate_primary_key_rows", "dup", frm=x),
        number_sql(w, "unique_customers", "u", frm=x),
        number_sql(w, "repeat_customer_structure.repeated_customer_rows", "rr", frm=x),
        number_sql(w, "repeat_customer_structure.customers_with_multiple_interactions", "mu", frm=x),
        number_sql(w, "customer_overlap_across_temporal_splits.customers_spanning_simulated_splits", "sp", frm=x),
        number_sql(w, "temporal_ordering_evidence.process_before_event_rows", "pb", frm=x),
        number_sql(w, "temporal_ordering_evidence.same_calendar_day_rows", "sd", frm=x),
        label_sql(w, "true_temporal_ordering_risk", "CASE WHEN pb > 0 THEN 'PRESENT' ELSE 'NOT_OBSERVED' END", frm=x),
        label_sql(w, "post_outcome_feature_risk", "'REQUIRES_MANUAL_REVIEW'", "UNKNOWN", frm=x),
        number_sql(w, "outcome_availability_pct", "round(oc / n * 100, 6)", frm=x),
        label_sql(w, "post_interaction_outcome_timing", "'UNKNOWN'", "UNKNOWN", frm=x),
        label_sql(w, "leakage_risk", "'REQUIRES_MANUAL_REVIEW'", "UNKNOWN", frm=x),
        label_sql(w, "time_based_dev_validation_holdout_constructible", "CASE WHEN u > 0 THEN 'YES' ELSE 'UNKNOWN' END", frm=x),
    ]
    return cte, parts


_READY_A = _ready_sql("A", _CALLS, "interaction_id", "interaction_date", "was_resolved")
_READY_B = _ready_sql("B", "complaints", "complaint_id", "creation_date", "resolution")


@register(
    "t15_readiness",
    with_tables(_CALLS, "complaints", "satisfaction_surveys")
    + _READY_A[0]
    + _READY_B[0]
    + f""", sv AS (SELECT (SELECT count(DISTINCT trim(i.interaction_id)) FROM {_CALLS} i JOIN satisfaction_surveys s ON i.interaction_id = s.interaction_id WHERE {ts('interaction_date')} IS NOT NULL) AS cov,
      (SELECT count(*) FROM {_CALLS} i JOIN satisfaction_surveys s ON i.interaction_id = s.interaction_id WHERE {ts('interaction_date')} IS NOT NULL AND {ts('survey_date')} IS NOT NULL) AS prs,
      (SELECT count(*) FROM {_CALLS} i JOIN satisfaction_surveys s ON i.interaction_id = s.interaction_id WHERE {d(ts('survey_date'))} < {d(ts('interaction_date'))}) AS bad, CAST(NULL AS BIGINT) AS nothing)
    """
    + metric_union(
        [
            *_READY_A[1],
            *_READY_B[1],
            number_sql("A", "survey_availability", "cov", frm="sv"),
            number_sql("A", "survey_timing.joined_pairs_with_both_dates", "prs", frm="sv"),
            number_sql("A", "survey_timing.survey_before_interaction_rows", "bad", frm="sv"),
            number_sql("B", "survey_availability", "nothing", frm="sv"),
            number_sql("B", "survey_timing.joined_pairs_with_both_dates", "nothing", "NOT_APPLICABLE", frm="sv"),
            number_sql("B", "survey_timing.survey_before_interaction_rows", "nothing", "NOT_APPLICABLE", frm="sv"),
        ]
    ),
)
def readiness(spark, sf):
    t = tables(spark, sf, _CALLS, "complaints", "satisfaction_surveys")
    a = W.readiness("A", t[_CALLS], "interaction_id", "interaction_date", "was_resolved", surveys=t["satisfaction_surveys"])
    b = W.readiness("B", t["complaints"], "complaint_id", "creation_date", "resolution", origin="origin_interaction_id")
    return metric_rows(a.unionByName(b))


@register(
    "t16_temporal_profile",
    with_tables(_CALLS)
    + f""", z AS (SELECT *, {ts('interaction_date')} AS e, {ts('process_date')} AS p, {ne('interaction_date')} AS filled FROM ({_PATHS})),
    q AS (SELECT *, {GRANULARITY} AS g, {ORDERING} AS o, CASE WHEN p IS NOT NULL AND e IS NOT NULL THEN {LAG} END AS lag, CAST(regexp_extract(path, 'year=([0-9]{{4}})', 1) AS INT) AS y, CAST(regexp_extract(path, 'month=([0-9]{{2}})', 1) AS INT) AS m,
      try_cast(regexp_extract(path, 'day=([0-9]{{2}})', 1) AS INT) AS dd FROM z),
    pd AS (SELECT DISTINCT make_date(y, m, coalesce(dd, 1)) AS day FROM q),
    x AS (SELECT strftime(min(e), '%Y-%m-%d %H:%M:%S') AS lo, strftime(max(e), '%Y-%m-%d %H:%M:%S') AS hi, count(DISTINCT {d('e')}) AS days, count(*) FILTER (e > TIMESTAMP '2024-01-20 23:59:59') AS fut, count(*) FILTER (filled AND e IS NULL) AS bad,
      (SELECT count(*) FROM (SELECT DISTINCT y, m, dd FROM q)) AS parts, (SELECT date_diff('day', min(day), max(day)) + 1 - count(*) FROM pd) AS gaps,
      count(*) FILTER (e IS NOT NULL AND y = year(e) AND m = month(e) AND (dd IS NULL OR dd = day(e))) AS al, count(*) FILTER (e IS NOT NULL AND (y <> year(e) OR m <> month(e) OR (dd IS NOT NULL AND dd <> day(e)))) AS mi,
      count(*) FILTER (g = 'BOTH_TIMESTAMP') AS bt, count(*) FILTER (g = 'CALENDAR_DAY') AS cd, count(*) FILTER (o = 'EVENT_BEFORE_PROCESS') AS eb, count(*) FILTER (o = 'PROCESS_BEFORE_EVENT') AS pb,
      count(*) FILTER (o = 'SAME_CALENDAR_DAY') AS sd, count(*) FILTER (o = 'UNKNOWN') AS un, min(lag) AS l1, max(lag) AS l2, median(lag) AS l3 FROM q)
    """
    + metric_union(
        [
            label_sql(_CALLS, "event_min", "lo"),
            label_sql(_CALLS, "event_max", "hi"),
            number_sql(_CALLS, "distinct_event_dates", "days"),
            number_sql(_CALLS, "partition_dates_represented", "parts"),
            number_sql(_CALLS, "missing_partition_dates", "gaps"),
            number_sql(_CALLS, "future_timestamps_vs_runtime_date", "fut"),
            number_sql(_CALLS, "malformed_timestamps", "bad"),
            number_sql(_CALLS, "partition_aligned_rows", "al"),
            number_sql(_CALLS, "partition_mismatched_rows", "mi"),
            number_sql(_CALLS, "partition_mismatch_rate_pct", "round(mi / (al + mi) * 100, 6)"),
            label_sql(_CALLS, "temporal_comparison_granularity", "'both-timestamp rows=' || bt || '; calendar-day rows=' || cd"),
            number_sql(_CALLS, "event_before_process_count", "eb"),
            number_sql(_CALLS, "process_before_event_count", "pb"),
            number_sql(_CALLS, "same_calendar_day_count", "sd"),
            number_sql(_CALLS, "temporal_comparison_unknown_count", "un"),
            number_sql(_CALLS, "event_process_lag_min", "l1"),
            number_sql(_CALLS, "event_process_lag_max", "l2"),
            number_sql(_CALLS, "event_process_lag_median", "l3"),
            label_sql(_CALLS, "true_temporal_ordering_risk", "CASE WHEN pb > 0 THEN 'PRESENT' ELSE 'NOT_OBSERVED' END", "DERIVED"),
        ],
        "dataset",
    ),
)
def temporal_profile(spark, sf):
    calls = _with_paths(table(spark, sf, _CALLS))
    rows = metric_rows(X.temporal_profile(calls, _CALLS, "interaction_date", "process_date", "2024-01-20", "path"), "dataset")
    extreme = F.col("metric").isin("event_min", "event_max")
    return rows.withColumn("value_text", F.when(extreme, F.substring("value_text", 1, 19)).otherwise(F.col("value_text")))
