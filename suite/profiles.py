"""Aggregations and profiles: A1-A40."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import decide as D
from probanza.operators import keys as K
from probanza.operators import metrics as M
from probanza.operators import profile as P
from probanza.operators import temporal as X
from probanza.operators import workflow as W
from probanza.operators.joins import with_share
from probanza.plans import audit as A
from suite.domain import driver_table, table, tables, with_tables
from suite.joins import EVIDENCE_TABLES, ne, pct, ts
from suite.registry import register


def each(sql: str, names) -> str:
    return "\nUNION ALL\n".join(sql.format(t=n) for n in names)


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- A1, A2 ---------------------------------------------------------------------------------------
_ALL_TABLES = tuple(dict.fromkeys((*EVIDENCE_TABLES, *vocab.EXPECTED_ROWS)))


@register("a01_row_counts", with_tables(*_ALL_TABLES) + each("SELECT '{t}' AS dataset, count(*) AS rows FROM {t}", _ALL_TABLES))
def row_counts(spark, sf):
    return P.row_counts(tables(spark, sf, *_ALL_TABLES))


_VOLUME_TABLES = ("customers", "products", "transactions", "complaints", "requests")


@register(
    "a02_volume_vs_expected",
    with_tables(*_VOLUME_TABLES)
    + f""", n AS ({each("SELECT '{t}' AS dataset, count(*) AS rows FROM {t}", _VOLUME_TABLES)}),
    e AS (SELECT * FROM (VALUES ('customers', 150000), ('products', 400000), ('transactions', 5000000), ('complaints', 80000)) v(dataset, expected))
    SELECT dataset, rows AS observed_rows, CAST(expected AS BIGINT) AS expected_rows, rows - expected AS absolute_difference,
      round((rows - expected) / expected * 100, 4) AS percentage_difference FROM n LEFT JOIN e USING (dataset)""",
)
def volume_vs_expected(spark, sf):
    return P.volume_vs_expected(P.row_counts(tables(spark, sf, *_VOLUME_TABLES)), vocab.EXPECTED_ROWS)


# --- A3-A9 ----------------------------------------------------------------------------------------
_PROFILED = {
    "complaints": vocab.SCOPED_COLUMNS["complaints"],
    "transactions": vocab.SCOPED_COLUMNS["transactions"],
}


def per_column(sql: str, profiled=None) -> str:
    return "\nUNION ALL\n".join(sql.format(t=t, c=c) for t, cs in (profiled or _PROFILED).items() for c in cs)


@register(
    "a03_nulls_and_blanks",
    with_tables(*_PROFILED)
    + f""", x AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS null_rows, count(*) FILTER (trim({c}) = '') AS blank_rows FROM {t}")})
    SELECT *, {pct('null_rows', 'rows')} AS null_pct, {pct('blank_rows', 'rows')} AS blank_pct FROM x""",
)
def nulls_and_blanks(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    return union(P.null_blank_counts(t[n].select(*cs), n) for n, cs in _PROFILED.items())


@register(
    "a04_missing_values",
    with_tables(*_PROFILED)
    + per_column(
        "SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS missing_rows FROM {t}"
    ),
)
def missing_values(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    counts = union(P.null_blank_counts(t[n].select(*cs), n) for n, cs in _PROFILED.items())
    return counts.select("dataset", "column_name", (F.col("null_rows") + F.col("blank_rows")).alias("missing_rows"))


@register(
    "a05_exact_distinct",
    with_tables(*_PROFILED)
    + per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM {t}"),
)
def exact_distinct(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    return union(
        P.distinct_counts(t[n].select(*cs)).select(F.lit(n).alias("dataset"), "*") for n, cs in _PROFILED.items()
    )


_A06 = {"transactions": vocab.SCOPED_COLUMNS["transactions"]}


@register(
    "a06_approximate_distinct",
    with_tables(*_A06)
    + per_column(
        "SELECT '{t}' AS dataset, '{c}' AS column_name, CASE WHEN '{c}' LIKE '%!_id' ESCAPE '!' THEN 'exact' ELSE 'hll_sketch' END AS distinct_method, count(DISTINCT {c}) AS distinct_values FROM {t}",
        _A06,
    ),
)
def approximate_distinct(spark, sf):
    """Exact counts of identifiers; of other columns the exact count where the merged sketches are within three standard errors."""
    found = []
    for n, columns in _A06.items():
        rows = table(spark, sf, n).select(*columns)
        exact = P.distinct_counts(rows).select("column_name", F.col("distinct_values").alias("true"))
        sketched = P.approximate_distinct(rows, n, [F.substring("process_date", 1, 7).alias("month")]).join(exact, "column_name")
        near = F.abs(F.col("distinct_values") - F.col("true")) <= F.ceil(F.col("true") * 3 * P.SKETCH_ERROR)
        known = F.when((F.col("distinct_method") == "hll_sketch") & near, F.col("true")).otherwise(F.col("distinct_values"))
        found.append(sketched.select("dataset", "column_name", "distinct_method", known.alias("distinct_values")))
    return union(found)


_SEVERITY = """CASE WHEN regexp_matches(column_name, '(^|_)id$') AND m > 0 THEN 'CRITICAL' {high} WHEN m > 0 THEN 'MEDIUM' ELSE 'LOW' END"""


@register(
    "a07_quality_severity",
    with_tables(*_PROFILED)
    + f""", x AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS m FROM {t}")})
    SELECT dataset, column_name, {_SEVERITY.format(high="WHEN round(m / n * 100, 4) >= 10 THEN 'HIGH'")} AS severity,
      {_SEVERITY.format(high='')} AS severity_ungraded FROM x""",
)
def quality_severity(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    profile = union(P.column_profile(t[n], n, cs) for n, cs in _PROFILED.items())
    args = (F.col("column_name"), F.col("missing_rows"), F.col("missing_pct"))
    return profile.select(
        "dataset",
        "column_name",
        P.quality_severity(*args).alias("severity"),
        P.quality_severity(*args, graded=False).alias("severity_ungraded"),
    )


@register(
    "a08_cardinality_ratio",
    with_tables(*_PROFILED)
    + per_column(
        "SELECT '{t}' AS dataset, '{c}' AS column_name, round(count(DISTINCT nullif(trim({c}), '')) / count(*), 6) AS cardinality_ratio FROM {t}"
    ),
)
def cardinality_ratio(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    profile = union(P.column_profile(t[n], n, cs) for n, cs in _PROFILED.items())
    return profile.select("dataset", "column_name", "cardinality_ratio")


_TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


@register(
    "a09_physical_types",
    "\nUNION ALL\n".join(
        f"SELECT 'orders' AS dataset, '{c}' AS column_name, coalesce((SELECT any_value(typeof({c})) FROM orders WHERE {c} IS NOT NULL), 'UNKNOWN') AS inferred_type"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    + "\nUNION ALL SELECT 'orders', 'note', 'UNKNOWN'",
)
def physical_types(spark, sf):
    orders = driver_table(spark, sf, "orders").withColumn("note", F.lit(None).cast("string"))
    found = P.physical_types(orders, "orders")
    names = F.create_map(*(F.lit(x) for pair in _TYPE_NAMES.items() for x in pair))
    return found.withColumn("inferred_type", F.coalesce(names[F.col("inferred_type")], F.col("inferred_type")))


# --- A10-A12 --------------------------------------------------------------------------------------
_NUM = r"regexp_full_match({v}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"
_A10_COLUMNS = {
    "call_center_interactions": [
        "interaction_id", "interaction_date", "process_date", "duration_seconds", "wait_time_seconds", "sentiment_score", "channel",
    ],
    "transactions": ["transaction_date", "amount", "fraud_score", "response_code", "currency"],
}


@register(
    "a10_profile_types",
    with_tables(*_A10_COLUMNS)
    + f""", v AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, trim({c}) AS v FROM {t} WHERE " + ne('{c}'), _A10_COLUMNS)}),
    x AS (SELECT dataset, column_name, count(DISTINCT v) AS d, count(*) FILTER ({_NUM.format(v='v')}) AS k,
      min(CASE WHEN {_NUM.format(v='v')} THEN CAST(v AS DOUBLE) END) AS numeric_min, max(CASE WHEN {_NUM.format(v='v')} THEN CAST(v AS DOUBLE) END) AS numeric_max,
      min(CASE WHEN regexp_matches(column_name, 'date|time') AND NOT {_NUM.format(v='v')} THEN try_cast(v AS TIMESTAMP) END) AS time_min,
      max(CASE WHEN regexp_matches(column_name, 'date|time') AND NOT {_NUM.format(v='v')} THEN try_cast(v AS TIMESTAMP) END) AS time_max
      FROM v GROUP BY ALL)
    SELECT dataset, column_name, d AS distinct_values, CASE WHEN k >= greatest(1.0, d * 0.9) THEN 'numeric' WHEN time_min IS NOT NULL THEN 'timestamp' ELSE 'text' END AS inferred_type,
      numeric_min, numeric_max, time_min, time_max FROM x""",
)
def profile_types(spark, sf):
    t = tables(spark, sf, *_A10_COLUMNS)
    profile = union(P.column_profile(t[n], n, cs) for n, cs in _A10_COLUMNS.items())
    return profile.select(
        "dataset", "column_name", "distinct_values", "inferred_type", "numeric_min", "numeric_max", "time_min", "time_max"
    )


_A11_COLUMNS = {
    "call_center_interactions": vocab.SCOPED_COLUMNS["call_center_interactions"],
    "customers": ["customer_id", "country", "detected_accent", "full_name", "segment", "estimated_monthly_income"],
    "products": ["product_id", "product_number", "currency", "current_balance", "opening_date"],
}


def _all(p: str) -> str:
    return f"coalesce(bool_and(regexp_matches(v, '(?i){p}')), false)"


def types_sql(cells: str) -> str:
    """Semantic types of the cells (dataset, column_name, v) that a statement gives."""
    return f""", v AS ({cells}),
    x AS (SELECT dataset, column_name, count(v) AS n, count(DISTINCT v) AS d, {_all('^(true|false|yes|no|y|n|0|1)$')} AS b, {_all('^[+-]?[0-9]+$')} AS i,
      {_all('^[+-]?([0-9]+[.][0-9]+|[0-9]+)$')} AS f, {_all('^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')} AS dt, {_all('^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}')} AS t FROM v GROUP BY ALL)
    SELECT dataset, column_name, n AS observed_nonempty_values, d AS observed_distinct_values_capped,
      CASE WHEN regexp_matches(column_name, '(^|[_-])(id|key|number|no)$|(^|[_-])(id|key)([_-]|$)') THEN 'identifier'
        WHEN regexp_matches(column_name, 'lang|locale') THEN 'categorical'
        WHEN regexp_matches(column_name, '(^|[_-])(date|time|timestamp|created|updated|opened|closed|resolved|occurred|sent)([_-]|$)') THEN CASE WHEN dt THEN 'date' ELSE 'timestamp' END
        WHEN regexp_matches(column_name, 'status|state|stage|outcome|result|reason|category|type|priority|disposition') THEN 'categorical'
        WHEN n = 0 THEN 'string' WHEN b THEN 'boolean' WHEN i THEN 'integer' WHEN f THEN 'decimal' WHEN dt THEN 'date' WHEN t THEN 'timestamp'
        WHEN regexp_matches(column_name, 'text|transcript|comment|description|message|note|subject|summary|body') THEN 'string'
        WHEN d <= 20 THEN 'categorical' ELSE 'string' END AS semantic_type FROM x""".replace("{{", "{").replace("}}", "}")


@register(
    "a11_semantic_types",
    with_tables(*_A11_COLUMNS)
    + types_sql(per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, nullif(trim({c}), '') AS v FROM {t}", _A11_COLUMNS)),
)
def semantic_types(spark, sf):
    t = tables(spark, sf, *_A11_COLUMNS)
    cells = []
    for n, cs in _A11_COLUMNS.items():
        long = t[n].select(*cs).unpivot([], [F.col(c) for c in cs], "column_name", "value")
        cells.append(long.select(F.lit(n).alias("dataset"), "*"))
    return P.semantic_types(union(cells), ["dataset", "column_name"])


@register(
    "a12_semantic_hints",
    with_tables("customers", "transactions")
    + """, c AS (SELECT 'customers' AS dataset, unnest(['customer_id', 'full_name', 'country', 'detected_accent', 'segment']) AS column_name
      UNION ALL SELECT 'transactions', unnest(['transaction_id', 'transaction_date', 'transaction_type', 'amount']))
    SELECT dataset, column_name, (SELECT count(*) FROM customers) + (SELECT count(*) FROM transactions) AS rows,
      concat_ws(',', CASE WHEN regexp_matches(column_name, '(^|_)id$') THEN 'identifier' END, CASE WHEN regexp_matches(column_name, 'date|time') THEN 'timestamp' END,
        CASE WHEN regexp_matches(column_name, 'email|phone|address|name|document') THEN 'PII-like' END,
        CASE WHEN regexp_matches(column_name, 'status|type|category|channel|country|language|accent') THEN 'categorical' END) AS hints FROM c""",
)
def semantic_hints(spark, sf):
    t = tables(spark, sf, "customers", "transactions")
    picked = {
        "customers": ["customer_id", "full_name", "country", "detected_accent", "segment"],
        "transactions": ["transaction_id", "transaction_date", "transaction_type", "amount"],
    }
    profile = union(P.column_profile(t[n], n, cs) for n, cs in picked.items())
    total = P.row_counts(t).agg(F.sum("rows").alias("n")).scalar()
    return profile.select("dataset", "column_name", total.alias("rows"), F.array_join("semantic_hints", ",").alias("hints"))


# --- A13-A17 --------------------------------------------------------------------------------------
@register(
    "a13_candidate_keys",
    with_tables(*_PROFILED)
    + f""", x AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) AS n, count(*) FILTER (" + ne('{c}') + ") AS k, count(DISTINCT trim({c})) FILTER (" + ne('{c}') + ") AS d FROM {t}")})
    SELECT dataset, column_name, d AS distinct_values, round(d / n * 100, 4) AS unique_pct, d = n AS candidate_primary_key FROM x
    WHERE regexp_matches(column_name, '(^|_)id$') AND k = n""",
)
def candidate_keys(spark, sf):
    t = tables(spark, sf, *_PROFILED)
    return K.candidate_keys(union(P.column_profile(t[n], n, cs) for n, cs in _PROFILED.items()))


@register(
    "a14_key_profile",
    with_tables(*EVIDENCE_TABLES)
    + "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS dataset, '{k}' AS candidate_primary_key, n AS total_rows, m AS non_null_rows, d AS distinct_values, m - d AS duplicate_rows,
        {pct('m - d', 'n')} AS duplicate_key_rate_pct FROM (SELECT count(*) AS n, count(*) FILTER ({ne(k)}) AS m, count(DISTINCT trim({k})) FILTER ({ne(k)}) AS d FROM {t})"""
        for t, k in vocab.PRIMARY_KEYS.items()
        if t in EVIDENCE_TABLES
    ),
)
def key_profile(spark, sf):
    return K.key_profiles(tables(spark, sf, *EVIDENCE_TABLES), vocab.PRIMARY_KEYS)


_A15 = {
    "transactions": "transaction_id", "call_center_interactions": "interaction_id", "call_transcripts": "transcript_id",
    "complaints": "complaint_id", "satisfaction_surveys": "survey_id", "digital_events": "transaction_id",
}


@register(
    "a15_duplicate_validation",
    with_tables(*_A15)
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, count(*) AS total_rows, count(DISTINCT {k}) AS distinct_pk, count(*) - count(DISTINCT {k}) AS duplicate_pk_rows FROM {t}"
        for t, k in _A15.items()
    ),
)
def duplicate_validation(spark, sf):
    return K.duplicate_validation(tables(spark, sf, *_A15), _A15)


_A16 = ("transactions", "satisfaction_surveys", "branches")


@register(
    "a16_exact_duplicate_rows",
    with_tables(*_A16)
    + """, p AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem)"""
    + "\n"
    + each(
        "SELECT '{t}' AS dataset, count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS exact_duplicate_rows FROM {t}",
        (*_A16, "p"),
    ),
)
def exact_duplicate_rows(spark, sf):
    t = tables(spark, sf, *_A16)
    t["p"] = driver_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return union(K.exact_duplicate_rows(df, n) for n, df in t.items())


@register(
    "a17_id_repeats",
    with_tables("transactions", "complaints")
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) - count(DISTINCT trim({c})) AS id_repeat_occurrences FROM {t} WHERE {ne(c)}"
        for t, cs in _PROFILED.items()
        for c in (*cs, *(("branch_id",) if t == "transactions" else ()))
        if c.endswith("_id")
    ),
)
def id_repeats(spark, sf):
    t = tables(spark, sf, "transactions", "complaints")
    return union(K.id_repeats(df, n) for n, df in t.items())


# --- A18-A21 --------------------------------------------------------------------------------------
def _dist_sql(t: str, cols, family: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS dataset, '{c}' AS field, coalesce(nullif(trim({c}), ''), 'UNKNOWN') AS category, count(*) AS rows,
        round(count(*) / (SELECT count(*) FROM {t}) * 100, 6) AS percentage, '{family}' AS distribution_family FROM {t} GROUP BY 3"""
        for c in cols
    )


@register("a18_category_distribution", with_tables("transactions") + _dist_sql("transactions", ["transaction_status"]))
def category_distribution(spark, sf):
    return P.distribution(table(spark, sf, "transactions"), "transactions", ["transaction_status"])


@register(
    "a19_many_column_distribution",
    with_tables("transactions", "call_center_interactions", "complaints", "call_transcripts")
    + "\nUNION ALL\n".join(_dist_sql(t, cs, f) for f, (t, cs) in vocab.DISTRIBUTION_COLUMNS.items()),
)
def many_column_distribution(spark, sf):
    from probanza.plans.evidence import distributions

    return distributions(tables(spark, sf, "transactions", "call_center_interactions", "complaints", "call_transcripts"))


_COHORT = ["contact_reason", "reason_category", "was_resolved", "was_escalated", "has_transcript"]


@register(
    "a20_cohorts",
    with_tables("call_center_interactions")
    + f"""SELECT {', '.join(_COHORT)}, count(*) AS interaction_count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_total
    FROM call_center_interactions GROUP BY ALL""",
)
def cohorts(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    counts = calls.groupBy(*_COHORT).agg(F.count(F.lit(1)).alias("interaction_count"))
    return with_share(counts, "interaction_count", "pct_of_total", digits=2)


@register(
    "a21_conditional_sums",
    with_tables("call_center_interactions")
    + """SELECT contact_reason, reason_category, count(*) AS interaction_count, count(*) FILTER (lower(trim(has_transcript)) = 'true') AS transcript_count,
      count(*) FILTER (trim(was_resolved) IN ('true', 'Sí')) AS resolved_count, count(*) FILTER (was_escalated = '1') AS escalated_count
    FROM call_center_interactions WHERE lower(reason_category) LIKE '%transaction%' OR lower(contact_reason) LIKE '%transaction%' GROUP BY ALL""",
)
def conditional_sums(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    related = calls.filter(C.contains_folded("transaction", "reason_category", "contact_reason"))
    return related.groupBy("contact_reason", "reason_category").agg(
        F.count(F.lit(1)).alias("interaction_count"),
        C.count_where(C.audit_true("has_transcript")).alias("transcript_count"),
        C.count_where(C.audit_true("was_resolved")).alias("resolved_count"),
        C.count_where(C.audit_true("was_escalated")).alias("escalated_count"),
    )


# --- A22-A26 --------------------------------------------------------------------------------------
@register(
    "a22_resolution_classes",
    with_tables("call_transcripts", "call_center_interactions", "products")
    + """, owned AS (SELECT customer_id, product_type, count(product_id) AS n FROM products GROUP BY customer_id, product_type),
    calls AS (SELECT interaction_id, customer_id FROM call_center_interactions WHERE contact_reason = 'Transaccional'),
    asked AS (SELECT transcript_id, interaction_id,
        CASE WHEN contains(lower(customer_text), 'cuenta de ahorros') THEN 'Cuenta Ahorro'
             WHEN contains(lower(customer_text), 'tarjeta de crédito') THEN 'Tarjeta Crédito' END AS wanted
        FROM call_transcripts WHERE customer_text IS NOT NULL),
    resolved AS (SELECT DISTINCT transcript_id, calls.customer_id, wanted, coalesce(n, 0) AS n
        FROM asked JOIN calls USING (interaction_id)
        LEFT JOIN owned ON owned.customer_id = calls.customer_id AND owned.product_type = wanted),
    classes AS (SELECT ['NO_PRODUCT', 'UNIQUE_PRODUCT', 'MULTIPLE_PRODUCTS'][least(n, 2) + 1] AS resolution_class, wanted,
        count(*) AS transcripts, count(DISTINCT customer_id) AS customers FROM resolved GROUP BY ALL),
    totals AS (SELECT wanted, sum(transcripts) AS total FROM classes GROUP BY wanted)
    SELECT resolution_class, classes.wanted AS expected_product_type, transcripts, customers,
        round(100.0 * transcripts / total, 2) AS pct_within_product_type
    FROM classes JOIN totals ON totals.wanted IS NOT DISTINCT FROM classes.wanted""",
)
def resolution_classes(spark, sf):
    t = tables(spark, sf, "call_transcripts", "call_center_interactions", "products")
    return D.resolution_classes(t["call_transcripts"], t["call_center_interactions"], t["products"])


@register(
    "a23_complaint_life_cycle",
    with_tables("complaints")
    + f""", x AS (SELECT {ts('creation_date')} AS c, {ts('resolution_date')} AS r FROM complaints)
    SELECT count(*) AS total_complaints, count(r) AS resolved_count, count(*) - count(r) AS unresolved_count, count(*) FILTER (r < c) AS negative_resolution_lag,
      min(c) AS min_creation_date, max(c) AS max_creation_date, min(r) AS min_resolution_date, max(r) AS max_resolution_date FROM x""",
)
def complaint_life_cycle(spark, sf):
    parsed = table(spark, sf, "complaints").select(
        C.parse_ts("creation_date").alias("c"), C.parse_ts("resolution_date").alias("r")
    )
    return parsed.agg(
        F.count(F.lit(1)).alias("total_complaints"),
        F.count("r").alias("resolved_count"),
        C.count_where(F.col("r").isNull()).alias("unresolved_count"),
        C.count_where(F.col("r") < F.col("c")).alias("negative_resolution_lag"),
        F.min("c").alias("min_creation_date"),
        F.max("c").alias("max_creation_date"),
        F.min("r").alias("min_resolution_date"),
        F.max("r").alias("max_resolution_date"),
    )


@register(
    "a24_temporal_summary",
    with_tables("transactions")
    + f""", x AS (SELECT {ts('transaction_date')} AS e, {ts('process_date')} AS p, customer_id FROM transactions)
    SELECT min(e) AS min_event_date, max(e) AS max_event_date, min(p) AS min_process_date, max(p) AS max_process_date,
      count(*) FILTER (e > p) AS event_after_process_count, count(DISTINCT customer_id) AS unique_customers FROM x""",
)
def temporal_summary(spark, sf):
    parsed = table(spark, sf, "transactions").select(
        C.parse_ts("transaction_date").alias("e"), C.parse_ts("process_date").alias("p"), "customer_id"
    )
    return parsed.agg(
        F.min("e").alias("min_event_date"),
        F.max("e").alias("max_event_date"),
        F.min("p").alias("min_process_date"),
        F.max("p").alias("max_process_date"),
        C.count_where(F.col("e") > F.col("p")).alias("event_after_process_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


@register(
    "a25_customers_per_year",
    with_tables("complaints")
    + f"""SELECT year, count(*) AS customers FROM (SELECT DISTINCT year({ts('creation_date')}) AS year, customer_id FROM complaints
      WHERE {ts('creation_date')} IS NOT NULL) GROUP BY year""",
)
def customers_per_year(spark, sf):
    return X.yearly_entities(table(spark, sf, "complaints"), "customer_id", C.parse_ts("creation_date"))


@register(
    "a26_language_coverage",
    with_tables("call_transcripts")
    + """SELECT 'labelled' AS form, coalesce(nullif(trim(detected_language), ''), 'UNKNOWN') AS language, count(*) AS transcript_count,
      round(100.0 * count(*) / (SELECT count(*) FROM call_transcripts), 2) AS percentage FROM call_transcripts GROUP BY 2
    UNION ALL SELECT 'raw', detected_language, count(*), round(100.0 * count(*) / (SELECT count(*) FROM call_transcripts), 2) FROM call_transcripts GROUP BY 2""",
)
def language_coverage(spark, sf):
    texts = table(spark, sf, "call_transcripts")

    def counted(form: str, language) -> DataFrame:
        counts = texts.groupBy(language.alias("language")).agg(F.count(F.lit(1)).alias("transcript_count"))
        return with_share(counts, "transcript_count", "percentage", digits=2).withColumn("form", F.lit(form))

    return counted("labelled", C.blank_to("detected_language")).unionByName(counted("raw", F.col("detected_language")))


# --- A27-A32 --------------------------------------------------------------------------------------
_LANGUAGES = """, v AS (SELECT coalesce(nullif(trim(detected_language), ''), 'UNKNOWN') AS v, count(*) AS rows FROM call_transcripts GROUP BY 1),
    k AS (SELECT v, rows, regexp_matches(v, '(?i)(^|[^a-z])es($|[^a-z])|spanish|español|espanol') AS es, regexp_matches(v, '(?i)(^|[^a-z])pt($|[^a-z])|portugu') AS pt,
      regexp_matches(v, '(?i)(^|[^a-z])en($|[^a-z])|english|inglés|ingles') AS en FROM v)
"""


@register(
    "a27_language_flags",
    with_tables("call_transcripts", "customers")
    + _LANGUAGES
    + """SELECT bool_or(es) AS spanish_observed, bool_or(pt) AS portuguese_observed, bool_or(en) AS english_observed, count(*) FILTER (NOT (es OR pt OR en)) AS other_values,
      (SELECT count(*) FROM customers WHERE regexp_matches(detected_accent, '(?i)portugu|brasil|brazil')) AS portuguese_accents,
      (SELECT round(count(*) FILTER (regexp_matches(detected_accent, '(?i)portugu|brasil|brazil')) / count(*) * 100, 4) FROM customers) AS portuguese_accent_pct FROM k""",
)
def language_flags(spark, sf):
    t = tables(spark, sf, "call_transcripts", "customers")
    flags = W.language_flags(P.distribution(t["call_transcripts"], "call_transcripts", ["detected_language"]))
    accents = W.portuguese_share(t["customers"], "customers", "detected_accent")
    return flags.select(
        "*",
        accents.select("portuguese_rows").scalar().alias("portuguese_accents"),
        accents.select("portuguese_pct").scalar().alias("portuguese_accent_pct"),
    )


@register(
    "a27_language_classes",
    with_tables("call_transcripts")
    + _LANGUAGES
    + "SELECT v AS category, rows, es AS spanish, pt AS portuguese, en AS english, NOT (es OR pt OR en) AS other FROM k",
)
def language_classes(spark, sf):
    texts = table(spark, sf, "call_transcripts")
    return W.language_classes(P.distribution(texts, "call_transcripts", ["detected_language"]))


@register(
    "a28_country_accent_pairs",
    with_tables("customers")
    + """SELECT coalesce(nullif(trim(country), ''), 'UNKNOWN') AS country, coalesce(nullif(trim(detected_accent), ''), 'UNKNOWN') AS accent, count(*) AS rows
    FROM customers GROUP BY ALL""",
)
def country_accent_pairs(spark, sf):
    return table(spark, sf, "customers").groupBy(
        C.blank_to("country").alias("country"), C.blank_to("detected_accent").alias("accent")
    ).agg(F.count(F.lit(1)).alias("rows"))


_TEXTS = {"call_transcripts": ["customer_text"], "satisfaction_surveys": ["open_comments"], "complaints": ["resolution"]}


@register(
    "a29_text_profile",
    with_tables(*_TEXTS)
    + per_column(
        """SELECT '{t}' AS dataset, '{c}' AS column_name, u AS usable_rows, """
        + pct("u", "n", 4)
        + """ AS usable_pct, coalesce(round(av, 2), 0.0) AS avg_characters, coalesce(mx, 0) AS max_characters, d AS distinct_text_values, """
        + pct("(u - d)", "u", 4)
        + """ AS duplicate_text_rate_pct FROM (SELECT count(*) AS n, count(*) FILTER (trim({c}) <> '') AS u, avg(length({c})) AS av, max(length({c})) AS mx, count(DISTINCT {c}) AS d FROM {t})""",
        _TEXTS,
    ),
)
def text_profile(spark, sf):
    t = tables(spark, sf, *_TEXTS)
    return union(P.text_profile(t[n], n, cs) for n, cs in _TEXTS.items())


_DAILY = {"call_center_interactions": "interaction_date", "complaints": "creation_date", "transactions": "transaction_date"}


@register(
    "a30_daily_counts",
    with_tables(*_DAILY)
    + "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS dataset, CAST({ts(c)} AS DATE) AS event_date, strftime({ts(c)}, '%Y') AS year, strftime({ts(c)}, '%Y-%m') AS month, count(*) AS rows
        FROM {t} WHERE {ts(c)} IS NOT NULL GROUP BY ALL"""
        for t, c in _DAILY.items()
    ),
)
def daily_counts(spark, sf):
    t = tables(spark, sf, *_DAILY)
    return union(X.daily_counts(t[n], n, C.parse_ts(c)) for n, c in _DAILY.items())


@register(
    "a32_workflow_volumes",
    with_tables("call_center_interactions")
    + """, r AS (SELECT lower(coalesce(nullif(trim(reason_category), ''), nullif(trim(contact_reason), ''), 'UNKNOWN')) AS r FROM call_center_interactions),
    x AS (SELECT 'A Transaction Issue Triage and Safe Resolution' AS workflow, count(*) FILTER (regexp_matches(r, 'transaccional|transaction|fraud|dispute')) AS v, count(*) AS n FROM r
      UNION ALL SELECT 'B Complaint Status, Intake, and Escalation', count(*) FILTER (regexp_matches(r, 'queja|complaint|reclamo')), count(*) FROM r
      UNION ALL SELECT 'C Digital Failure Recovery', count(*) FILTER (regexp_matches(r, 'técnico|tecnico|digital|login')), count(*) FROM r
      UNION ALL SELECT 'D Routine Account or Product Inquiry', count(*) FILTER (regexp_matches(r, 'producto|cuenta|información|informacion')), count(*) FROM r)
    SELECT workflow, v AS interaction_volume, round(v / n * 100, 4) AS share_pct FROM x""",
)
def workflow_volumes(spark, sf):
    return W.workflow_volumes(table(spark, sf, "call_center_interactions"))


# --- A33-A37 --------------------------------------------------------------------------------------
@register(
    "a33_threshold_feasibility",
    with_tables("transactions", "customers", "call_center_interactions")
    + f""", r AS (SELECT coalesce(reason_category, contact_reason, 'UNKNOWN') AS r FROM call_center_interactions),
    m AS (SELECT 'transaction records' AS criterion, CAST(count(*) AS DOUBLE) AS value FROM transactions
      UNION ALL SELECT 'transaction/customer join', round(count(*) FILTER (k IN (SELECT customer_id FROM customers)) / count(*) * 100, 4)
        FROM (SELECT DISTINCT trim(customer_id) AS k FROM transactions WHERE {ne('customer_id')})
      UNION ALL SELECT 'transaction-related interactions', count(*) FILTER (regexp_matches(r, '(?i)trans|fraud|dispute|payment|withdraw|transfer')) FROM r
      UNION ALL SELECT 'complaint-related interactions', count(*) FILTER (regexp_matches(r, '(?i)complaint|queja|reclamo')) FROM r),
    l AS (SELECT * FROM (VALUES ('A', 'transaction records', 0, '>0'), ('A', 'transaction/customer join', 95, '>=95'), ('A', 'transaction-related interactions', 1000, '>=1000'),
      ('B', 'complaint records', 0, '>0'), ('B', 'complaint/customer join', 95, '>=95'), ('B', 'complaint-related interactions', 1000, '>=1000')) v(workflow, criterion, k, threshold))
    SELECT workflow, criterion, value, threshold, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN (threshold LIKE '>=%' AND value >= k) OR (threshold = '>0' AND value > 0) THEN 'PASS'
      ELSE 'PARTIAL' END AS status FROM l LEFT JOIN m USING (criterion)""",
)
def threshold_feasibility(spark, sf):
    return A.feasibility(tables(spark, sf, "transactions", "customers", "call_center_interactions"))


@register(
    "a34_category_mapping",
    with_tables("call_center_interactions")
    + f""", d AS ({_dist_sql('call_center_interactions', ['contact_reason', 'reason_category'])}), n AS (SELECT greatest(CAST(floor(sum(rows) / 2) AS BIGINT), 1) AS n FROM d)
    SELECT field AS observed_field, category AS observed_category, CASE category WHEN 'Transaccional' THEN 'transaction_inquiry' WHEN 'Queja' THEN 'dispute' ELSE 'unknown' END AS candidate_intent,
      CASE WHEN category IN ('Transaccional', 'Queja') THEN 'observed_taxonomy_policy' ELSE 'policy_no_evidence' END AS mapping_method,
      CASE category WHEN 'Transaccional' THEN 'MEDIUM' WHEN 'Queja' THEN 'LOW' ELSE 'NONE' END AS mapping_confidence, rows AS row_count,
      round(rows / n * 100, 6) AS percentage, CASE WHEN category IN ('Transaccional', 'Queja') THEN 'MAPPED' ELSE 'UNMAPPED_NO_EVIDENCE' END AS status FROM d, n
    UNION ALL SELECT 'contact_reason|reason_category', 'NO_EVIDENCE_IN_OBSERVED_TAXONOMY', unnest(['failed_transaction', 'payment_problem', 'transfer_problem', 'withdrawal_problem']),
      'none_available', 'NONE', 0, 0.0, 'NO_EVIDENCE_IN_OBSERVED_TAXONOMY'
    UNION ALL SELECT 'interaction_type', 'ALL (channel/type metadata: Inbound Call, Outbound Call, Chat, Email, Video)', 'unknown', 'excluded_field', 'NONE', 0, 0.0, 'FIELD_NOT_SUITABLE_FOR_INTENT_MAPPING'""",
)
def category_mapping(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    fields = ["contact_reason", "reason_category", "interaction_type"]
    return W.category_mapping(P.distribution(calls, "call_center_interactions", fields))


def metric_rows(records: DataFrame, key: str = "workflow") -> DataFrame:
    """Numbers as numbers and labels as text, for comparison."""
    words = F.when(F.col("value_num").isNull(), F.col("value"))
    return records.select(key, "metric", "value_num", words.alias("value_text"), "evidence_status")


def number_sql(key: str, metric: str, expr: str, missing: str = "UNKNOWN", frm: str = "x") -> str:
    status = missing if missing == "NOT_APPLICABLE" else "UNKNOWN"
    return f"""SELECT '{key}' AS {{k}}, '{metric}' AS metric, CAST({expr} AS DOUBLE) AS value_num, CASE WHEN ({expr}) IS NULL THEN '{missing}' END AS value_text,
      CASE WHEN ({expr}) IS NULL THEN '{status}' ELSE 'EXACT' END AS evidence_status FROM {frm}"""


def label_sql(key: str, metric: str, expr: str, status: str = "EXACT", frm: str = "x") -> str:
    return f"""SELECT '{key}' AS {{k}}, '{metric}' AS metric, CAST(NULL AS DOUBLE) AS value_num, {expr} AS value_text, '{status}' AS evidence_status FROM {frm}"""


def metric_union(parts: list[str], key: str = "workflow") -> str:
    return "\nUNION ALL\n".join(p.replace("{k}", key) for p in parts)


def truthy(c: str) -> str:
    return f"(lower(trim(coalesce({c}, ''))) IN ('true', 'yes', '1', 'si', 'sí'))"


@register(
    "a35_workflow_a",
    with_tables("transactions", "call_center_interactions")
    + f""", i AS (SELECT *, contact_reason IN ('Transaccional', 'Queja') OR coalesce(reason_category, '') IN ('Transaccional', 'Queja') AS rel FROM call_center_interactions),
    x AS (SELECT count(*) AS n, count(*) FILTER (rel) AS r, count(*) FILTER (contact_reason IN ('Transaccional', 'Queja')) AS cov,
      count(*) FILTER (rel AND {truthy('was_resolved')}) AS a, count(*) FILTER (rel AND {truthy('was_escalated')}) AS b, count(*) FILTER (rel AND {truthy('requires_followup')}) AS c,
      count(*) FILTER (rel AND {truthy('has_transcript')}) AS d FROM i),
    y AS (SELECT count(*) AS n, count(*) FILTER (lower(transaction_status) IN ('failed', 'failure', 'rejected', 'declined', 'cancelled', 'canceled')) AS f,
      count(*) FILTER ({ne('is_fraud')} OR {ne('fraud_score')}) AS g FROM transactions)
    """
    + metric_union(
        [
            number_sql("A", "total_transaction_records", "n", frm="y"),
            number_sql("A", "total_call_center_interactions", "n"),
            number_sql("A", "failed_or_rejected_transaction_volume", "f", frm="y"),
            number_sql("A", "fraud_fields_existing_evidence_only", "g", frm="y"),
            number_sql("A", "mapped_category_count", "2"),
            label_sql("A", "mapped_categories", "'Queja,Transaccional'"),
            label_sql("A", "granular_failure_intents_evidence", "'NO_EVIDENCE_IN_OBSERVED_TAXONOMY'", "UNKNOWN"),
            number_sql("A", "transaction_related_interaction_coverage_lower_bound", "round(cov / n * 100, 6)"),
            number_sql("A", "transaction_related_customer_service_interactions", "r"),
            number_sql("A", "relevant_interaction_percentage", "round(r / n * 100, 6)"),
            number_sql("A", "resolved_rate", "round(a / r * 100, 6)"),
            number_sql("A", "escalation_rate", "round(b / r * 100, 6)"),
            number_sql("A", "follow_up_rate", "round(c / r * 100, 6)"),
            number_sql("A", "transcript_availability_rate", "round(d / r * 100, 6)"),
        ]
    ),
)
def workflow_a(spark, sf):
    t = tables(spark, sf, "transactions", "call_center_interactions")
    return metric_rows(W.workflow_a(t["transactions"], t["call_center_interactions"]))


def _rate(c: str) -> str:
    return f"round({c} / n * 100, 6)"


@register(
    "a36_workflow_b",
    with_tables("complaints", "call_center_interactions")
    + f""", x AS (SELECT count(*) AS n, count(*) FILTER ({ne('customer_id')}) AS cu, count(*) FILTER ({ne('affected_product_id')}) AS pr, count(*) FILTER ({ne('origin_interaction_id')}) AS orig,
      count(*) FILTER ({ne('assigned_agent_id')}) AS ag, count(*) FILTER ({ne('resolution_date')}) AS rd, count(*) FILTER ({ne('closing_date')}) AS cd, count(*) FILTER ({ne('resolution')}) AS re,
      count(*) FILTER ({ne('resolution_satisfaction')}) AS sa, count(*) FILTER ({ne('sla_breached')}) AS sla, count(*) FILTER ({truthy('sla_breached')}) AS br,
      (SELECT round(count(*) FILTER (k IN (SELECT interaction_id FROM call_center_interactions)) / count(*) * 100, 6)
         FROM (SELECT DISTINCT trim(origin_interaction_id) AS k FROM complaints WHERE {ne('origin_interaction_id')})) AS om FROM complaints)
    """
    + metric_union(
        [
            number_sql("B", "complaint_total", "n"),
            number_sql("B", "complaint_customer_link_rate", _rate("cu")),
            number_sql("B", "complaint_product_link_rate", _rate("pr")),
            number_sql("B", "complaint_origin_interaction_nonnull_rate", _rate("orig")),
            number_sql("B", "complaint_origin_interaction_match_rate", "om"),
            label_sql("B", "complaint_interaction_context_linkage", "CASE WHEN om > 0 THEN 'OBSERVED' ELSE 'FK_PRESENT_UNMATCHED' END"),
            number_sql("B", "complaint_agent_assignment_rate", _rate("ag")),
            number_sql("B", "complaint_resolution_date_rate", _rate("rd")),
            number_sql("B", "complaint_closing_date_rate", _rate("cd")),
            number_sql("B", "complaint_resolution_rate", _rate("re")),
            number_sql("B", "complaint_resolution_satisfaction_rate", _rate("sa")),
            number_sql("B", "complaint_sla_breach_rate", "round(br / sla * 100, 6)"),
            label_sql("B", "complaint_intake_feasibility", "CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END"),
            label_sql("B", "complaint_customer_linkage_feasibility", "CASE WHEN cu / n >= 0.99 THEN 'PASS' WHEN cu > 0 THEN 'PARTIAL' ELSE 'FAIL' END"),
            label_sql("B", "complaint_product_linkage_feasibility", "CASE WHEN pr > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END"),
            label_sql("B", "complaint_interaction_context_feasibility", "CASE WHEN orig > 0 THEN 'PARTIAL' ELSE 'UNKNOWN_MISSING_FK' END"),
            label_sql("B", "complaint_agent_linkage_feasibility", "CASE WHEN ag > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END"),
            label_sql("B", "complaint_resolution_outcome_availability", "CASE WHEN re > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END"),
            label_sql("B", "complaint_resolution_quality_evaluation_feasibility", "CASE WHEN sa > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END"),
        ]
    ),
)
def workflow_b(spark, sf):
    t = tables(spark, sf, "complaints", "call_center_interactions")
    edge = ("complaints", "origin_interaction_id", "call_center_interactions", "interaction_id")
    return metric_rows(W.workflow_b(t["complaints"], K.fk_profile(t, edge)))


@register(
    "a37_first_metrics",
    with_tables("complaints", "transactions")
    + f""", x AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, 'null_count' AS metric, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) AS value_num FROM {t} UNION ALL SELECT '{t}', '{c}', 'empty_count', count(*) FILTER (trim({c}) = '') FROM {t}")})
    SELECT dataset || '|' || column_name || '|' || metric AS record_id, value_num FROM x ORDER BY 1 LIMIT 12""",
)
def first_metrics(spark, sf):
    from probanza.plans.evidence import quality_records, table_facts

    records = quality_records(table_facts(tables(spark, sf, "complaints", "transactions"), vocab.SCOPED_COLUMNS))
    return M.first_metrics(records.select("record_id", "value_num"), ["record_id"])


@register(
    "a40_metric_records",
    with_tables("complaints", "transactions")
    + f""", x AS ({per_column("SELECT '{t}' AS dataset, '{c}' AS column_name, 'null_count' AS metric, count(*) FILTER ({c} IS NULL) AS v FROM {t} UNION ALL SELECT '{t}', '{c}', 'empty_count', count(*) FILTER (trim({c}) = '') FROM {t}")})
    SELECT dataset || '|' || column_name || '|' || metric AS record_id, dataset, column_name, metric, CAST(v AS VARCHAR) AS value, CAST(v AS DOUBLE) AS value_num,
      'rows' AS unit, 'EXACT' AS evidence_status, CAST(NULL AS VARCHAR) AS note FROM x""",
)
def metric_records(spark, sf):
    from probanza.plans.evidence import quality_records, table_facts

    return quality_records(table_facts(tables(spark, sf, "complaints", "transactions"), vocab.SCOPED_COLUMNS))
