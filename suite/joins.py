"""Joins and keys: J1-J19."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import decide as D
from probanza.operators import keys as K
from probanza.operators import score as R
from probanza.operators import temporal as X
from probanza.operators.joins import lookup_join
from suite.domain import table, tables, with_tables
from suite.registry import register

EVIDENCE_TABLES = tuple(vocab.SCOPED_COLUMNS)


def ne(c: str) -> str:
    return f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')"


def ts(c: str) -> str:
    return f"try_cast(nullif(trim(CAST({c} AS VARCHAR)), '') AS TIMESTAMP)"


def pct(a: str, b: str, digits: int = 6) -> str:
    return f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b} * 100, {digits}) ELSE 0.0 END"


# --- J1 -------------------------------------------------------------------------------------------
@register(
    "j01_transcript_interaction",
    with_tables("call_transcripts", "call_center_interactions")
    + """SELECT t.transcript_id, i.interaction_id, i.contact_reason, length(t.customer_text) AS chars
    FROM call_transcripts t JOIN call_center_interactions i ON t.interaction_id = i.interaction_id""",
)
def transcript_interaction(spark, sf):
    t = tables(spark, sf, "call_transcripts", "call_center_interactions")
    texts = t["call_transcripts"].select(
        "transcript_id", "interaction_id", F.length("customer_text").cast("bigint").alias("chars")
    )
    calls = t["call_center_interactions"].select("interaction_id", "contact_reason")
    return lookup_join(texts, calls, "interaction_id", "inner")


# --- J2 -------------------------------------------------------------------------------------------
@register(
    "j02_composite_left_count",
    with_tables("call_transcripts", "products")
    + """, owned AS (SELECT customer_id, product_type, count(product_id) AS n FROM products GROUP BY customer_id, product_type),
    named AS (SELECT transcript_id, customer_id, CASE WHEN contains(lower(customer_text), 'cuenta de ahorros') THEN 'Cuenta Ahorro'
        WHEN contains(lower(customer_text), 'tarjeta de crédito') THEN 'Tarjeta Crédito' END AS expected_product_type FROM call_transcripts)
    SELECT transcript_id, named.customer_id, expected_product_type, coalesce(n, 0) AS compatible_product_count
    FROM named LEFT JOIN owned ON owned.customer_id = named.customer_id AND owned.product_type = named.expected_product_type""",
)
def composite_left_count(spark, sf):
    t = tables(spark, sf, "call_transcripts", "products")
    typed = t["call_transcripts"].select(
        "transcript_id", "customer_id", D.coarse_product_type("customer_text").alias("expected_product_type")
    )
    catalog = t["products"].groupBy("customer_id", F.col("product_type").alias("expected_product_type")).agg(
        F.count("product_id").alias("n")
    )
    counted = lookup_join(typed, catalog, ["customer_id", "expected_product_type"], "left")
    return counted.groupBy("transcript_id", "customer_id", "expected_product_type").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("compatible_product_count")
    )


# --- J3 -------------------------------------------------------------------------------------------
def _keys_of_both(c: str, ck: str, p: str, pk: str, key: str) -> str:
    """A row per key of either side with the rows that hold it as child and as parent."""
    return f"""(SELECT k, count(*) FILTER (child) AS c, count(*) FILTER (NOT child) AS p
      FROM (SELECT {key.format(ck)} AS k, true AS child FROM {c} UNION ALL SELECT {key.format(pk)}, false FROM {p}) GROUP BY k)"""


def fk_sql(edge) -> str:
    held = "FILTER (k IS NOT NULL AND {})".format
    return f"""SELECT '{"{}.{}->{}.{}".format(*edge)}' AS record_id, '{edge[0]}' AS child_dataset, '{edge[1]}' AS child_key,
      '{edge[2]}' AS parent_dataset, '{edge[3]}' AS parent_key, rows_c AS child_row_count, keyed_c AS non_null_child_keys,
      d AS distinct_child_keys, m AS matched_distinct_keys, d - m AS unmatched_distinct_keys,
      round(m / nullif(d, 0) * 100, 6) AS match_rate_pct, round((d - m) / nullif(d, 0) * 100, 6) AS orphan_rate_pct,
      coalesce(round(extra_p / nullif(rows_p, 0) * 100, 6), 0) AS parent_duplicate_key_rate_pct,
      if(d = 0, 'UNKNOWN_NO_NONNULL_KEYS', 'KNOWN') AS rate_status,
      if(d = 0, 'NO_NONNULL_CHILD_KEYS', 'OBSERVED RELATIONSHIP') AS status
    FROM (SELECT coalesce(sum(c), 0)::BIGINT AS rows_c, coalesce(sum(c) {held("true")}, 0)::BIGINT AS keyed_c,
        count(*) {held("c > 0")} AS d, count(*) {held("c > 0 AND p > 0")} AS m,
        sum(p) AS rows_p, coalesce(sum(p - 1) {held("p > 0")}, 0) AS extra_p
      FROM {_keys_of_both(*edge, "nullif(trim({}), '')")})"""


@register("j03_fk_profile", with_tables(*EVIDENCE_TABLES) + "\nUNION ALL\n".join(fk_sql(e) for e in vocab.EVIDENCE_EDGES))
def fk_profile(spark, sf):
    return K.fk_profiles(tables(spark, sf, *EVIDENCE_TABLES), vocab.EVIDENCE_EDGES)


# --- J4 -------------------------------------------------------------------------------------------
@register(
    "j04_unmatched_child_keys",
    with_tables("transactions", "products")
    + f"""SELECT trim(product_id) AS join_key, count(*) AS rows FROM transactions
    WHERE {ne('product_id')} AND trim(product_id) NOT IN (SELECT trim(product_id) FROM products WHERE {ne('product_id')})
    GROUP BY 1""",
)
def unmatched_child_keys(spark, sf):
    t = tables(spark, sf, "transactions", "products")
    return K.unmatched_keys(t["transactions"], "product_id", t["products"], "product_id")


# --- J5 -------------------------------------------------------------------------------------------
_EDGE_TABLES = tuple(dict.fromkeys(t for c, _, p, _ in vocab.DOCUMENTED_EDGES for t in (c, p)))


def _row_fk_sql(edge) -> str:
    c, ck, p, pk = edge
    head = f"SELECT '{c}' AS child_table, '{ck}' AS child_column, '{p}' AS parent_table, '{pk}' AS parent_column,"
    return f"""{head} n AS child_rows, m AS matched_rows, n - z - m AS orphan_rows, {pct('n - z - m', '(n - z)', 4)} AS orphan_rate,
      z AS null_rows, {pct('z', 'n', 4)} AS null_rate, 'observed' AS status
      FROM (SELECT count(*) AS n, count(*) FILTER (NOT {ne(ck)}) AS z,
        count(*) FILTER ({ne(ck)} AND {ck} IN (SELECT {pk} FROM {p})) AS m FROM {c})"""


@register("j05_fk_row_profile", with_tables(*_EDGE_TABLES) + "\nUNION ALL\n".join(_row_fk_sql(e) for e in vocab.DOCUMENTED_EDGES))
def fk_row_profile(spark, sf):
    """All documented relationships."""
    return K.fk_row_profiles(tables(spark, sf, *_EDGE_TABLES), vocab.DOCUMENTED_EDGES)


# --- J6 -------------------------------------------------------------------------------------------
def _reconcile_sql(c, ck, p, pk, prefix) -> str:
    return f"""SELECT '{c}' AS child, sum(a)::BIGINT AS distinct_child_keys, sum(b)::BIGINT AS distinct_parent_keys,
      sum(ab)::BIGINT AS exact_matches, sum(a * b)::BIGINT AS normalized_matches, 'MEASURED' AS status
    FROM (SELECT count(*) FILTER (c > 0) AS a, count(*) FILTER (p > 0) AS b, count(*) FILTER (c > 0 AND p > 0) AS ab
      FROM {_keys_of_both(c, ck, p, pk, "{}")} WHERE k IS NOT NULL GROUP BY regexp_replace(k, '^{prefix}[-_]', ''))"""


@register(
    "j06_key_reconciliation",
    with_tables("complaints", "call_center_interactions", "digital_events", "transactions")
    + _reconcile_sql("complaints", "origin_interaction_id", "call_center_interactions", "interaction_id", "INT")
    + "\nUNION ALL\n"
    + _reconcile_sql("digital_events", "transaction_id", "transactions", "transaction_id", "TRX"),
)
def key_reconciliation(spark, sf):
    t = tables(spark, sf, "complaints", "call_center_interactions", "digital_events", "transactions")
    a = K.key_reconciliation(
        t["complaints"], "origin_interaction_id", t["call_center_interactions"], "interaction_id", "INT"
    ).select(F.lit("complaints").alias("child"), "*")
    b = K.key_reconciliation(t["digital_events"], "transaction_id", t["transactions"], "transaction_id", "TRX")
    return a.unionByName(b.select(F.lit("digital_events").alias("child"), "*"))


@register(
    "j06_key_reconciliation_missing_column",
    """SELECT CAST(NULL AS BIGINT) AS distinct_child_keys, CAST(NULL AS BIGINT) AS distinct_parent_keys,
    CAST(NULL AS BIGINT) AS exact_matches, CAST(NULL AS BIGINT) AS normalized_matches, 'UNKNOWN_MISSING_COLUMN' AS status
    FROM (SELECT count(*) FROM events)""",
)
def key_reconciliation_missing_column(spark, sf):
    t = tables(spark, sf, "digital_events", "transactions")
    events = t["digital_events"].drop("transaction_id")
    return K.key_reconciliation(events, "transaction_id", t["transactions"], "transaction_id", "TRX")


# --- J7 -------------------------------------------------------------------------------------------
def _status_sql(edge) -> str:
    c, ck, p, pk = edge
    return f"""SELECT '{c}' AS child_dataset, '{ck}' AS child_key, '{p}' AS parent_dataset, '{pk}' AS parent_key,
      m AS matched_child_keys, d - m AS unmatched_child_keys, {pct('m', 'd', 4)} AS match_rate_pct, {pct('d - m', 'd', 4)} AS orphan_rate_pct,
      {pct('r', 'd', 4)} AS duplicate_join_key_rate_pct,
      CASE WHEN d > 0 AND m / d >= 0.95 THEN 'VERIFIED RELATIONSHIP' ELSE 'LIKELY RELATIONSHIP' END AS status
      FROM (SELECT count(*) AS d, count(*) FILTER (n > 1) AS r,
              count(*) FILTER (k IN (SELECT trim({pk}) FROM {p} WHERE {ne(pk)})) AS m
            FROM (SELECT trim({ck}) AS k, count(*) AS n FROM {c} WHERE {ne(ck)} GROUP BY 1))"""


@register("j07_relationship_status", with_tables(*_EDGE_TABLES) + "\nUNION ALL\n".join(_status_sql(e) for e in vocab.DOCUMENTED_EDGES))
def relationship_status(spark, sf):
    """All documented relationships."""
    return K.relationship_status(tables(spark, sf, *_EDGE_TABLES), vocab.DOCUMENTED_EDGES)


# --- J8 -------------------------------------------------------------------------------------------
@register(
    "j08_join_multiplicity",
    with_tables("call_center_interactions", "service_agents")
    + f""", per AS (SELECT trim(agent_id) AS k, count(*) AS n FROM call_center_interactions WHERE {ne('agent_id')} GROUP BY 1),
    hit AS (SELECT * FROM per WHERE k IN (SELECT agent_id FROM service_agents)),
    s AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM per) AS total, CAST(sum(n) AS BIGINT) AS matched, max(n) AS most FROM hit)
    SELECT n AS children_per_parent, count(*) AS parents, any_value(s.total) AS child_nonempty, any_value(s.matched) AS matched,
      {pct('any_value(s.matched)', 'any_value(s.total)', 4)} AS join_success_pct,
      CASE WHEN any_value(s.most) > 1 THEN 'one-to-many' ELSE 'one-to-one-or-sparse' END AS relationship
    FROM hit, s GROUP BY n""",
)
def join_multiplicity(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "service_agents")
    return K.multiplicity(t["call_center_interactions"], "agent_id", t["service_agents"], "agent_id")


# --- J9 -------------------------------------------------------------------------------------------
_ID_TABLES = {
    "customers": ("customer_id", "registration_branch_id"),
    "products": ("product_id", "customer_id", "opening_branch_id"),
    "service_agents": ("agent_id", "assigned_branch_id"),
    "transactions": ("transaction_id", "product_id", "customer_id"),
    "call_center_interactions": ("interaction_id", "customer_id", "agent_id"),
    "call_transcripts": ("transcript_id", "interaction_id", "customer_id", "agent_id"),
    "complaints": (
        "complaint_id", "customer_id", "affected_product_id", "related_branch_id", "origin_interaction_id", "assigned_agent_id",
    ),
    "satisfaction_surveys": ("survey_id", "interaction_id", "customer_id", "agent_id"),
    "digital_events": ("event_id", "customer_id", "product_id", "transaction_id"),
}
_STACKED = "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, trim({c}) AS v FROM {t} WHERE {ne(c)}" for t, cs in _ID_TABLES.items() for c in cs
)


@register(
    "j09_join_discovery",
    with_tables(*_ID_TABLES)
    + f""", s AS ({_STACKED}), z AS (SELECT t, c, count(*) AS n FROM s GROUP BY ALL),
    m AS (SELECT a.t AS child, a.c AS key_column, b.t AS parent, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.v = b.v AND a.t <> b.t GROUP BY ALL)
    SELECT child, key_column, parent, x.n AS child_distinct, y.n AS parent_distinct, m.n AS matched_distinct,
      x.n - m.n AS unmatched_distinct, round(m.n / x.n * 100, 4) AS join_success_pct
    FROM m JOIN z x ON x.t = child AND x.c = key_column JOIN z y ON y.t = parent AND y.c = key_column""",
)
def join_discovery(spark, sf):
    return K.discover_joins(tables(spark, sf, *_ID_TABLES))


# --- J10 ------------------------------------------------------------------------------------------
@register(
    "j10_scalar_combination",
    with_tables("call_center_interactions", "complaints", "satisfaction_surveys")
    + """SELECT (SELECT count(*) FROM call_center_interactions) AS interactions, (SELECT count(*) FROM complaints) AS complaints,
    (SELECT count(DISTINCT customer_id) FROM satisfaction_surveys) AS surveyed_customers,
    (SELECT count(*) FROM complaints) / (SELECT count(*) FROM call_center_interactions) AS complaints_per_interaction""",
)
def scalar_combination(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "complaints", "satisfaction_surveys")
    calls = t["call_center_interactions"].agg(F.count(F.lit(1)).alias("interactions"))
    complaints = t["complaints"].agg(F.count(F.lit(1)).alias("n")).scalar()
    surveyed = t["satisfaction_surveys"].agg(F.count_distinct("customer_id").alias("n")).scalar()
    return calls.select(
        "interactions",
        complaints.alias("complaints"),
        surveyed.alias("surveyed_customers"),
        (complaints / F.col("interactions")).alias("complaints_per_interaction"),
    )


# --- J11, J12 -------------------------------------------------------------------------------------
@register(
    "j11_child_before_parent",
    with_tables("call_center_interactions", "satisfaction_surveys")
    + f"""SELECT count(*) FILTER (s.d IS NOT NULL AND i.d IS NOT NULL) AS pairs_with_both_dates,
      count(*) FILTER (s.d < i.d) AS child_before_parent_pairs
    FROM (SELECT trim(interaction_id) AS k, CAST({ts('survey_date')} AS DATE) AS d FROM satisfaction_surveys WHERE {ne('interaction_id')}) s
    JOIN (SELECT trim(interaction_id) AS k, CAST({ts('interaction_date')} AS DATE) AS d FROM call_center_interactions) i USING (k)""",
)
def child_before_parent(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "satisfaction_surveys")
    return X.child_before_parent(
        t["satisfaction_surveys"], "interaction_id", C.parse_ts("survey_date"),
        t["call_center_interactions"], "interaction_id", C.parse_ts("interaction_date"),
    )


@register(
    "j11_order_lines_before_order",
    """SELECT count(*) AS pairs_with_both_dates, count(*) FILTER (CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) AS child_before_parent_pairs
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def order_lines_before_order(spark, sf):
    from suite.domain import driver_table

    lines, orders = driver_table(spark, sf, "lineitem"), driver_table(spark, sf, "orders")
    return X.child_before_parent(
        lines, "l_orderkey", F.col("l_shipdate"), orders, "o_orderkey", F.col("o_orderdate")
    )


@register(
    "j12_coverage",
    with_tables("call_center_interactions", "satisfaction_surveys")
    + f"""SELECT count(DISTINCT trim(i.interaction_id)) AS covered_parents FROM call_center_interactions i
    JOIN satisfaction_surveys s ON trim(i.interaction_id) = trim(s.interaction_id)
    WHERE {ne('i.interaction_id')} AND {ts('i.interaction_date')} IS NOT NULL""",
)
def coverage(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "satisfaction_surveys")
    return X.coverage(
        t["call_center_interactions"], "interaction_id", C.parse_ts("interaction_date"),
        t["satisfaction_surveys"], "interaction_id",
    )


# --- J13 ------------------------------------------------------------------------------------------
@register(
    "j13_lookup_missing_as_empty",
    with_tables("satisfaction_surveys", "call_center_interactions")
    + """SELECT s.survey_id, coalesce(trim(i.contact_reason), '') AS contact_reason, coalesce(trim(i.reason_category), '') AS reason_category
    FROM satisfaction_surveys s LEFT JOIN call_center_interactions i ON i.interaction_id = s.interaction_id
    WHERE coalesce(trim(i.contact_reason), '') <> 'Queja'""",
)
def lookup_missing_as_empty(spark, sf):
    t = tables(spark, sf, "satisfaction_surveys", "call_center_interactions")
    calls = t["call_center_interactions"].select("interaction_id", "contact_reason", "reason_category")
    joined = lookup_join(t["satisfaction_surveys"].select("survey_id", "interaction_id"), calls, "interaction_id", "left")
    return joined.select(
        "survey_id", C.strip("contact_reason").alias("contact_reason"), C.strip("reason_category").alias("reason_category")
    ).filter("contact_reason <> 'Queja'")


# --- J14, J15 -------------------------------------------------------------------------------------
@register(
    "j14_catalog_resolution",
    with_tables("requests", "products")
    + """, c AS (SELECT customer_id, product_type, count(*) AS n, min(product_id) AS first_product FROM products GROUP BY ALL)
    SELECT r.case_id, coalesce(c.n, 0) AS compatible_product_count,
      CASE WHEN c.n IS NULL THEN 'NO_PRODUCT' WHEN c.n = 1 THEN 'UNIQUE_PRODUCT' ELSE 'AMBIGUOUS' END AS resolution,
      CASE WHEN c.n = 1 THEN c.first_product ELSE '' END AS product_id
    FROM requests r LEFT JOIN c ON c.customer_id = r.customer_id AND c.product_type = 'Tarjeta Crédito'""",
)
def catalog_resolution(spark, sf):
    t = tables(spark, sf, "requests", "products")
    asked = t["requests"].select("case_id", "customer_id", F.lit("Tarjeta Crédito").alias("product_type"))
    joined = lookup_join(asked, D.catalog_index(t["products"]), ["customer_id", "product_type"], "left")
    count = F.coalesce("compatible_product_count", F.lit(0))
    return joined.select(
        "case_id",
        count.alias("compatible_product_count"),
        D.resolution(count).alias("resolution"),
        F.when(count == 1, F.col("product.product_id")).otherwise("").alias("product_id"),
    )


@register(
    "j15_customer_wide_resolution",
    with_tables("customers", "products")
    + """, c AS (SELECT customer_id, count(*) AS n, min(product_id) AS first_product FROM products
      WHERE product_type IN ('Cuenta Ahorro', 'Tarjeta Crédito') GROUP BY ALL)
    SELECT k.customer_id, CASE WHEN c.n IS NULL THEN 'NO_PRODUCT' WHEN c.n = 1 THEN 'UNIQUE_PRODUCT' ELSE 'AMBIGUOUS' END AS resolution,
      CASE WHEN c.n = 1 THEN c.first_product END AS product_id
    FROM customers k LEFT JOIN c USING (customer_id)""",
)
def customer_wide_resolution(spark, sf):
    t = tables(spark, sf, "customers", "products")
    joined = lookup_join(t["customers"].select("customer_id"), D.catalog_by_customer(t["products"]), "customer_id", "left")
    return joined.select(
        "customer_id",
        D.resolution(F.col("count_any")).alias("resolution"),
        F.when(F.col("count_any") == 1, F.col("product_any.product_id")).alias("product_id"),
    )


# --- J16, J17 -------------------------------------------------------------------------------------
@register(
    "j16_case_prediction",
    with_tables("cases", "answers")
    + """SELECT trim(c.case_id) AS case_id, c.expected_action, coalesce(a.predicted_action, '') AS predicted_action
    FROM cases c LEFT JOIN answers a ON a.case_id = trim(c.case_id) WHERE trim(c.case_id) <> ''""",
)
def case_prediction(spark, sf):
    t = tables(spark, sf, "cases", "answers")
    return R.join_predictions(t["cases"], t["answers"]).select("case_id", "expected_action", "predicted_action")


_POLICY_SQL = """CASE WHEN intent = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' WHEN intent <> 'BALANCE_INQUIRY' THEN 'REQUEST_CLARIFICATION'
      WHEN auth IN ('DENY', 'AUTH_REQUIRED') THEN auth WHEN resolution = 'NO_PRODUCT' THEN 'NO_PRODUCT_DISCLOSURE'
      WHEN resolution = 'UNIQUE_PRODUCT' AND auth = 'ALLOW' THEN 'READ_BALANCE' WHEN resolution = 'UNIQUE_PRODUCT' THEN 'AUTH_REQUIRED'
      ELSE 'REQUEST_CLARIFICATION' END"""


@register(
    "j17_policy_lookup",
    with_tables("cases")
    + f""", x AS (SELECT case_id, CASE WHEN category = '' THEN 'OTHER' ELSE expected_intent END AS intent, upper(expected_resolution) AS resolution,
       CASE WHEN expected_authorization = '' THEN 'NOT_APPLICABLE' ELSE expected_authorization END AS auth FROM cases),
    y AS (SELECT case_id, CASE WHEN resolution IN ('NO_PRODUCT', 'UNIQUE_PRODUCT', 'AMBIGUOUS') THEN {_POLICY_SQL}
        ELSE 'REQUEST_CLARIFICATION' END AS action FROM x)
    SELECT case_id, action, CASE WHEN action = 'READ_BALANCE' THEN 'ANSWER' WHEN action IN ('REQUEST_CLARIFICATION', 'NO_PRODUCT_DISCLOSURE') THEN 'CLARIFY'
      ELSE action END AS outcome FROM y""",
)
def policy_lookup(spark, sf):
    cases = table(spark, sf, "cases")
    staged = cases.select(
        "case_id",
        F.when(F.col("category") == "", "OTHER").otherwise(F.col("expected_intent")).alias("intent"),
        F.upper("expected_resolution").alias("resolution"),
        C.blank_to("expected_authorization", "NOT_APPLICABLE").alias("authorization"),
    )
    return D.with_action(staged).select("case_id", "action", "outcome")


# --- J18, J19 -------------------------------------------------------------------------------------
@register(
    "j18_missing_days",
    """WITH o AS (SELECT make_date(year(d), month(d), CASE WHEN month(d) = 2 THEN 28 ELSE greatest(day(d), 9) END) AS day
      FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)), d AS (SELECT DISTINCT day FROM o WHERE day IS NOT NULL)
    SELECT CAST(g AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS g)
    WHERE CAST(g AS DATE) NOT IN (SELECT day FROM d)""",
)
def missing_days(spark, sf):
    from suite.domain import driver_table

    # Booked on the 9th at the earliest, and on the 28th of February: every order has a day, and days are missing.
    day = F.to_date("o_orderdate")
    booked = F.when(F.month(day) == 2, 28).otherwise(F.greatest(F.dayofmonth(day), F.lit(9)))
    return X.missing_days(driver_table(spark, sf, "orders").select(F.make_date(F.year(day), F.month(day), booked).alias("day")), "day")


@register(
    "j19_product_lookup",
    with_tables("cases", "answers", "products")
    + """SELECT a.case_id, p.product_id, p.product_type, p.currency FROM answers a JOIN products p ON p.product_id = a.predicted_product_id
    WHERE a.predicted_product_id <> ''""",
)
def product_lookup(spark, sf):
    t = tables(spark, sf, "answers", "products")
    return D.product_lookup(t["answers"], t["products"])


