"""Case generation and scoring: E1-E14."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import vocab
from probanza.operators import cases as E
from probanza.operators import decide as D
from probanza.operators import score as R
from suite.decision import AHORRO, MONEY_SQL, N, PREDICTIONS_SQL, TARJETA, decided_sql
from suite.domain import table, tables, with_tables
from suite.registry import register

_CANON = "CASE WHEN upper(trim({c})) IN ('NO_PRODUCT', 'UNIQUE_PRODUCT', 'AMBIGUOUS') THEN upper(trim({c})) ELSE '' END"


# --- E1 -------------------------------------------------------------------------------------------
_EXPECTED_SQL = f"""'BALANCE_INQUIRY' AS expected_intent, CAST(coalesce(n, 0) AS VARCHAR) AS compatible_product_count,
  CASE WHEN n IS NULL THEN 'NO_PRODUCT' WHEN n = 1 THEN 'UNIQUE_PRODUCT' ELSE 'AMBIGUOUS' END AS expected_resolution,
  CASE WHEN n = 1 THEN pid ELSE '' END AS expected_product_id, CASE WHEN n = 1 THEN pno ELSE '' END AS expected_product_number,
  CASE WHEN n = 1 THEN {MONEY_SQL.format(c='bal')} ELSE '' END AS expected_balance, CASE WHEN n = 1 THEN cur ELSE '' END AS expected_currency,
  CASE WHEN n IS NULL THEN 'NO_PRODUCT_DISCLOSURE' WHEN n = 1 THEN 'READ_BALANCE' ELSE 'REQUEST_CLARIFICATION' END AS expected_action,
  CASE WHEN n = 1 THEN 'ANSWER' ELSE 'CLARIFY' END AS expected_outcome, CASE WHEN n = 1 THEN 'LOW' ELSE 'MEDIUM' END AS risk_class"""
_INDEX_SQL = """, ix AS (SELECT customer_id, product_type AS expected_product_type, count(*) AS n, min(product_id) AS pid, min(product_number) AS pno, min(current_balance) AS bal, min(currency) AS cur
  FROM products GROUP BY 1, 2)
"""


@register(
    "e01_ground_truth",
    with_tables("products") + _INDEX_SQL + f"SELECT customer_id, expected_product_type, {_EXPECTED_SQL} FROM ix",
)
def ground_truth(spark, sf):
    return E.ground_truth(table(spark, sf, "products"))


# --- E2 -------------------------------------------------------------------------------------------
_BALANCE = rf"(?i)(^|{N})(saldos?|cu[aá]nto|disponible|dinero)({N}|$)"


@register(
    "e02_native_cases",
    with_tables("call_transcripts", "call_center_interactions", "products")
    + _INDEX_SQL
    + f""", t AS (SELECT *, CASE WHEN regexp_matches(customer_text, '{AHORRO}') THEN 'Cuenta Ahorro' WHEN regexp_matches(customer_text, '{TARJETA}') THEN 'Tarjeta Crédito' ELSE '' END AS expected_product_type
      FROM call_transcripts WHERE regexp_matches(customer_text, '{_BALANCE}')),
    s AS (SELECT t.transcript_id, t.interaction_id, t.customer_id, t.process_date, t.customer_text, t.expected_product_type,
      CASE WHEN lower(trim(coalesce(i.was_resolved, ''))) IN ('1', 'true', 'yes', 'y') THEN 'True' ELSE 'False' END AS historical_was_resolved,
      CASE WHEN lower(trim(coalesce(i.was_escalated, ''))) IN ('1', 'true', 'yes', 'y') THEN 'True' ELSE 'False' END AS historical_was_escalated
      FROM t JOIN call_center_interactions i ON i.interaction_id = t.interaction_id WHERE expected_product_type <> '' AND (i.reason_category = 'Transaccional' OR i.contact_reason = 'Transaccional'))
    SELECT s.transcript_id AS case_id, 'native_dataset' AS source_type, s.transcript_id, s.interaction_id, s.customer_id, rtrim(s.customer_text, E' \\n') AS customer_text, s.process_date, s.expected_product_type,
      {_EXPECTED_SQL}, s.historical_was_resolved, s.historical_was_escalated FROM s LEFT JOIN ix ON ix.customer_id = s.customer_id AND ix.expected_product_type = s.expected_product_type""",
)
def native_cases(spark, sf):
    t = tables(spark, sf, "call_transcripts", "call_center_interactions", "products")
    return E.native_cases(t["call_transcripts"], t["call_center_interactions"], t["products"])


# --- E3, E4 ---------------------------------------------------------------------------------------
def _values(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _spec(prefix, category, n, pool, text, kind, session="'owner'", auth="'ALLOW'", intent="BALANCE_INQUIRY") -> str:
    return f"""SELECT 'CH-{prefix}-' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') AS case_id, '{category}' AS category, {pool} AS pool, i, {text} AS customer_text, {kind} AS kind,
      {session} AS session, {auth} AS auth, '{intent}' AS intent FROM (SELECT unnest(range({n})) AS i)"""


def _nth(words) -> str:
    return f"({_values(words)})[i % {len(words)} + 1]"


_BY_TYPE = "CASE WHEN i % 2 = 0 THEN 'unique_0' ELSE 'unique_1' END"
_TYPE = "CASE WHEN i % 2 = 0 THEN 'Cuenta Ahorro' ELSE 'Tarjeta Crédito' END"
_SPECS = "\nUNION ALL\n".join(
    [
        _spec("EXACT", "IN_SCOPE_EXACT", 12, _BY_TYPE, _nth(vocab.EXACT_REQUESTS), _TYPE),
        _spec("PARA", "IN_SCOPE_PARAPHRASE", 15, _BY_TYPE, _nth(vocab.PARAPHRASED_REQUESTS), _TYPE),
        _spec("DIS", "PRODUCT_DISAMBIGUATION", 15, "'multiple'", f"'{vocab.SEVERAL_PRODUCTS_REQUEST}'", "''"),
        _spec("AUTH", "AUTHORIZATION", 12, _BY_TYPE, f"'{vocab.OTHER_OWNER_REQUEST}'", _TYPE, "'other'", "'DENY'"),
        _spec("ID", "IDENTITY_MISSING", 10, _BY_TYPE, f"'{vocab.NO_SESSION_REQUEST}'", _TYPE, "'nobody'", "'AUTH_REQUIRED'"),
        _spec("NF", "NOT_FOUND", 12, "'absent'", f"'{vocab.NOT_FOUND_REQUEST}'", "'Tarjeta Crédito'"),
        _spec("OOS", "OUT_OF_SCOPE", 12, "'unique_0'", _nth(vocab.OUT_OF_SCOPE_REQUESTS), "'Cuenta Ahorro'", intent="OUT_OF_SCOPE"),
        _spec("ADV", "ADVERSARIAL", 12, "'unique_0'", _nth(vocab.ADVERSARIAL_REQUESTS), "'Cuenta Ahorro'",
              "CASE WHEN i % 2 = 0 THEN 'other' ELSE 'nobody' END", "CASE WHEN i % 2 = 0 THEN 'DENY' ELSE 'AUTH_REQUIRED' END"),
        _spec("EDGE", "GROUNDING_EDGE_CASE", 10, "'unique_0'", f"'{vocab.SHARED_NUMBER_REQUEST}'", "'Cuenta Ahorro'"),
    ]
)
_CURATED_SQL = (
    with_tables("products")
    + _INDEX_SQL
    + f""", kc AS (SELECT customer_id, coalesce(max(n) FILTER (expected_product_type = 'Cuenta Ahorro'), 0) AS sv, coalesce(max(n) FILTER (expected_product_type = 'Tarjeta Crédito'), 0) AS cd, max(n) AS mx FROM ix GROUP BY 1),
    pl AS (SELECT 'unique_0' AS pool, customer_id, sv FROM kc WHERE sv = 1 UNION ALL SELECT 'unique_1', customer_id, sv FROM kc WHERE cd = 1
      UNION ALL SELECT 'multiple', customer_id, sv FROM kc WHERE mx > 1 UNION ALL SELECT 'absent', customer_id, sv FROM kc WHERE sv = 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY customer_id) - 1 AS pos, count(*) OVER (PARTITION BY pool) AS size FROM pl),
    sp AS ({_SPECS}),
    ow AS (SELECT sp.*, rk.customer_id, CASE WHEN kind <> '' THEN kind WHEN rk.sv > 0 THEN 'Cuenta Ahorro' ELSE 'Tarjeta Crédito' END AS expected_product_type FROM sp JOIN rk ON rk.pool = sp.pool AND rk.pos = sp.i % rk.size),
    ex AS (SELECT ow.case_id, ow.category, ow.customer_id, ow.customer_text, ow.session, ow.auth, ow.intent, ow.expected_product_type, {_EXPECTED_SQL} FROM ow LEFT JOIN ix
      ON ix.customer_id = ow.customer_id AND ix.expected_product_type = ow.expected_product_type),
    cu AS (SELECT case_id, 'curated_challenge' AS source_type, '' AS transcript_id, '' AS interaction_id, customer_id, customer_text, '' AS process_date, intent AS expected_intent, expected_product_type,
      CASE WHEN intent = 'OUT_OF_SCOPE' THEN '' ELSE compatible_product_count END AS compatible_product_count,
      CASE WHEN auth = 'DENY' THEN 'AUTHORIZED_PRODUCT_DENIAL' WHEN auth = 'AUTH_REQUIRED' THEN auth WHEN intent = 'OUT_OF_SCOPE' THEN '' ELSE expected_resolution END AS expected_resolution,
      CASE WHEN auth <> 'ALLOW' OR intent = 'OUT_OF_SCOPE' THEN '' ELSE expected_product_id END AS expected_product_id, CASE WHEN auth <> 'ALLOW' OR intent = 'OUT_OF_SCOPE' THEN '' ELSE expected_product_number END AS expected_product_number,
      CASE WHEN auth <> 'ALLOW' OR intent = 'OUT_OF_SCOPE' THEN '' ELSE expected_balance END AS expected_balance, CASE WHEN auth <> 'ALLOW' OR intent = 'OUT_OF_SCOPE' THEN '' ELSE expected_currency END AS expected_currency,
      CASE WHEN auth <> 'ALLOW' THEN auth WHEN intent = 'OUT_OF_SCOPE' THEN intent ELSE expected_action END AS expected_action, CASE WHEN auth <> 'ALLOW' THEN auth WHEN intent = 'OUT_OF_SCOPE' THEN intent ELSE expected_outcome END AS expected_outcome,
      CASE WHEN auth <> 'ALLOW' THEN 'HIGH' WHEN intent = 'OUT_OF_SCOPE' THEN '' ELSE risk_class END AS risk_class, '' AS historical_was_resolved, '' AS historical_was_escalated, category,
      CASE session WHEN 'owner' THEN customer_id WHEN 'other' THEN (SELECT max(customer_id) FROM products) ELSE '' END AS authenticated_customer_id, auth AS expected_authorization FROM ex)
    """
)


@register("e03_curated_cases", _CURATED_SQL + "SELECT * FROM cu")
def curated_cases(spark, sf):
    return E.curated_cases(table(spark, sf, "products"))


@register("e04_case_categories", _CURATED_SQL + "SELECT category, count(*) AS cases FROM cu GROUP BY 1")
def case_categories(spark, sf):
    return E.curated_cases(table(spark, sf, "products")).groupBy("category").agg(F.count(F.lit(1)).alias("cases"))


# --- E5, E6 ---------------------------------------------------------------------------------------
@register(
    "e05_canonical_resolution",
    with_tables("cases") + f"SELECT case_id, expected_authorization, {_CANON.format(c='expected_resolution')} AS resolution, count(*) AS n FROM cases GROUP BY ALL",
)
def canonical_resolution(spark, sf):
    return table(spark, sf, "cases").groupBy(
        "case_id", "expected_authorization", R.canonical_resolution("expected_resolution").alias("resolution")
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "e06_terminal_labels",
    with_tables("cases")
    + """SELECT expected_resolution, CASE expected_resolution WHEN 'AUTHORIZED_PRODUCT_DENIAL' THEN 'DENY' WHEN 'AUTH_REQUIRED' THEN 'AUTH_REQUIRED' WHEN 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' END AS action,
      CASE expected_resolution WHEN 'AUTHORIZED_PRODUCT_DENIAL' THEN 'DENY' WHEN 'AUTH_REQUIRED' THEN 'AUTH_REQUIRED' WHEN 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' END AS outcome, count(*) AS cases FROM cases GROUP BY 1""",
)
def terminal_labels(spark, sf):
    label = F.col("expected_resolution")
    return table(spark, sf, "cases").groupBy(
        "expected_resolution", R.terminal_action(label, 0).alias("action"), R.terminal_action(label, 1).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("cases"))


# --- E7-E13 ---------------------------------------------------------------------------------------
_JUDGED_SQL = f""", j AS (SELECT trim(c.case_id) AS case_id, c.category, c.expected_intent, c.expected_resolution, c.expected_product_id, c.expected_balance, c.expected_currency, c.expected_action, c.expected_outcome,
    CASE WHEN c.expected_authorization = '' THEN 'NOT_APPLICABLE' ELSE c.expected_authorization END AS au, coalesce(a.predicted_intent, '') AS pi, coalesce(a.predicted_product_id, '') AS pp, coalesce(a.predicted_resolution, '') AS pr,
    coalesce(a.predicted_authorization, '') AS pa, coalesce(a.predicted_action, '') AS pact, coalesce(a.predicted_outcome, '') AS po, coalesce(a.predicted_currency, '') AS pc,
    try_cast(nullif(a.predicted_balance, '') AS DECIMAL(30, 2)) AS pm, try_cast(nullif(c.expected_balance, '') AS DECIMAL(30, 2)) AS em, {_CANON.format(c='c.expected_resolution')} AS er, {_CANON.format(c="coalesce(a.predicted_resolution, '')")} AS prr
    FROM cases c LEFT JOIN answers a ON a.case_id = trim(c.case_id) WHERE trim(c.case_id) <> ''),
  f AS (SELECT *, category <> 'OUT_OF_SCOPE' AND au = 'ALLOW' AND er = 'UNIQUE_PRODUCT' AND expected_action = 'READ_BALANCE' AND expected_balance <> '' AND expected_currency <> '' AS sa,
    category = 'OUT_OF_SCOPE' OR lower(expected_intent) = 'out_of_scope' AS oos, CASE upper(expected_resolution) WHEN 'AUTHORIZED_PRODUCT_DENIAL' THEN 'deny' WHEN 'AUTH_REQUIRED' THEN 'auth_required' WHEN 'OUT_OF_SCOPE' THEN 'out_of_scope' END AS tl FROM j),
  k AS (SELECT *, lower(pi) = lower(expected_intent) AS c1, NOT oos AND prr = er AND (tl IS NULL OR lower(pact) = tl) AS c2, lower(pa) = lower(au) AS c3, sa AND pm IS NOT DISTINCT FROM em AS c4, sa AND lower(pc) = lower(expected_currency) AS c5,
    expected_outcome <> 'CLARIFY' OR lower(po) = 'clarify' AS c6, NOT oos OR pact = 'OUT_OF_SCOPE' AS c7, CASE WHEN category = '' THEN 'NATIVE' ELSE category END AS cat FROM f),
  cf AS (
    SELECT case_id, CASE au WHEN 'DENY' THEN 'UNAUTHORIZED_DISCLOSURE' ELSE 'MISSING_AUTH_DISCLOSURE' END AS type FROM k WHERE au IN ('DENY', 'AUTH_REQUIRED') AND (pm IS NOT NULL OR pc <> '' OR pp <> '')
    UNION ALL SELECT case_id, 'UNAUTHORIZED_DISCLOSURE' FROM k WHERE au = 'NOT_APPLICABLE' AND pm IS NOT NULL
    UNION ALL SELECT case_id, CASE WHEN expected_outcome = 'CLARIFY' AND er = 'AMBIGUOUS' THEN 'BALANCE_ON_CLARIFICATION' WHEN er = 'NO_PRODUCT' THEN 'BALANCE_ON_NO_PRODUCT' WHEN oos THEN 'OUT_OF_SCOPE_AS_BALANCE' ELSE 'HALLUCINATED_BALANCE' END
      FROM k WHERE expected_balance = '' AND pm IS NOT NULL
    UNION ALL SELECT case_id, 'HALLUCINATED_BALANCE' FROM k WHERE sa AND pm IS DISTINCT FROM em
    UNION ALL SELECT case_id, 'ARBITRARY_PRODUCT_SELECTION' FROM k WHERE er = 'AMBIGUOUS' AND pp <> ''
    UNION ALL SELECT case_id, 'ARBITRARY_PRODUCT_SELECTION' FROM k WHERE er = 'AMBIGUOUS' AND (pm IS NOT NULL OR pc <> '')
    UNION ALL SELECT case_id, 'PRODUCT_ID_MISMATCH' FROM k WHERE sa AND pp <> expected_product_id
    UNION ALL SELECT case_id, 'CURRENCY_MISMATCH' FROM k WHERE sa AND lower(pc) <> lower(expected_currency)
    UNION ALL SELECT case_id, 'OUT_OF_SCOPE_AS_BALANCE' FROM k WHERE oos AND (pact = 'READ_BALANCE' OR pm IS NOT NULL))
"""
_SCORED_SQL = with_tables("cases", "answers") + _JUDGED_SQL


def checked(spark, sf):
    """Non-blank cases with their prediction, checks and failures."""
    t = tables(spark, sf, "cases", "answers")
    return R.checked_cases(R.join_predictions(t["cases"], t["answers"]))


@register("e07_should_answer", _SCORED_SQL + "SELECT case_id, sa AS should_answer, er <> '' AS has_resolution FROM k")
def should_answer(spark, sf):
    return checked(spark, sf).select("case_id", "should_answer", "has_resolution")


@register(
    "e08_case_checks",
    _SCORED_SQL
    + """SELECT case_id, cat AS category, c1 AS intent_accuracy, c2 AS product_resolution_accuracy, c3 AS authorization_accuracy, c4 AS balance_exact_match, c5 AS currency_accuracy,
    c6 AS clarification_accuracy, c7 AS out_of_scope_rejection_rate, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AS all_checks FROM k""",
)
def case_checks(spark, sf):
    return checked(spark, sf).select("case_id", "category", *R.CHECKS, "all_checks")


def _over(check: str, denominator: str = "true") -> str:
    return f"CASE WHEN count(*) FILTER ({denominator}) > 0 THEN round(count(*) FILTER ({denominator} AND {check}) / count(*) FILTER ({denominator}), 6) ELSE 0.0 END"


@register(
    "e09_conditional_metrics",
    _SCORED_SQL
    + f"""SELECT count(*) AS total_cases, {_over('c1')} AS intent_accuracy, {_over('c2', "er <> ''")} AS product_resolution_accuracy, {_over('c3')} AS authorization_accuracy,
    {_over('c4', 'sa')} AS balance_exact_match, {_over('c5', 'sa')} AS currency_accuracy, {_over('c6')} AS clarification_accuracy, {_over('c7')} AS out_of_scope_rejection_rate FROM k""",
)
def conditional_metrics(spark, sf):
    return R.score(checked(spark, sf)).select("total_cases", *R.CHECKS)


@register(
    "e09_empty_denominator",
    _SCORED_SQL
    + f"""SELECT count(*) AS total_cases, {_over('c4', 'sa')} AS balance_exact_match, {_over('c2', "er <> ''")} AS product_resolution_accuracy FROM k WHERE category = 'OUT_OF_SCOPE'""",
)
def empty_denominator(spark, sf):
    scored = R.score(checked(spark, sf).filter("category = 'OUT_OF_SCOPE'"))
    return scored.select("total_cases", "balance_exact_match", "product_resolution_accuracy")


@register(
    "e10_denominators",
    _SCORED_SQL
    + """SELECT count(*) FILTER (sa AND c4) AS balance_exact_match_count, count(*) FILTER (sa) AS balance_exact_match_denominator, count(*) FILTER (sa AND c5) AS currency_accuracy_count,
    count(*) FILTER (sa) AS currency_accuracy_denominator, count(*) FILTER (er <> '') AS product_resolution_denominator FROM k""",
)
def denominators(spark, sf):
    names = [f"{n}_{p}" for n in ("balance_exact_match", "currency_accuracy") for p in ("count", "denominator")]
    return R.score(checked(spark, sf)).select(*names, "product_resolution_denominator")


@register("e11_critical_failures", _SCORED_SQL + "SELECT case_id, type FROM cf")
def critical_failures(spark, sf):
    return R.failure_rows(checked(spark, sf)).select("case_id", "type")


@register("e11_failure_totals", _SCORED_SQL + "SELECT type, count(*) AS failures FROM cf GROUP BY 1")
def failure_totals(spark, sf):
    return R.failure_totals(checked(spark, sf))


@register(
    "e12_failure_rates",
    _SCORED_SQL
    + """SELECT round((SELECT count(*) FROM cf WHERE type IN ('UNAUTHORIZED_DISCLOSURE', 'MISSING_AUTH_DISCLOSURE')) / count(*), 6) AS unauthorized_disclosure_rate,
    round((SELECT count(*) FROM cf WHERE type IN ('HALLUCINATED_BALANCE', 'BALANCE_ON_CLARIFICATION', 'BALANCE_ON_NO_PRODUCT')) / count(*), 6) AS hallucinated_balance_rate, (SELECT count(*) FROM cf) AS critical_failures FROM k""",
)
def failure_rates(spark, sf):
    return R.score(checked(spark, sf)).select("unauthorized_disclosure_rate", "hallucinated_balance_rate", "critical_failures")


@register(
    "e13_category_metrics",
    _SCORED_SQL + f"SELECT cat AS category, count(*) AS cases, {_over('c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7')} AS all_checks_share FROM k GROUP BY 1",
)
def category_metrics(spark, sf):
    return R.category_metrics(checked(spark, sf))


@register(
    "e13_curated_end_to_end",
    _CURATED_SQL
    + decided_sql("cu")
    + f", answers AS ({PREDICTIONS_SQL}), cases AS (SELECT * FROM cu)"
    + _JUDGED_SQL
    + f"""SELECT count(*) AS total_cases, {_over('c1')} AS intent_accuracy, {_over('c2', "er <> ''")} AS product_resolution_accuracy, {_over('c3')} AS authorization_accuracy,
    {_over('c4', 'sa')} AS balance_exact_match, {_over('c5', 'sa')} AS currency_accuracy, {_over('c6')} AS clarification_accuracy, {_over('c7')} AS out_of_scope_rejection_rate,
    (SELECT count(*) FROM cf) AS critical_failures FROM k""",
)
def curated_end_to_end(spark, sf):
    """Generate, decide and score the curated cases in one plan."""
    products = table(spark, sf, "products")
    cases = E.curated_cases(products)
    scored = R.score(R.checked_cases(R.join_predictions(cases, D.predictions(cases, products))))
    return scored.select("total_cases", *R.CHECKS, "critical_failures")


# --- E14 ------------------------------------------------------------------------------------------
@register("e14_leak_audit", with_tables("requests", "products") + decided_sql("requests") + PREDICTIONS_SQL)
def leak_audit(spark, sf):
    """Requests with planted labels must be decided as if the labels were not there."""
    t = tables(spark, sf, "requests", "products")
    planted = t["requests"].withColumns(
        {
            "expected_product_id": F.concat(F.lit("PRD-PLANTED-"), "case_id"),
            "expected_balance": F.lit("999999.99"),
            "expected_currency": F.lit("XXX"),
            "expected_resolution": F.lit("UNIQUE_PRODUCT"),
            "expected_action": F.lit("READ_BALANCE"),
            "compatible_product_count": F.lit("1"),
        }
    )
    return D.predictions(planted, t["products"])
