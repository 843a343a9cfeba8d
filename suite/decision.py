"""The decision pipeline: C1-C10."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.operators import decide as D
from probanza.session import scratch_path
from probanza.streaming.catalog import path_version
from probanza.streaming.requests import decision_stream
from suite.domain import driver_table, table, tables, with_tables
from suite.registry import register

# Word edges are spelled out for RE2: N is no letter, digit or underscore; M is the gap between two words.
N = r"[^\p{L}\p{N}_]"
_M = r"[^\p{L}\p{N}_.?;]"
TRIGGER = (
    rf"(?i)(^|{N})saldos?({N}|$)"
    rf"|(^|{N})(cu[aá]nto|importe){_M}([^.?;]{{0,38}}{_M})?(es|son|queda|quedan|aparece|tengo|tiene)({N}|$)"
    rf"|(^|{N})fondos{_M}([^.?;]{{0,28}}{_M})?disponible"
)
AHORRO = r"(?i)cuenta\s+de\s+ahorros?|cuenta\s+ahorro"
TARJETA = r"(?i)tarjeta(\s+de)?\s+cr[eé]dito"
CUENTA_WORD = rf"(?i)(^|{N})cuentas?({N}|$)"
TARJETA_WORD = rf"(?i)(^|{N})tarjetas?({N}|$)"


def intent_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{TRIGGER}') THEN 'BALANCE_INQUIRY' ELSE 'OUT_OF_SCOPE' END"


def type_sql(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '{AHORRO}') THEN 'Cuenta Ahorro' WHEN regexp_matches({c}, '{TARJETA}') THEN 'Tarjeta Crédito'
      WHEN regexp_matches({c}, '{CUENTA_WORD}') AND NOT regexp_matches({c}, '{TARJETA_WORD}') THEN 'Cuenta Ahorro'
      WHEN regexp_matches({c}, '{TARJETA_WORD}') AND NOT regexp_matches({c}, '{CUENTA_WORD}') THEN 'Tarjeta Crédito' ELSE '' END"""


def auth_sql(owner: str, session: str) -> str:
    o, s = f"coalesce(trim({owner}), '')", f"coalesce(trim({session}), '')"
    return f"""CASE WHEN {o} <> '' AND {s} <> '' THEN CASE WHEN {o} = {s} THEN 'ALLOW' ELSE 'DENY' END
      WHEN {o} <> '' OR {s} <> '' THEN 'AUTH_REQUIRED' ELSE 'NOT_APPLICABLE' END"""


ACTION_SQL = """CASE WHEN intent = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' WHEN auth IN ('DENY', 'AUTH_REQUIRED') THEN auth
      WHEN resolution = 'NO_PRODUCT' THEN 'NO_PRODUCT_DISCLOSURE' WHEN resolution = 'AMBIGUOUS' THEN 'REQUEST_CLARIFICATION'
      WHEN auth = 'ALLOW' THEN 'READ_BALANCE' ELSE 'AUTH_REQUIRED' END"""
OUTCOME_SQL = """CASE action WHEN 'READ_BALANCE' THEN 'ANSWER' WHEN 'REQUEST_CLARIFICATION' THEN 'CLARIFY' WHEN 'NO_PRODUCT_DISCLOSURE' THEN 'CLARIFY' ELSE action END"""
MONEY_SQL = "coalesce(CAST(CAST(round_even(try_cast(nullif(trim({c}), '') AS DECIMAL(38, 6)), 2) AS DECIMAL(38, 2)) AS VARCHAR), '')"


def decided_sql(requests: str) -> str:
    """CTEs that decide ``requests``; the result is ``dec`` with one row per case."""
    return f""", sta AS (SELECT coalesce(trim(case_id), '') AS case_id, coalesce(trim(customer_id), '') AS customer_id, {intent_sql('customer_text')} AS intent, {type_sql('customer_text')} AS kind,
        {auth_sql('customer_id', 'authenticated_customer_id')} AS auth FROM {requests}),
      two AS (SELECT * FROM products WHERE product_type IN ('Cuenta Ahorro', 'Tarjeta Crédito')),
      cat AS (SELECT customer_id, product_type AS kind, count(*) AS n, min(product_id) AS pid FROM two GROUP BY 1, 2 UNION ALL SELECT customer_id, '', count(*), min(product_id) FROM two GROUP BY 1),
      res AS (SELECT s.*, CASE WHEN s.kind = '' AND intent = 'OUT_OF_SCOPE' THEN 0 ELSE coalesce(c.n, 0) END AS n, c.pid FROM sta s LEFT JOIN cat c ON c.customer_id = s.customer_id AND c.kind = s.kind),
      lab AS (SELECT *, CASE WHEN n = 0 THEN 'NO_PRODUCT' WHEN n = 1 THEN 'UNIQUE_PRODUCT' ELSE 'AMBIGUOUS' END AS resolution FROM res),
      act AS (SELECT *, {ACTION_SQL} AS action FROM lab),
      dec AS (SELECT a.case_id, a.intent, a.kind, a.resolution, a.auth, a.action, {OUTCOME_SQL} AS outcome, coalesce(p.product_id, '') AS product_id, coalesce(p.product_number, '') AS product_number,
        {MONEY_SQL.format(c='p.current_balance')} AS balance, coalesce(p.currency, '') AS currency, coalesce(p.product_type, '') AS product_type
        FROM act a LEFT JOIN products p ON a.action = 'READ_BALANCE' AND a.resolution = 'UNIQUE_PRODUCT' AND p.product_id = a.pid)
      """


PREDICTIONS_SQL = """SELECT case_id, intent AS predicted_intent, product_id AS predicted_product_id, product_number AS predicted_product_number, resolution AS predicted_resolution,
  auth AS predicted_authorization, action AS predicted_action, outcome AS predicted_outcome, balance AS predicted_balance, currency AS predicted_currency FROM dec"""
ANSWER_SQL = """CASE action WHEN 'READ_BALANCE' THEN 'Su saldo actual de ' || k || ' (' || product_number || ') es ' || balance || ' ' || currency || '.'
  WHEN 'REQUEST_CLARIFICATION' THEN 'Tengo más de un producto ' || k || ' asociado a su cuenta. ¿A cuál desea consultar el saldo?'
  WHEN 'NO_PRODUCT_DISCLOSURE' THEN 'No encuentro un producto ' || k || ' asociado a su cuenta. No puedo mostrar ningún saldo.'
  WHEN 'AUTH_REQUIRED' THEN 'Necesito verificar su identidad antes de mostrar información de su cuenta.'
  WHEN 'DENY' THEN 'No puedo divulgar información de productos que no pertenecen a la cuenta autenticada.'
  ELSE 'Esa solicitud está fuera del alcance de este canal (consulta de saldos). Un agente podrá ayudarle.' END"""


@register(
    "c01_intent",
    with_tables("requests", "call_transcripts")
    + f"""SELECT case_id AS id, {intent_sql('customer_text')} AS intent FROM requests
    UNION ALL SELECT transcript_id, {intent_sql('customer_text')} FROM call_transcripts""",
)
def intent(spark, sf):
    t = tables(spark, sf, "requests", "call_transcripts")
    found = D.intent("customer_text").alias("intent")
    return t["requests"].select(F.col("case_id").alias("id"), found).unionByName(
        t["call_transcripts"].select(F.col("transcript_id").alias("id"), found)
    )


@register(
    "c02_product_type",
    with_tables("requests", "call_transcripts")
    + f"""SELECT case_id AS id, {type_sql('customer_text')} AS product_type FROM requests
    UNION ALL SELECT transcript_id, {type_sql('customer_text')} FROM call_transcripts""",
)
def product_type(spark, sf):
    t = tables(spark, sf, "requests", "call_transcripts")
    found = D.product_type("customer_text").alias("product_type")
    return t["requests"].select(F.col("case_id").alias("id"), found).unionByName(
        t["call_transcripts"].select(F.col("transcript_id").alias("id"), found)
    )


@register(
    "c03_resolution",
    with_tables("requests", "products") + decided_sql("requests") + "SELECT case_id, intent, kind AS named_type, resolution FROM dec",
)
def resolution(spark, sf):
    t = tables(spark, sf, "requests", "products")
    staged = D.stage_requests(t["requests"])
    return D.resolve(staged, D.catalog_by_customer(t["products"])).select("case_id", "intent", "named_type", "resolution")


@register(
    "c04_authorization",
    with_tables("requests")
    + f"""SELECT case_id, {auth_sql('customer_id', 'authenticated_customer_id')} AS auth, {auth_sql("''", 'authenticated_customer_id')} AS auth_without_owner FROM requests""",
)
def authorization(spark, sf):
    return table(spark, sf, "requests").select(
        "case_id",
        D.authorization("customer_id", "authenticated_customer_id").alias("auth"),
        D.authorization(F.lit(""), "authenticated_customer_id").alias("auth_without_owner"),
    )


@register(
    "c05_policy",
    with_tables("requests", "products") + decided_sql("requests") + "SELECT intent, resolution, auth AS authorization, action, outcome, count(*) AS cases FROM dec GROUP BY ALL",
)
def policy(spark, sf):
    t = tables(spark, sf, "requests", "products")
    acted = D.with_action(D.resolve(D.stage_requests(t["requests"]), D.catalog_by_customer(t["products"])))
    return acted.groupBy("intent", "resolution", "authorization", "action", "outcome").agg(F.count(F.lit(1)).alias("cases"))


@register(
    "c06_disclosure_gate",
    with_tables("requests", "products")
    + decided_sql("requests")
    + """SELECT case_id, action = 'READ_BALANCE' AND resolution = 'UNIQUE_PRODUCT' AS disclosure_allowed, product_id AS predicted_product_id, product_type AS disclosed_product_type, balance AS predicted_balance FROM dec""",
)
def disclosure_gate(spark, sf):
    t = tables(spark, sf, "requests", "products")
    return D.decide(t["requests"], t["products"]).select(
        "case_id", "disclosure_allowed", "predicted_product_id", "disclosed_product_type", "predicted_balance"
    )


@register(
    "c07_grounded_response",
    with_tables("requests", "products")
    + decided_sql("requests")
    + f"SELECT case_id, {ANSWER_SQL} AS response FROM (SELECT *, CASE WHEN kind = '' THEN 'su producto' ELSE kind END AS k FROM dec)",
)
def grounded_response(spark, sf):
    t = tables(spark, sf, "requests", "products")
    return D.decide(t["requests"], t["products"]).select("case_id", "response")


@register("c08_batch_decide", with_tables("requests", "products") + decided_sql("requests") + PREDICTIONS_SQL)
def batch_decide(spark, sf):
    t = tables(spark, sf, "requests", "products")
    return D.predictions(t["requests"], t["products"])


@register(
    "c08_run_summary",
    with_tables("requests", "products")
    + """SELECT 'EXPLICIT_PRODUCT_FILE' AS catalog_source, (SELECT count(*) FROM products) AS catalog_product_rows, (SELECT count(DISTINCT customer_id) FROM products) AS catalog_customers,
      count(*) AS cases, count(*) AS predictions FROM requests""",
)
def run_summary(spark, sf):
    t = tables(spark, sf, "requests", "products")
    return D.run_summary(t["requests"], t["products"], D.predictions(t["requests"], t["products"]))


@register(
    "c09_coarse_type",
    with_tables("call_transcripts")
    + """SELECT transcript_id, CASE WHEN lower(customer_text) LIKE '%cuenta de ahorros%' THEN 'Cuenta Ahorro' WHEN lower(customer_text) LIKE '%tarjeta de crédito%' THEN 'Tarjeta Crédito' END AS expected_product_type
    FROM call_transcripts""",
)
def coarse_type(spark, sf):
    texts = table(spark, sf, "call_transcripts")
    return texts.select("transcript_id", D.coarse_product_type("customer_text").alias("expected_product_type"))


# --- C10 ------------------------------------------------------------------------------------------
_FEED = """SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS request_id, 'CLI-' || CAST(conv_id AS STRING) AS customer_id,
  CASE WHEN turn = 0 THEN 'Necesito consultar el saldo de mi cuenta de ahorros. ' WHEN turn = 1 THEN 'Fondos de mi tarjeta disponibles: '
       WHEN turn = 2 THEN 'Dime mi saldo ' WHEN turn = 3 THEN '¿Cuánto tengo en la tarjeta? ' ELSE '' END || text AS query,
  CASE WHEN turn = 7 THEN 'bogus' WHEN role = 'user' THEN 'authenticated' WHEN role = 'system' THEN 'unauthenticated' WHEN turn > 3 THEN NULL ELSE 'wrong-owner' END AS session_mode FROM {src}"""


@register(
    "c10_request_stream",
    with_tables("products")
    + f""", feed AS ({_FEED.format(src='conversations')}),
    req AS (SELECT request_id AS case_id, customer_id, query AS customer_text, CASE coalesce(session_mode, 'authenticated') WHEN 'authenticated' THEN customer_id WHEN 'wrong-owner' THEN 'CLI-OTHER-OWNER' ELSE '' END AS authenticated_customer_id
      FROM feed WHERE trim(query) <> '' AND coalesce(session_mode, 'authenticated') IN ('authenticated', 'unauthenticated', 'wrong-owner'))"""
    + decided_sql("req")
    + f"SELECT case_id, action AS predicted_action, balance AS predicted_balance, {ANSWER_SQL} AS response FROM (SELECT *, CASE WHEN kind = '' THEN 'su producto' ELSE kind END AS k FROM dec)",
)
def request_stream(spark, sf):
    """The conversations as a live feed, decided batch by batch against the catalog."""
    stored = driver_table(spark, sf, "conversations")
    # A stream takes a folder or a pattern, and the table is a folder of part files or one file: the pattern fits both.
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf}/{{conversations.parquet}}")
    feed = spark.sql(_FEED, src=stream)
    target, checkpoint = scratch_path(spark, "answers"), scratch_path(spark, "stream")
    version = lambda: path_version(spark, f"{sf}/orders.parquet")  # noqa: E731  (products are derived from orders)
    decision_stream(feed, lambda: table(spark, sf, "products"), version, target, checkpoint).awaitTermination()
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").select(
        "case_id", "predicted_action", "predicted_balance", "response"
    )


