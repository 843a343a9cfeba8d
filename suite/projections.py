"""Projections, filters and predicates: P1-P21."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import profile as P
from probanza.sources import tables as S
from suite.domain import driver_table, table, tables, with_tables
from suite.joins import ne, ts
from suite.profiles import truthy, union
from suite.registry import register


@register("p01_key_normalisation", with_tables("products") + "SELECT product_id, trim(current_balance) AS balance_key FROM products")
def key_normalisation(spark, sf):
    return table(spark, sf, "products").select("product_id", C.trimmed("current_balance").alias("balance_key"))


@register(
    "p02_nonempty",
    with_tables("complaints")
    + f"SELECT complaint_id, {ne('assigned_agent_id')} AS assigned, {ne('resolution')} AS resolved FROM complaints",
)
def nonempty(spark, sf):
    return table(spark, sf, "complaints").select(
        "complaint_id", C.nonempty("assigned_agent_id").alias("assigned"), C.nonempty("resolution").alias("resolved")
    )


@register(
    "p03_blank_to_default",
    with_tables("complaints")
    + "SELECT complaint_id, coalesce(nullif(trim(resolution), ''), 'UNKNOWN') AS resolution FROM complaints",
)
def blank_to_default(spark, sf):
    return table(spark, sf, "complaints").select("complaint_id", C.blank_to("resolution").alias("resolution"))


@register(
    "p04_fallback_column",
    with_tables("call_center_interactions")
    + """SELECT interaction_id, coalesce(nullif(trim(reason_category), ''), nullif(trim(contact_reason), ''), 'UNKNOWN') AS reason,
      coalesce(reason_category, contact_reason, 'UNKNOWN') AS reason_null_only FROM call_center_interactions""",
)
def fallback_column(spark, sf):
    return table(spark, sf, "call_center_interactions").select(
        "interaction_id",
        C.first_nonblank("reason_category", "contact_reason").alias("reason"),
        F.coalesce("reason_category", "contact_reason", F.lit("UNKNOWN")).alias("reason_null_only"),
    )


@register(
    "p05_audit_truthy",
    with_tables("call_center_interactions")
    + f"""SELECT interaction_id, {truthy('was_resolved')} AS resolved, {truthy('has_transcript')} AS transcript, {truthy('was_escalated')} AS escalated
    FROM call_center_interactions""",
)
def audit_truthy(spark, sf):
    return table(spark, sf, "call_center_interactions").select(
        "interaction_id",
        C.audit_true("was_resolved").alias("resolved"),
        C.audit_true("has_transcript").alias("transcript"),
        C.audit_true("was_escalated").alias("escalated"),
    )


@register(
    "p06_scoring_truthy",
    with_tables("call_center_interactions")
    + """SELECT interaction_id, lower(trim(coalesce(was_resolved, ''))) IN ('1', 'true', 'yes', 'y') AS resolved,
      lower(trim(coalesce(requires_followup, ''))) IN ('1', 'true', 'yes', 'y') AS followup FROM call_center_interactions""",
)
def scoring_truthy(spark, sf):
    return table(spark, sf, "call_center_interactions").select(
        "interaction_id", C.score_true("was_resolved").alias("resolved"), C.score_true("requires_followup").alias("followup")
    )


@register(
    "p07_equality_filter",
    with_tables("call_center_interactions")
    + "SELECT interaction_id FROM call_center_interactions WHERE contact_reason = 'Transaccional' AND reason_category IN ('Queja', 'Comercial')",
)
def equality_filter(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    wanted = (F.col("contact_reason") == vocab.TRANSACTIONAL_REASON) & F.col("reason_category").isin("Queja", "Comercial")
    return calls.filter(wanted).select("interaction_id")


@register(
    "p08_status_enum_filter",
    with_tables("transactions")
    + """SELECT transaction_id, transaction_status, amount FROM transactions
    WHERE lower(coalesce(transaction_status, '')) IN ('failed', 'failure', 'rejected', 'declined', 'cancelled', 'canceled')""",
)
def status_enum_filter(spark, sf):
    trades = table(spark, sf, "transactions")
    return trades.filter(C.failed_status("transaction_status")).select("transaction_id", "transaction_status", "amount")


@register(
    "p09_substring_filter",
    with_tables("call_center_interactions")
    + """SELECT interaction_id FROM call_center_interactions WHERE lower(reason_category) LIKE '%transac%' OR lower(contact_reason) LIKE '%transac%'""",
)
def substring_filter(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    return calls.filter(C.contains_folded("transac", "reason_category", "contact_reason")).select("interaction_id")


@register(
    "p10_regex_token_filter",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)trans|fraud|dispute|payment|withdraw|transfer')
       OR regexp_matches(text, '(?i)ción')""",
)
def regex_token_filter(spark, sf):
    docs = driver_table(spark, sf, "documents")
    return docs.filter(C.matches("text", vocab.TRANSACTION_REASON) | C.matches("text", "ción")).select("doc_id")


@register(
    "p11_token_list_match",
    """SELECT doc_id, regexp_matches(lower(text), 'queja|complaint|reclamo') AS complaint, regexp_matches(lower(text), 'técnico|tecnico|digital|login') AS digital
    FROM documents""",
)
def token_list_match(spark, sf):
    b, c = list(vocab.WORKFLOW_TOKENS.values())[1:3]
    return driver_table(spark, sf, "documents").select(
        "doc_id", C.has_any_token("text", b).alias("complaint"), C.has_any_token("text", c).alias("digital")
    )


@register(
    "p12_case_label",
    with_tables("products")
    + """SELECT product_id, CASE WHEN product_type = 'Cuenta Ahorro' THEN 'SAVINGS' WHEN product_type LIKE 'Tarjeta%' THEN 'CARD' ELSE 'OTHER' END AS label FROM products""",
)
def case_label(spark, sf):
    kind = F.col("product_type")
    label = F.when(kind == "Cuenta Ahorro", "SAVINGS").when(kind.like("Tarjeta%"), "CARD").otherwise("OTHER")
    return table(spark, sf, "products").select("product_id", label.alias("label"))


@register(
    "p13_conditional_count",
    with_tables("complaints")
    + """SELECT category, CAST(sum(CASE WHEN resolution_date IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS resolved,
      CAST(sum(CASE WHEN status = 'Open' THEN 1 ELSE 0 END) AS BIGINT) AS still_open FROM complaints GROUP BY category""",
)
def conditional_count(spark, sf):
    return table(spark, sf, "complaints").groupBy("category").agg(
        C.count_where(F.col("resolution_date").isNotNull()).alias("resolved"),
        C.count_where(F.col("status") == "Open").alias("still_open"),
    )


_COUNTED = ("transactions", "complaints", "customers", "call_transcripts")
_GROUPS = {
    "id": vocab.ID_COLUMN, "time": vocab.DATE_LIKE_COLUMN, "text": vocab.TEXT_COLUMN,
    "country_or_language": f"{vocab.COUNTRY_COLUMN}|{vocab.LANGUAGE_COLUMN}", "pii": vocab.PII_COLUMN,
}


@register(
    "p14_columns_by_pattern",
    with_tables(*_COUNTED)
    + ", n AS ("
    + "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, count(*) AS rows FROM {t}" for t in _COUNTED)
    + "), c AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS dataset, column_name FROM (DESCRIBE SELECT * FROM {t})" for t in _COUNTED
    )
    + "), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{g}', '{p}')" for g, p in _GROUPS.items())
    + ") v(kind, pattern)) SELECT dataset, kind, column_name, rows FROM c JOIN p ON regexp_matches(lower(column_name), pattern) JOIN n USING (dataset)",
)
def columns_by_pattern(spark, sf):
    t = tables(spark, sf, *_COUNTED)
    rows = [(n, kind, c) for n, df in t.items() for kind, p in _GROUPS.items() for c in P.named(df.columns, p)]
    chosen = spark.createDataFrame(rows, "dataset string, kind string, column_name string")
    return P.row_counts(t).join(F.broadcast(chosen), "dataset").select("dataset", "kind", "column_name", "rows")


@register(
    "p15_schema_conditional",
    with_tables("transactions", "products")
    + f"""SELECT 'transactions' AS dataset, min({ts('process_date')}) AS min_process_date, max({ts('process_date')}) AS max_process_date,
      count(DISTINCT customer_id) AS unique_customers FROM transactions
    UNION ALL SELECT 'products', NULL, NULL, count(DISTINCT customer_id) FROM products""",
)
def schema_conditional(spark, sf):
    t = tables(spark, sf, "transactions", "products")
    wanted = [("process_date", "string"), ("customer_id", "string")]

    def summary(name: str):
        shaped = S.absent_as_null(t[name], wanted).select(C.parse_ts("process_date").alias("p"), "customer_id")
        return shaped.agg(
            F.min("p").alias("min_process_date"),
            F.max("p").alias("max_process_date"),
            F.count_distinct("customer_id").alias("unique_customers"),
        ).select(F.lit(name).alias("dataset"), "*")

    return union(summary(n) for n in t)


@register(
    "p16_date_range_comparison",
    with_tables("complaints")
    + f"SELECT complaint_id FROM complaints WHERE {ts('resolution_date')} < {ts('creation_date')}",
)
def date_range_comparison(spark, sf):
    complaints = table(spark, sf, "complaints")
    return complaints.filter(C.parse_ts("resolution_date") < C.parse_ts("creation_date")).select("complaint_id")


@register(
    "p17_future_timestamps",
    with_tables("transactions")
    + f"SELECT transaction_id, transaction_date FROM transactions WHERE {ts('transaction_date')} > TIMESTAMP '2001-06-30 23:59:59'",
)
def future_timestamps(spark, sf):
    trades = table(spark, sf, "transactions")
    return trades.filter(C.after_run_date(C.parse_ts("transaction_date"), "2001-06-30")).select(
        "transaction_id", "transaction_date"
    )


_NAMES = ("transactions", "call_center_interactions", "complaints", "customers", "products")
_IDS = "regexp_matches(column_name, '(^|[_-])(id|key|number|no)$|(^|[_-])(id|key)([_-]|$)')"


def _names_sql() -> str:
    listed = "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, column_name FROM (DESCRIBE SELECT * FROM {t})" for t in _NAMES)
    counts = "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, count(*) AS rows FROM {t}" for t in _NAMES)
    return f", c AS ({listed}), n AS ({counts})\n"


@register(
    "p18_column_flags",
    with_tables(*_NAMES)
    + _names_sql()
    + f"""SELECT dataset, column_name, {_IDS} AS primary_key_candidate, {_IDS} AS foreign_key_candidate,
      regexp_matches(column_name, 'status|state|stage|outcome|result|reason|category|type|priority|disposition') AS status_category_reason_field,
      regexp_matches(column_name, 'lang|locale|language') AS language_related_field, """
    + ", ".join(f"{_IDS} AND regexp_matches(column_name, '{w}') AS {f}" for f, w in vocab.RECON_SUBJECTS.items())
    + ", rows FROM c JOIN n USING (dataset)",
)
def column_flags(spark, sf):
    t = tables(spark, sf, *_NAMES)
    names = P.columns_frame(spark, {n: df.columns for n, df in t.items()})
    return P.column_flags(names).join(P.row_counts(t), "dataset")


@register(
    "p19_pii_columns",
    with_tables(*_NAMES)
    + _names_sql()
    + """SELECT dataset, column_name, CASE WHEN regexp_matches(column_name, 'email|phone|address|name|document|birth') THEN 'PII or free-text' ELSE 'sensitive free text' END AS risk,
      'Restrict access; hash or redact in derived artifacts' AS handling, rows FROM c JOIN n USING (dataset)
    WHERE regexp_matches(column_name, 'email|phone|address|name|document|birth|text|description|comment|secret|token')""",
)
def pii_columns(spark, sf):
    t = tables(spark, sf, *_NAMES)
    names = P.columns_frame(spark, {n: df.columns for n, df in t.items()})
    return P.pii_columns(names).join(P.row_counts(t), "dataset")


_CUSTOMER = ("customer_id", "registration_branch_id", "customer_status", "country", "detected_accent", "full_name", "segment")


@register(
    "p20_example_values",
    with_tables("customers")
    + ", x AS ("
    + "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{c}' AS column_name, trim({c}) AS value FROM customers WHERE {ne(c)}"
        for c in _CUSTOMER
        if c != "full_name"
    )
    + ") SELECT column_name, rank, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rank FROM x) WHERE rank <= 3",
)
def example_values(spark, sf):
    return P.example_values(table(spark, sf, "customers"), list(_CUSTOMER))


@register(
    "p21_protected_distinct",
    with_tables("customers")
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count(DISTINCT nullif(trim({c}), '')) AS distinct_values FROM customers" for c in _CUSTOMER),
)
def protected_distinct(spark, sf):
    return P.protected_distinct(table(spark, sf, "customers"), list(_CUSTOMER))
