"""Windows, sorts, limits and set operations: W1-W4, O1-O6, U1-U6."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import vocab
from probanza.operators import decide as D
from probanza.operators import keys as K
from probanza.operators import profile as P
from probanza.operators import score as R
from probanza.operators import workflow as W
from probanza.operators.joins import with_share
from probanza.sources import sinks
from suite.domain import driver_table, table, tables, with_tables
from suite.joins import _STACKED, _ID_TABLES, ne
from suite.profiles import _dist_sql, each
from suite.registry import register


@register(
    "w01_share_of_total",
    """SELECT o_orderpriority, count(*) AS orders, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct_of_total FROM orders GROUP BY 1""",
)
def share_of_total(spark, sf):
    counts = driver_table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return with_share(counts, "orders", "pct_of_total")


@register(
    "w02_share_within_group",
    with_tables("products")
    + """SELECT product_type, currency, count(*) AS products, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY product_type), 6) AS pct_within_type
    FROM products GROUP BY 1, 2""",
)
def share_within_group(spark, sf):
    counts = table(spark, sf, "products").groupBy("product_type", "currency").agg(F.count(F.lit(1)).alias("products"))
    return with_share(counts, "products", "pct_within_type", ["product_type"])


@register(
    "w03_first_middle_last",
    """WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS place, count(*) OVER (PARTITION BY event_type) AS days FROM d)
    SELECT event_type, day, place, days FROM r WHERE place IN (1, days // 2 + 1, days)""",
)
def first_middle_last(spark, sf):
    from pyspark.sql import Window

    days = driver_table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    whole = Window.partitionBy("event_type")
    placed = days.select(
        "*",
        F.row_number().over(whole.orderBy("day")).cast("bigint").alias("place"),
        F.count(F.lit(1)).over(whole).alias("days"),
    )
    middle = F.floor(F.col("days") / 2) + 1
    return placed.filter((F.col("place") == 1) | (F.col("place") == middle) | (F.col("place") == F.col("days")))


@register(
    "w04_last_record_wins",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, value FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def last_record_wins(spark, sf):
    events = driver_table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return R.last_record_wins(events, "user_id", ["ts", "event_id"])


@register(
    "o01_sort_by_count",
    with_tables("complaints") + _dist_sql("complaints", ["category", "subcategory"]) + " ORDER BY rows DESC, category",
)
def sort_by_count(spark, sf):
    counts = P.distribution(table(spark, sf, "complaints"), "complaints", ["category", "subcategory"])
    return counts.orderBy(F.desc("rows"), F.asc("category"))


@register(
    "o02_top_values",
    with_tables("transactions", "complaints")
    + f""", d AS ({_dist_sql('transactions', ['customer_id', 'product_id', 'response_code'])}),
    r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY rows DESC, category) AS rank FROM d)
    SELECT field, category, rows, percentage, rank FROM r WHERE rank <= 50""",
)
def top_values(spark, sf):
    counts = P.distribution(table(spark, sf, "transactions"), "transactions", ["customer_id", "product_id", "response_code"])
    return P.top_categories(counts, ["field"], 50).select("field", "category", "rows", "percentage", "rank")


@register(
    "o03_multi_key_sort",
    with_tables("call_center_interactions")
    + f""", d AS ({_dist_sql('call_center_interactions', ['contact_reason', 'reason_category'])})
    SELECT field AS observed_field, category AS observed_category, rows AS row_count FROM d ORDER BY 1, 3 DESC, 2""",
)
def multi_key_sort(spark, sf):
    calls = table(spark, sf, "call_center_interactions")
    mapping = W.category_mapping(P.distribution(calls, "call_center_interactions", list(vocab.INTENT_FIELDS)))
    observed = mapping.filter(F.col("observed_field").isin(*vocab.INTENT_FIELDS))
    return observed.select("observed_field", "observed_category", "row_count").orderBy(
        F.asc("observed_field"), F.desc("row_count"), F.asc("observed_category")
    )


@register(
    "o04_sorted_collection",
    with_tables("products")
    + "SELECT customer_id, product_type, product_id, product_number FROM products ORDER BY customer_id, product_type, product_id, product_number",
)
def sorted_collection(spark, sf):
    return D.sorted_catalog(table(spark, sf, "products")).select("customer_id", "product_type", "product_id", "product_number")


@register(
    "o05_first_edges",
    with_tables(*_ID_TABLES)
    + f""", s AS ({_STACKED}), z AS (SELECT t, c, count(*) AS n FROM s GROUP BY ALL),
    m AS (SELECT a.t AS child, a.c AS key_column, b.t AS parent, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.v = b.v AND a.t <> b.t GROUP BY ALL)
    SELECT child, key_column, parent, round(m.n / x.n * 100, 4) AS join_success_pct FROM m JOIN z x ON x.t = child AND x.c = key_column
    ORDER BY join_success_pct DESC, child, key_column, parent LIMIT 30""",
)
def first_edges(spark, sf):
    found = K.discover_joins(tables(spark, sf, *_ID_TABLES))
    return found.select("child", "key_column", "parent", "join_success_pct").orderBy(*K.join_order()).limit(30)


@register("u01_distinct_keys", with_tables("transactions") + f"SELECT DISTINCT trim(product_id) AS join_key FROM transactions WHERE {ne('product_id')}")
def distinct_keys(spark, sf):
    return K.rows_per_key(table(spark, sf, "transactions"), "product_id").filter("join_key is not null").select("join_key")


@register(
    "u02_key_intersection",
    with_tables("call_center_interactions", "service_agents")
    + "SELECT agent_id AS join_key FROM call_center_interactions INTERSECT SELECT agent_id FROM service_agents",
)
def key_intersection(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "service_agents")
    return K.matched_keys(t["call_center_interactions"], "agent_id", t["service_agents"], "agent_id").select("join_key")


@register(
    "u03_key_difference",
    with_tables("call_center_interactions", "service_agents")
    + "SELECT agent_id AS join_key FROM call_center_interactions EXCEPT SELECT agent_id FROM service_agents",
)
def key_difference(spark, sf):
    t = tables(spark, sf, "call_center_interactions", "service_agents")
    return K.unmatched_keys(t["call_center_interactions"], "agent_id", t["service_agents"], "agent_id").select("join_key")


@register(
    "u04_bag_union",
    with_tables("transactions", "complaints")
    + """SELECT customer_id, currency, CAST(NULL AS VARCHAR) AS priority FROM transactions UNION ALL SELECT customer_id, NULL, priority FROM complaints""",
)
def bag_union(spark, sf):
    t = tables(spark, sf, "transactions", "complaints")
    return sinks.union_all([t["transactions"].select("customer_id", "currency"), t["complaints"].select("customer_id", "priority")])


_OBSERVED = ("customers", "products", "branches", "transactions", "complaints")


@register(
    "u06_missing_tables",
    with_tables(*_OBSERVED)
    + f""", o AS ({each("SELECT '{t}' AS dataset, count(*) AS n FROM {t}", _OBSERVED)})
    SELECT unnest(['customers', 'products', 'branches', 'service_agents', 'marketing_campaigns', 'transactions', 'call_center_interactions', 'call_transcripts',
      'satisfaction_surveys', 'digital_events', 'complaints', 'campaign_sends', 'daily_exchange_rates']) AS dataset EXCEPT SELECT dataset FROM o""",
)
def missing_tables(spark, sf):
    return P.missing_tables(P.row_counts(tables(spark, sf, *_OBSERVED)), vocab.EXPECTED_ROWS)


