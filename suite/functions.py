"""Scalar functions: F1-F19."""

from __future__ import annotations

from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.operators import decide as D
from probanza.operators import temporal as X
from suite.domain import driver_table, table, with_tables
from suite.joins import pct
from suite.registry import register


@register("f01_trim_lower_upper", with_tables("call_center_interactions") + "SELECT interaction_id, lower(trim(was_resolved)) AS low, upper(contact_reason) AS up FROM call_center_interactions")
def trim_lower_upper(spark, sf):
    return table(spark, sf, "call_center_interactions").select(
        "interaction_id", F.lower(C.trimmed("was_resolved")).alias("low"), F.upper("contact_reason").alias("up")
    )


@register("f02_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents")
def length(spark, sf):
    return driver_table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))


@register("f03_prefix_removal", with_tables("complaints") + "SELECT complaint_id, regexp_replace(origin_interaction_id, '^INT[-_]', '') AS bare FROM complaints")
def prefix_removal(spark, sf):
    return table(spark, sf, "complaints").select("complaint_id", C.without_prefix("origin_interaction_id", "INT").alias("bare"))


@register("f04_regexp_extract", "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, try_cast(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INT) AS page FROM pages")
def regexp_extract(spark, sf):
    return driver_table(spark, sf, "pages").select(
        "page_id",
        F.nullif(F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract("url", r"page=([0-9]+)", 1), F.lit("")).try_cast("int").alias("page"),
    )


@register("f05_regexp_search", "SELECT conv_id, turn, regexp_matches(text, '(?i)ÉTION|ción|the') AS hit FROM conversations")
def regexp_search(spark, sf):
    return driver_table(spark, sf, "conversations").select("conv_id", "turn", C.matches("text", "ÉTION|ción|the").alias("hit"))


@register("f06_like", with_tables("call_transcripts") + "SELECT transcript_id, lower(customer_text) LIKE '%cuenta de ahorros%' AS hit FROM call_transcripts")
def like(spark, sf):
    return table(spark, sf, "call_transcripts").select("transcript_id", F.lower("customer_text").like("%cuenta de ahorros%").alias("hit"))


@register(
    "f07_conditionals",
    with_tables("complaints")
    + """SELECT complaint_id, coalesce(nullif(trim(status), ''), 'UNKNOWN') AS status, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN priority = '5-LOW' THEN 'low' ELSE 'other' END AS band FROM complaints""",
)
def conditionals(spark, sf):
    band = F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("priority") == "5-LOW", "low").otherwise("other")
    return table(spark, sf, "complaints").select("complaint_id", C.blank_to("status").alias("status"), band.alias("band"))


@register("f08_casts", with_tables("call_center_interactions") + "SELECT interaction_id, try_cast(duration_seconds AS BIGINT) AS seconds, CAST(sentiment_score AS DOUBLE) AS score FROM call_center_interactions")
def casts(spark, sf):
    return table(spark, sf, "call_center_interactions").select(
        "interaction_id",
        F.col("duration_seconds").try_cast("bigint").alias("seconds"),
        F.col("sentiment_score").cast("double").alias("score"),
    )


@register(
    "f09_rounding_and_percent",
    f"""SELECT c_custkey, round(c_acctbal, 1) AS r1, floor(c_acctbal / 3) AS fl, {pct('c_nationkey', '(c_custkey)', 4)} AS share FROM customer""",
)
def rounding_and_percent(spark, sf):
    return driver_table(spark, sf, "customer").select(
        "c_custkey",
        F.round("c_acctbal", 1).alias("r1"),
        F.floor(F.col("c_acctbal") / 3).cast("double").alias("fl"),
        C.pct(F.col("c_nationkey"), F.col("c_custkey"), 4).alias("share"),
    )


@register("f10_least", with_tables("transactions") + "SELECT transaction_id, count(*) AS n, min(least(try_cast(transaction_date AS TIMESTAMP), try_cast(process_date AS TIMESTAMP))) AS first FROM transactions GROUP BY 1")
def least(spark, sf):
    first = F.least(C.parse_ts("transaction_date"), C.parse_ts("process_date"))
    return table(spark, sf, "transactions").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))


@register(
    "f11_date_differences",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, date_diff('second', o_orderdate, l_shipdate) AS seconds,
      CAST(o_orderdate AS DATE) + CAST(l_quantity AS INT) AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def date_differences(spark, sf):
    from probanza.operators.joins import lookup_join

    lines = driver_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = driver_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = lookup_join(lines, orders, "l_orderkey", "inner")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"),
        (C.whole_seconds("l_shipdate") - C.whole_seconds("o_orderdate")).alias("seconds"),
        F.date_add(F.to_date("o_orderdate"), F.col("l_quantity").cast("int")).alias("due"),
    )


@register("f12_make_date", "SELECT DISTINCT make_date(year(o_orderdate), month(o_orderdate), 1) AS month_start, CAST(day(last_day(o_orderdate)) AS BIGINT) AS days FROM orders")
def make_date(spark, sf):
    day = F.col("o_orderdate")
    return driver_table(spark, sf, "orders").select(
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("month_start"), F.dayofmonth(F.last_day(day)).cast("bigint").alias("days")
    ).distinct()


@register("f13_date_series", "SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS day")
def date_series(spark, sf):
    span = driver_table(spark, sf, "events").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias("day"))


@register("f14_median", "SELECT event_type, median(CAST(round(value * 100) AS BIGINT)) AS median FROM events GROUP BY 1")
def median(spark, sf):
    cents = driver_table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return X.exact_median(cents, "cents", ["event_type"])


@register("f15_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def hashes(spark, sf):
    return driver_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@register("f16_row_json", with_tables("branches") + "SELECT branch_id, CAST(to_json(b) AS VARCHAR) AS row_json FROM branches b")
def row_json(spark, sf):
    branches = table(spark, sf, "branches")
    return branches.select("branch_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json"))


@register("f17_typeof", "SELECT DISTINCT typeof(o_totalprice) AS price, typeof(o_orderkey) AS key FROM orders")
def typeof(spark, sf):
    return driver_table(spark, sf, "orders").select(
        F.upper(F.typeof("o_totalprice")).alias("price"), F.upper(F.typeof("o_orderkey")).alias("key")
    ).distinct()


@register(
    "f18_money",
    with_tables("products")
    + """SELECT product_id, coalesce(CAST(CAST(round_even(try_cast(nullif(trim(current_balance), '') AS DECIMAL(38, 6)), 2) AS DECIMAL(38, 2)) AS VARCHAR), '') AS money FROM products""",
)
def money(spark, sf):
    return table(spark, sf, "products").select("product_id", C.money_text("current_balance").alias("money"))


@register(
    "f18_money_half_even",
    "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || CASE WHEN s_nationkey % 2 = 0 THEN '.02' ELSE '.04' END AS money FROM supplier",
)
def money_half_even(spark, sf):
    tie = F.when(F.col("s_nationkey") % 2 == 0, ".025").otherwise(".035")
    return driver_table(spark, sf, "supplier").select("s_suppkey", C.money_text(F.concat(F.col("s_suppkey").cast("string"), tie)).alias("money"))


@register(
    "f19_template",
    with_tables("products")
    + """SELECT product_id, 'Su saldo actual de ' || product_type || ' (' || product_number || ') es ' || trim(current_balance) || ' ' || currency || '.' AS answer FROM products""",
)
def template(spark, sf):
    return table(spark, sf, "products").select(
        "product_id",
        D.response(F.lit("READ_BALANCE"), F.col("product_type"), F.col("product_number"), C.strip("current_balance"), F.col("currency")).alias("answer"),
    )
