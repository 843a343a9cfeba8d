"""Evaluation cases: ground truth, native extraction and the curated set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import decide as D
from probanza.operators.joins import lookup_join
from probanza.session import written


# --- ground truth ---------------------------------------------------------------------------------
def with_expected(cases: DataFrame, products: DataFrame) -> DataFrame:
    """Add the expected fields to cases that hold ``customer_id`` and ``expected_product_type``."""
    index = D.catalog_index(products).withColumnRenamed("product_type", "expected_product_type")
    joined = lookup_join(cases, index, ["customer_id", "expected_product_type"], "left")
    return joined.select(*cases.columns, *expected_fields())


def expected_fields() -> list[Column]:
    count = F.coalesce("compatible_product_count", F.lit(0))
    label = D.resolution(count)
    unique = count == 1

    def fact(c: Column) -> Column:
        return F.when(unique, F.coalesce(c, F.lit(""))).otherwise("")

    return [
        F.lit("BALANCE_INQUIRY").alias("expected_intent"),
        count.cast("string").alias("compatible_product_count"),
        label.alias("expected_resolution"),
        fact(F.col("product.product_id")).alias("expected_product_id"),
        fact(F.col("product.product_number")).alias("expected_product_number"),
        fact(C.money_text("product.current_balance")).alias("expected_balance"),
        fact(F.col("product.currency")).alias("expected_currency"),
        F.when(unique, "READ_BALANCE").when(count > 1, "REQUEST_CLARIFICATION").otherwise("NO_PRODUCT_DISCLOSURE").alias(
            "expected_action"
        ),
        F.when(unique, "ANSWER").otherwise("CLARIFY").alias("expected_outcome"),
        F.when(unique, "LOW").otherwise("MEDIUM").alias("risk_class"),
    ]


def ground_truth(products: DataFrame) -> DataFrame:
    """Expected fields of every (customer, product type) of the catalog."""
    index = D.catalog_index(products)
    return index.select("customer_id", F.col("product_type").alias("expected_product_type"), *expected_fields())


# --- native cases ---------------------------------------------------------------------------------
def _explicit_type(text: Column) -> Column:
    found = F.lit("")
    for name, pattern in reversed(vocab.EXPLICIT_PRODUCT.items()):
        found = F.when(C.matches(text, pattern), name).otherwise(found)
    return found


def native_cases(transcripts: DataFrame, interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Transcripts that ask for the balance of a named product in a transactional interaction.

    Of repeated interaction ids the last record counts, by process and interaction time (missing ones
    first); among equal times a transactional one.
    """
    text = C.strip("customer_text")
    asked = transcripts.filter(C.matches("customer_text", vocab.NATIVE_BALANCE)).select(
        *(C.strip(c).alias(c) for c in ("transcript_id", "interaction_id", "customer_id", "process_date")),
        text.alias("customer_text"),
        _explicit_type(text).alias("expected_product_type"),
    ).filter(F.col("expected_product_type") != "")
    times = [c for c in ("process_date", "interaction_date") if c in interactions.columns]
    reasons = interactions.select(
        *(C.parse_ts(c).alias(c) for c in times),
        C.strip("interaction_id").alias("interaction_id"),
        ((C.strip("reason_category") == vocab.TRANSACTIONAL_REASON) | (C.strip("contact_reason") == vocab.TRANSACTIONAL_REASON)).alias("hit"),
        C.score_true("was_resolved").cast("string").alias("was_resolved"),
        C.score_true("was_escalated").cast("string").alias("was_escalated"),
    )
    one = reasons.groupBy("interaction_id").agg(F.max(F.struct(*times, "hit", "was_resolved", "was_escalated")).alias("found"))
    all_keys = transcripts.select(C.strip("interaction_id").alias("interaction_id"))
    transactional = lookup_join(asked, one, "interaction_id", "left", keys_from=all_keys).filter("found.hit")
    cases = transactional.select(
        F.col("transcript_id").alias("case_id"),
        F.lit("native_dataset").alias("source_type"),
        *asked.columns,
        F.initcap("found.was_resolved").alias("historical_was_resolved"),
        F.initcap("found.was_escalated").alias("historical_was_escalated"),
    )
    # Written once, so that the texts are searched once however often the cases are read below.
    return with_expected(written(cases, "native-cases"), products).select(*vocab.NATIVE_CASE_COLUMNS)


# --- curated cases --------------------------------------------------------------------------------
def curated_specs() -> list[tuple]:
    """(case_id, category, pool, index, text, type, session, authorization, intent) of every case.

    ``session`` is who is signed in: the owner, another customer, or nobody.
    """
    ahorro, tarjeta = vocab.PRODUCT_TYPES
    specs: list[tuple] = []

    def add(prefix: str, category: str, count: int, **choose) -> None:
        for i in range(count):
            pick = {k: v(i) if callable(v) else v for k, v in choose.items()}
            specs.append((
                f"CH-{prefix}-{i + 1:03d}", category, pick["pool"], i, pick["text"], pick["type"],
                pick.get("session", "owner"), pick.get("auth", "ALLOW"), pick.get("intent", "BALANCE_INQUIRY"),
            ))

    def turns(options: tuple) -> object:
        return lambda i: options[i % len(options)]

    each = {"pool": turns(("unique_0", "unique_1")), "type": turns(vocab.PRODUCT_TYPES)}
    savings = {"pool": "unique_0", "type": ahorro}
    add("EXACT", "IN_SCOPE_EXACT", 12, text=turns(vocab.EXACT_REQUESTS), **each)
    add("PARA", "IN_SCOPE_PARAPHRASE", 15, text=turns(vocab.PARAPHRASED_REQUESTS), **each)
    add("DIS", "PRODUCT_DISAMBIGUATION", 15, text=vocab.SEVERAL_PRODUCTS_REQUEST, pool="multiple", type="")
    add("AUTH", "AUTHORIZATION", 12, text=vocab.OTHER_OWNER_REQUEST, session="other", auth="DENY", **each)
    add("ID", "IDENTITY_MISSING", 10, text=vocab.NO_SESSION_REQUEST, session="nobody", auth="AUTH_REQUIRED", **each)
    add("NF", "NOT_FOUND", 12, text=vocab.NOT_FOUND_REQUEST, pool="absent", type=tarjeta)
    add("OOS", "OUT_OF_SCOPE", 12, text=turns(vocab.OUT_OF_SCOPE_REQUESTS), intent="OUT_OF_SCOPE", **savings)
    add("ADV", "ADVERSARIAL", 12, text=turns(vocab.ADVERSARIAL_REQUESTS), session=turns(("other", "nobody")),
        auth=turns(("DENY", "AUTH_REQUIRED")), **savings)
    add("EDGE", "GROUNDING_EDGE_CASE", 10, text=vocab.SHARED_NUMBER_REQUEST, **savings)
    return specs


def curated_pools(products: DataFrame, depth: int) -> DataFrame:
    """(pool, position, customer_id, pool_size, has_savings), customers in id order.

    A case takes position ``i mod size``, so no position beyond ``depth`` (the largest i) is ever
    addressed and each pool is a top-k by customer id.
    """
    ahorro, tarjeta = vocab.PRODUCT_TYPES
    per_type = stripped_counts(products)
    kinds = written(
        per_type.groupBy("customer_id").agg(
            F.coalesce(F.max(F.when(F.col("product_type") == ahorro, F.col("n"))), F.lit(0)).alias("savings"),
            F.coalesce(F.max(F.when(F.col("product_type") == tarjeta, F.col("n"))), F.lit(0)).alias("cards"),
            F.max("n").alias("most"),
        ),
        "curated-kinds",
    )
    members = {
        "unique_0": F.col("savings") == 1,
        "unique_1": F.col("cards") == 1,
        "multiple": F.col("most") > 1,
        "absent": F.col("savings") == 0,
    }
    sizes = kinds.agg(*(C.count_where(rule).alias(pool) for pool, rule in members.items()))
    pools = []
    for pool, rule in members.items():
        found = kinds.filter(rule).select("customer_id", (F.col("savings") > 0).alias("has_savings"))
        first = found.orderBy("customer_id").limit(depth)
        listed = first.agg(F.array_sort(F.collect_list(F.struct("customer_id", "has_savings"))).alias("m"))
        pools.append(
            listed.select(
                F.lit(pool).alias("pool"), sizes.select(pool).scalar().alias("pool_size"), F.posexplode("m").alias("position", "m")
            ).select(
                "pool", "pool_size", F.col("position").cast("bigint").alias("position"), "m.customer_id", "m.has_savings"
            )
        )
    return reduce(DataFrame.unionByName, pools)


def stripped_counts(products: DataFrame) -> DataFrame:
    return D.stripped_catalog(products).groupBy("customer_id", "product_type").agg(F.count(F.lit(1)).alias("n"))


def curated_cases(products: DataFrame) -> DataFrame:
    """The curated cases over a catalog: owners by position, expected fields, and the overrides."""
    spark = products.sparkSession
    ahorro, tarjeta = vocab.PRODUCT_TYPES
    rows = curated_specs()
    specs = spark.createDataFrame(
        rows,
        "case_id string, category string, pool string, i bigint, customer_text string, wanted_type string, "
        "session string, expected_authorization string, intent string",
    )
    pools = curated_pools(products, max(r[3] for r in rows) + 1)
    sizes = pools.groupBy("pool").agg(F.max("pool_size").alias("pool_size"))
    if not specs.join(sizes, "pool", "left_anti").isEmpty():
        raise ValueError("the catalog has no customer for a pool of curated cases")
    placed = specs.join(sizes, "pool").withColumn("position", F.col("i") % F.col("pool_size")).drop("pool_size")
    owned = placed.join(pools.drop("pool_size"), ["pool", "position"])
    other = D.stripped_catalog(products).agg(F.max("customer_id").alias("c")).scalar()
    signed_in = F.when(F.col("session") == "owner", F.col("customer_id")).when(F.col("session") == "other", other)
    chosen = owned.select(
        "case_id",
        F.lit("curated_challenge").alias("source_type"),
        "customer_id",
        "customer_text",
        F.coalesce(F.nullif(F.col("wanted_type"), F.lit("")), F.when(F.col("has_savings"), ahorro).otherwise(tarjeta)).alias(
            "expected_product_type"
        ),
        "category",
        F.coalesce(signed_in, F.lit("")).alias("authenticated_customer_id"),
        "expected_authorization",
        "intent",
    )
    chosen = written(chosen, "curated-cases")
    # The cases are a fixed short list, so their customers may be broadcast to trim the catalog.
    asked = F.broadcast(chosen.select("customer_id").distinct())
    relevant = products.withColumn("customer_id", C.strip("customer_id")).join(asked, "customer_id", "left_semi")
    return _override(with_expected(chosen, relevant)).select(
        *(F.col(c) if c in _CURATED else F.lit("").alias(c) for c in vocab.CHALLENGE_CASE_COLUMNS)
    )


_CURATED = set(vocab.CHALLENGE_CASE_COLUMNS) - {
    "transcript_id", "interaction_id", "process_date", "historical_was_resolved", "historical_was_escalated",
}


def _override(cases: DataFrame) -> DataFrame:
    """Denied, unauthenticated and out-of-scope cases expect no product facts."""
    auth = F.col("expected_authorization")
    refused, oos = auth.isin("DENY", "AUTH_REQUIRED"), F.col("intent") == "OUT_OF_SCOPE"
    values = {"expected_intent": F.col("intent")}
    for c in ("expected_product_id", "expected_product_number", "expected_balance", "expected_currency"):
        values[c] = F.when(refused | oos, "").otherwise(F.col(c))
    for c in ("expected_action", "expected_outcome"):
        values[c] = F.when(refused, auth).when(oos, "OUT_OF_SCOPE").otherwise(F.col(c))
    denied = F.when(auth == "DENY", "AUTHORIZED_PRODUCT_DENIAL").otherwise(auth)
    values["expected_resolution"] = F.when(refused, denied).when(oos, "").otherwise(F.col("expected_resolution"))
    values["risk_class"] = F.when(refused, "HIGH").when(oos, "").otherwise(F.col("risk_class"))
    values["compatible_product_count"] = F.when(oos, "").otherwise(F.col("compatible_product_count"))
    return cases.withColumns(values)
