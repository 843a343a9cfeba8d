"""From a customer's request to a decision, as column expressions and two joins.

The catalog is aggregated per customer before it meets the requests, so nothing fans out, and only
the input columns of a request are read; expected labels cannot reach the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators.joins import lookup_join

REQUEST_COLUMNS = ("case_id", "customer_id", "customer_text", "authenticated_customer_id")
_PRODUCT = ("product_id", "product_number", "current_balance", "currency", "product_type")


# --- stages as columns ----------------------------------------------------------------------------
def intent(text: Column | str) -> Column:
    """BALANCE_INQUIRY only on a positive trigger."""
    return F.when(C.matches(text, vocab.BALANCE_TRIGGER), "BALANCE_INQUIRY").otherwise("OUT_OF_SCOPE")


def product_type(text: Column | str) -> Column:
    """Explicit wording first; else the generic word if exactly one type is named; else ''."""
    found = None
    for name, pattern in vocab.EXPLICIT_PRODUCT.items():
        hit = C.matches(text, pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    named = [(name, C.matches(text, pattern)) for name, pattern in vocab.GENERIC_PRODUCT.items()]
    hits = sum((hit.cast("int") for _, hit in named), F.lit(0))
    for name, hit in named:
        found = found.when((hits == 1) & hit, name)
    return found.otherwise("")


def coarse_product_type(text: Column | str) -> Column:
    """The coarser LIKE classification; NULL when neither phrase occurs."""
    low = F.lower(text)
    return F.when(low.like("%cuenta de ahorros%"), "Cuenta Ahorro").when(low.like("%tarjeta de crédito%"), "Tarjeta Crédito")


def resolution(count: Column, several: str = "AMBIGUOUS") -> Column:
    """Cardinality of the compatible products as a label."""
    many = F.coalesce(count, F.lit(0))
    return F.when(many == 0, "NO_PRODUCT").when(many == 1, "UNIQUE_PRODUCT").otherwise(several)


def authorization(owner: Column | str, session: Column | str) -> Column:
    """From session facts only; the text of the request never matters."""
    owner, session = C.strip(owner), C.strip(session)
    both = (owner != "") & (session != "")
    return (
        F.when(both & (owner != session), "DENY")
        .when(both, "ALLOW")
        .when((owner != "") | (session != ""), "AUTH_REQUIRED")
        .otherwise("NOT_APPLICABLE")
    )


def response(action: Column, named_type: Column, number: Column, balance: Column, currency: Column) -> Column:
    """Grounded answer text of an action."""
    slots = {"product_type": F.coalesce(F.nullif(named_type, F.lit("")), F.lit(vocab.NO_TYPE_NAMED)),
             "product_number": number, "balance": balance, "currency": currency}
    text = None
    for name, template in vocab.RESPONSES.items():
        order = sorted((s for s in slots if "{" + s + "}" in template), key=lambda s: template.index("{" + s + "}"))
        pattern = template
        for s in order:
            pattern = pattern.replace("{" + s + "}", "%s")
        filled = F.format_string(pattern, *(slots[s] for s in order)) if order else F.lit(template)
        text = F.when(action == name, filled) if text is None else text.when(action == name, filled)
    return text


# --- policy ---------------------------------------------------------------------------------------
def policy_table(spark: SparkSession) -> DataFrame:
    """The 24 combinations of intent, resolution and authorization with action and outcome."""
    return spark.createDataFrame(
        list(vocab.POLICY), "intent string, resolution string, authorization string, action string, outcome string"
    )


def with_action(staged: DataFrame) -> DataFrame:
    """Action and outcome of (intent, resolution, authorization); unknown combinations fail safe."""
    policy = F.broadcast(policy_table(staged.sparkSession))
    action, outcome = vocab.FAIL_SAFE
    joined = staged.join(policy, ["intent", "resolution", "authorization"], "left")
    return joined.withColumns(
        {"action": F.coalesce("action", F.lit(action)), "outcome": F.coalesce("outcome", F.lit(outcome))}
    )


# --- catalog --------------------------------------------------------------------------------------
def stripped_catalog(products: DataFrame) -> DataFrame:
    """Catalog columns as stripped text; the only source of product facts."""
    return products.select(*(C.strip(c).alias(c) for c in vocab.CATALOG_COLUMNS))


def catalog_index(products: DataFrame) -> DataFrame:
    """Products per (customer, type): how many, and the first by id and number."""
    return stripped_catalog(products).groupBy("customer_id", "product_type").agg(
        F.count(F.lit(1)).alias("compatible_product_count"),
        F.min(F.struct("product_id", "product_number", "current_balance", "currency")).alias("product"),
    )


def sorted_catalog(products: DataFrame) -> DataFrame:
    """Catalog in (customer, type, id, number) order; the range sort also splits one customer's rows."""
    return stripped_catalog(products).orderBy("customer_id", "product_type", "product_id", "product_number")


def catalog_by_customer(products: DataFrame) -> DataFrame:
    """Per customer: count and first product of each decided type, and over both types."""
    fact = F.struct(*_PRODUCT)
    columns = []
    for i, name in enumerate(vocab.PRODUCT_TYPES):
        of_type = F.col("product_type") == name
        columns += [C.count_where(of_type).alias(f"count_{i}"), F.min(F.when(of_type, fact)).alias(f"product_{i}")]
    decided = stripped_catalog(products).filter(F.col("product_type").isin(*vocab.PRODUCT_TYPES))
    return decided.groupBy("customer_id").agg(
        *columns, F.count(F.lit(1)).alias("count_any"), F.min(fact).alias("product_any")
    )


# --- decision -------------------------------------------------------------------------------------
def stage_requests(requests: DataFrame) -> DataFrame:
    """Input columns only, with intent, named product type and authorization."""
    have = [F.col(c) if c in requests.columns else F.lit("").alias(c) for c in REQUEST_COLUMNS]
    clean = requests.select(*have).select(*(C.strip(c).alias(c) for c in REQUEST_COLUMNS))
    return clean.select(
        "case_id",
        "customer_id",
        intent("customer_text").alias("intent"),
        product_type("customer_text").alias("named_type"),
        authorization("customer_id", "authenticated_customer_id").alias("authorization"),
    )


def resolve(staged: DataFrame, by_customer: DataFrame) -> DataFrame:
    """Join the requests to their customer's products; an inquiry that names no type spans both."""
    joined = lookup_join(staged, by_customer, "customer_id", "left")
    named = F.col("named_type")
    count, product = None, None
    for i, name in enumerate(vocab.PRODUCT_TYPES):
        hit = named == name
        count = F.when(hit, F.col(f"count_{i}")) if count is None else count.when(hit, F.col(f"count_{i}"))
        product = F.when(hit, F.col(f"product_{i}")) if product is None else product.when(hit, F.col(f"product_{i}"))
    spans = F.col("intent") == "BALANCE_INQUIRY"
    count = count.when(spans, F.col("count_any")).otherwise(F.lit(0))
    product = product.when(spans, F.col("product_any"))
    return joined.select(*staged.columns, resolution(count).alias("resolution"), product.alias("product"))


def decide(requests: DataFrame, products: DataFrame) -> DataFrame:
    """One prediction per request, with the grounded response."""
    return decide_with(requests, catalog_by_customer(products))


def decide_with(requests: DataFrame, by_customer: DataFrame) -> DataFrame:
    acted = with_action(resolve(stage_requests(requests), by_customer))
    disclose = (F.col("action") == "READ_BALANCE") & (F.col("resolution") == "UNIQUE_PRODUCT")

    def fact(name: str) -> Column:
        value = C.money_text("product.current_balance") if name == "current_balance" else F.col(f"product.{name}")
        return F.when(disclose, F.coalesce(value, F.lit(""))).otherwise("")

    number, balance, currency = fact("product_number"), fact("current_balance"), fact("currency")
    return acted.select(
        "case_id",
        F.col("intent").alias("predicted_intent"),
        fact("product_id").alias("predicted_product_id"),
        number.alias("predicted_product_number"),
        F.col("resolution").alias("predicted_resolution"),
        F.col("authorization").alias("predicted_authorization"),
        F.col("action").alias("predicted_action"),
        F.col("outcome").alias("predicted_outcome"),
        balance.alias("predicted_balance"),
        currency.alias("predicted_currency"),
        F.col("named_type").alias("named_product_type"),
        fact("product_type").alias("disclosed_product_type"),
        disclose.alias("disclosure_allowed"),
        response(F.col("action"), F.col("named_type"), number, balance, currency).alias("response"),
    )


def predictions(requests: DataFrame, products: DataFrame) -> DataFrame:
    return decide(requests, products).select(*vocab.PREDICTION_COLUMNS)


def run_summary(requests: DataFrame, products: DataFrame, decided: DataFrame) -> DataFrame:
    """Provenance of a batch: catalog rows and customers, cases, predictions."""
    count = F.count(F.lit(1)).alias("n")
    customers = stripped_catalog(products).select("customer_id").distinct().agg(count).scalar()
    return products.agg(F.count(F.lit(1)).alias("catalog_product_rows")).select(
        F.lit("EXPLICIT_PRODUCT_FILE").alias("catalog_source"),
        "catalog_product_rows",
        customers.alias("catalog_customers"),
        requests.agg(count).scalar().alias("cases"),
        decided.agg(count).scalar().alias("predictions"),
    )


def product_lookup(decided: DataFrame, products: DataFrame) -> DataFrame:
    """Type and currency of each disclosed product, found by product id."""
    facts = stripped_catalog(products).groupBy("product_id").agg(
        F.min(F.struct("product_type", "currency")).alias("found")
    )
    disclosed = decided.filter(F.col("predicted_product_id") != "").select(
        "case_id", F.col("predicted_product_id").alias("product_id")
    )
    return lookup_join(disclosed, facts, "product_id", "inner").select(
        "case_id", "product_id", "found.product_type", "found.currency"
    )


def resolution_classes(transcripts: DataFrame, interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Transcripts per named product type and resolution class, with the share within the type.

    The inner join to the interactions goes through one row per interaction and its multiplicity.
    A transcript without a type keeps a NULL key, which matches no product.
    """
    from probanza.operators.joins import with_share

    transactional = interactions.filter(F.col("contact_reason") == vocab.TRANSACTIONAL_REASON).select(
        "interaction_id", "customer_id"
    )
    typed = (
        transcripts.filter(F.col("customer_text").isNotNull() & F.col("interaction_id").isNotNull())
        .select("transcript_id", "interaction_id", coarse_product_type("customer_text").alias("expected_product_type"))
    )
    owned = lookup_join(typed, transactional, "interaction_id", "inner", keys_from=transcripts).select(
        "transcript_id", "customer_id", F.col("expected_product_type")
    )
    weighted = owned.groupBy("transcript_id", "customer_id", "expected_product_type").agg(F.count(F.lit(1)).alias("w"))
    catalog = products.groupBy("customer_id", F.col("product_type").alias("expected_product_type")).agg(
        F.count("product_id").alias("products")
    )
    counted = lookup_join(weighted, catalog, ["customer_id", "expected_product_type"], "left").select(
        "customer_id",
        "expected_product_type",
        resolution(F.col("products") * F.col("w"), "MULTIPLE_PRODUCTS").alias("resolution_class"),
    )
    per_customer = counted.groupBy("resolution_class", "expected_product_type", "customer_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = per_customer.groupBy("resolution_class", "expected_product_type").agg(
        F.sum("n").alias("transcripts"), F.count("customer_id").alias("customers")
    )
    return with_share(classes, "transcripts", "pct_within_product_type", ["expected_product_type"], 2)
