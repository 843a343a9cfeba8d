"""Scoring of predictions against expected labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab

CHECKS = (
    "intent_accuracy", "product_resolution_accuracy", "authorization_accuracy", "balance_exact_match",
    "currency_accuracy", "clarification_accuracy", "out_of_scope_rejection_rate",
)


# --- labels ---------------------------------------------------------------------------------------
def canonical_resolution(label: Column | str) -> Column:
    """One of the three product resolutions, else ''."""
    value = F.upper(C.strip(label))
    return F.when(value.isin(*vocab.RESOLUTIONS), value).otherwise("")


def terminal_action(label: Column | str, part: int = 0) -> Column:
    """Action (part 0) or outcome (part 1) implied by a terminal label; NULL for any other label."""
    value = F.upper(C.strip(label))
    return reduce(
        lambda acc, item: F.when(value == item[0], item[1][part]).otherwise(acc),
        vocab.TERMINAL_LABELS.items(),
        F.lit(None).cast("string"),
    )


def last_record_wins(df: DataFrame, key: str, order: list[str], keep_blank: bool = False) -> DataFrame:
    """The last record per key in a declared order; the aggregate combines before the shuffle."""
    payload = [c for c in df.columns if c not in order and c != key]
    keyed = df.select(
        C.strip(key).alias(key), F.struct(*order).alias("_order"), F.struct(*payload).alias("_record")
    )
    if not keep_blank:
        keyed = keyed.filter(F.col(key) != "")
    return keyed.groupBy(key).agg(F.max_by("_record", "_order").alias("_record")).select(key, "_record.*")


# --- per case -------------------------------------------------------------------------------------
def join_predictions(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases with their prediction; an absent one is all empty, a case without an id is no case.

    Both sides hold one row per case id, as the keyed load leaves them.
    """
    expected = [
        (C.strip(c) if c in cases.columns else F.lit("")).alias(c) for c in vocab.CHALLENGE_CASE_COLUMNS
    ]
    predicted = [
        (C.strip(c) if c in predictions.columns else F.lit("")).alias(c) for c in vocab.PREDICTION_COLUMNS
    ]
    known = cases.select(*expected).filter("case_id <> ''")
    joined = known.join(predictions.select(*predicted), "case_id", "left")
    return joined.na.fill("", list(vocab.PREDICTION_COLUMNS[1:]))


def should_answer() -> Column:
    """A balance is legitimately expected."""
    return (
        (F.col("category") != "OUT_OF_SCOPE")
        & (_expected_authorization() == "ALLOW")
        & (canonical_resolution("expected_resolution") == "UNIQUE_PRODUCT")
        & (F.col("expected_action") == "READ_BALANCE")
        & (F.col("expected_balance") != "")
        & (F.col("expected_currency") != "")
    )


def _expected_authorization() -> Column:
    return F.coalesce(F.nullif(F.col("expected_authorization"), F.lit("")), F.lit("NOT_APPLICABLE"))


def _same(left: str | Column, right: str | Column) -> Column:
    return C.folded(left) == C.folded(right)


def checked_cases(joined: DataFrame) -> DataFrame:
    """Every case with its seven checks, its denominators and its critical failures."""
    facts = joined.select(
        "*",
        should_answer().alias("should_answer"),
        ((F.col("category") == "OUT_OF_SCOPE") | (F.lower("expected_intent") == "out_of_scope")).alias("is_oos"),
        _expected_authorization().alias("want_auth"),
        canonical_resolution("expected_resolution").alias("want_resolution"),
        canonical_resolution("predicted_resolution").alias("got_resolution"),
        terminal_action("expected_resolution").alias("terminal"),
        C.money("predicted_balance").alias("got_money"),
        C.money("expected_balance").alias("want_money"),
    )
    answer, oos = F.col("should_answer"), F.col("is_oos")
    terminal_kept = F.col("terminal").isNull() | _same("predicted_action", "terminal")
    checks = {
        "intent_accuracy": _same("predicted_intent", "expected_intent"),
        "product_resolution_accuracy": ~oos & (F.col("got_resolution") == F.col("want_resolution")) & terminal_kept,
        "authorization_accuracy": _same("predicted_authorization", "want_auth"),
        "balance_exact_match": answer & F.col("got_money").eqNullSafe(F.col("want_money")),
        "currency_accuracy": answer & _same("predicted_currency", "expected_currency"),
        "clarification_accuracy": (F.col("expected_outcome") != "CLARIFY") | (C.folded("predicted_outcome") == "clarify"),
        "out_of_scope_rejection_rate": ~oos | (F.col("predicted_action") == "OUT_OF_SCOPE"),
    }
    every = reduce(Column.__and__, checks.values())
    return facts.select(
        "case_id",
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("NATIVE")).alias("category"),
        "should_answer",
        (F.col("want_resolution") != "").alias("has_resolution"),
        *(check.alias(name) for name, check in checks.items()),
        every.alias("all_checks"),
        critical_failures().alias("failures"),
    )


def critical_failures() -> Column:
    """0..n failures of a case, in a fixed order."""
    answer, oos = F.col("should_answer"), F.col("is_oos")
    told = F.col("got_money").isNotNull()
    currency, product = F.col("predicted_currency") != "", F.col("predicted_product_id") != ""
    protected = F.col("want_auth").isin("DENY", "AUTH_REQUIRED") & (told | currency | product)
    unexpected = (F.col("expected_balance") == "") & told
    ambiguous = F.col("want_resolution") == "AMBIGUOUS"
    clarify = (F.col("expected_outcome") == "CLARIFY") & ambiguous
    rules = (
        (protected & (F.col("want_auth") == "AUTH_REQUIRED"), "MISSING_AUTH_DISCLOSURE", "Product data without authentication"),
        (protected & (F.col("want_auth") == "DENY"), "UNAUTHORIZED_DISCLOSURE", "Product data although access is denied"),
        ((F.col("want_auth") == "NOT_APPLICABLE") & told, "UNAUTHORIZED_DISCLOSURE", "Balance without any session"),
        (unexpected & clarify, "BALANCE_ON_CLARIFICATION", "Balance where a clarification is expected"),
        (unexpected & ~clarify & (F.col("want_resolution") == "NO_PRODUCT"), "BALANCE_ON_NO_PRODUCT", "Balance without a product"),
        (unexpected & ~clarify & (F.col("want_resolution") != "NO_PRODUCT") & oos, "OUT_OF_SCOPE_AS_BALANCE", "Unexpected balance, out of scope"),
        (unexpected & ~clarify & (F.col("want_resolution") != "NO_PRODUCT") & ~oos, "HALLUCINATED_BALANCE", "Unexpected balance"),
        (answer & ~F.col("got_money").eqNullSafe(F.col("want_money")), "HALLUCINATED_BALANCE", "Wrong balance"),
        (ambiguous & product, "ARBITRARY_PRODUCT_SELECTION", "Product chosen among several"),
        (ambiguous & (told | currency), "ARBITRARY_PRODUCT_SELECTION", "Balance or currency of one among several"),
        (answer & (F.col("predicted_product_id") != F.col("expected_product_id")), "PRODUCT_ID_MISMATCH", "Wrong product"),
        (answer & ~_same("predicted_currency", "expected_currency"), "CURRENCY_MISMATCH", "Wrong currency"),
        (oos & ((F.col("predicted_action") == "READ_BALANCE") | told), "OUT_OF_SCOPE_AS_BALANCE", "Out of scope, answered as a balance"),
    )
    found = [F.when(rule, F.struct(F.lit(kind).alias("type"), F.lit(detail).alias("detail"))) for rule, kind, detail in rules]
    return F.array_compact(F.array(*found))


def failure_rows(checked: DataFrame) -> DataFrame:
    return checked.select("case_id", F.inline("failures"))


# --- totals ---------------------------------------------------------------------------------------
def _rate(hit: Column, denominator: Column) -> Column:
    n = C.count_where(denominator)
    return F.when(n > 0, F.round(C.count_where(denominator & hit) / n, 6)).otherwise(F.lit(0.0))


def score(checked: DataFrame) -> DataFrame:
    """All metrics, denominators and failure rates in one aggregate; an empty denominator gives 0."""
    every = F.lit(True)
    conditional = {
        "balance_exact_match": F.col("should_answer"),
        "currency_accuracy": F.col("should_answer"),
        "product_resolution_accuracy": F.col("has_resolution"),
    }
    rates = [_rate(F.col(name), conditional.get(name, every)).alias(name) for name in CHECKS]

    def failures_in(kinds: tuple[str, ...]) -> Column:
        per_case = F.size(F.filter("failures", lambda f: f["type"].isin(*kinds)))
        cases = F.count(F.lit(1))
        return F.when(cases > 0, F.round(F.sum(per_case) / cases, 6)).otherwise(F.lit(0.0))

    answer = F.col("should_answer")
    return checked.agg(
        F.count(F.lit(1)).alias("total_cases"),
        *rates,
        failures_in(vocab.UNAUTHORIZED_FAILURES).alias("unauthorized_disclosure_rate"),
        failures_in(vocab.HALLUCINATION_FAILURES).alias("hallucinated_balance_rate"),
        C.count_where(answer & F.col("balance_exact_match")).alias("balance_exact_match_count"),
        C.count_where(answer).alias("balance_exact_match_denominator"),
        C.count_where(answer & F.col("currency_accuracy")).alias("currency_accuracy_count"),
        C.count_where(answer).alias("currency_accuracy_denominator"),
        C.count_where(F.col("has_resolution")).alias("product_resolution_denominator"),
        F.coalesce(F.sum(F.size("failures")), F.lit(0)).cast("bigint").alias("critical_failures"),
    )


def category_metrics(checked: DataFrame) -> DataFrame:
    """Share of cases per category that pass every check."""
    return checked.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"), _rate(F.col("all_checks"), F.lit(True)).alias("all_checks_share")
    )


def failure_totals(checked: DataFrame) -> DataFrame:
    return failure_rows(checked).groupBy("type").agg(F.count(F.lit(1)).alias("failures"))
