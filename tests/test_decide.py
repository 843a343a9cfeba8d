import pytest

from probanza.functions import vocab
from probanza.operators import cases as E
from probanza.operators import decide as D
from probanza.operators import score as R

CATALOG = "customer_id product_id product_type product_number current_balance currency"
REQUEST = "case_id customer_id customer_text authenticated_customer_id"
ASK = "Necesito consultar el saldo de mi cuenta de ahorros."


def one(frame, catalog, text=ASK, owner="C1", session="C1"):
    products = frame(CATALOG, catalog)
    return D.decide(frame(REQUEST, [("x", owner, text, session)]), products).first()


P1 = ("C1", "PRD-1", "Cuenta Ahorro", "900", "10.00", "COP")
CARD_OF_ANOTHER = ("C2", "PRD-2", "Tarjeta Crédito", "901", "7", "USD")


def blank(r):
    return (r.predicted_product_id, r.predicted_product_number, r.predicted_balance, r.predicted_currency) == ("", "", "", "")


def test_owner_with_one_product_is_answered(frame):
    r = one(frame, [P1, CARD_OF_ANOTHER])
    assert (r.predicted_action, r.predicted_balance, r.predicted_currency, r.predicted_product_id) == ("READ_BALANCE", "10.00", "COP", "PRD-1")
    assert r.response == "Su saldo actual de Cuenta Ahorro (900) es 10.00 COP."


def test_product_of_another_customer_never_matches(frame):
    r = one(frame, [CARD_OF_ANOTHER], session="C1")
    assert r.predicted_resolution == "NO_PRODUCT" and blank(r)
    assert r.response.startswith("No encuentro un producto Cuenta Ahorro")


def test_two_products_are_ambiguous(frame):
    r = one(frame, [P1, ("C1", "PRD-9", "Cuenta Ahorro", "902", "5", "COP")])
    assert (r.predicted_resolution, r.predicted_action) == ("AMBIGUOUS", "REQUEST_CLARIFICATION") and blank(r)


@pytest.mark.parametrize("session, want", [("C2", "DENY"), ("", "AUTH_REQUIRED"), (None, "AUTH_REQUIRED")])
def test_without_the_owners_session_nothing_is_told(frame, session, want):
    r = one(frame, [P1], session=session)
    assert (r.predicted_authorization, r.predicted_action) == (want, want) and blank(r)


def test_no_session_at_all_is_not_applicable(frame):
    r = one(frame, [P1], owner="", session="")
    assert r.predicted_authorization == "NOT_APPLICABLE" and blank(r)


def test_inquiry_without_a_type_spans_both_types(frame):
    card = ("C1", "PRD-3", "Tarjeta Crédito", "903", "3", "USD")
    assert one(frame, [P1], text="Dime mi saldo").predicted_action == "READ_BALANCE"
    assert one(frame, [P1, card], text="Dime mi saldo").predicted_resolution == "AMBIGUOUS"
    assert one(frame, [P1, card], text="Hola, buenos días.").predicted_action == "OUT_OF_SCOPE"


@pytest.mark.parametrize(
    "text, intent, kind",
    [(t, "BALANCE_INQUIRY", k) for t, k in zip(vocab.EXACT_REQUESTS, vocab.PRODUCT_TYPES)]
    + [(t.upper(), "BALANCE_INQUIRY", k) for t, k in zip(vocab.EXACT_REQUESTS, vocab.PRODUCT_TYPES)]
    + [
        (vocab.PARAPHRASED_REQUESTS[0], "BALANCE_INQUIRY", "Cuenta Ahorro"),
        (vocab.PARAPHRASED_REQUESTS[1], "BALANCE_INQUIRY", "Tarjeta Crédito"),
        (vocab.PARAPHRASED_REQUESTS[2], "BALANCE_INQUIRY", "Cuenta Ahorro"),
        (vocab.SEVERAL_PRODUCTS_REQUEST, "BALANCE_INQUIRY", ""),
        ("saldo de mi cuenta y mi tarjeta", "BALANCE_INQUIRY", ""),
        ("cuanto. es", "OUT_OF_SCOPE", ""),
        ("resaldo fondosdisponible", "OUT_OF_SCOPE", ""),
    ]
    + [(t, "OUT_OF_SCOPE", "Cuenta Ahorro" if "cuenta" in t else "") for t in vocab.OUT_OF_SCOPE_REQUESTS],
)
def test_intent_and_type(frame, text, intent, kind):
    r = frame("t", [(text,)]).select(D.intent("t").alias("i"), D.product_type("t").alias("k")).first()
    assert (r.i, r.k) == (intent, kind)


def test_policy_is_total_and_fails_safe(spark):
    table = D.policy_table(spark)
    assert table.count() == 24 == table.select("intent", "resolution", "authorization").distinct().count()
    answers = table.filter("action = 'READ_BALANCE'").collect()
    assert [(r.intent, r.resolution, r.authorization) for r in answers] == [("BALANCE_INQUIRY", "UNIQUE_PRODUCT", "ALLOW")]
    odd = spark.createDataFrame([("?", "UNIQUE_PRODUCT", "ALLOW")], "intent string, resolution string, authorization string")
    r = D.with_action(odd).first()
    assert (r.action, r.outcome) == vocab.FAIL_SAFE


def test_planted_labels_change_nothing(frame):
    products = frame(CATALOG, [CARD_OF_ANOTHER])
    planted = frame(
        REQUEST + " expected_product_id expected_balance expected_currency",
        [("x", "C1", "Hola, buenos días.", "C1", "PRD-2", "7", "USD")],
    )
    assert blank(D.decide(planted, products).first())


def test_run_summary(frame):
    products, requests = frame(CATALOG, [P1, CARD_OF_ANOTHER, P1]), frame(REQUEST, [("x", "C1", ASK, "C1")])
    r = D.run_summary(requests, products, D.decide(requests, products)).first()
    assert (r.catalog_product_rows, r.catalog_customers, r.cases, r.predictions) == (3, 2, 1, 1)


def test_curated_cases(frame):
    rows = []
    for i in range(40):
        kind = vocab.PRODUCT_TYPES[i % 2]
        rows.append((f"C{i:03d}", f"P{i:03d}", kind, str(i), f"{i}.5", "COP"))
        if i % 5 == 0:
            rows.append((f"C{i:03d}", f"Q{i:03d}", kind, str(i), f"{i}.7", "COP"))
    products = frame(CATALOG, rows)
    cases = E.curated_cases(products)
    counts = {r.category: r["count"] for r in cases.groupBy("category").count().collect()}
    assert counts == {
        "IN_SCOPE_EXACT": 12, "IN_SCOPE_PARAPHRASE": 15, "PRODUCT_DISAMBIGUATION": 15, "AUTHORIZATION": 12, "IDENTITY_MISSING": 10,
        "NOT_FOUND": 12, "OUT_OF_SCOPE": 12, "ADVERSARIAL": 12, "GROUNDING_EDGE_CASE": 10,
    }
    first = cases.filter("case_id = 'CH-EXACT-001'").first()
    assert (first.customer_id, first.expected_resolution, first.expected_balance) == ("C002", "UNIQUE_PRODUCT", "2.50")
    denied = cases.filter("expected_authorization = 'DENY'").collect()
    assert {r.expected_resolution for r in denied} == {"AUTHORIZED_PRODUCT_DENIAL"} and {r.expected_balance for r in denied} == {""}
    assert {r.authenticated_customer_id for r in denied} == {"C039"}
    checked = R.checked_cases(R.join_predictions(cases, D.predictions(cases, products)))
    r = R.score(checked).first()
    assert (r.total_cases, r.intent_accuracy, r.authorization_accuracy, r.out_of_scope_rejection_rate) == (110, 1.0, 1.0, 1.0)
    assert r.unauthorized_disclosure_rate == 0.0


def test_native_cases(frame):
    transcripts = frame(
        "transcript_id interaction_id customer_id process_date customer_text",
        [("T1", "I1", "C1", "2026-01-01", " El saldo de mi cuenta de ahorros "), ("T2", "I2", "C1", "d", "saldo cuenta ahorro"), ("T3", "I1", "C1", "d", "cuenta de ahorros"), ("T4", "I9", "C1", "d", ASK)],
    )
    calls = frame("interaction_id reason_category contact_reason was_resolved was_escalated", [("I1", " Transaccional", "x", "Yes", "no"), ("I2", "Queja", "y", "", "")])
    rows = E.native_cases(transcripts, calls, frame(CATALOG, [P1])).collect()
    assert [(r.case_id, r.customer_text, r.historical_was_resolved, r.historical_was_escalated, r.expected_balance) for r in rows] == [
        ("T1", "El saldo de mi cuenta de ahorros", "True", "False", "10.00")
    ]


def test_native_cases_take_the_last_record_of_an_interaction(frame):
    transcripts = frame(
        "transcript_id interaction_id customer_id process_date customer_text", [("T1", "I1", "C1", "d", ASK), ("T2", "I2", "C1", "d", ASK)]
    )
    calls = frame(
        "interaction_id reason_category contact_reason was_resolved was_escalated process_date interaction_date",
        [
            ("I1", "Transaccional", "", "yes", "", "2026-01-01", "2026-01-01 10:00:00"), ("I1", "Queja", "", "", "", "2026-01-02", "2026-01-01 10:00:00"),
            ("I2", "Queja", "", "", "", None, "2026-01-03 10:00:00"), ("I2", "Transaccional", "", "", "yes", "2026-01-02", "2026-01-02 10:00:00"),
        ],
    )
    rows = E.native_cases(transcripts, calls, frame(CATALOG, [P1])).collect()
    assert [(r.case_id, r.historical_was_resolved, r.historical_was_escalated) for r in rows] == [("T2", "False", "True")]
