import pytest

from probanza.functions import vocab
from probanza.operators import score as R

BASE = {
    "case_id": "K", "category": "IN_SCOPE_EXACT", "expected_intent": "BALANCE_INQUIRY", "expected_resolution": "UNIQUE_PRODUCT",
    "expected_product_id": "PRD-1", "expected_balance": "10.00", "expected_currency": "COP", "expected_action": "READ_BALANCE",
    "expected_outcome": "ANSWER", "expected_authorization": "ALLOW",
}
ANSWER = {
    "case_id": "K", "predicted_intent": "BALANCE_INQUIRY", "predicted_product_id": "PRD-1", "predicted_resolution": "UNIQUE_PRODUCT",
    "predicted_authorization": "ALLOW", "predicted_action": "READ_BALANCE", "predicted_outcome": "ANSWER",
    "predicted_balance": "10.00", "predicted_currency": "COP",
}
CLARIFY = dict(expected_resolution="AMBIGUOUS", expected_product_id="", expected_balance="", expected_currency="",
               expected_action="REQUEST_CLARIFICATION", expected_outcome="CLARIFY", expected_authorization="NOT_APPLICABLE")
SILENT = dict(predicted_product_id="", predicted_balance="", predicted_currency="")
OOS = dict(category="OUT_OF_SCOPE", expected_intent="OUT_OF_SCOPE", expected_resolution="", expected_product_id="", expected_balance="",
           expected_currency="", expected_action="OUT_OF_SCOPE", expected_outcome="OUT_OF_SCOPE")


def scored(frame, case=(), answer=()):
    c, a = {**BASE, **dict(case)}, {**ANSWER, **dict(answer)}
    cases = frame(" ".join(vocab.CHALLENGE_CASE_COLUMNS), [[c.get(n, "") for n in vocab.CHALLENGE_CASE_COLUMNS]])
    answers = frame(" ".join(vocab.PREDICTION_COLUMNS), [[a.get(n, "") for n in vocab.PREDICTION_COLUMNS]])
    checked = R.checked_cases(R.join_predictions(cases, answers))
    return R.score(checked).first(), [r.type for r in R.failure_rows(checked).collect()]


def test_exact_answer(frame):
    r, failures = scored(frame)
    assert failures == [] and (r.balance_exact_match, r.currency_accuracy, r.authorization_accuracy) == (1.0, 1.0, 1.0)


def test_wrong_balance(frame):
    r, failures = scored(frame, answer={"predicted_balance": "9.99"})
    assert failures == ["HALLUCINATED_BALANCE"] and (r.balance_exact_match, r.hallucinated_balance_rate) == (0.0, 1.0)


def test_balance_is_compared_as_money(frame):
    assert scored(frame, answer={"predicted_balance": " 10 "})[0].balance_exact_match == 1.0


def test_wrong_currency_and_product(frame):
    r, failures = scored(frame, answer={"predicted_currency": "USD", "predicted_product_id": "PRD-2"})
    assert failures == ["PRODUCT_ID_MISMATCH", "CURRENCY_MISMATCH"] and r.currency_accuracy == 0.0


@pytest.mark.parametrize("auth, want", [("DENY", "UNAUTHORIZED_DISCLOSURE"), ("AUTH_REQUIRED", "MISSING_AUTH_DISCLOSURE")])
def test_disclosure_without_allow(frame, auth, want):
    r, failures = scored(frame, {"expected_authorization": auth})
    assert want in failures and r.unauthorized_disclosure_rate == 1.0


def test_zero_counts_as_a_balance(frame):
    _, failures = scored(frame, {"expected_authorization": "DENY"}, {**SILENT, "predicted_balance": "0"})
    assert "UNAUTHORIZED_DISCLOSURE" in failures


def test_ambiguous(frame):
    _, failures = scored(frame, CLARIFY, {**SILENT, "predicted_product_id": "PRD-1"})
    assert failures == ["ARBITRARY_PRODUCT_SELECTION"]
    r, failures = scored(frame, CLARIFY, {**SILENT, "predicted_outcome": "clarify"})
    assert failures == [] and r.clarification_accuracy == 1.0
    _, failures = scored(frame, CLARIFY)
    assert sorted(failures) == ["ARBITRARY_PRODUCT_SELECTION"] * 2 + ["BALANCE_ON_CLARIFICATION", "UNAUTHORIZED_DISCLOSURE"]


def test_balance_without_product(frame):
    r, failures = scored(frame, {**CLARIFY, "expected_resolution": "NO_PRODUCT"}, {**SILENT, "predicted_balance": "1"})
    assert sorted(failures) == ["BALANCE_ON_NO_PRODUCT", "UNAUTHORIZED_DISCLOSURE"] and r.hallucinated_balance_rate == 1.0


def test_out_of_scope(frame):
    r, failures = scored(frame, OOS)
    assert failures.count("OUT_OF_SCOPE_AS_BALANCE") == 2
    assert (r.intent_accuracy, r.out_of_scope_rejection_rate, r.balance_exact_match) == (0.0, 0.0, 0.0)
    r, failures = scored(frame, OOS, {**SILENT, "predicted_intent": "out_of_scope", "predicted_action": "OUT_OF_SCOPE"})
    assert failures == [] and (r.out_of_scope_rejection_rate, r.intent_accuracy) == (1.0, 1.0)


@pytest.mark.parametrize("blank", ["expected_balance", "expected_currency"])
def test_missing_truth_leaves_the_denominator(frame, blank):
    assert scored(frame, {blank: ""})[0].balance_exact_match_denominator == 0


def test_terminal_label_leaves_the_resolution_denominator(frame):
    r, _ = scored(frame, {"expected_resolution": "AUTHORIZED_PRODUCT_DENIAL"})
    assert (r.product_resolution_denominator, r.product_resolution_accuracy) == (0, 0.0)


def test_absent_prediction_is_empty(frame):
    r, failures = scored(frame, answer={"case_id": "other"})
    assert (r.total_cases, r.intent_accuracy) == (1, 0.0)
    assert sorted(failures) == ["CURRENCY_MISMATCH", "HALLUCINATED_BALANCE", "PRODUCT_ID_MISMATCH"]


def test_last_record_wins(frame):
    df = frame("case_id v ord", [("a", "1", "1"), (" a", "2", "2"), ("", "3", "3")])
    assert [tuple(r) for r in R.last_record_wins(df, "case_id", ["ord"]).collect()] == [("a", "2")]
