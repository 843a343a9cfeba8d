import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.operators import temporal as X
from probanza.operators import workflow as W


def metrics(df):
    return {r.metric: (r.value_num if r.value_num is not None else r.value) for r in df.collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-500000, 500000), min_size=1, max_size=40))
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    assert X.exact_median(df, "v").first().median == statistics.median(values)


def test_exact_median_by_group(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(-9, 9)) for g in "ab" for _ in range(51)] + [("hot", 5)] * 200 + [("hot", 6)] * 200
    got = {r.g: r.median for r in X.exact_median(spark.createDataFrame(rows, "g string, v bigint"), "v", ["g"]).collect()}
    for g in ("a", "b", "hot"):
        assert got[g] == statistics.median([v for k, v in rows if k == g])


@pytest.mark.parametrize(
    "values",
    [[-(1 << 63), (1 << 63) - 1], [-(1 << 63), 5, (1 << 63) - 1, 6, 7, 7], [(1 << 40) * k for k in range(9)], [-(1 << 62), -3, 4, 1 << 62], [0] * 7, [-70000, 70000]],
)
def test_exact_median_of_any_range(spark, values):
    assert X.exact_median(spark.createDataFrame([(v,) for v in values], "v bigint"), "v").first().median == float(statistics.median(values))


def test_exact_median_counts_digits_not_values(spark):
    rows = spark.range(300_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 300_007 * 1000).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 4), (None, None), (9, None)], "g bigint, v bigint"))
    got = {r.g: r.median for r in X.exact_median(rows, "v", ["g"]).collect()}
    plain = {}
    for g, v in ((r.g, r.v) for r in rows.collect()):
        plain.setdefault(g, []).extend([] if v is None else [v])
    assert got == {g: float(statistics.median(v)) if v else None for g, v in plain.items()}


def test_lag_profiles(frame):
    t = {"a": frame("p e", [("2026-01-10 10:00:00", "2026-01-10 09:00:00"), ("2026-01-12", "2026-01-10"), ("x", "2026-01-10")]), "b": frame("p e", [("", "2026-01-10")])}
    got = {r.dataset: (r.lag_min, r.lag_max, r.lag_median) for r in X.lag_profiles({n: (d, "p", "e") for n, d in t.items()}).collect()}
    assert got == {"a": (3600, 172800, 88200.0), "b": (None, None, None)}


def test_profile_of_same_day_repeats(frame):
    rows = [(f"2026-01-10 0{i}:00:00", "2026-01-10") for i in range(1, 6)]
    m = metrics(X.temporal_profile(frame("event process", rows), "t", "event", "process", "2026-09-30"))
    assert (m["process_before_event_count"], m["same_calendar_day_count"]) == (0, 5)
    assert m["true_temporal_ordering_risk"] == "NOT_OBSERVED"
    assert m["partition_aligned_rows"] == "NOT_APPLICABLE" and m["event_process_lag_median"] == 0


def test_future_and_malformed(frame):
    rows = [("2027-01-01", ""), ("2026-01-01", ""), ("2026-13-01", ""), ("", "")]
    m = metrics(X.temporal_profile(frame("event process", rows), "t", "event", None, "2026-09-30"))
    assert (m["future_timestamps_vs_runtime_date"], m["malformed_timestamps"]) == (1, 1)
    assert m["event_before_process_count"] == "NOT_APPLICABLE"


def test_partition_metrics(frame):
    path = "r/year=2026/month=01/day={}/f.csv"
    rows = [("2026-01-01", path.format("01")), ("2026-01-02", path.format("04")), ("bad", path.format("04")), ("2026-01-01", "r/year=2026/month=01/f.csv")]
    m = metrics(X.temporal_profile(frame("event path", rows), "t", "event", None, "2026-09-30", "path"))
    assert (m["partition_aligned_rows"], m["partition_mismatched_rows"]) == (2, 1)
    assert (m["partition_dates_represented"], m["missing_partition_dates"]) == (3, 2)
    assert m["partition_mismatch_rate_pct"] == 33.333333


def test_child_before_parent_against_brute_force(frame):
    rng = random.Random(11)
    day = lambda: f"2026-01-{rng.randint(1, 9):02d}" if rng.random() < 0.85 else ""
    child = [(rng.choice("abc "), day()) for _ in range(70)]
    parent = [(rng.choice("abc "), day()) for _ in range(25)]
    pairs = [(c[1], p[1]) for c in child for p in parent if c[0] == p[0] != " " and c[1] and p[1]]
    r = X.child_before_parent(
        frame("k d", child), "k", C.parse_ts("d"), frame("k d", parent), "k", C.parse_ts("d")
    ).first()
    assert (r.pairs_with_both_dates, r.child_before_parent_pairs) == (len(pairs), sum(c < p for c, p in pairs))


def test_tertiles(frame):
    rows = [("early", "2026-01-01"), ("late", "2026-01-31"), ("mid", "2026-01-15"), ("span", "2026-01-01"), ("span", "2026-01-31"), ("", "2026-01-05")]
    r = X.tertile_overlap(X.entity_days(frame("c d", rows), "c", C.parse_ts("d"))).first()
    assert (r.train_only, r.holdout_only, r.spanning, r.middle_only) == (1, 1, 2, 1)


def test_one_customer_twice_on_a_day_is_no_leak(frame):
    calls = frame(
        "interaction_id interaction_date process_date customer_id was_resolved",
        [("I1", "2026-01-10 09:00:00", "2026-01-10", "C1", "true"), ("I2", "2026-01-10 10:00:00", "2026-01-10", "C1", "")],
    )
    surveys = frame("interaction_id survey_date", [("I1", "2026-01-09"), ("I1", "2026-01-11"), ("", "2026-01-11")])
    m = metrics(W.readiness("A", calls, "interaction_id", "interaction_date", "was_resolved", surveys=surveys))
    assert m["repeat_customer_structure.repeated_customer_rows"] == 1
    assert (m["true_temporal_ordering_risk"], m["leakage_risk"]) == ("NOT_OBSERVED", "REQUIRES_MANUAL_REVIEW")
    assert (m["survey_availability"], m["survey_timing.joined_pairs_with_both_dates"]) == (1, 2)
    assert (m["survey_timing.survey_before_interaction_rows"], m["outcome_availability_pct"]) == (1, 50.0)


def test_missing_days_of_nothing(frame):
    assert X.missing_days(frame("d", [(None,)]).select(F.col("d").cast("date")), "d").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_results_do_not_depend_on_row_order(frame, seed):
    rows = [(f"2026-01-{d:02d} 0{d % 9}:00:00", f"2026-01-{(d * 7) % 28 + 1:02d}") for d in range(1, 28)]
    shuffled = random.Random(seed).sample(rows, len(rows))
    a, b = (metrics(X.temporal_profile(frame("e p", r), "t", "e", "p", "2026-01-20")) for r in (rows, shuffled))
    assert a == b
