import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab

PAIRS = [
    ("2026-01-10", "2026-01-10 09:00:00", "SAME_CALENDAR_DAY"),
    ("2026-01-10", "2026-01-10 00:00:01", "SAME_CALENDAR_DAY"),
    ("2026-01-10", "2026-01-10", "SAME_CALENDAR_DAY"),
    ("2026-01-10 08:00:00", "2026-01-10 09:00:00", "PROCESS_BEFORE_EVENT"),
    ("2026-01-10 08:00:00", "2026-01-09 09:00:00", "EVENT_BEFORE_PROCESS"),
    ("2026-01-09 08:00:00", "2026-01-10 09:00:00", "PROCESS_BEFORE_EVENT"),
    ("2026-01-11", "2026-01-10 23:00:00", "EVENT_BEFORE_PROCESS"),
    ("2026-01-09", "2026-01-10 01:00:00", "PROCESS_BEFORE_EVENT"),
    ("", "2026-01-10 09:00:00", "UNKNOWN"),
    ("2026-01-10 08:00:00", None, "UNKNOWN"),
    ("2026-01-10 08:00:00", "2026-01-10 08:00:00", "SAME_CALENDAR_DAY"),
]


def test_ordering_pairs(frame):
    df = frame("p e want", PAIRS)
    rows = df.select(C.parse_ts("p").alias("p"), C.parse_ts("e").alias("e"), "want").select(
        C.ordering_class("p", "e").alias("got"), "want"
    )
    assert all(r.got == r.want for r in rows.collect())


def test_granularity_and_lag(frame):
    df = frame("p e", [("2026-01-11", "2026-01-10 23:00:00"), ("2026-01-10 08:00:02.1", "2026-01-10 08:00:00.9"), ("", "2026-01-01")])
    rows = df.select(C.parse_ts("p").alias("p"), C.parse_ts("e").alias("e")).select(
        C.granularity("p", "e").alias("g"), C.lag_seconds("p", "e").alias("lag")
    )
    assert [tuple(r) for r in rows.collect()] == [("CALENDAR_DAY", 86400), ("BOTH_TIMESTAMP", 2), ("UNKNOWN", None)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2026", None), ("09:00", None), ("2026-02-30", None), ("", None), (" ", None), (None, None), ("junk", None),
        ("2026-01-02", dt.datetime(2026, 1, 2)), ("2026/01/02", dt.datetime(2026, 1, 2)),
        (" 2026-1-2 ", dt.datetime(2026, 1, 2)), ("2026-01-02T03:04:05Z", dt.datetime(2026, 1, 2, 3, 4, 5)),
        ("2026-01-02 03:04:05.5", dt.datetime(2026, 1, 2, 3, 4, 5, 500000)), ("2026-01-02 03", None), ("2026-01-02junk", None),
    ],
)
def test_parse(frame, text, want):
    assert frame("t", [(text,)]).select(C.parse_ts("t").alias("x")).first().x == want


def test_parse_does_not_depend_on_the_session_zone(spark, frame):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
        row = frame("t", [("2026-01-02 00:30:00",)]).select(C.parse_ts("t").alias("x"), C.whole_seconds(C.parse_ts("t")).alias("s")).first()
        assert row.x == dt.datetime(2026, 1, 2, 0, 30)
        assert row.s == int(dt.datetime(2026, 1, 2, 0, 30, tzinfo=dt.timezone.utc).timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_blank_null_and_truth(frame):
    df = frame("v", [(None,), ("",), ("  ",), ("\t",), (" Sí ",), ("YES",), ("y",), ("1",)])
    rows = df.select(
        C.nonempty("v").alias("ne"), C.blank("v").alias("bl"), C.blank_to("v").alias("d"), C.strip("v").alias("s"),
        C.audit_true("v").alias("a"), C.score_true("v").alias("k"),
    ).collect()
    assert [r.ne for r in rows] == [False, False, False, True, True, True, True, True]
    assert [r.bl for r in rows] == [False, True, True, False, False, False, False, False]
    assert [r.d for r in rows][:3] == ["UNKNOWN"] * 3
    assert [r.s for r in rows] == ["", "", "", "", "Sí", "YES", "y", "1"]
    assert [r.a for r in rows] == [False, False, False, False, True, True, False, True]
    assert [r.k for r in rows] == [False, False, False, False, False, True, True, True]


@pytest.mark.parametrize(
    "text, want",
    [("2.665", "2.66"), ("2.675", "2.68"), ("0.0050000001", "0.01"), ("10", "10.00"), ("0", "0.00"), ("", ""), ("abc", ""), (None, ""), (" 7.1 ", "7.10"), ("1e3", "1000.00")],
)
def test_money_is_half_even(frame, text, want):
    assert frame("m", [(text,)]).select(C.money_text("m").alias("x")).first().x == want


def test_patterns_follow_unicode(frame):
    df = frame("t", [("CRÉDITO",), ("saldo",), ("saldó",), ("SALDO x",), ("resaldo",), ("saldo_1",), ("mi saldo.",)])
    hit = [r.x for r in df.select(C.matches("t", r"\bsaldo[s]?\b|cr[eé]dito").alias("x")).collect()]
    assert hit == [True, True, False, True, False, False, True]
    spaced = frame("t", [("cuenta de ahorros",), ("cuenta ahorro",)])
    assert all(r.x for r in spaced.select(C.matches("t", vocab.EXPLICIT_PRODUCT["Cuenta Ahorro"]).alias("x")).collect())


def test_partition_dates(frame):
    df = frame("p", [("a/year=2026/month=02/day=03/f.csv",), ("a/year=2026/month=02/f.csv",), ("a/f.csv",), ("a/year=2026/month=02/day=30/f",)])
    assert [r.d for r in df.select(C.partition_date("p").alias("d")).collect()] == [dt.date(2026, 2, 3), dt.date(2026, 2, 1), None, None]


def test_percent_guards(spark):
    row = spark.range(1).select(
        C.pct(F.lit(1), F.lit(0)).alias("z"), C.pct_or_null(F.lit(1), F.lit(0)).alias("n"), C.pct(F.lit(1), F.lit(3), 2).alias("p"),
        C.money(F.lit("2.665")).alias("m"),
    ).first()
    assert (row.z, row.n, row.p, row.m) == (0.0, None, 33.33, Decimal("2.66"))


def test_money_of_many_digits(frame):
    rows = frame("v", [("123456789012345678901234.565",), ("2.675",), ("1.125",), ("x",)])
    got = [None if r[0] is None else str(r[0]) for r in rows.select(C.money("v")).collect()]
    assert got == ["123456789012345678901234.56", "2.68", "1.12", None]
