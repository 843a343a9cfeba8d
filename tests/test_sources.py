import hashlib
import json

import pytest
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators import profile as P
from probanza.plans import audit as A
from probanza.sources import files as L
from probanza.sources import sinks
from probanza.sources import tables as S

TRANSACTION = [
    "transaction_id", "transaction_date", "process_date", "product_id", "customer_id", "transaction_type", "transaction_category",
    "amount", "currency", "amount_usd", "channel", "branch_id", "merchant_name", "merchant_category", "transaction_country",
    "transaction_city", "transaction_status", "response_code", "is_fraud", "fraud_score", "latitude", "longitude",
]


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def line(n, first="T"):
    return ",".join([first] + [f"v{i}" for i in range(1, n)]) + "\n"


@pytest.fixture
def hive(tmp_path):
    head = ",".join(TRANSACTION) + "\n"
    for day in ("10", "11"):
        put(tmp_path, f"transactions/year=2026/month=01/day={day}/t_{day}.csv", head + line(22, f"T{day}"))
    return tmp_path


def test_partition_columns_are_virtual_and_keep_zeros(spark, hive):
    df = S.read_dataset(spark, str(hive), "transactions")
    assert len([c for c in df.columns if c != S.SOURCE_FILE]) == 25
    scoped = S.scoped(df, vocab.SCOPED_COLUMNS["transactions"])
    assert len(scoped.columns) == 13 + 3 + 1 and scoped.count() == 2
    assert {r.month for r in scoped.select("month").collect()} == {"01"}
    assert {str(r.d) for r in scoped.select(C.partition_date(S.SOURCE_FILE).alias("d")).collect()} == {"2026-01-10", "2026-01-11"}


@pytest.mark.parametrize("width", [23, 3])
def test_a_row_of_another_width_stops_the_strict_scan(spark, hive, width):
    put(hive, "transactions/year=2026/month=01/day=12/t.csv", ",".join(TRANSACTION) + "\n" + line(width))
    df = S.read_dataset(spark, str(hive), "transactions")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        df.select("transaction_id").collect()
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        df.count()
    good = S.read_dataset(spark, str(hive), "transactions", "DROPMALFORMED")
    assert good.select("transaction_id").count() == 2


def test_columns_are_matched_by_name(spark, tmp_path):
    put(tmp_path, "d/a.csv", "a,b\n1,2\n")
    put(tmp_path, "d/b.csv", "b,a\n20,10\n")
    put(tmp_path, "d/c.csv", "﻿a,c\n100,x\n")
    rows = S.read_dataset(spark, str(tmp_path), "d").select("a", "b", "c").orderBy(F.col("a").cast("int")).collect()
    assert [tuple(r) for r in rows] == [("1", "2", None), ("10", "20", None), ("100", None, "x")]
    drift = L.header_drift(L.list_files(spark, str(tmp_path))).first()
    assert (drift.files, drift.headers, drift.columns_in_all_files, drift.columns_in_some_files, drift.schema_drift) == (3, 3, 1, 2, True)


def test_null_and_quoted_blank_stay_apart(spark, tmp_path):
    put(tmp_path, "d.csv", 'a,b,c\n1,,x\n2,"",y\n')
    df = S.read_dataset(spark, str(tmp_path), "d").select("a", "b", "c")
    rows = {r.column_name: (r.null_rows, r.blank_rows) for r in P.null_blank_counts(df, "d").collect()}
    assert rows["b"] == (1, 1)


def test_lenient_scan(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes(b"a,b\n1,x\xff\n2\n3,y,z\n4,w\n")
    good, bad = S.read_lenient(spark, [str(tmp_path / "d.csv")], ["a", "b"])
    assert [r.a for r in good.orderBy("a").collect()] == ["1", "4"] and bad.count() == 2
    assert "�" in good.filter("a = '1'").first().b


def test_widths(spark, tmp_path):
    put(tmp_path, "d.csv", 'a,b\n1,"x,y"\n2\n3,y,z\n4,w\n')
    widths = S.row_widths(spark, str(tmp_path))
    assert {r.width: r.rows for r in widths.collect()} == {2: 2, 1: 1, 3: 1}
    with pytest.raises(S.RowWidthError):
        S.require_one_width(widths)
    put(tmp_path, "e/e.csv", "a, \n1,2\n")
    with pytest.raises(S.RowWidthError):
        S.read_dataset(spark, str(tmp_path), "e")


def test_listing_and_fingerprint(spark, hive):
    put(hive, "customers.csv", "customer_id\nC1\n")
    put(hive, "notes.txt", "x")
    listing = L.list_files(spark, str(hive))
    sets = {r.dataset: (r.files, r.partition_dates) for r in L.dataset_files(listing).collect()}
    assert sets == {"customers": (1, 0), "transactions": (2, 2)}
    files = sorted(p for p in hive.rglob("*.csv"))
    parts = [(str(p.relative_to(hive)), p.stat().st_size) for p in files]
    assert L.input_fingerprint(listing).first()[0] == hashlib.sha256("".join(f"{a}{b}" for a, b in parts).encode()).hexdigest()
    assert L.input_fingerprint(listing, ":").first()[0] == hashlib.sha256("".join(f"{a}:{b}" for a, b in parts).encode()).hexdigest()
    hashes = {r.relative_path: r.sha256 for r in L.content_hashes(spark, str(hive)).collect()}
    assert hashes["customers.csv"] == hashlib.sha256((hive / "customers.csv").read_bytes()).hexdigest()
    profile = L.tree_profile(listing).first()
    assert (profile.files, profile.bytes, profile.files_below_1kb) == (3, sum(b for _, b in parts), 3)
    assert L.largest(listing, "dataset").first().dataset == "transactions"
    assert L.duplicate_basenames(listing).count() == 0 and L.extension_counts(listing).first().extension == ".csv"


def test_representative_files(spark, tmp_path):
    for day in range(1, 8):
        put(tmp_path, f"d/year=2026/month=01/day={day:02d}/f.csv", "a\n1\n")
    put(tmp_path, "short/year=2026/month=01/day=01/f.csv", "a\n1\n")
    put(tmp_path, "products.csv", "a\n1\n")
    chosen = L.representative_files(L.list_files(spark, str(tmp_path)))
    days = sorted(str(r.partition_date) for r in chosen.filter("dataset = 'd'").collect())
    assert days == ["2026-01-01", "2026-01-04", "2026-01-07"]
    with pytest.raises(ValueError, match="short"):
        L.require_three_files(chosen)
    capped = L.capped_files(L.list_files(spark, str(tmp_path)), 2).filter("dataset = 'd'").collect()
    assert len(capped) == 2 and all(r.rows_are_sampled for r in capped)


def test_prefix_sample_and_recon(spark, tmp_path):
    for day in ("01", "02", "03"):
        body = "".join(f"{i},{'true' if i < 2 else 'maybe'},2026-01-{day}\n" for i in range(60))
        put(tmp_path, f"d/year=2026/month=01/day={day}/f.csv", "row_id,was_ok,event_date\n" + body)
    sample = S.prefix_sample(S.with_position(spark.read.option("header", True).csv(str(tmp_path / "d"))), 2)
    assert {r.row_id for r in sample.collect()} == {"0", "1"} and sample.count() == 6
    rows = {r.column_name: r for r in A.schema_recon(spark, str(tmp_path)).collect()}
    assert rows["row_id"].semantic_type == "identifier" and rows["row_id"].primary_key_candidate
    assert (rows["was_ok"].semantic_type, rows["was_ok"].observed_distinct_values_capped) == ("categorical", 2)
    assert (rows["was_ok"].observed_nonempty_values, rows["was_ok"].present_in) == (180, 3)
    assert rows["event_date"].semantic_type == "date" and rows["event_date"].timestamp_or_date_candidate
    assert rows["event_date"].present_in_all_samples


def test_catalog_fails_closed(spark, tmp_path):
    with pytest.raises(S.CatalogError):
        S.load_catalog(spark, str(tmp_path / "none.csv"))
    put(tmp_path, "short.csv", "customer_id,product_id\nC1,P1\n")
    with pytest.raises(S.CatalogError, match="product_type"):
        S.load_catalog(spark, str(tmp_path / "short.csv"))
    put(tmp_path, "empty.csv", ",".join(vocab.CATALOG_COLUMNS) + "\n")
    with pytest.raises(S.CatalogError, match="no rows"):
        S.load_catalog(spark, str(tmp_path / "empty.csv"))
    put(tmp_path, "good.csv", ",".join(vocab.CATALOG_COLUMNS) + "\nC1,P1,Cuenta Ahorro,9,1,COP\n")
    assert S.load_catalog(spark, str(tmp_path / "good.csv")).count() == 1


def test_predictions_by_suffix(spark, tmp_path):
    put(tmp_path, "p.csv", "case_id,predicted_action\nA,DENY\nB,X\nA,READ_BALANCE\n")
    put(tmp_path, "p.jsonl", "\n".join(json.dumps({"case_id": c, "predicted_action": a}) for c, a in (("A", "DENY"), ("A", "READ_BALANCE"), ("B", "X"))))
    for name in ("p.csv", "p.jsonl"):
        rows = {r.case_id: (r.predicted_action, r.predicted_balance) for r in S.load_predictions(spark, str(tmp_path / name)).collect()}
        assert rows == {"A": ("READ_BALANCE", ""), "B": ("X", "")}


def test_later_file_wins(spark, tmp_path):
    put(tmp_path, "1.csv", "case_id,category\nA,one\n,none\nB,one\n")
    put(tmp_path, "2.csv", "case_id,category\nA,two\n")
    rows = S.load_cases(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")]).collect()
    assert {r.case_id: r.category for r in rows} == {"A": "two", "B": "one"}


def test_union_of_columns(spark, frame, tmp_path):
    frames = [frame("a b", [("1", "2")]), frame("a c", [("3", "4")]), frame("b d", [("5", " 6")])]
    united = sinks.union_all(frames)
    assert united.columns == ["a", "b", "c", "d"] and sinks.union_all(frames[::-1], True).columns == ["a", "b", "c", "d"]
    sinks.write_csv(united, str(tmp_path / "out"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "out").glob("*.csv")]
    assert {p[0] for p in parts} == {"a,b,c,d"} and {x for p in parts for x in p[1:]} == {"1,2,,", "3,,4,", ",5,, 6"}
    listed = L.artifact_manifest(spark, str(tmp_path))
    assert {r.artifact for r in listed.collect()} == {"out"} and listed.filter("bytes <= 0").count() == 0


def test_manifest(spark, frame, tmp_path):
    t = {"x": frame("a b", [("1", "2"), ("3", "4")]), "y": frame("c", [("1",)])}
    names = P.columns_frame(spark, {n: d.columns for n, d in t.items()})
    sinks.write_json(sinks.manifest(spark, P.row_counts(t), P.schema_hashes(names), {"k": "v"}, []), str(tmp_path / "m"))
    r = spark.read.json(str(tmp_path / "m")).first()
    assert (r.k, r.total_rows) == ("v", 3)
    assert {x.dataset: x.schema_sha256 for x in r.tables}["x"] == hashlib.sha256(b"a|b").hexdigest()


def test_quotes_and_line_breaks_in_fields(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "n.csv").write_text('id,text\n1,"He said ""hi"", ok"\n2,"two\nlines"\n3,"a\\"\n', encoding="utf-8")
    want = [("1", 'He said "hi", ok'), ("2", "two\nlines"), ("3", "a\\")]
    for mode in ("FAILFAST", "DROPMALFORMED"):
        rows = S.read_dataset(spark, str(tmp_path), "notes", mode).select("id", "text").orderBy("id").collect()
        assert [tuple(r) for r in rows] == want
    S.require_one_width(S.row_widths(spark, str(tmp_path)))
    sinks.write_csv(spark.createDataFrame(want, "id string, text string"), str(tmp_path / "out"))
    again = spark.read.options(**S.RFC_4180).csv(str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in again] == want
