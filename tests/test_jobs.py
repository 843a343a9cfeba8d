import pytest

from probanza.plans import audit as A
from probanza.plans import evidence as V
from probanza.functions import vocab
from probanza.streaming import catalog as K
from probanza.streaming import requests as Q


def put(root, path, columns, rows):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    lines = [columns.replace(" ", ",")] + [",".join(r) for r in rows]
    target.write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    put(root, "customers.csv", "customer_id registration_branch_id customer_status country detected_accent", [("C1", "B1", "Active", "CO", "x"), ("C2", "B1", "Active", "MX", "y")])
    put(root, "products.csv", "product_id customer_id product_status product_type opening_branch_id", [("P1", "C1", "A", "Cuenta Ahorro", "B1"), ("P2", "C2", "A", "Tarjeta", "B1")])
    put(root, "service_agents.csv", "agent_id assigned_branch_id agent_status languages specialty", [("A1", "B1", "Active", '"es,en"', "x")])
    put(root, "transactions/year=2026/month=01/day=10/t.csv", " ".join(vocab.SCOPED_COLUMNS["transactions"]), [
        ("T1", "2026-01-10 09:00:00", "2026-01-10", "P1", "C1", "t", "c", "1", "COP", "Approved", "0", "", ""),
        ("T2", "2026-01-10 09:30:00", "2026-01-09", "P2", "C2", "t", "c", "2", "COP", "Declined", "1", "", ""),
    ])
    calls = "interaction_id interaction_date process_date customer_id agent_id contact_reason reason_category was_resolved was_escalated requires_followup has_transcript interaction_type"
    put(root, "call_center_interactions/year=2026/month=01/day=10/c.csv", calls, [
        ("I1", "2026-01-10 10:00:00", "2026-01-10", "C1", "A1", "Transaccional", "Transaccional", "true", "false", "no", "true", "Chat"),
        ("I2", "2026-01-10 11:00:00", "2026-01-10", "C1", "A1", "Queja", "Queja", "false", "true", "yes", "true", "Chat"),
        ("I3", "2026-01-10 12:00:00", "2026-01-10", "C2", "A1", "Retención", "Retención", "true", "false", "no", "false", "Chat"),
    ])
    put(root, "call_transcripts/year=2026/month=01/day=10/r.csv", "transcript_id interaction_id process_date customer_id agent_id detected_language", [
        ("R1", "I1", "2026-01-10", "C1", "A1", "es"), ("R2", "I2", "2026-01-10", "C1", "A1", "es"),
    ])
    complaints = "complaint_id creation_date process_date customer_id category affected_product_id origin_interaction_id assigned_agent_id resolution_date closing_date resolution resolution_satisfaction sla_breached"
    put(root, "complaints/year=2026/month=01/day=10/k.csv", complaints, [
        ("K1", "2026-01-10", "2026-01-10", "C1", "cat", "P1", "", "A1", "2026-01-12", "2026-01-13", "done", "5", "true"),
        ("K2", "2026-01-10", "2026-01-10", "C2", "cat", "", "", "", "", "", "", "", ""),
    ])
    put(root, "satisfaction_surveys/year=2026/month=01/day=11/s.csv", "survey_id survey_date process_date interaction_id customer_id agent_id", [
        ("S1", "2026-01-11", "2026-01-11", "I1", "C1", "A1"),
    ])
    return root


def test_evidence_pass(spark, data, tmp_path):
    artifacts = V.run(spark, str(data), str(tmp_path / "out"), "2026-09-30")
    assert {p.name for p in (tmp_path / "out").iterdir()} == {*artifacts, "manifest"}
    records = {r.record_id: r.value for r in artifacts["05_relevant_profile"].collect()}
    assert records["transactions|same_calendar_day_count"] == "1"
    assert records["transactions|process_before_event_count"] == "1"
    assert records["transactions|event_before_process_count"] == "0"
    assert records["transactions|temporal_comparison_unknown_count"] == "0"
    assert records["transactions|true_temporal_ordering_risk"] == "PRESENT"
    assert records["satisfaction_surveys|same_calendar_day_count"] == "1"
    assert records["transactions|partition_aligned_rows"] == "2"
    assert records["customers|minimum_relevant_date"] == "NOT_APPLICABLE"
    assert records["complaints|malformed_relevant_dates"] == "0"
    assert records["complaints|priority|null_count"] == "2"
    b = {r.metric: r.value for r in artifacts["09_workflow_B_feasibility"].filter("workflow = 'B'").collect()}
    assert (b["complaint_total"], b["complaint_origin_interaction_nonnull_rate"], b["complaint_sla_breach_rate"]) == ("2", "0.0", "100.0")
    assert b["complaint_origin_interaction_match_rate"] == "UNKNOWN_NOT_APPLICABLE"
    a = {r.metric: r.value for r in artifacts["08_workflow_A_feasibility"].filter("workflow = 'A'").collect()}
    assert a["transaction_related_customer_service_interactions"] == "2"
    ready = {r.record_id: r.value for r in artifacts["10_evaluation_feasibility"].collect()}
    assert ready["A|survey_availability"] == "1" and ready["B|survey_availability"] == "0"
    languages = artifacts["07_language_coverage"].collect()
    assert [(r.category, r.rows, r.percentage) for r in languages] == [("es", 2, 100.0)]
    assert artifacts["06_join_quality"].count() == 15
    written = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert written.total_rows == 15 and len(written.warnings) == 4


def test_whole_audit(spark, data, tmp_path):
    artifacts = A.run(spark, str(data), str(tmp_path / "out"), "2026-09-30")
    assert {p.name for p in (tmp_path / "out").iterdir()} == set(artifacts)
    inventory = {r.dataset: r for r in artifacts["data_inventory"].collect()}
    assert inventory["transactions"].candidate_primary_key == "customer_id,product_id,transaction_id"
    assert (inventory["customers"].rows, inventory["customers"].files, inventory["transactions"].event_like) == (2, 1, True)
    edges = {(r.child_table, r.child_column, r.parent_table): r.status for r in artifacts["foreign_key_quality"].collect()}
    assert len(edges) == len(vocab.DOCUMENTED_EDGES) and edges["transactions", "customer_id", "customers"] == "observed"
    assert {s for (child, _, parent), s in edges.items() if "campaign" in child + parent} == {"MISSING EVIDENCE"}
    daily = {(r.dataset, str(r.event_date)): r.rows for r in artifacts["temporal_coverage"].collect()}
    assert daily[("call_center_interactions", "2026-01-10")] == 3


CATALOG = "customer_id product_id product_type product_number current_balance currency"


def _feed(spark, path):
    schema = "request_id string, customer_id string, query string, session_mode string"
    return spark.readStream.schema(schema).json(str(path))


def test_stream_answers_by_session(spark, frame, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [("1", "saldo de mi cuenta", "authenticated"), ("2", "saldo de mi cuenta", "unauthenticated"), ("3", "saldo de mi cuenta", "wrong-owner"), ("4", " ", "authenticated"), ("5", "saldo", "bogus")]
    live = {"processingTime": "0 seconds"}
    (feed / "a.json").write_text("\n".join(f'{{"request_id": "{i}", "customer_id": "C1", "query": "{q}", "session_mode": "{m}"}}' for i, q, m in rows))
    products = frame(CATALOG, [("C1", "P1", "Cuenta Ahorro", "9", "10", "COP")])
    out = str(tmp_path / "out")
    left = str(tmp_path / "left")
    start = lambda trigger: Q.decision_stream(_feed(spark, feed), lambda: products, lambda: "1", out, str(tmp_path / "cp"), rejects=left, trigger=trigger)
    start(None).awaitTermination()
    running = start(live)
    (feed / "b.json").write_text('{"request_id": "6", "customer_id": "C1", "query": "hola", "session_mode": null}\n{"request_id": "7", "customer_id": "C1"}')
    running.processAllAvailable()
    running.stop()
    got = {r.case_id: (r.predicted_action, r.predicted_balance) for r in spark.read.parquet(out).collect()}
    assert got == {"1": ("READ_BALANCE", "10.00"), "2": ("AUTH_REQUIRED", ""), "3": ("DENY", ""), "6": ("OUT_OF_SCOPE", "")}
    rejected = spark.read.parquet(left)
    assert {r.request_id: r.error for r in rejected.collect()} == {"4": "query is required", "5": "invalid session_mode", "7": "query is required"}


def _request(feed, name, number, customer="C1"):
    (feed / name).write_text(f'{{"request_id": "{number}", "customer_id": "{customer}", "query": "saldo de mi cuenta", "session_mode": "authenticated"}}')


def test_broken_catalog_stops_the_stream(spark, frame, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    _request(feed, "a.json", 1)
    empty = frame(CATALOG, [("C1", "P1", "t", "9", "1", "COP")]).filter("false")
    query = Q.decision_stream(_feed(spark, feed), lambda: empty, lambda: "1", str(tmp_path / "out"), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="no rows"):
        query.awaitTermination()
    assert not (tmp_path / "out").exists()


def test_catalog_is_read_once_per_version(spark, frame, tmp_path):
    feed, catalog, out = tmp_path / "feed", tmp_path / "catalog", str(tmp_path / "out")
    feed.mkdir()
    catalog.mkdir()
    reads = []

    def offer(balance):
        rows = [f"C{k},P{k},Cuenta Ahorro,9,{balance + k},COP" for k in range(300)]
        (catalog / "p.csv").write_text("\n".join([CATALOG.replace(" ", ","), *(rows if balance else [])]) + "\n")

    def load():
        reads.append(1)
        return spark.read.option("header", True).csv(str(catalog))

    def run():
        stream = _feed_of_one(spark, feed)
        Q.decision_stream(stream, load, lambda: K.path_version(spark, str(catalog)), out, str(tmp_path / "cp")).awaitTermination()

    def answered():
        return {r.case_id: r.predicted_balance for r in spark.read.parquet(out).collect()}

    offer(100)
    for number in (1, 2, 3):
        _request(feed, f"{number}.json", number, f" C{number} ")
    run()
    assert answered() == {"1": "101.00", "2": "102.00", "3": "103.00"} and len(reads) == 1
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    _request(feed, "4.json", 4)
    run()  # a restart finds the snapshot
    assert answered()["4"] == "101.00" and len(reads) == 1
    offer(200)
    _request(feed, "5.json", 5)
    run()
    assert answered()["5"] == "201.00" and len(reads) == 2
    offer(0)
    _request(feed, "6.json", 6)
    for _ in range(2):
        with pytest.raises(Exception, match="no rows"):
            run()
    assert set(answered()) == {"1", "2", "3", "4", "5"}
    offer(300)
    run()
    assert answered()["6"] == "301.00" and spark.read.parquet(out).select("catalog_version").distinct().count() == 3


def _feed_of_one(spark, path):
    schema = "request_id string, customer_id string, query string, session_mode string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
