import random
from collections import Counter

from pyspark.sql import functions as F

from probanza.operators import keys as K
from probanza.operators import profile as P
from probanza.operators.joins import hot_keys, lookup_join, with_share


def test_fk_profile_with_an_orphan_and_a_blank(frame):
    t = {"complaints": frame("oid", [("I1",), ("GHOST",), (" ",)]), "calls": frame("id", [("I1",), ("I2",), ("I2",)])}
    r = K.fk_profile(t, ("complaints", "oid", "calls", "id")).first()
    assert (r.child_row_count, r.non_null_child_keys, r.distinct_child_keys, r.matched_distinct_keys) == (3, 2, 2, 1)
    assert (r.match_rate_pct, r.orphan_rate_pct, r.status) == (50.0, 50.0, "OBSERVED RELATIONSHIP")
    assert r.parent_duplicate_key_rate_pct == 33.333333


def test_fk_profile_without_keys_is_unknown_not_zero(frame):
    t = {"c": frame("k", [("",), (None,)]), "p": frame("k", [("I1",)])}
    r = K.fk_profile(t, ("c", "k", "p", "k")).first()
    assert r.match_rate_pct is None and r.orphan_rate_pct is None
    assert (r.rate_status, r.status) == ("UNKNOWN_NO_NONNULL_KEYS", "NO_NONNULL_CHILD_KEYS")


def test_relationship_without_keys_is_likely_only(frame):
    t = {"c": frame("k", [("",)]), "p": frame("k", [("x",)])}
    r = K.relationship_status(t, (("c", "k", "p", "k"),)).first()
    assert (r.match_rate_pct, r.status) == (0.0, "LIKELY RELATIONSHIP")


def test_missing_table_is_missing_evidence(frame):
    t = {"c": frame("k", [("a",), ("a",), ("",)]), "d": frame("k", [("a",)])}
    rows = {r.parent_table: r for r in K.fk_row_profiles(t, (("c", "k", "p", "k"), ("c", "k", "d", "k"))).collect()}
    assert (rows["p"].status, rows["p"].child_rows) == ("MISSING EVIDENCE", None)
    assert (rows["d"].child_rows, rows["d"].matched_rows, rows["d"].orphan_rows, rows["d"].null_rows) == (3, 2, 0, 1)


def test_reconciliation_counts_pairs(frame):
    child = frame("k", [("INT-1",), ("INT_1",), ("INT-2",), ("x",), (None,), ("x",)])
    parent = frame("k", [("INT-1",), ("1",), ("INT_2",), ("y",)])
    r = K.key_reconciliation(child, "k", parent, "k", "INT").first()
    assert (r.distinct_child_keys, r.distinct_parent_keys, r.exact_matches, r.normalized_matches) == (4, 4, 1, 5)


def test_discovery_against_brute_force(frame):
    rng = random.Random(7)
    data = {t: [(str(rng.randint(0, 30)), str(rng.randint(0, 9)) if rng.random() < 0.8 else None) for _ in range(60)] for t in "abc"}
    tables = {t: frame("u_id v_id", rows) for t, rows in data.items()}
    got = {(r.child, r.key_column, r.parent): (r.child_distinct, r.matched_distinct) for r in K.discover_joins(tables).collect()}
    want = {}
    for i, col in enumerate(("u_id", "v_id")):
        sets = {t: {r[i] for r in rows if r[i]} for t, rows in data.items()}
        for x in sets:
            for y in sets:
                if x != y and sets[x] & sets[y]:
                    want[(x, col, y)] = (len(sets[x]), len(sets[x] & sets[y]))
    assert got == want


def test_discovery_over_seventy_tables(frame):
    long = "x" * 100
    tables = {f"t{i:02d}": frame("a_id", [(str(i % 7),), (f"{long}{i % 35}",), (None,)]) for i in range(70)}
    found = K.discover_joins(tables).collect()
    assert len(found) == 70 * 9 and {(r.child_distinct, r.matched_distinct) for r in found} == {(2, 1), (2, 2)}
    same = {(r.child, r.parent) for r in found if r.matched_distinct == 2}
    assert same == {(f"t{i:02d}", f"t{(i + 35) % 70:02d}") for i in range(70)}


def test_salted_lookup_equals_the_plain_join(spark):
    rows = [("hot", i) for i in range(400)] + [(None, i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(300)]
    fact = spark.createDataFrame(rows, "k string, i int")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, v int")
    hot = {r.k for r in hot_keys(fact, ["k"], share=0.2).collect()}
    assert hot == {"hot", None}
    for how in ("left", "inner"):
        salted = lookup_join(fact, dim, "k", how, share=0.2, salts=8)
        assert Counter(map(tuple, salted.select("k", "i", "v").collect())) == Counter(
            map(tuple, fact.join(dim, "k", how).select("k", "i", "v").collect())
        )


def test_salted_lookup_on_two_keys(spark):
    fact = spark.createDataFrame([("a", None, i) for i in range(50)] + [("a", "b", i) for i in range(50)], "x string, y string, i int")
    dim = spark.createDataFrame([("a", "b", 9)], "x string, y string, v int")
    got = lookup_join(fact, dim, ["x", "y"], "left", share=0.1, salts=4)
    assert got.count() == 100 and got.filter("v = 9").count() == 50


def test_multiplicity(frame):
    child, parent = frame("k", [("a",)] * 3 + [("b",), ("c",), ("",)]), frame("k", [("a",), ("b",)])
    rows = {r.children_per_parent: r.parents for r in K.multiplicity(child, "k", parent, "k").collect()}
    assert rows == {3: 1, 1: 1}
    r = K.multiplicity(child, "k", parent, "k").first()
    assert (r.child_nonempty, r.matched, r.join_success_pct, r.relationship) == (5, 4, 80.0, "one-to-many")


def test_duplicates(frame):
    df = frame("id v", [("1", "a"), ("1", "a"), ("2", None), ("2", ""), (None, "a")])
    r = K.exact_duplicate_rows(df, "t").first()
    assert (r.total_rows, r.exact_duplicate_rows) == (5, 1)
    r = K.key_profile(df, "t", "id").first()
    assert (r.non_null_rows, r.distinct_values, r.duplicate_rows, r.duplicate_key_rate_pct) == (4, 2, 2, 40.0)
    r = K.duplicate_validation({"t": df}, {"t": "id"}).first()
    assert (r.total_rows, r.distinct_pk, r.duplicate_pk_rows) == (5, 2, 3)


def test_shares_add_up(frame):
    df = frame("g v", [("a", "x")] * 3 + [("a", "y")] + [(None, "x")] * 2)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    inside = {(r.g, r.v): r.s for r in with_share(counts, "n", "s", ["g"], 2).collect()}
    assert inside == {("a", "x"): 75.0, ("a", "y"): 25.0, (None, "x"): 100.0}
    total = sum(r.s for r in with_share(counts, "n", "s", digits=9).collect())
    assert abs(total - 100) < 1e-6


def test_profile_types_and_examples(frame):
    df = frame("a_id amount when_date email", [("1", "1.5", "2026/01/02", "x@y"), ("2", "nan", "", "z@y"), ("3", "2", "2026-01-05T10:00:00Z", "")])
    rows = {r.column_name: r for r in P.column_profile(df, "t").collect()}
    assert rows["a_id"].inferred_type == "numeric" and rows["when_date"].inferred_type == "timestamp"
    assert (rows["amount"].numeric_min, rows["amount"].numeric_max, rows["amount"].inferred_type) == (1.5, 2.0, "text")
    assert str(rows["when_date"].time_max) == "2026-01-05 10:00:00"
    assert rows["email"].semantic_hints == ["PII-like"]
    assert [r.column_name for r in K.candidate_keys(P.column_profile(df, "t")).collect()] == ["a_id"]
    assert "email" not in {r.column_name for r in P.example_values(df).collect()}


def test_approximate_distinct_is_near(spark):
    df = spark.range(20000).selectExpr("cast(id as string) as row_id", "cast(id % 5000 as string) as v")
    rows = {r.column_name: r for r in P.approximate_distinct(df, "t").collect()}
    assert (rows["row_id"].distinct_values, rows["row_id"].distinct_method) == (20000, "exact")
    assert abs(rows["v"].distinct_values - 5000) < 5000 * 0.15


def test_exact_distinct_of_integers_and_text(spark):
    rows = [(k % 7 - 3, k * 100_003 - (1 << 40), None if k % 3 else f"v{k % 50}", k / 4) for k in range(2000)] + [(None, None, "", float("nan"))] * 3
    df = spark.createDataFrame(rows, "a int, b bigint, c string, d double")
    got = {r.column_name: r.distinct_values for r in P.distinct_counts(df).collect()}
    assert got == {"a": 7, "b": 2000, "c": 51, "d": 2001}
    assert {r.column_name: r.distinct_values for r in P.distinct_counts(df.limit(0).select("a", "c")).collect()} == {}


def test_sketches_are_extended_without_rereading(spark):
    day = lambda k: spark.range(k * 3000, k * 3000 + 6000).selectExpr(f"'d{k}' as day", "cast(id as string) as v", "cast(id % 9 as string) as w")
    stored = P.distinct_sketches(day(0), ["v", "w"], [F.col("day")])
    for k in (1, 2):
        stored = stored.unionByName(P.distinct_sketches(day(k), ["v", "w"], [F.col("day")]))
    assert stored.count() == 6
    merged = {r.column_name: r.n for r in P.merged_sketches(stored, ["column_name"]).select("column_name", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert abs(merged["v"] - 12_000) <= 12_000 * 3 * P.SKETCH_ERROR and merged["w"] == 9


def test_text_profile_matches_python(frame):
    texts = ["abc", "abc", " ", "", None, "longer text"]
    r = P.text_profile(frame("t", [(x,) for x in texts]), "d", ["t"]).first()
    assert (r.usable_rows, r.usable_pct, r.max_characters, r.distinct_text_values) == (3, 50.0, 11, 4)
    assert r.avg_characters == round((3 + 3 + 1 + 0 + 11) / 5, 2)
    assert r.duplicate_text_rate_pct == round((3 - 4) / 3 * 100, 4)
