"""Hard negatives and near copies of embeddings against plain computations."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probanza.llm import collisions, hard_negatives, statements

SCHEMA = "vec_id long, embedding array<float>, label int, score long, row string, part int, n_links string"
NAN, INF = float("nan"), float("inf")


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "r", 2, "n") for i, v, k in rows], SCHEMA)


def _by_sql(name, df):
    rows = df.select("vec_id", "embedding", "label").collect()
    embeddings = pa.table({
        "vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
        "label": pa.array([r[2] for r in rows], pa.int32()),
    })
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    return sorted(con.execute(statements.SQL[name]).fetchall(), key=str)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors with copies, near copies in groups of several sizes and a chain, and rows that can take no part."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 16))
    near = [np.vstack([b + rng.normal(scale=0.12, size=(k, 16))]) for b, k in zip(base, (2, 3, 5, 60, 9, 30), strict=False)]
    angle = np.arange(12) * 0.25
    chain = np.zeros((12, 16))
    chain[:, 0], chain[:, 1] = np.cos(angle), np.sin(angle)
    whole = np.vstack([base, *near, chain, np.repeat(base[20:21], 40, axis=0), base[20:21] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(whole)]
    odd = [None, [], [0.0] * 16, [NAN] + [1.0] * 15, [INF] * 16, [None] + [1.0] * 15]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(2100, whole[3].tolist(), None), rows[5], rows[5], rows[100], (None, whole[0].tolist(), 2)]
    return _frame(spark, rows)


def _same_length(df):
    """Without empty vectors, which the SQL function for products does not take."""
    return df.filter("embedding IS NULL OR size(embedding) > 0")


def test_hard_negatives(vectors):
    df = _same_length(vectors)
    got = _rows(hard_negatives.hard_negatives(df))
    assert len(got) > 20 and got == _by_sql("op11_hard_negatives", df)


def test_hard_negatives_in_many_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "GROUP", 1)
    df = _same_length(vectors).filter("vec_id < 250 OR vec_id > 1000").repartition(3)
    assert _rows(hard_negatives.hard_negatives(df)) == _by_sql("op11_hard_negatives", df)


def test_hard_negatives_of_equal_scores_and_lengths(spark):
    rows = [(100 * k, [1.0, 0.5], 1) for k in range(4)] + [(k, [1.0, 0.5, 9.0], k % 3) for k in range(1, 60)] + [(601, [], 1), (602, [1e9], 1)]
    got = _rows(hard_negatives.hard_negatives(_frame(spark, rows)))
    whole = [(i, [int(np.floor(256 * x)) for x in v], (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows if max(map(abs, v), default=0) < hard_negatives.LIMIT]
    want = []
    for a, (i, q, k) in enumerate(whole):
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j, label) for b, (j, v, label) in enumerate(whole) if a != b)
            for p, j, _ in [s for s in scored if s[2] == k][:5]:
                fits = [s for s in scored if s[2] != k and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
                want += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fits)]
    assert got == sorted(want, key=str) and len(got) > 50


@pytest.mark.parametrize("k", [1, 5])
def test_vertical_scan_rules_rows_out(k):
    rng = np.random.default_rng(3)
    columns = rng.integers(-300, 300, (24, 3000))
    block = hard_negatives.Block(columns, rng.permutation(3000), np.zeros(3000, np.int64))
    query = rng.integers(-300, 300, 24)
    candidates = np.ones(3000, dtype=bool)
    exact = query @ columns
    windows = [(-(1 << 62), 1 << 62), (int(exact.max() * 0.5), int(exact.max() * 0.8))]
    found = hard_negatives.vertical_scan(block, query, candidates, windows, k, step=4)
    for (least, most), (rows, scores) in zip(windows, found, strict=True):
        inside = np.flatnonzero((exact >= least) & (exact <= most))
        want = inside[np.lexsort((block.ids[inside], -exact[inside]))[:k]]
        assert rows.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert candidates.sum() < 1500


def test_near_dedup(vectors):
    got = _rows(collisions.near_dedup(vectors))
    assert got == _by_sql("op13_embedding_near_dedup", vectors) and max(r[1] for r in got) >= 59


def test_near_dedup_in_blocks_and_strips(vectors, monkeypatch):
    want = _rows(collisions.near_dedup(vectors))
    monkeypatch.setattr(collisions, "BLOCK", 16)
    monkeypatch.setattr(collisions, "STRIP", 50)
    assert _rows(collisions.near_dedup(vectors.repartition(5))) == want


def test_near_dedup_keeps_lengths_apart(spark):
    rows = [(k, [1.0, 0.01 * k] + [0.0] * (k % 2), 0) for k in range(10)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.near_dedup(_frame(spark, rows)).collect()}
    assert got == {k: (4, k % 2) for k in range(10)}


@pytest.mark.parametrize("operator", [hard_negatives.hard_negatives, collisions.near_dedup])
def test_empty_table(vectors, operator):
    assert operator(vectors.limit(0)).count() == 0
    assert operator(vectors.filter("embedding IS NULL").withColumn("embedding", F.col("embedding").cast("array<double>"))).count() in (0, 1)


@pytest.mark.parametrize("n", [100, 10_000, 10_000_000])
def test_plan_reaches_its_recall(n):
    plan = collisions.plan_projections(n)
    rng = np.random.default_rng(5)
    pairs = 200_000
    x = rng.standard_normal(pairs)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * rng.standard_normal(pairs)
    share = 2 * np.mean((x > plan.least_value) & (y > plan.least_value) & (np.abs(x - y) <= plan.window))
    exact = 2 * collisions.collision_chance(0.95, plan.least_value, plan.window)
    assert abs(share - exact) < 5 * np.sqrt(exact / pairs) + 1e-5
    assert 1 - (1 - exact) ** plan.directions - plan.directions * exact * (1 - exact) ** (plan.directions - 1) > 0.998
    assert plan.directions * 2 * (1 - collisions.NormalDist().cdf(plan.least_value)) < 20
