"""The splittable scan against Spark's own one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from probanza.sources import records as R
from probanza.sources import tables as S

HEAD = ["id", "text", "note"]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that small files are split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(path, rows, head=HEAD, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(head)
    writer.writerows(rows)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out.getvalue().encode())


def _rows(n, seed):
    rng = random.Random(seed)
    pieces = ["a", "bc ", '"', ",", "\n", '""', "\n\n", "é", "5\" pipe", "line of words " * 4]
    return [(str(i), "".join(rng.choices(pieces, k=rng.randrange(6))) or "-", rng.choice(["x", "y\nz", "w" * 50])) for i in range(n)]


def _got(df):
    return sorted(tuple(r) for r in df.select(*HEAD).collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_one_task_reader(spark, tmp_path, small_ranges, end):
    rows = _rows(300, 1)
    _write(tmp_path / "d" / "a.csv", rows, end=end)
    got = S.read_dataset(spark, str(tmp_path), "d")
    assert got.rdd.getNumPartitions() > 20
    assert _got(got) == sorted(rows)
    assert _got(got) == sorted(tuple(r) for r in spark.read.options(**S.RFC_4180).csv(str(tmp_path / "d")).collect())


def test_fields_longer_than_a_range(spark, tmp_path, small_ranges):
    rows = [("1", "a\n" * 2000, "x"), ("2", "\n" * 3 + "b", "y"), ("3", "c", 'say "\n" twice'), *_rows(50, 2)]
    _write(tmp_path / "d.csv", rows)
    assert _got(S.read_dataset(spark, str(tmp_path), "d")) == sorted(rows)


def test_stray_quotes_are_plain_characters(spark, tmp_path, small_ranges):
    text = "id,text,note\n" + "".join(f'{i},5" pipe and 6" pipe,"a\nb"\n{i}x,7" pipe,c\n' for i in range(60))
    (tmp_path / "d.csv").write_text(text)
    want = [(str(i), '5" pipe and 6" pipe', "a\nb") for i in range(60)] + [(f"{i}x", '7" pipe', "c") for i in range(60)]
    assert _got(S.read_dataset(spark, str(tmp_path), "d")) == sorted(want)


def test_strict_and_lenient_in_ranges(spark, tmp_path, small_ranges):
    rows = _rows(80, 3)
    _write(tmp_path / "d" / "a.csv", [*rows[:40], ("only", "two\nlines"), *rows[40:], ("a", "b", "c", "one\nmore")])
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_dataset(spark, str(tmp_path), "d").count()
    assert _got(S.read_dataset(spark, str(tmp_path), "d", "DROPMALFORMED")) == sorted(rows)
    good, bad = S.read_lenient(spark, [str(tmp_path / "d")], HEAD)
    assert _got(good) == sorted(rows) and sorted(r[0] for r in bad.select("_corrupt_record").collect()) == ['a,b,c,"one\nmore"', 'only,"two\nlines"']
    assert {r.width: r.rows for r in S.row_widths(spark, str(tmp_path)).collect()} == {3: 80, 2: 1, 4: 1}


def test_headers_are_bound_in_one_scan(spark, tmp_path, small_ranges):
    rows = _rows(60, 4)
    _write(tmp_path / "d" / "year=2026" / "a.csv", rows)
    _write(tmp_path / "d" / "year=2025" / "b.csv", [(n, i, "extra") for i, _, n in rows], ["note", "id", "more"])
    got = S.read_dataset(spark, str(tmp_path), "d")
    assert set(got.columns) == {*HEAD, "more", "year", S.SOURCE_FILE}
    assert sorted(map(tuple, got.filter("year = '2025'").select("id", "text", "note", "more").collect())) == sorted((i, "", n, "extra")[:1] + (None,) + (n, "extra") for i, _, n in rows)
    assert _got(got.filter("year = '2026'")) == sorted(rows)


def test_many_small_files(spark, tmp_path):
    for i in range(400):
        head = ("id", "text") if i % 2 else ("text", "id")
        _write(tmp_path / "d" / f"part={i}" / "f.csv", [(i, i)], head)
    got = S.read_dataset(spark, str(tmp_path), "d")
    assert got.filter("id = text").count() == 400 and got.rdd.getNumPartitions() < 400


def test_edges(spark, tmp_path):
    for name, text in {"empty": "", "head": "a,b\n", "open": 'a,b\n1,"never closed\n2,x\n', "bom": '\ufeffa,b\r\n1,\r\n\r\n2,""', "blank": "a, \n1,2\n", "twice": "a,a\n1,2\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda name: [tuple(r) for r in S.read_dataset(spark, str(tmp_path), name).select("a", "b").collect()]
    assert read("head") == [] and sorted(read("bom")) == [("1", None), ("2", "")]
    assert read("open") == [("1", "never closed\n2,x\n")] or read("open") == [("1", "never closed\n2,x")]
    for name in ("blank", "twice"):
        with pytest.raises(Exception, match="column name"):
            S.read_dataset(spark, str(tmp_path), name).count()
    for name in ("empty", "none"):
        with pytest.raises(FileNotFoundError):
            read(name)


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    block = "".join(f'{i},"two\nlines of text, and ""quotes"" in it {i}",{"w" * 60}\n' for i in range(100_000))
    (tmp_path / "d.csv").write_text("id,text,note\n" + block * 18)
    assert (tmp_path / "d.csv").stat().st_size > 200_000_000
    rows = S.read_dataset(spark, str(tmp_path), "d")
    assert rows.rdd.getNumPartitions() >= 4
    found = rows.agg(F.count("id").alias("n"), F.sum(F.col("id").cast("long")).alias("s"), F.min(F.length("text")).alias("least")).first()
    assert tuple(found) == (1_800_000, 18 * sum(range(100_000)), len('two\nlines of text, and "quotes" in it 0'))


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [
        (b"a,b", False, False), (b"a,b", True, True), (b'a,"b', False, True), (b'b",c', True, False), (b'"a""', False, True),
        (b'a""', True, True), (b'a"",', True, True), (b'5" x', False, False), (b'x","', True, True), (b'"",""', False, False), (b'"', True, False),
        (b'"a"b,"c', False, True),
    ],
)
def test_state_after_a_line(line, inside, after):
    assert R.ends_inside(line, inside) is after
