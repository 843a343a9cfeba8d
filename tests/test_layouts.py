"""Tables in folders of part files, CSV trees in gzip and ranges of mixed files, as larger inputs have them; what a pass leaves on disk."""

import csv
import gzip
import hashlib
import shutil
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from probanza.sources import files as L
from probanza.sources import records as R
from probanza.sources import tables as S
from probanza.streaming import catalog as K
from suite import sources
from suite.check import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest scale; the tables of the stream lie in several part files each."""
    root = tmp_path_factory.mktemp("parts")
    for name, files in (("conversations", 5), ("orders", 3)):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(files).write.parquet(f"{root}/{name}.parquet")
    return root


def test_stream_over_part_files(spark, parts):
    query = entry.queries()["c10_request_stream"]
    one, several = query(spark, FOLDER), query(spark, str(parts))
    want = rows_of(one.columns, one.collect())
    assert want and rows_of(several.columns, several.collect()) == want


def test_version_of_part_files(spark, parts, tmp_path):
    table = tmp_path / "orders.parquet"
    shutil.copytree(parts / "orders.parquet", table)
    before = K.path_version(spark, str(table))
    spark.read.parquet(f"{FOLDER}/orders.parquet").limit(1).write.mode("append").parquet(str(table))
    assert K.path_version(spark, str(table)) != before
    single = K.path_version(spark, f"{FOLDER}/orders.parquet")
    assert single.startswith("1-") and single == K.path_version(spark, f"file://{FOLDER}/orders.parquet")


def test_ranges_agree_beside_small_files(spark, tmp_path):
    """A record that ranges cut in two is joined as well where small files share the scan."""
    want = [(str(i), f"line {i}\n{'x' * (i % 90)}\n\"quoted\", end") for i in range(900)]
    with (tmp_path / "large.csv").open("w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([("id", "note"), *want])
    for i in range(20):
        (tmp_path / f"small{i}.csv").write_text(f"id,note\ns{i},n\n")
        want.append((f"s{i}", "n"))
    key = "spark.sql.files.openCostInBytes"
    spark.conf.set(key, "1k")
    try:
        got = R.scan(spark, str(tmp_path), ["id", "note"]).select("id", "note").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, got)) == sorted(want)


def test_dataset_in_gzip(spark, tmp_path):
    texts = {"customers/a.csv.gz": 'id,note\n1,"two\nlines, ""q"""\n2,\n', "customers/b.csv": "note,id\nplain,3\n", "branches.csv.gz": "id\nB1\n"}
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    rows = S.read_dataset(spark, str(tmp_path), "customers").select("id", "note").collect()
    assert sorted(map(tuple, rows)) == [("1", 'two\nlines, "q"'), ("2", None), ("3", "plain")]
    assert [r.id for r in S.read_dataset(spark, str(tmp_path), "branches").collect()] == ["B1"]
    hashed = {r.relative_path: r.sha256 for r in L.content_hashes(spark, str(tmp_path)).collect()}
    assert hashed == {name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in texts}


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_evidence_pass_keeps_little_on_disk(spark):
    root = L.plain_root(sources.scoped_tree(spark, FOLDER))
    text = spark.read.option("recursiveFileLookup", True).text(root).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    stored = L.list_files(spark, root, "*.csv*").agg(F.sum("bytes")).first()[0]
    assert stored * 2.5 < text
    before = _shuffle_files(spark)
    frame = entry.queries()["s23_evidence_from_files"](spark, FOLDER)
    for _ in range(20):  # files go a little after their query
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and frame.count() == 15
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
