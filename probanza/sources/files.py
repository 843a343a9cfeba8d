"""File listings as DataFrames. Listings hold one row per file and never the contents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from probanza.functions import columns as C
from probanza.functions import vocab

#: CSV files, plain or compressed as a whole.
CSV = "{*.csv,*.csv.gz}"


def plain_root(root: str) -> str:
    """A folder without the ``file:`` scheme and without a closing slash."""
    return root.removeprefix("file://").removeprefix("file:").rstrip("/")


def list_files(spark: SparkSession, root: str, pattern: str = CSV) -> DataFrame:
    """(dataset, relative_path, partition, partition_date, bytes, path) of every file below a folder.

    The dataset is the first folder below the root, or the stem of a file that lies in the root.
    """
    root = plain_root(root)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    relative = F.col("path").substr(F.locate(root, F.col("path")) + len(root) + 1, F.length("path"))
    parts = F.split("relative_path", "/")
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: s.contains("="))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(\.csv\.gz|\.[^.]*)$", "")
    return found.withColumn("relative_path", relative).select(
        F.when(F.size(parts) > 1, parts[0]).otherwise(stem).alias("dataset"),
        "relative_path",
        F.array_join(folders, "/").alias("partition"),
        C.partition_date("relative_path").alias("partition_date"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        "path",
    )


def dataset_files(listing: DataFrame) -> DataFrame:
    """Files, bytes, and partition coverage per dataset."""
    return listing.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("partition_date").alias("partition_dates"),
        F.min("partition_date").alias("first_partition"),
        F.max("partition_date").alias("last_partition"),
        F.min("relative_path").alias("first_path"),
        F.max("relative_path").alias("last_path"),
    )


def tree_profile(listing: DataFrame) -> DataFrame:
    """Totals, size bands, extensions and files that lack a partition level, in one row."""
    extension = F.lower(F.regexp_extract("relative_path", r"(\.[^./]*)$", 1))
    levels = F.size(F.split("partition", "/"))
    partitioned = F.col("partition") != ""
    return listing.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("dataset").alias("datasets"),
        F.count_distinct(extension).alias("extensions"),
        C.count_where(F.col("bytes") == 0).alias("zero_byte_files"),
        C.count_where(F.col("bytes") < 1024).alias("files_below_1kb"),
        C.count_where(F.col("bytes") > 100 * 1024 * 1024).alias("files_above_100mb"),
        C.count_where(partitioned & (levels < 3)).alias("files_missing_a_partition_level"),
    )


def largest(listing: DataFrame, by: str, k: int = 20) -> DataFrame:
    """The k largest files (``relative_path``) or datasets (``dataset``) by bytes."""
    sizes = listing.groupBy(by).agg(F.sum("bytes").alias("bytes"))
    return sizes.orderBy(F.desc("bytes"), F.asc(by)).limit(k)


def duplicate_basenames(listing: DataFrame) -> DataFrame:
    """File names that occur in more than one folder."""
    name = F.element_at(F.split("relative_path", "/"), -1).alias("name")
    return listing.groupBy(name).agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def extension_counts(listing: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("relative_path", r"(\.[^./]*)$", 1)).alias("extension")
    return listing.groupBy(extension).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def input_fingerprint(listing: DataFrame, separator: str = "") -> DataFrame:
    """One SHA-256 over the relative paths and sizes of all files in path order.

    Works on the listing alone, which the session's file index holds anyway.
    """
    entry = F.struct("relative_path", F.concat_ws(separator, "relative_path", F.col("bytes").cast("string")).alias("e"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["e"])
    return listing.agg(F.sha2(F.concat_ws("", ordered), 256).alias("input_fingerprint"))


def content_hashes(spark: SparkSession, root: str, pattern: str = CSV) -> DataFrame:
    """SHA-256 of the content of every file, read in blocks on the executors."""
    listing = list_files(spark, root, pattern).select("path", "relative_path", "bytes")
    spread = listing.select("path").repartition("path")
    hashed = spread.mapInPandas(_hash_contents, "path string, sha256 string")
    return listing.join(hashed, "path").drop("path")


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Name, path and bytes of the data files below an output folder."""
    listed = list_files(spark, root, "*")
    name = F.element_at(F.split("relative_path", "/"), -1)
    return listed.filter(~name.startswith("_") & ~name.startswith(".")).select(
        F.col("dataset").alias("artifact"), name.alias("file"), F.col("relative_path").alias("path"), "bytes"
    )


def representative_files(listing: DataFrame) -> DataFrame:
    """First, middle and last file of every dataset in partition order."""
    parts = [F.coalesce(C.partition_part("relative_path", n, d), F.lit(0)) for n, d in (("year", 4), ("month", 2), ("day", 2))]
    order = Window.partitionBy("dataset").orderBy(*parts, F.col("relative_path"))
    totals = listing.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"))
    placed = listing.select("*", F.row_number().over(order).cast("bigint").alias("place")).join(totals, "dataset")
    middle = F.floor(F.col("files") / 2) + 1
    return placed.filter((F.col("place") == 1) | (F.col("place") == middle) | (F.col("place") == F.col("files")))


def require_three_files(chosen: DataFrame, static: tuple[str, ...] = vocab.STATIC_DATASETS) -> None:
    """A partitioned dataset must offer three files to choose from."""
    short = chosen.filter(~F.col("dataset").isin(*static) & (F.col("files") < 3)).select("dataset").distinct()
    names = [r.dataset for r in short.orderBy("dataset").limit(20).collect()]
    if names:
        raise ValueError(f"fewer than three files in {short.count()} datasets, the first of them: {', '.join(names)}")


def capped_files(listing: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files per dataset in path order, and whether files were left out."""
    order = Window.partitionBy("dataset").orderBy("relative_path")
    totals = listing.groupBy("dataset").agg(F.count(F.lit(1)).alias("available_files"))
    placed = listing.select("*", F.row_number().over(order).cast("bigint").alias("place")).join(totals, "dataset")
    return placed.filter(F.col("place") <= cap).withColumn("rows_are_sampled", F.col("available_files") > cap)


# --- reading files by path ------------------------------------------------------------------------
def _open(path: str, compression: str | None = "detect"):
    """Input stream of a listed file; a compressed one is read as its text unless ``compression`` is None."""
    from pyarrow import fs

    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    filesystem, name = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_stream(name, compression=compression)


def _hash_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _open(path, None) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests})


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First CSV record of every listed file; only the start of each file is read."""
    import csv
    import io

    for batch in batches:
        headers = []
        for path in batch["path"]:
            text = b""
            with _open(path) as stream:
                while text.count(b'"') % 2 or b"\n" not in text:
                    block = stream.read(1 << 16)
                    if not block:
                        break
                    text += block
            headers.append(next(csv.reader(io.StringIO(text.decode("utf-8-sig", errors="replace"))), []))
        yield pd.DataFrame({"path": batch["path"], "header": headers})


def file_headers(listing: DataFrame) -> DataFrame:
    """(path, header) of every listed file, read in parallel on the executors."""
    spread = listing.select("path").repartition("path")
    return spread.mapInPandas(_read_headers, "path string, header array<string>")


def header_drift(listing: DataFrame) -> DataFrame:
    """Per dataset: columns in all and in only some files, differing headers, drift."""
    headers = listing.select("dataset", "path").join(file_headers(listing), "path")
    per_dataset = headers.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("header").alias("headers")
    )
    columns = headers.select("dataset", F.explode("header").alias("column_name")).groupBy("dataset", "column_name").agg(
        F.count(F.lit(1)).alias("present_in")
    )
    joined = columns.join(per_dataset, "dataset")
    everywhere = F.col("present_in") == F.col("files")
    return joined.groupBy("dataset", "files", "headers").agg(
        C.count_where(everywhere).alias("columns_in_all_files"),
        C.count_where(~everywhere).alias("columns_in_some_files"),
    ).select(
        "*",
        (F.col("headers") > 1).alias("header_inconsistency"),
        ((F.col("headers") > 1) | (F.col("columns_in_some_files") > 0)).alias("schema_drift"),
    )


def metadata_path() -> Column:
    """Path of the file a row came from."""
    return F.col("_metadata.file_path")
