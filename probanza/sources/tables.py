"""CSV and prediction readers."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probanza.functions import columns as C
from probanza.functions import vocab
from probanza.operators.score import last_record_wins
from probanza.session import side_by_side, written
from probanza.sources import files as L
from probanza.sources import records as R
from probanza.sources.records import RowWidthError

SOURCE_FILE = "__source_file"
PARTITION_COLUMNS = ("year", "month", "day")
# Quotes are doubled inside quoted fields, which may hold line breaks. Spark's own reader does not split such files.
RFC_4180 = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
class CatalogError(RuntimeError):
    """The product catalog cannot be used; nothing may be decided."""


# --- scans ----------------------------------------------------------------------------------------
def read_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header and inferred types; one layout for all files."""
    return spark.read.options(**RFC_4180).option("inferSchema", True).option("recursiveFileLookup", True).csv(path)


def column_names(listing: DataFrame) -> list[str]:
    """Names in the headers of the listed files, each once, by their first place in a header."""
    names = L.file_headers(listing).select(F.posexplode("header").alias("place", "name")).groupBy("name").agg(F.min("place").alias("place"))
    found = [r.name for r in names.orderBy("place", "name").collect()]
    if not found or any(not name.strip() for name in found):
        raise RowWidthError("blank or missing column name in a header")
    return found


def read_dataset(spark: SparkSession, root: str, dataset: str, mode: str = "FAILFAST") -> DataFrame:
    """All-text scan of one dataset below a data root; columns are matched by header name, absent ones NULL.

    Files with differing headers meet in one scan that splits large files. Partition folders become
    text columns that are never part of the file's own width. FAILFAST stops at a row that is too long
    or too short; DROPMALFORMED skips it.
    """
    listing = L.list_files(spark, root).filter(F.col("dataset") == dataset)
    top = F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("top")
    tops = [r.top for r in listing.select(top).distinct().collect()]  # the folder, and a file of that name
    if not tops:
        raise FileNotFoundError(f"no file of {dataset} below {root}")
    everywhere = listing.agg(*(F.bool_and(F.contains("path", F.lit(f"/{p}="))).alias(p) for p in PARTITION_COLUMNS)).first()
    columns = column_names(listing)
    rows = R.scan(spark, [f"{L.plain_root(root)}/{t}" for t in tops], columns, mode, pattern=L.CSV)
    parts = {p: F.url_decode(F.regexp_extract(R.FILE, f"/{p}=([^/]*)", 1)) for p in PARTITION_COLUMNS if everywhere[p]}
    return rows.withColumns(parts).withColumnRenamed(R.FILE, SOURCE_FILE).select(*(f"`{c}`" for c in columns if c not in parts), *parts, SOURCE_FILE)


def read_lenient(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows with their raw text); undecodable bytes are replaced."""
    rows = R.scan(spark, paths, columns, "PERMISSIVE", header=columns)
    bad = F.col(R.MALFORMED).isNotNull()
    malformed = rows.filter(bad).select(F.col(R.MALFORMED).alias("_corrupt_record"), F.col(R.FILE).alias(SOURCE_FILE))
    return rows.filter(~bad).select(*(f"`{c}`" for c in columns)), malformed


def scoped(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted columns, absent ones as NULL text; partition and source columns stay."""
    kept = [c for c in (*PARTITION_COLUMNS, SOURCE_FILE) if c in df.columns and c not in wanted]
    have = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    return df.select(*have, *kept)


def scoped_cache(spark: SparkSession, root: str, datasets: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """Every dataset read once, cut to its scoped columns and written as Parquet for reuse."""
    wanted = datasets or vocab.SCOPED_COLUMNS

    def load(name: str) -> DataFrame:
        return written(scoped(read_dataset(spark, root, name), wanted[name]), f"scoped-{name}", "zstd")

    return dict(zip(wanted, side_by_side(spark, [partial(load, name) for name in wanted])))


# --- samples and widths ---------------------------------------------------------------------------
def with_position(df: DataFrame) -> DataFrame:
    """Mark each row with its file and its place there (block start, then order within the block)."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def prefix_sample(positioned: DataFrame, k: int) -> DataFrame:
    """The first k rows of every file: a sampling operator, which no profile relies on."""
    order = Window.partitionBy("_file").orderBy("_block", "_row")
    return positioned.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)


def long_cells(rows: DataFrame, file: str) -> DataFrame:
    """All cells of a file scan in long form: file, column, value."""
    names = [c for c in rows.columns if c != file]
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))
    return rows.select(F.col(file).alias("file"), F.inline(cells))


def row_widths(spark: SparkSession, root: str) -> DataFrame:
    """(file, width, rows): how many fields the rows of every file below a folder hold."""
    rows = R.scan(spark, L.plain_root(root), [], "PERMISSIVE", pattern=L.CSV)
    return rows.groupBy(F.col(R.FILE).alias("file"), F.col(R.WIDTH).alias("width")).agg(F.count(F.lit(1)).alias("rows"))


def require_one_width(widths: DataFrame) -> None:
    """Stop when any file mixes row widths."""
    mixed = widths.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = [r.file for r in mixed.orderBy("file").limit(20).collect()]
    if names:
        raise RowWidthError(f"rows of differing width in {mixed.count()} files, the first of them: {', '.join(names)}")


# --- decision sources -----------------------------------------------------------------------------
def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The explicit product file as text; missing file, missing column or no rows stop the run."""
    try:
        rows = spark.read.options(**RFC_4180).csv(path)
    except AnalysisException as error:
        raise CatalogError(f"product catalog cannot be read: {path}") from error
    return require_catalog(rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns)))


def require_catalog(products: DataFrame) -> DataFrame:
    missing = [c for c in vocab.CATALOG_COLUMNS if c not in products.columns]
    if missing:
        raise CatalogError(f"product catalog lacks columns: {missing}")
    if products.isEmpty():
        raise CatalogError("product catalog holds no rows")
    return products


def _positioned_records(spark: SparkSession, paths: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Records of several files with their place: file order, block, row."""
    frames = []
    for order, path in enumerate(paths):
        if path.lower().endswith(".jsonl"):
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            rows = spark.read.schema(schema).json(path)
        else:
            rows = spark.read.options(**RFC_4180).csv(path)
        placed = with_position(rows)
        have = [F.col(f"`{c}`").cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
        frames.append(placed.select(*have, F.lit(order).alias("_order"), "_block", "_row"))
    return reduce(DataFrame.unionByName, frames)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from CSV or JSON lines (by suffix); absent columns are '', the last record wins."""
    records = _positioned_records(spark, [path], vocab.PREDICTION_COLUMNS)
    kept = last_record_wins(records, "case_id", ["_order", "_block", "_row"], keep_blank=True)
    return kept.select(*(C.strip(c).alias(c) for c in vocab.PREDICTION_COLUMNS))


def load_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases of several files; a later file or row replaces an earlier one, blank ids are dropped."""
    records = _positioned_records(spark, paths, vocab.CHALLENGE_CASE_COLUMNS)
    return last_record_wins(records, "case_id", ["_order", "_block", "_row"])


def absent_as_null(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """The wanted (name, type) columns, NULL where the table lacks them, so one query fits both."""
    cells: list[Column] = [
        F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(kind).alias(n) for n, kind in wanted
    ]
    return df.select(*cells)
