"""A versioned snapshot of the product catalog for a stream of requests.

The catalog is aggregated per customer once per version and written in buckets of customers; a marker
with its number of customers is written last, so a half-written snapshot is never used. A micro-batch
reads only the buckets of its own customers. As long as the version stays, the catalog is not
read again, not even after a restart. A new version replaces the old one or stops the stream: while it is
missing, broken or empty, nothing is answered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probanza.operators import decide as D
from probanza.sources import files as L
from probanza.sources.tables import CatalogError, require_catalog

BUCKETS = 256


def bucket(customer: str) -> Column:
    return F.pmod(F.xxhash64(F.trim(customer)), F.lit(BUCKETS)).cast("int")


def path_version(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """A digest of names, sizes and times of the files below a path; no file is read."""
    try:
        files = L.list_files(spark, path, pattern)
    except AnalysisException as error:
        raise CatalogError(f"product catalog cannot be listed: {path}") from error
    entry = F.xxhash64("path", "bytes", "modified")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(entry, F.lit(1 << 40))).alias("sum"), F.bit_xor(entry).alias("xor")).first()
    return f"{row.n}-{row.sum}-{row.xor}"


class VersionedCatalog:
    """The per-customer index of the current version of a catalog, kept below ``root``."""

    def __init__(self, spark: SparkSession, load: Callable[[], DataFrame], version: Callable[[], str], root: str):
        self.spark, self.load, self.version, self.root = spark, load, version, root
        self.current: str | None = None
        self.index: DataFrame | None = None

    def refresh(self) -> str:
        """The version in use; a changed one is published first, or nothing can be answered."""
        version = self.version()
        if version != self.current:
            self.current = self.index = None
            path = f"{self.root}/{hashlib.sha256(version.encode()).hexdigest()}"
            if not self._published(path):
                self._publish(path)
            self.index, self.current = self.spark.read.parquet(f"{path}/customers"), version
        return version

    def _published(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(f"{path}/marker").first()["customers"] > 0
        except AnalysisException:
            return False

    def _publish(self, path: str) -> None:
        by_customer = D.catalog_by_customer(require_catalog(self.load())).withColumn("bucket", bucket("customer_id"))
        by_customer.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/customers")
        try:
            written = self.spark.read.parquet(f"{path}/customers").agg(F.count(F.lit(1)).alias("customers"))
        except AnalysisException as error:  # no customer has a product of a decided type
            raise CatalogError("product catalog holds no product that requests can name") from error
        written.write.mode("overwrite").parquet(f"{path}/marker")

    def of(self, requests: DataFrame) -> DataFrame:
        """The index of the buckets that the requests' customers fall into."""
        wanted = [r.bucket for r in requests.select(bucket("customer_id").alias("bucket")).distinct().collect()]  # at most BUCKETS
        return self.index.filter(F.col("bucket").isin([b for b in wanted if b is not None])).drop("bucket")
