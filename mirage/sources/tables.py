"""Access to the input tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

#: Schemas of the tables that this application has opened, by path: a table's
#: footers are read once, not once per handle.
_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan ``{base}/{name}.parquet``; projections and filters applied later
    are pushed into this scan by Catalyst."""
    path = f"{base.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


class Tables:
    """Lazy table handles for one data folder: ``Tables(spark, d).lineitem``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        handle = read_table(self.spark, self.base, name)
        setattr(self, name, handle)      # one handle a table: scans can be reused
        return handle


def save_table(df: DataFrame, name: str, path: str, by: str | None = None, buckets: int = 32) -> None:
    """Store ``df`` as a catalog table at ``path``. With ``by`` it is bucketed
    and sorted by that column: tables with the same number of buckets join on
    it without a shuffle. Rows are dealt by the same hash first, so a bucket is
    one file."""
    rows = df.repartition(buckets, by) if by else df
    w = rows.write.mode("overwrite").option("path", path)
    if by:
        w = w.bucketBy(buckets, by).sortBy(by)
    w.saveAsTable(name)


def scan_table(spark: SparkSession, name: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A table or view of the catalog by name; columns and condition are
    pushed into the scan."""
    rows = spark.table(name)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows
