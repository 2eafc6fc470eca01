"""Stored pages, clustered for lookups by id and by title.

``write_pages`` lays pages out twice: whole pages by ranges of ids, and the
title's definition by the hash of its collation key, which is equal for titles
that differ in case or accents only. A lookup first finds which folders of the
store its ids or titles fall into - a list no longer than the store has
folders - and reads these alone, whichever way Spark then joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.functions.text import definition_from_paragraphs
from mirage.operators.terms import ci_ai

#: Ids in a folder, and folders by title.
PER_PART, BUCKETS = 100_000, 64


def _by_title(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """``rows`` with ``bucket``: where Spark's own hash partitioning by the
    collation key puts them, the same for equal keys in every job."""
    return rows.repartition(buckets, ci_ai(column)).withColumn("bucket", F.spark_partition_id())


def _only(stored: DataFrame, folder: str, asked: DataFrame) -> DataFrame:
    """The rows of ``stored`` in the folders that ``asked`` names."""
    return stored.where(F.col(folder).isin([r[0] for r in asked.select(folder).distinct().collect()]))


def write_pages(pages: DataFrame, path: str, per_part: int = PER_PART, buckets: int = BUCKETS) -> "PageStore":
    """Store ``pages`` (_id, wikipedia_title, text). Pages without an id or a
    title are not found by it."""
    spark = pages.sparkSession
    part = F.floor(F.col("_id") / F.lit(per_part)).cast("long")
    whole = pages.where(F.col("_id").isNotNull()).withColumn("part", part)
    whole.repartition("part").sortWithinPartitions("part", "_id").write.partitionBy("part").parquet(f"{path}/by_id")
    titled = pages.where(F.col("wikipedia_title").isNotNull()).select(
        "_id", "wikipedia_title", definition_from_paragraphs(F.col("text")).alias("definition"))
    _by_title(titled, "wikipedia_title", buckets).write.partitionBy("bucket").parquet(f"{path}/by_title")
    spark.read.schema("_id long, part long").parquet(f"{path}/by_id").select("part").distinct().write.parquet(f"{path}/parts")
    spark.createDataFrame([(per_part, buckets)], "per_part long, buckets int").write.parquet(f"{path}/layout")
    return PageStore(spark, path)


class PageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.per_part, self.buckets = spark.read.parquet(f"{path}/layout").first()
        whole = "_id long, wikipedia_title string, text array<string>, part long"
        self.pages = spark.read.schema(whole).parquet(f"{path}/by_id")
        self.parts = spark.read.schema("part long").parquet(f"{path}/parts")
        self.titles = spark.read.schema("_id long, wikipedia_title string, definition string, bucket int").parquet(f"{path}/by_title")

    def by_id(self, ids: DataFrame, id_col: str = "_id") -> DataFrame:
        """The pages with these ids (each asked once)."""
        part = F.floor(F.col("_id") / F.lit(self.per_part)).cast("long")
        asked = ids.select(F.col(id_col).cast("long").alias("_id")).distinct().withColumn("part", part)
        return asked.join(_only(self.pages, "part", asked.join(self.parts, "part", "left_semi")), ["part", "_id"]).drop("part")

    def by_title(self, terms: DataFrame, term_col: str = "term") -> DataFrame:
        """J12 + F12: as ``terms.lookup_by_title``, from the store."""
        t = terms.select(F.col(term_col).alias("term")).distinct()
        asked = _by_title(t.where(F.col("term").isNotNull()), "term", self.buckets)
        hits = asked.alias("a").join(_only(self.titles, "bucket", asked).alias("p"), (F.col("a.bucket") == F.col("p.bucket")) & (ci_ai("a.term") == ci_ai("p.wikipedia_title")))
        best = hits.groupBy("term").agg(F.min(F.struct("_id", "definition")).alias("_p"))
        return t.join(best, "term", "left").select("term", F.col("_p._id").alias("page_id"),
                                                   F.coalesce(F.col("_p.definition"), F.lit("None")).alias("definition"))
