"""A training corpus from ``documents``: quality, duplicates, mix, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and calls one operator of
``mirage.llm``; its result is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``: those
that the operator doesn't read travel as one struct, so columns may have any
names. A choice among rows that repeat an id and a text
goes by the hash of the whole row, so a task that runs again chooses alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirage.llm import mixing, quality, queries
from mirage.llm.common import materialise, table
from mirage.llm.exact_dedup import exact_dedup
from mirage.llm.ngram_join import near_dedup


def carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns ``read``, and all others as one."""
    others = [c for c in docs.columns if c not in read]
    return docs.select(*read, (F.struct(*others) if others else F.lit(0)).alias("_carry"))


def rows_of(got: DataFrame, docs: DataFrame, *read: str, **own) -> DataFrame:
    """Those columns again; ``own`` replaces some."""
    return got.select(*[own.get(c, F.col(c) if c in read else F.col("_carry")[c]).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above junk is at least a half."""
    rows = queries.rated(spark, carried(docs, "doc_id", "text"), sf_dir)
    return rows_of(rows.where(quality.keeps(1, queries.QUALITY_TAIL)), docs, "doc_id", "text")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, once."""
    rows = exact_dedup(carried(docs, "doc_id", "text")).where("kept")
    # Rows that repeat id and text are kept together by the operator. Only
    # where an id repeats at all is it worth a second shuffle of the texts.
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id", "text_sha256").orderBy(F.xxhash64("_carry", "text"), F.to_json(F.struct("_carry", "text")))
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows_of(rows, docs, "doc_id", "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, once."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt by the mix's weights, each document at
    most once; a leaf's last document may be cut."""
    rows = mixing.mix_sources(carried(docs, "doc_id", "text", "lang", "source"), queries.domain(), queries.WEIGHTS, share=0.9, epochs=1)
    rows = rows.withColumn("_text", mixing.taken_text())
    return rows_of(rows, docs, "doc_id", "lang", "source", text=F.col("_text"), n_chars=F.length("_text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return queries.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written in between."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k + 1}")
    return docs
