"""File sources (S1-S6, S9, S10). Every reader takes an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.schemas import QUESTION_FILE_SCHEMA


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",",
             encoding: str | None = None, header: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header; quoted fields may span lines
    (answers hold newlines). ``encoding='ISO-8859-1'`` reads Latin-1 files,
    ``sep='\\t'`` tab-separated ones. A file whose fields may span lines is
    read by one task; ``multi_line=False``, for fields that hold no line
    breaks, reads a large file in splits."""
    r = (spark.read.schema(schema).option("header", header).option("multiLine", multi_line)
         .option("escape", '"').option("sep", sep))
    if encoding:
        r = r.option("encoding", encoding)
    return r.csv(path)


def read_question_file(spark: SparkSession, path: str) -> DataFrame:
    """Question file in JSON lines, ``questionId`` renamed."""
    return spark.read.schema(QUESTION_FILE_SCHEMA).json(path) \
                .withColumnRenamed("questionId", "question_id")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``name: explanation`` strings → ``(pos, topic)``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "topic"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of sample name → question ids →
    ``(sample, question_id)``."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", "map<string,array<bigint>>"))
                   .alias("sample", "ids"))
    return m.select("sample", F.explode("ids").alias("question_id"))


def read_pages(spark: SparkSession, path: str, fmt: str = "json",
               columns: tuple[str, ...] = ("_id", "wikipedia_title", "text")) -> DataFrame:
    """Wiki pages with only the needed fields (the reader prunes the
    rest; input splits replace cursor chunks)."""
    from mirage.schemas import WIKI_PAGE_SCHEMA
    r = spark.read.schema(WIKI_PAGE_SCHEMA) if fmt == "json" else spark.read
    return r.format(fmt).load(path).select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict) -> DataFrame:
    """S7 for a live database: the built-in JDBC source (filters on the
    result are pushed into the database query)."""
    return spark.read.jdbc(url, table, properties=properties)
