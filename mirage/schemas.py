"""Schemas of the pipeline tables and the fixed lookup rows.

Ids are BIGINT throughout; label and kind codes are small integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference data for right results).
# ---------------------------------------------------------------------------
# Term sources: 0 hypothetical, 1 gpt_suggestion, 2 title_similarity, 3 text_similarity
TERM_SOURCES = [(0, "hypothetical"), (1, "gpt_suggestion"), (2, "title_similarity"),
                (3, "text_similarity")]
# Replacement types: 0 none, 1 programmatic, 2 gold_answer, 3 fresh
REPLACEMENT_TYPES = [(0, "none"), (1, "programmatic"), (2, "gold_answer"), (3, "fresh")]
# Evaluation kinds (table names win over the in-code names)
EVAL_SOURCES = [(1, "HumanEval"), (2, "certainty reflection"), (3, "definition reflection"),
                (4, "code_check")]
# Models: 0 is the human evaluator, 10 the inclusion check ("function")
MODELS = [(0, "Human"), (1, "gpt-3.5-turbo"), (2, "llama2:7b-chat-q4_1"),
          (3, "ChatGPT_August_3_2023"), (4, "orca-mini:3b-q4_1"), (5, "orca-mini:7b-q4_1"),
          (6, "llama2:13b-chat-q4_K_M"), (7, "llama2:70b-chat-q4_K_M"),
          (8, "llama2:70b-chat-q4_1"), (9, "llama2:13b-chat-q4_1"), (10, "function")]
# Labels: 0 valid, 1 hallucination, 2 irrelevant
EVAL_NAMES = [(0, "valid"), (1, "hallucination"), (2, "irrelevant")]
# Tags removed (in this order) when shortening model names; then ':' -> '_'
MODEL_NAME_TAGS = ["-chat-q4_K_M", "-chat-q4_1", "-q4_1", "_August_3_2023", "-1106-preview",
                   "-turbo"]
# Sentinels written by a failed model call
FAILURE_SENTINELS = ["WARNING! Model failure.", "WARNING! Timeout."]
# Prefix added to a judge reply that could not be parsed
PARSE_FAILURE_PREFIX = "WARNING: Failed to parse response: "
# ---------------------------------------------------------------------------

VALID, HALLUCINATION, IRRELEVANT = 0, 1, 2
HUMAN_EVAL, ACCEPTANCE, DEFINITION, CODE_CHECK = 1, 2, 3, 4
HUMAN_MODEL_ID, FUNCTION_MODEL_ID = 0, 10
NO_REPLACEMENT, PROGRAMMATIC, GOLD_ANSWER, FRESH = 0, 1, 2, 3

LOOKUP_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                              T.StructField("name", T.StringType(), False)])


def lookup(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """A fixed id → name table. Its size is bounded by construction, so joins
    against it may broadcast it."""
    return spark.createDataFrame(rows, LOOKUP_SCHEMA)


TERM_STRUCT = T.StructType([
    T.StructField("termId", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("termSet", T.StringType()),
    T.StructField("termSetId", T.LongType()),
    T.StructField("explanation", T.StringType()),
])

QUESTION_FILE_SCHEMA = T.StructType([
    T.StructField("questionId", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("terms", T.ArrayType(TERM_STRUCT)),
])

# Column names of the input and report files.
WIDE_ANSWER_COLUMNS = ["answer_id", "answer", "question_id", "question", "nonexistent_id",
                       "nonexistent", "secondary_id", "secondary", "secondary_meaning",
                       "secondary_source", "replacement_id", "replacement",
                       "replacement_meaning", "replacement_source"]

SHORT_ANSWER_COLUMNS = ["answer_id", "answer", "question_id", "question", "terms"]

TRIPLET_INPUT_COLUMNS = ["fake_term_id", "fake_term", "fake_term_explanation", "topic",
                         "topic_explanation", "source_id", "real_term_id", "real_term",
                         "real_term_explanation"]

#: What question generation needs of the combined triplet view.
TRIPLET_VIEW_COLUMNS = ["term_triplet_id", "nonexistent_id", "nonexistent_term",
                        "nonexistent_explanation", "secondary_id", "secondary_term",
                        "secondary_source_id", "secondary_explanation", "replacement_id",
                        "replacement_term", "replacement_source_id", "replacement_explanation",
                        "topic", "topic_explanation"]

REPORT_DETAIL_COLUMNS = ["answer_source", "question_id", "answer_id", "question", "answer",
                         "isHypotheticalQuestion", "evaluator_model", "eval_id", "eval_type",
                         "term_label_id", "term_label", "term", "term_id",
                         "IsHypotheticalTerm", "term_source", "reflection",
                         "answer_label_id", "answer_label"]

WIKI_PAGE_SCHEMA = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("wikipedia_title", T.StringType()),
    T.StructField("text", T.ArrayType(T.StringType())),
])


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """Raise naming the missing columns (column-set checks of the pipeline)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
