"""Reports over answer labels.

A7 label distribution (percent per label for all / hypothetical / valid
questions), A8 score, W5 stacked-bar totals, A9 nested per-question detail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirage.functions.common import pct_half_even
from mirage.schemas import EVAL_NAMES

CATEGORY_ORDER = [name for _, name in EVAL_NAMES]  # valid < hallucination < irrelevant
COHORTS = ["all_questions", "hypothetical_questions", "valid_questions"]


def label_distribution(answer_level: DataFrame,
                       group_cols: list[str] = ("evaluator_model", "answer_source"),
                       label_col: str = "answer_label",
                       hyp_col: str = "isHypotheticalQuestion") -> DataFrame:
    """One row per group × label (all three labels always present).

    Rows whose label is not one of the three names leave the denominator, as
    with an ordered categorical. One aggregation computes all three cohorts;
    the label spine is an ``explode`` of a literal array per group.
    """
    group_cols = list(group_cols)
    rows = answer_level.where(F.col(label_col).isin(CATEGORY_ORDER))
    hyp = F.col(hyp_col)
    counts = rows.groupBy(*group_cols, label_col).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(hyp == F.lit(True)).alias("n_hyp"),
        F.count_if(hyp == F.lit(False)).alias("n_valid"))
    totals = counts.groupBy(*group_cols).agg(
        F.sum("n_all").alias("t_all"), F.sum("n_hyp").alias("t_hyp"),
        F.sum("n_valid").alias("t_valid"))
    order = F.array(*[F.struct(F.lit(i).alias("label_order"), F.lit(n).alias(label_col))
                      for i, n in enumerate(CATEGORY_ORDER)])
    spine = totals.select("*", F.explode(order).alias("_l")).select(
        *group_cols, "t_all", "t_hyp", "t_valid", "_l.label_order", f"_l.{label_col}")
    j = spine.join(counts, [*group_cols, label_col], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(*group_cols, label_col, "label_order",
                    pct_half_even(z("n_all"), F.col("t_all")).alias("all_questions"),
                    pct_half_even(z("n_hyp"), F.col("t_hyp")).alias("hypothetical_questions"),
                    pct_half_even(z("n_valid"), F.col("t_valid")).alias("valid_questions"))


def score(distribution: DataFrame, group_cols: list[str] = ("evaluator_model", "answer_source"),
          label_col: str = "answer_label") -> DataFrame:
    """The share of valid answers among hypothetical questions."""
    return (distribution.where(F.col(label_col) == "valid")
                        .select(*group_cols, F.col("hypothetical_questions").alias("score")))


def stacked_totals(distribution: DataFrame,
                   group_cols: list[str] = ("evaluator_model", "answer_source"),
                   label_col: str = "answer_label", font_size: float = 24.0) -> DataFrame:
    """Bar geometry of the stacked chart. For each cohort, the bar of a
    label starts at the cohort total minus the labels before it (a running
    sum from the current label to the last), and its text sits at
    ``max((top + bottom - font/2) / 2, bottom)``. Drawing is not done."""
    group_cols = list(group_cols)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("cohort"), F.col(c).alias("value"))
                                for c in COHORTS])).alias("_c")
    long = distribution.select(*group_cols, label_col, "label_order", stack).select(
        *group_cols, label_col, "label_order", "_c.cohort", "_c.value")
    w = (Window.partitionBy(*group_cols, "cohort").orderBy("label_order")
               .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    top = F.sum("value").over(w)
    bottom = top - F.col("value")
    return long.select(*group_cols, "cohort", label_col, "label_order", "value",
                       top.alias("bar_top"),
                       F.greatest((top + bottom - F.lit(font_size / 2)) / 2, bottom)
                        .alias("text_position"))


QUESTION_FIELDS = ["question_id", "answer_id", "question", "answer", "answer_label",
                   "isHypotheticalQuestion", "evaluator_model"]
EVAL_FIELDS = ["eval_id", "eval_type", "term_label", "term", "term_id", "IsHypotheticalTerm",
               "term_source", "reflection"]


def nested_rows(detail: DataFrame) -> DataFrame:
    """A9 without its JSON: one row per (answer source, question) holding the
    question fields of its first row (lowest eval id), as far as ``detail``
    has them, and the evaluations ordered by eval id. The question is the
    group's own column, so rows that lie by question are not shuffled."""
    fields = [c for c in QUESTION_FIELDS if c in detail.columns and c != "question_id"]
    ev = F.struct(*[F.col(c) for c in EVAL_FIELDS])
    head = F.struct(F.col("eval_id"), *[F.col(c) for c in fields])
    g = detail.groupBy("answer_source", "question_id").agg(
        F.min(head).alias("_h"), F.sort_array(F.collect_list(ev)).alias("evaluations"))
    return g.select("answer_source", "question_id", *[F.col(f"_h.{c}").alias(c) for c in fields], "evaluations")


def with_json(nested: DataFrame) -> DataFrame:
    return nested.select("answer_source", *QUESTION_FIELDS, "evaluations").withColumn(
        "json", F.to_json(F.struct(*[F.col(c) for c in QUESTION_FIELDS], "evaluations")))


def nested_report(detail: DataFrame) -> DataFrame:
    """``nested_rows`` and the same record as a JSON string.

    A row holds a whole question, as long as its evaluations are. Where a
    question may have very many of them, ``report_lines`` gives the same
    document line by line."""
    return with_json(nested_rows(detail))


def report_lines(detail: DataFrame) -> DataFrame:
    """A9 as lines of text: (answer_source, question_id, line_no, line). The
    lines of a question, in order, are its JSON document: the question fields
    of its first evaluation, a line for each evaluation by eval id, and the
    closing ``]}``. A sorted run is streamed: no question is collected, so
    one with a million evaluations takes no more memory than any other."""
    run = Window.partitionBy("answer_source", "question_id").orderBy(*[F.col(c).asc_nulls_first() for c in EVAL_FIELDS])
    n = F.row_number().over(run).cast("long")
    rows = detail.select("answer_source", *QUESTION_FIELDS, *EVAL_FIELDS, n.alias("_n"), F.lead(F.lit(1)).over(run).isNull().alias("_last"))
    head = F.to_json(F.struct(*QUESTION_FIELDS))
    start = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.when(F.length(head) > 2, F.lit(",")).otherwise(""), F.lit('"evaluations":['))
    line = lambda number, text: F.struct(number.cast("long").alias("line_no"), text.alias("line"))
    body = line(F.col("_n"), F.concat(F.to_json(F.struct(*EVAL_FIELDS)), F.when(F.col("_last"), "").otherwise(",")))
    lines = F.concat(F.when(F.col("_n") == 1, F.array(line(F.lit(0), start))).otherwise(F.array()), F.array(body),
                     F.when(F.col("_last"), F.array(line(F.col("_n") + 1, F.lit("]}")))).otherwise(F.array()))
    return rows.select("answer_source", "question_id", F.explode(lines).alias("_l")).select("answer_source", "question_id", "_l.line_no", "_l.line")


def for_judge_and_model(df: DataFrame, evaluator_model: str, model_under_test: str,
                        include_function: bool = True) -> DataFrame:
    """Rows of one judge (and of the inclusion check, named ``function``)
    for one answering model."""
    judges = [evaluator_model] + (["function"] if include_function else [])
    return df.where(F.col("evaluator_model").isin(judges)
                    & (F.col("answer_source") == model_under_test))


def require_report_columns(detail: DataFrame) -> DataFrame:
    """The nested report needs these columns; names the missing ones."""
    from mirage.schemas import REPORT_DETAIL_COLUMNS, require_columns
    require_columns(detail, REPORT_DETAIL_COLUMNS, "report detail")
    return detail


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(col).distinct().orderBy(col)
