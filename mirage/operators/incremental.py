"""Resumable runs and upserts.

Every "has this been done?" question is one anti-join against the stored
results instead of a lookup per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.common import keep_first, spread
from mirage.functions.text import inclusion_label, is_failure
from mirage.operators.ordering import GlobalOrder
from mirage.schemas import CODE_CHECK, FUNCTION_MODEL_ID
from mirage.session import stored


def unprocessed(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` without a stored result under ``keys``."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def unanswered(questions: DataFrame, answers: DataFrame, model_id: int,
               qid: str = "id") -> DataFrame:
    """Questions this model has not answered yet."""
    done = answers.where(F.col("model_id") == model_id).select(F.col("question_id").alias(qid))
    return questions.join(done, qid, "left_anti")


def sample_filter(df: DataFrame, samples: DataFrame, name: str, id_col: str = "question_id",
                  check: bool = True) -> DataFrame:
    """P4 + J19: keep rows whose question is in the named sample
    (``samples``: ``sample, question_id``); an unknown name is an error."""
    chosen = samples.where(F.col("sample") == name).select(F.col("question_id").alias(id_col))
    if check and chosen.limit(1).count() == 0:
        raise ValueError(f"Invalid sample size: {name}")
    return df.join(chosen.distinct(), id_col, "left_semi")


EVAL_KEY = ["answer_id", "term_source", "term_id", "model_id", "eval_type_id"]


def not_yet_evaluated(work: DataFrame, evals: DataFrame, judge_model_id: int,
                      kinds: list[int]) -> DataFrame:
    """(answer, term, kind) work items without a stored evaluation of
    that kind by this judge — per kind, so a term judged for acceptance but
    not for meaning is still pending for meaning."""
    items = work.select("*", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("eval_type_id"))
    items = items.withColumn("model_id", F.lit(judge_model_id).cast("long"))
    done = evals.where(F.col("model_id") == judge_model_id).select(
        "answer_id", F.col("term_source").cast("string").alias("term_source"), "term_id",
        "model_id", "eval_type_id")
    items = items.withColumn("term_source", F.col("term_source").cast("string"))
    return items.join(done, EVAL_KEY, "left_anti")


def reconcile_inclusion(stored: DataFrame, long: DataFrame, partitions: int | None = None) -> DataFrame:
    """Compare stored inclusion labels (kind 4) with recomputed ones.

    One row per (answer, term) of ``long`` with ``status`` in
    ``missing | changed | same`` plus old and new labels; ``revised`` applies
    it (changed rows updated, missing rows added). ``partitions`` deals the
    rows over that many tasks before their texts are cleaned."""
    new = spread(long.select("answer_id", "term_source", "term_id", "answer", "term"), partitions).select("answer_id", F.col("term_source").cast("long").alias("term_source"),
                      "term_id", inclusion_label(F.col("answer"), F.col("term")).alias("new_label"))
    old = (stored.where(F.col("eval_type_id") == CODE_CHECK)
                 .groupBy("answer_id", "term_source", "term_id")
                 .agg(F.min("id").alias("eval_id"), F.min("eval_label").alias("old_label")))
    j = new.join(old, ["answer_id", "term_source", "term_id"], "left")
    status = (F.when(F.col("eval_id").isNull(), "missing")
               .when(F.col("old_label") != F.col("new_label"), "changed").otherwise("same"))
    return j.withColumn("status", status)


def reconcile_counts(rec: DataFrame) -> DataFrame:
    """How many labels changed and how many were missing."""
    return rec.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def revised(stored_evals: DataFrame, rec: DataFrame) -> DataFrame:
    """I3 applied: stored rows with changed inclusion labels replaced, plus
    one row for each missing (answer, term). A term that an answer holds
    twice is one term: ``rec`` is brought to one row per (answer, source,
    term) first, and its labels agree as they depend on nothing else. New
    rows get ids after the largest stored one."""
    key = ["answer_id", "term_source", "term_id"]
    one = rec.groupBy(*key).agg(F.min("new_label").alias("_new"), F.min("status").alias("_status"))
    upd = one.where(F.col("_status") == "changed").select(*key, "_new", F.lit(CODE_CHECK).cast("long").alias("eval_type_id"))
    s = stored_evals.join(upd, [*key, "eval_type_id"], "left")
    s = s.withColumn("eval_label", F.coalesce("_new", "eval_label")).drop("_new")
    top = stored_evals.agg(F.max("id")).first()[0] or 0                      # one scalar
    missing = one.where(F.col("_status") == "missing").select(*key, F.col("_new").alias("eval_label"))
    add = GlobalOrder(missing, key).with_position("id", base=top + 1).select(
        "id", "answer_id", "eval_label", F.lit(CODE_CHECK).cast("long").alias("eval_type_id"),
        F.lit("").alias("reflection"), "term_source", "term_id",
        F.lit(FUNCTION_MODEL_ID).cast("long").alias("model_id"))
    return s.select(*stored_evals.columns).unionByName(add.select(*stored_evals.columns))


def model_ids(models: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Get-or-create ids for model names. Known names keep their id; new
    names get the ids after the largest known one, in name order."""
    n = names.select(F.col(name_col).alias("name")).distinct()
    known = n.join(models, "name")
    new = n.join(models.select("name"), "name", "left_anti")
    top = models.agg(F.max("id")).first()[0] or 0          # one scalar
    fresh = GlobalOrder(new, ["name"]).with_position("id", base=top + 1).select("name", "id")
    return known.select("name", F.col("id").cast("long").alias("id")).unionByName(fresh)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """K6: the rows an insert would keep when unique-key conflicts are
    ignored: the first new row per key (by ``order``), minus keys already
    stored. Append the result to the table."""
    first = keep_first(new, key, order)
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def split_failures(answers: DataFrame, answer_col: str = "answer",
                   max_failures: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """I5 + F29: separate failure sentinels from answers. The run is stopped
    (raise) when more than ``max_failures`` exist; ``None`` never stops. The
    answers are stored first, so a model behind them is asked once."""
    answers = stored(answers, "answers")
    bad = answers.where(is_failure(F.col(answer_col)))
    good = answers.where(~is_failure(F.col(answer_col)) | F.col(answer_col).isNull())
    if max_failures is not None:
        n = bad.limit(max_failures + 1).count()
        if n > max_failures:
            raise RuntimeError(f"model failures: more than {max_failures}")
    return good, bad


def run_counts(evals: DataFrame) -> DataFrame:
    """Term evaluations and distinct answers per judge."""
    return evals.groupBy("model_id").agg(F.count(F.lit(1)).alias("evaluations"),
                                         F.count_distinct("answer_id").alias("answers"))
