"""Answer labels from term-level evaluations.

A1  severity fold: any hallucination → 1, else any irrelevant → 2, else valid.
A2  table mode: per judge, per answer that judge evaluated, fold that judge's
    rows together with the answer's inclusion-check rows (model 10).
A3  file mode: lowest model id only, labels joined back onto the term rows.
A4  per answer × judge label of the judge kinds (grouped view).
A5  inclusion fold per (answer, term).
A6  merge of A4 and A5 (labelled view, one row per term × judge).
A10 keep-first dedupe of evaluations; A11 keep-first dedupe of report rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirage.functions.common import keep_first
from mirage.schemas import EVAL_NAMES, FUNCTION_MODEL_ID, HUMAN_MODEL_ID, CODE_CHECK

EVAL_KEY = ["answer_id", "eval_type_id", "term_source", "term_id", "model_id"]


def severity(label: Column) -> Column:
    """A1 as an orderable code: hallucination 2 > irrelevant 1 > anything else 0."""
    return F.when(label == 1, 2).when(label == 2, 1).otherwise(0)


def label_from_severity(sev: Column) -> Column:
    return F.when(sev == 2, 1).when(sev == 1, 2).otherwise(0).cast("long")


def label_name(code: Column) -> Column:
    """label code → name, as a literal map (no join)."""
    m = F.create_map(*[x for k, v in EVAL_NAMES for x in (F.lit(k), F.lit(v))])
    return m[code]


def dedupe_evals(evals: DataFrame) -> DataFrame:
    """A10: keep the first evaluation (lowest ``id``) per five-part key."""
    return keep_first(evals, EVAL_KEY, ["id"])


def first_rank() -> Column:
    """A10 as one number to take the minimum of over ``EVAL_KEY``: rows order
    by id, then label (missing ones first), as ``dedupe_evals`` orders them.
    A numeric buffer, so the fold is a hash aggregate with map-side combine."""
    ident = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).cast("decimal(20,0)")
    label = F.col("eval_label")
    place = F.when(label == 1, 1).when(label == 2, 2).when(label > 2, 3).otherwise(0)
    return F.min(ident * 4 + place)


def first_severity(rank: Column) -> Column:
    """A1 of the row that ``first_rank`` found."""
    place = F.pmod(rank, F.lit(4).cast("decimal(20,0)")).cast("int")
    return F.when(place == 1, 2).when(place == 2, 1).otherwise(0)


def is_judge(model: Column) -> Column:
    return ~model.isin(HUMAN_MODEL_ID, FUNCTION_MODEL_ID)


def judge_label(severity_of_judge: Column, severity_of_code: Column) -> Column:
    return label_from_severity(F.greatest(severity_of_judge, F.coalesce(severity_of_code, F.lit(0))))


def answer_severities(evals: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row per answer: ``judges``, an array of (judge, sev) of the models
    that judged it, and ``code``, the severity of its inclusion rows (null
    without any). Three aggregations of one scan, each combined before its
    shuffle: per evaluation key, per (answer, model), per answer; the array is
    as long as there are models."""
    rows = evals.select(*EVAL_KEY, "id", "eval_label") if dedupe else evals
    if dedupe:
        rows = rows.groupBy(*EVAL_KEY).agg(first_rank().alias("rank")).select(
            "answer_id", "model_id", first_severity(F.col("rank")).alias("sev"))
    else:
        rows = rows.select("answer_id", "model_id", severity(F.col("eval_label")).alias("sev"))
    each = rows.groupBy("answer_id", "model_id").agg(F.max("sev").alias("sev"))
    model = F.col("model_id")
    entry = F.struct(model.alias("judge"), "sev")
    code = F.max(F.when((model == FUNCTION_MODEL_ID) & F.col("answer_id").isNotNull(), F.col("sev")))
    return each.groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.when(is_judge(model), entry))).alias("judges"), code.alias("code"))


def label_sets(evals: DataFrame) -> DataFrame:
    """A2 as one row per answer: answer_id, ``labels``, an array of (judge,
    label)."""
    rows = answer_severities(evals).where(F.size("judges") > 0)
    return rows.select("answer_id", F.transform("judges", lambda x: F.struct(
        x.judge.alias("judge"), judge_label(x.sev, F.col("code")).alias("label"))).alias("labels"))


def label_sets_of(labels: DataFrame) -> DataFrame:
    """The stored label table (answer_id, answer_label, evaluator_model_id) as
    ``label_sets`` gives it."""
    entry = F.struct(F.col("evaluator_model_id").alias("judge"), F.col("answer_label").alias("label"))
    return labels.groupBy("answer_id").agg(F.sort_array(F.collect_list(entry)).alias("labels"))


def answer_labels(evals: DataFrame, dedupe: bool = True, include_unjudged: bool = False,
                  judges: list[int] | None = None) -> DataFrame:
    """A2: ``(answer_id, answer_label, evaluator_model_id)``.

    Judge rows and inclusion rows are folded in one pass to one row per answer
    (``answer_severities``), which then gives a row per judge; nothing is
    joined, whatever the skew of the raw rows.

    ``include_unjudged`` also labels answers that only have inclusion rows
    (all their terms unused), once per judge (``judges``, or every judge that
    has evaluated anything).
    """
    rows = answer_severities(evals, dedupe)
    out = rows.select("answer_id", "code", F.explode("judges").alias("j")).select(
        "answer_id", judge_label(F.col("j.sev"), F.col("code")).alias("answer_label"),
        F.col("j.judge").alias("evaluator_model_id"))
    if include_unjudged:
        # All judges as one array: one row, joined on a constant key.
        if judges is None:
            all_of = out.agg(F.sort_array(F.collect_set("evaluator_model_id")).alias("_judges"))
        else:
            all_of = evals.sparkSession.createDataFrame([(sorted(judges),)], "_judges array<long>")
        unjudged = rows.where((F.size("judges") == 0) & F.col("code").isNotNull())
        extra = (unjudged.withColumn("_k", F.lit(0)).join(F.broadcast(all_of.withColumn("_k", F.lit(0))), "_k")
                         .select("answer_id", label_from_severity(F.col("code")).alias("answer_label"),
                                 F.explode("_judges").alias("evaluator_model_id")))
        out = out.unionByName(extra)
    return out


def answer_labels_file_mode(evals: DataFrame, label_col: str = "eval_label_id",
                            model_col: str = "model_id") -> DataFrame:
    """A3: the file variant. Only the lowest model id is labelled (the loop
    returns after the first judge), no id is excluded, and the result is
    left-joined back onto every term row with the label name."""
    first_model = evals.agg(F.min(model_col)).first()[0]
    if first_model is None:
        return evals.withColumn("answer_label_id", F.lit(None).cast("long")) \
                    .withColumn("answer_label", F.lit(None).cast("string"))
    sev = severity(F.col(label_col))
    judged = (evals.where(F.col(model_col) == first_model).select("answer_id").distinct())
    rows = evals.where(F.col(model_col).isin(first_model, FUNCTION_MODEL_ID))
    lab = (rows.join(judged, "answer_id", "left_semi")
               .groupBy("answer_id").agg(F.max(sev).alias("_s"))
               .select("answer_id", label_from_severity(F.col("_s")).alias("answer_label_id")))
    lab = lab.withColumn("answer_label", label_name(F.col("answer_label_id")))
    return evals.join(lab, "answer_id", "left")


AI_GROUPED_COLUMNS = ["answer_id", "eval_label", "question_id", "isHypotheticalQuestion",
                      "question", "answer", "answer_source_id", "answer_source",
                      "evaluator_model_id", "evaluator_model", "count"]


def ai_label(valid: Column, hallucination: Column, irrelevant: Column) -> Column:
    """The A4 rule from the number of rows with each label: all three labels →
    1, else 1 if it is the smallest, else the largest label."""
    return (F.when((valid > 0) & (hallucination > 0) & (irrelevant > 0), 1)
             .when((valid == 0) & (hallucination > 0), 1)
             .when(irrelevant > 0, 2).when(hallucination > 0, 1).otherwise(0).cast("long"))


def label_counts() -> list[Column]:
    """Number of rows with each label, one column each."""
    return [F.count_if(F.col("eval_label") == code).alias(f"n{code}") for code, _ in EVAL_NAMES]


def ai_fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The A4 rule per ``keys`` and the row count, from counts per label (a
    hash aggregate with numeric buffers). Rows with no known label count in
    nothing."""
    g = rows.groupBy(*keys).agg(*label_counts()).withColumn("count", F.col("n0") + F.col("n1") + F.col("n2"))
    return g.where("count > 0").select(*keys, ai_label(F.col("n0"), F.col("n1"), F.col("n2")).alias("eval_label"), "count")


def ai_grouped(detailed: DataFrame) -> DataFrame:
    """A4: per (answer, judge) over the judge kinds only, grouped by the ids
    and their dependent columns as the view does. Over the pipeline's own
    view, ``views.ai_grouped_view`` gives the same rows without carrying the
    text through the aggregation."""
    d = detailed.where((F.col("eval_type") != "HumanEval") & (F.col("eval_type") != "code_check"))
    keys = ["question_id", "answer_id", "evaluator_model_id", "isHypotheticalQuestion",
            "question", "answer", "answer_source_id", "answer_source", "evaluator_model"]
    return ai_fold(d, keys).select(*AI_GROUPED_COLUMNS)


def inclusion_fold(detailed: DataFrame, by_source: bool = True) -> DataFrame:
    """A5: max inclusion label per (answer, term). The original grouping
    ignores the term source, merging made-up id 7 with real id 7;
    ``by_source=False`` keeps that."""
    keys = ["answer_id", "term_id"] + (["term_source_id"] if by_source else [])
    return (detailed.where(F.col("eval_type_id") == CODE_CHECK)
                    .groupBy(*keys).agg(F.max("eval_label").alias("eval_label")))


def labelled_from(rc: DataFrame, ag: DataFrame, by_source: bool = True) -> DataFrame:
    """Inclusion folds left-joined to the grouped judge labels on the
    answer; one row per (answer, term, judge)."""
    j = rc.join(ag.withColumnRenamed("eval_label", "ai_label"), "answer_id", "left")
    hal = (F.when(F.col("ai_label") == 1, 1).when(F.col("ai_label") == 2, 2)
            .otherwise(F.col("eval_label")).cast("long"))
    extra = ["term_source_id"] if by_source else []
    return j.select("answer_id", "term_id", *extra, "ai_label",
                    F.col("eval_label").alias("isRelevant_label"),
                    hal.alias("hallucination_label"), "question_id", "isHypotheticalQuestion",
                    "question", "answer", "answer_source_id", "answer_source",
                    "evaluator_model_id", "evaluator_model", "count")


def labelled(detailed: DataFrame, by_source: bool = True) -> DataFrame:
    """A6 + J9 over a detailed view (``views.labelled_view`` for the
    pipeline's own view)."""
    return labelled_from(inclusion_fold(detailed, by_source), ai_grouped(detailed), by_source)


def dedupe_report_rows(detail: DataFrame, id_col: str = "eval_id") -> DataFrame:
    """Drop rows equal in everything but ``eval_id`` (keep the lowest id),
    then keep one row per ``eval_id`` (the first by the remaining columns).

    Both shuffles carry each row's columns once, combined before the first;
    leave out long texts that ids determine (``views.report_rows``)."""
    others = [c for c in detail.columns if c != id_col]
    once = keep_first(detail, others, [id_col])
    return keep_first(once, [id_col], others)
