"""Term-level evaluation of answers.

Answers arrive wide (one row per answer with three terms) or short (a
``terms`` array of two structs). Both become long rows, one per (answer,
term): the secondary term first, then the replacement (real) term when the
question replaced the made-up one, else the made-up term itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.functions import replies as RP
from mirage.functions.common import spread
from mirage.functions.text import inclusion_label, simple_included, term_included
from mirage.operators.ordering import GlobalOrder
from mirage.schemas import (ACCEPTANCE, CODE_CHECK, DEFINITION, FAILURE_SENTINELS,
                            FUNCTION_MODEL_ID, SHORT_ANSWER_COLUMNS, TERM_STRUCT,
                            WIDE_ANSWER_COLUMNS, require_columns)

LONG_COLUMNS = ["answer_id", "question_id", "term_pos", "term_id", "term", "meaning",
                "term_source", "is_hypothetical"]


def parse_terms_cell(cell) -> "F.Column":
    """a ``terms`` cell written as a Python literal (single quotes,
    ``None``) → ``ARRAY<STRUCT<termId, term, termSet, termSetId,
    explanation>>``. The JSON reader accepts single quotes; bare ``None``
    becomes ``null`` first."""
    return F.from_json(_as_json(cell), T.ArrayType(TERM_STRUCT), {"allowSingleQuotes": "true"})


def _as_json(cell) -> "F.Column":
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.regexp_replace(c, r":\s*None(\s*[,}])", ": null$1")


REQUIRED_TERM_KEYS = ["termId", "term", "termSet", "explanation"]


def _has_all_keys(terms: "F.Column") -> "F.Column":
    """Whether every entry of a text cell names all required keys (whatever
    their values: a key may well hold nothing)."""
    entries = F.from_json(_as_json(terms), T.ArrayType(T.MapType(T.StringType(), T.StringType())),
                          {"allowSingleQuotes": "true"})
    return (F.size(entries) == 2) & F.forall(
        entries, lambda e: F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_TERM_KEYS]), F.map_keys(e))) == 0)


def check_short_answers(df: DataFrame) -> DataFrame:
    """P11 (row part): short-form rows must hold exactly two term entries. In
    a text cell each must name ``termId, term, termSet, explanation``; an
    array of structs names them by its type. Returns the offending rows
    (empty when all pass); ``to_wide`` raises when any exist."""
    t = F.col("terms")
    ok = _has_all_keys(t) if isinstance(df.schema["terms"].dataType, T.StringType) else \
        (F.size(t) == 2) & F.forall(t, lambda x: x.isNotNull())
    return df.where(~F.coalesce(ok, F.lit(False)))


def to_wide(df: DataFrame, check: bool = True, order_cols: list[str] | None = None) -> DataFrame:
    """P11 + P12: accept the wide layout as is, or turn the short layout into
    it (element 0 is the main term: made-up when ``termSetId`` is 0, else the
    replacement; element 1 is the secondary term; absent side → 0 / "").

    In the short layout ``answer_id`` is the row's position (from 0) in the
    file: by ``order_cols``, or, for a frame as it was read, in the order of
    its rows. ``terms`` may be a text cell (F21) or an array of structs."""
    if all(c in df.columns for c in WIDE_ANSWER_COLUMNS):
        return df
    require_columns(df, [c for c in SHORT_ANSWER_COLUMNS if c != "answer_id"], "answers")
    if check:
        bad = check_short_answers(df).limit(1).count()
        if bad:
            raise ValueError("terms column does not hold two complete term entries in every row")
    df = df.drop("answer_id")
    if isinstance(df.schema["terms"].dataType, T.StringType):
        df = df.withColumn("terms", parse_terms_cell("terms"))
    if order_cols is None:
        df, order_cols = df.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    df = GlobalOrder(df, order_cols).with_position("answer_id").drop("_row")
    t0, t1 = F.get(F.col("terms"), 0), F.get(F.col("terms"), 1)
    made_up = F.coalesce(t0["termSetId"] == 0, F.lit(False))
    out = df.select(
        "*",
        t0["termSetId"].alias("replacement_type"),
        F.when(made_up, t0["termId"]).otherwise(F.lit(0)).cast("long").alias("nonexistent_id"),
        F.when(made_up, t0["term"]).otherwise(F.lit("")).alias("nonexistent"),
        F.when(made_up, t0["explanation"]).otherwise(F.lit("")).alias("nonexistent_meaning"),
        F.when(~made_up, t0["termId"]).otherwise(F.lit(0)).cast("long").alias("replacement_id"),
        F.when(~made_up, t0["term"]).otherwise(F.lit("")).alias("replacement"),
        F.when(~made_up, t0["explanation"]).otherwise(F.lit("")).alias("replacement_meaning"),
        F.when(~made_up, t0["termSet"]).otherwise(F.lit("")).alias("replacement_source"),
        t1["termId"].cast("long").alias("secondary_id"), t1["term"].alias("secondary"),
        t1["explanation"].alias("secondary_meaning"), t1["termSet"].alias("secondary_source"))
    return out.drop("terms")


def terms_long(wide: DataFrame) -> DataFrame:
    """One row per (answer, term); ``term_pos`` 0 is the secondary term,
    1 the replacement or made-up term. A NULL replacement type counts as a
    replacement (it is truthy where the rows are walked)."""
    rt = F.col("replacement_type")
    replaced = rt.isNull() | (rt != 0)

    def s(pos, tid, term, meaning, source, hyp):
        return F.struct(F.lit(pos).alias("term_pos"), tid.cast("long").alias("term_id"),
                        term.cast("string").alias("term"), meaning.cast("string").alias("meaning"),
                        source.cast("string").alias("term_source"),
                        F.lit(hyp).alias("is_hypothetical"))
    sec = s(0, F.col("secondary_id"), F.col("secondary"), F.col("secondary_meaning"),
            F.col("secondary_source"), False)
    main = F.when(replaced, s(1, F.col("replacement_id"), F.col("replacement"),
                              F.col("replacement_meaning"), F.col("replacement_source"), False)
                  ).otherwise(s(1, F.col("nonexistent_id"), F.col("nonexistent"), F.lit(""),
                                F.lit("0"), True))
    keep = [c for c in wide.columns if c in ("answer_id", "question_id", "answer", "question")]
    return (wide.select(*keep, F.explode(F.array(sec, main)).alias("_t"))
                .select(*keep, "_t.*"))


def inclusion_evals(long: DataFrame, reflection: str | None = None, partitions: int | None = None) -> DataFrame:
    """F4 over every long row: one inclusion-check evaluation (kind 4, model
    10) per (answer, term). ``partitions`` deals the rows over that many tasks
    before their texts are cleaned."""
    rows = spread(long.select("answer_id", "answer", "term_source", "term_id", "term_pos", "term"), partitions)
    return rows.select(
        "answer_id", inclusion_label(F.col("answer"), F.col("term")).alias("eval_label"),
        F.lit(CODE_CHECK).cast("long").alias("eval_type_id"),
        F.lit(reflection).cast("string").alias("reflection"),
        F.col("term_source"), F.col("term_id"),
        F.lit(FUNCTION_MODEL_ID).cast("long").alias("model_id"), "term_pos", "term")


JUDGE_OUT = T.StructType([T.StructField("request_id", T.StringType()),
                          T.StructField("reply", T.StringType())])

JudgeFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def judge_terms(long: DataFrame, judge: JudgeFn, judge_model_id: int,
                simple_gate: bool = False, only: int | None = None, done: DataFrame | None = None,
                partitions: int | None = None) -> DataFrame:
    """M2 + M3: the judge kinds for used terms (``only`` one kind, if given).

    Every used term (F2, or plain containment with ``simple_gate``) gets an
    acceptance request; used real terms also get a meaning request. Requests
    go through ``judge`` in ``mapInPandas`` (columns ``request_id, kind,
    answer, question, term, meaning, is_hypothetical`` in; ``request_id,
    reply`` out), then replies become labels (F18/F19) and stored replies
    (failed ones prefixed). A request the judge gives no reply to counts as a
    failed one; two replies to one request are an error. With ``done``
    (stored evaluations), what this judge has already judged is left out
    (J11).
    """
    gate = simple_included if simple_gate else term_included
    used = long.where(gate(F.col("answer"), F.col("term")))
    kinds = F.when(F.col("is_hypothetical"), F.array(F.lit(ACCEPTANCE))) \
             .otherwise(F.array(F.lit(ACCEPTANCE), F.lit(DEFINITION)))
    req = used.select("*", F.explode(kinds).alias("kind"))
    if only is not None:
        req = req.where(F.col("kind") == only)
    if done is not None:
        seen = done.where(F.col("model_id") == judge_model_id).select(
            "answer_id", F.col("term_source").cast("string").alias("term_source"), "term_id", F.col("eval_type_id").cast("int").alias("kind"))
        req = req.withColumn("term_source", F.col("term_source").cast("string")).join(
            seen, ["answer_id", "term_source", "term_id", "kind"], "left_anti")
    req = req.withColumn(
        "request_id", F.concat_ws(":", F.col("answer_id").cast("string"), F.col("term_pos").cast("string"),
                                  F.col("kind").cast("string")))
    j = spread(req, partitions).mapInPandas(_keep_rows(judge),
                        T.StructType(req.schema.fields + [T.StructField("reply", T.StringType()),
                                                          T.StructField("_p", RP.PARSED)]))
    src0 = F.col("is_hypothetical")
    src = F.when(src0, F.lit(0)).otherwise(F.lit(1))
    acc = F.col("kind") == ACCEPTANCE
    label = F.when(acc, RP.certainty_label(F.col("_p"), src)).otherwise(RP.meaning_label(F.col("_p")))
    failed = F.when(acc, RP.certainty_failed(F.col("_p"))).otherwise(RP.meaning_failed(F.col("_p")))
    return j.select("answer_id", label.alias("eval_label"),
                    F.col("kind").cast("long").alias("eval_type_id"),
                    RP.stored_reply(F.col("reply"), failed).alias("reflection"),
                    "term_source", "term_id", F.lit(judge_model_id).cast("long").alias("model_id"),
                    "term_pos", "term", F.col("_p.step").alias("parse_step"))


SENT_COLUMNS = ["request_id", "kind", "answer", "question", "term", "meaning", "is_hypothetical"]


def _keep_rows(judge: JudgeFn) -> JudgeFn:
    """Call the user's judge on the request columns of each Arrow batch and
    attach its replies to the batch rows, so no join is needed afterwards."""
    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            sent = pdf[[c for c in SENT_COLUMNS if c in pdf.columns]]
            none = pd.DataFrame({"request_id": pd.Series(dtype=object), "reply": pd.Series(dtype=object)})
            got = pd.concat([none, *judge(iter([sent]))], ignore_index=True)  # a judge may be silent
            if got["request_id"].duplicated().any():
                raise ValueError("the judge gave two replies to one request")
            replies = got.set_index("request_id")["reply"]
            out = pdf.copy()
            out["reply"] = out["request_id"].map(replies).where(out["request_id"].isin(replies.index), FAILURE_SENTINELS[0])
            out["_p"] = RP.parse_frame(out["reply"]).to_dict("records")
            yield out
    return run


def evaluate_answers(answers: DataFrame, judge: JudgeFn, judge_model_id: int,
                     only: int | None = None, done: DataFrame | None = None,
                     partitions: int | None = None) -> DataFrame:
    """The whole term-level evaluation: inclusion rows for every term plus
    judge rows for used terms, as one long table (M3). ``partitions`` deals the
    answers over that many tasks before their texts are cleaned and judged."""
    long = terms_long(spread(to_wide(answers), partitions))
    inc = inclusion_evals(long).withColumn("parse_step", F.lit(None).cast("int"))
    return inc.unionByName(judge_terms(long, judge, judge_model_id, only=only, done=done))


def stub_judge(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic judge for tests: acceptance replies ``mentioned`` when
    the term has an even number of characters, else ``unreal``; meaning
    replies ``verified`` true when the meaning is non-empty."""
    for pdf in pdfs:
        out = []
        for kind, term, meaning in zip(pdf["kind"], pdf["term"], pdf["meaning"]):
            if kind == ACCEPTANCE:
                c = "mentioned" if len(term or "") % 2 == 0 else "unreal"
                out.append('{"term": "t", "reasoning": "stub", "certainty": "%s"}' % c)
            else:
                out.append('{"term": "t", "reasoning": "stub", "verified": %s}'
                           % ("true" if meaning else "false"))
        yield pd.DataFrame({"request_id": pdf["request_id"], "reply": out})


def answers_of_model(answers: DataFrame, models: DataFrame, model_name: str) -> DataFrame:
    """P5: answers of the model with this name (joined on the model table)."""
    m = models.where(F.col("name") == model_name).select(F.col("id").alias("_mid"))
    return answers.join(m, answers["answer_source_id"] == F.col("_mid")).drop("_mid")
