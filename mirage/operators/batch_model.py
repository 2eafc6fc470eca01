"""Model calls at batch scale (M1, M4, M5, M6).

A model is a user function over Arrow batches: it gets a pandas DataFrame of
requests and returns one reply per row. ``with_retries`` wraps a per-request
callable with bounded retries, a time limit and a failure sentinel, so a
failing call becomes data (counted and quarantined) instead of an exception
that kills the task.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.functions.common import spread
from mirage.functions.prompts import render
from mirage.functions.text import labelled_term, question_checks, swap_term
from mirage.schemas import (FAILURE_SENTINELS, FRESH, NO_REPLACEMENT, PROGRAMMATIC,
                            TRIPLET_VIEW_COLUMNS, require_columns)
from mirage.session import stored

BatchFn = Callable[[pd.DataFrame], pd.Series]


def with_retries(call: Callable[[str], str], retries: int = 3, timeout_s: float = 120.0,
                 threads: int = 4) -> BatchFn:
    """M6: call ``call(prompt)`` per row of the ``prompt`` column, at most
    ``retries`` attempts each under ``timeout_s``; a row that never succeeds
    gets the failure sentinel (timeout or model failure)."""
    model_failure, timeout_sentinel = FAILURE_SENTINELS

    def batch(pdf: pd.DataFrame) -> pd.Series:
        prompts = pdf["prompt"].tolist()
        replies: list[str | None] = [model_failure] * len(prompts)
        todo = deque((n, 1) for n in range(len(prompts))) if retries > 0 else deque()
        lock, ended = threading.Lock(), queue.SimpleQueue()

        class Worker:
            """A daemon thread that takes one attempt after the other.
            ``now`` is the attempt it is at (row, number, start)."""

            def __init__(self):
                self.now, self.left_behind = None, False
                threading.Thread(target=self.run, daemon=True).start()

            def run(self) -> None:
                while True:
                    with lock:
                        self.now = (*todo.popleft(), time.monotonic()) if todo else None
                        if self.now is None:
                            ended.put(self)
                            return
                    n, number, _ = self.now
                    try:
                        done, value = True, call(prompts[n])
                    except Exception:
                        done, value = False, model_failure
                    with lock:
                        if self.left_behind:
                            return
                        if done or number >= retries:
                            replies[n] = value
                        else:
                            todo.appendleft((n, number + 1))

        running = {Worker() for _ in range(min(threads, len(todo)))}
        while running:
            # Until the oldest attempt's time is over. One that hangs is left
            # behind with its worker and holds up neither the next attempt,
            # which another worker takes, nor the end of the batch.
            with lock:
                started = [w.now[2] for w in running if w.now]
            try:
                running.discard(ended.get(timeout=max(0.0, min(started) + timeout_s - time.monotonic()) if started else timeout_s))
                continue
            except queue.Empty:
                pass
            with lock:
                over = [w for w in running if w.now and time.monotonic() - w.now[2] >= timeout_s]
                for w in over:
                    n, number, _ = w.now
                    w.left_behind = True
                    if number >= retries:
                        replies[n] = timeout_sentinel
                    else:
                        todo.appendleft((n, number + 1))
                more = min(len(over), len(todo))
            running.difference_update(over)
            running.update(Worker() for _ in range(more))
        return pd.Series(replies, index=pdf.index)
    return batch


def call_model(requests: DataFrame, fn: BatchFn, out_col: str = "reply",
               partitions: int | None = None) -> DataFrame:
    """Run ``fn`` over each Arrow batch of ``requests`` (which must hold a
    ``prompt`` column); adds ``out_col`` and the batch's seconds per row.
    ``partitions`` deals the requests over that many tasks first. The result
    is lazy: where more than one thing is derived from it, store it first
    (``session.stored``), else the model is asked again for each."""
    schema = T.StructType(requests.schema.fields + [
        T.StructField(out_col, T.StringType()), T.StructField("elapsed_s", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            t0 = time.time()
            reply = fn(pdf)
            pdf = pdf.copy()
            pdf[out_col] = list(reply)
            pdf["elapsed_s"] = (time.time() - t0) / max(len(pdf), 1)
            yield pdf
    return spread(requests, partitions).mapInPandas(run, schema)


def answer_questions(questions: DataFrame, fn: BatchFn, model_id: int,
                     template: str = "{question}", qid: str = "id", partitions: int | None = None) -> DataFrame:
    """M1: one answer per question row: ``(question_id, model_id, answer,
    elapsed_s)``. Feed it the unanswered questions (J10) to resume a run."""
    req = questions.select(F.col(qid).alias("question_id"), "question",
                           render(template, question="question").alias("prompt"))
    out = call_model(req, fn, "answer", partitions)
    return out.select("question_id", F.lit(model_id).cast("long").alias("model_id"), "answer",
                      "elapsed_s")


DEFAULT_QUESTION_TEMPLATE = ("Topic: {topic}\nMade-up term: {madeup_term}\n"
                             "Real term: {real_term}\nWrite one question using both terms.")
DEFAULT_FRESH_TEMPLATE = ("Topic: {topic}\nMain term: {main_term}\n"
                          "Secondary term: {secondary_term}\nWrite one question using both terms.")


QUESTION_KEY = ["main_id", "main_source", "secondary_id", "secondary_source"]


def _question_key(rows: DataFrame, replacement_type: int) -> DataFrame:
    """The terms that a question of this type is about. The main term is
    the made-up one (source 0) for type 0, else the replacement."""
    made_up = replacement_type == NO_REPLACEMENT
    return rows.withColumn("main_id", F.col("nonexistent_id" if made_up else "replacement_id")) \
               .withColumn("main_source", F.lit(NO_REPLACEMENT).cast("long") if made_up else F.col("replacement_source_id").cast("long")) \
               .withColumn("secondary_source", F.col("secondary_source_id").cast("long"))


def _stored_question(rows: DataFrame, existing: DataFrame, replacement_type: int) -> DataFrame:
    """``rows`` with ``_old``: the stored question about the same terms and of
    the same type, or null. Of several the first by text counts."""
    old = (existing.where(F.col("replacement_type") == replacement_type)
                   .groupBy(*QUESTION_KEY).agg(F.min("question").alias("_old")))
    return _question_key(rows, replacement_type).join(old, QUESTION_KEY, "left").drop("main_id", "main_source", "secondary_source")


def _ask_or_reuse(rows: DataFrame, fn: BatchFn, out: str, partitions: int | None) -> DataFrame:
    """``out``: the stored question where there is one, else the model's,
    asked once for each row and stored before anything is derived from it."""
    asked = call_model(rows.where(F.col("_old").isNull()).drop("_old"), fn, out, partitions).drop("elapsed_s")
    kept = rows.where(F.col("_old").isNotNull()).withColumnRenamed("_old", out)
    return stored(asked.unionByName(kept), "questions")


def generate_questions(triplets: DataFrame, fn: BatchFn,
                       question_template: str = DEFAULT_QUESTION_TEMPLATE,
                       fresh_template: str = DEFAULT_FRESH_TEMPLATE,
                       existing: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """M4 (+ F5-F7, F22, F26, P14, P16, J17) over the combined triplet view.

    Type 0: the model writes a question with the made-up and the secondary
    term; it is kept only when valid (F7). Types 1 and 3 exist only for
    triplets with a valid type-0 question: type 1 swaps the made-up term for
    the replacement in that question (F6), type 3 asks the model afresh with
    the replacement. With ``existing`` (main_id, main_source, secondary_id,
    secondary_source, replacement_type, question), a stored question about
    the same terms and of the same type is reused instead of asking: a type-0
    one if it is valid, a type-3 one as it is. The model is asked at most
    once per triplet and type."""
    require_columns(triplets, TRIPLET_VIEW_COLUMNS, "triplets")
    topic = labelled_term("topic", "topic_explanation")
    base = triplets.select(
        *TRIPLET_VIEW_COLUMNS,
        render(question_template, topic=topic,
               madeup_term=labelled_term("nonexistent_term", "nonexistent_explanation"),
               real_term=labelled_term("secondary_term", "secondary_explanation")).alias("prompt"),
        render(fresh_template, topic=topic,
               main_term=labelled_term("replacement_term", "replacement_explanation"),
               secondary_term=labelled_term("secondary_term", "secondary_explanation")).alias("fresh_prompt"),
        F.lit(NO_REPLACEMENT).alias("kind"))

    def valid(question: str):
        return question_checks(F.col(question), F.col("nonexistent_term"), F.col("secondary_term"), F.lit(NO_REPLACEMENT))[0]

    if existing is not None:
        base = _stored_question(base, existing, NO_REPLACEMENT)
        base = base.withColumn("_old", F.when(valid("_old"), F.col("_old")))
    else:
        base = base.withColumn("_old", F.lit(None).cast("string"))
    ok = _ask_or_reuse(base, fn, "q0", partitions).where(valid("q0"))
    t0 = ok.select("term_triplet_id", F.lit(NO_REPLACEMENT).alias("replacement_type"), F.col("q0").alias("question"))
    t1 = ok.select("term_triplet_id", F.lit(PROGRAMMATIC).alias("replacement_type"),
                   swap_term(F.col("q0"), F.col("nonexistent_term"), F.col("replacement_term")).alias("question"))
    fresh = ok.drop("prompt", "q0").withColumnRenamed("fresh_prompt", "prompt").withColumn("kind", F.lit(FRESH))
    if existing is not None:
        fresh = _stored_question(fresh, existing, FRESH)
    else:
        fresh = fresh.withColumn("_old", F.lit(None).cast("string"))
    t3 = _ask_or_reuse(fresh, fn, "question", partitions).select(
        "term_triplet_id", F.lit(FRESH).alias("replacement_type"), "question")
    return (t0.unionByName(t1).unionByName(t3)
              .select(F.col("term_triplet_id").alias("triplet_id"),
                      F.col("replacement_type").cast("long"), "question"))


DEFAULT_CANDIDATE_TEMPLATE = "Topic: {topic}\nSuggest made-up terms as term: definition items."


def generate_from_template(rows: DataFrame, fn: BatchFn, template: str, keep: list[str],
                           out_col: str = "reply", partitions: int | None = None, **fields) -> DataFrame:
    """M5: the same model-call operator with another template, e.g. made-up
    term candidates per topic or related real terms per made-up term; parse
    the replies with ``split_candidate_lists`` (F11) or ``parse_term_list``
    (F9)."""
    req = rows.select(*keep, render(template, **fields).alias("prompt"))
    return call_model(req, fn, out_col, partitions).drop("elapsed_s")


def stub_answerer(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic answerer for tests: a fixed sentence about the question."""
    return pdf["question"].map(lambda q: f"I do not know {q}")


def stub_generator(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic question writer for tests: type 0 names the made-up and
    the secondary term, type 3 the replacement and the secondary term."""
    out = []
    for kind, n, s, r in zip(pdf["kind"], pdf["nonexistent_term"], pdf["secondary_term"],
                             pdf["replacement_term"]):
        main = n if kind == NO_REPLACEMENT else r
        out.append(f"How does {main} relate to {s}?")
    return pd.Series(out, index=pdf.index)
