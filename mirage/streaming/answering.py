"""Answering as a Structured Streaming job.

The original appends one answered row at a time to a file so that a crash
loses little. Here new question files are a streaming source, and the ids that
have been passed on are keyed state in the state store: a question that comes
again, in the same file or a year later, is found there and not asked again.
No batch reads the sink.

The checkpoint folder holds the state and which files were consumed, so a
restarted job continues where it stopped. Each micro-batch writes a folder of
its own and overwrites it when Spark runs the batch again, so a batch that was
cut off between its answers and its commit adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mirage.operators.batch_model import BatchFn, answer_questions

QUESTION_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                                T.StructField("question", T.StringType())])


def _once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The question of one id, the first time that the id is seen. Rows marked
    as done only set the state. Of several texts in one batch the first in
    order is asked."""
    texts, done = [], state.exists
    for rows in batches:
        done = done or bool(rows["done"].any())
        texts += rows["question"][~rows["done"]].tolist()
    if not state.exists:
        state.update((True,))
    if texts and not done:
        yield pd.DataFrame({"id": [key[0]], "question": [min((t for t in texts if t is not None), default=None)]})


def unasked(questions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Of a stream of ``questions`` (id, question) each id once, unless the
    stream ``done`` (id) has brought it before or in the same batch. Rows
    without an id are nobody's question and drop out."""
    rows = questions.select("id", "question", F.lit(False).alias("done"))
    if done is not None:
        rows = rows.unionByName(done.select("id", F.lit(None).cast("string").alias("question"), F.lit(True).alias("done")))
    return rows.where(F.col("id").isNotNull()).groupBy("id").applyInPandasWithState(
        _once, QUESTION_SCHEMA, "passed boolean", "update", GroupStateTimeout.NoTimeout)


def start_answering(spark: SparkSession, questions_dir: str, answers_dir: str,
                    checkpoint_dir: str, fn: BatchFn, model_id: int,
                    available_now: bool = True, answered_dir: str | None = None):
    """Start the stream; returns the ``StreamingQuery``. ``answered_dir`` names
    a Parquet folder of answers (question_id) that other jobs wrote; each of
    its files is read once."""
    src = spark.readStream.schema(QUESTION_SCHEMA).json(questions_dir)
    done = None
    if answered_dir:
        done = spark.readStream.schema("question_id long").parquet(answered_dir).select(F.col("question_id").alias("id"))

    def batch(df: DataFrame, batch_id: int) -> None:
        out = answer_questions(df, fn, model_id).drop("model_id")
        out.write.mode("overwrite").parquet(f"{answers_dir.rstrip('/')}/model_id={model_id}/batch={batch_id}")

    w = unasked(src, done).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
