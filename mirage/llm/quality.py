"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w . x), with one weight vector for all
grades and ascending thresholds. x are hashed features of the text, each kind
as shares of the text (words' shares multiplied, see ``SCALES``):

* words (ASCII letters lowered);
* shapes: three consecutive characters by class (lower case or any non-ASCII
  byte, upper case, digit, space, every other ASCII character itself);
* repetition: how many words back the last two words occur as they are now.

The expected grade and the tail probabilities P(grade >= k) follow from the
one score. Fitting uses at most ``max_rated`` ratings (those whose hashed id
is smallest); features are extracted by the executors and fitted by one task.

Null or empty text has no features: its score is 0. Without ratings all
documents are kept, with expected grade null. Ratings that are null, or whose
document is missing, are ignored; a document rated more than once counts once
per rating. Where an id repeats, a rating speaks of one of its texts, the first
by hash. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.llm.common import text_of
from mirage.llm.words import Words, mix, raw_texts, slices

WORDS, SHAPES, LAGS = 1 << 16, 1 << 14, 24
SIZE = WORDS + SHAPES + LAGS + 1
#: What the shares of words, shapes and repetition are multiplied by, in the
#: order in which ``features`` gives them: a few telling words among hundreds
#: must weigh as much as the shape of the whole.
SCALES = (5.0, 1.0, 1.0)
#: Ratings that the model is fitted on at most.
MAX_RATED = 6000
#: Rows gone through at a time in fitting, and bytes of text in features.
FIT_ROWS, TEXT_BYTES = 256, 1 << 20

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[128:] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[0x09:0x0E] = ord(" ")


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind: the text's number and the feature, for every occurrence."""
    words = Words(texts, lower=True)
    out = [(words.text, (words.hash % np.uint64(WORDS)).astype(np.int64))]
    raw = np.frombuffer(words.data, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(raw)]
    if len(raw) >= 3:
        c = _CLASS[raw]
        code = mix((c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:])
        at = np.flatnonzero(owner[:-2] == owner[2:])
        at = at[at + 2 < (np.cumsum(sizes) - 1)[owner[at]]]  # not over the separator
        out.append((owner[at], WORDS + (code[at] % np.uint64(SHAPES)).astype(np.int64)))
    h, t = words.hash, words.text
    if len(h) >= 2:
        pair = h[1:] + h[:-1] * np.uint64(31)
        inside = t[1:] == t[:-1]
        back = np.full(len(pair), LAGS, np.int64)
        for lag in range(LAGS, 0, -1):
            if lag < len(pair):
                hit = (pair[lag:] == pair[:-lag]) & (t[lag + 1:] == t[:-lag - 1])
                back[lag:][hit] = lag - 1
        at = np.flatnonzero(inside)
        out.append((t[1:][at], WORDS + SHAPES + back[at]))
    return out


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for (owner, feature), scale in zip(features(texts), SCALES):
        n = np.bincount(owner, minlength=len(texts))
        out += scale * np.bincount(owner, weights[feature], len(texts)) / np.maximum(n, 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, n_grades: int,
        steps: int = 400, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least regularised loss (Adam, full batch).
    Thresholds are the first one and the logs of the gaps between them.
    Entries (row, col, val) come in order of row; they are gone through some
    rows at a time, so that no array but they grows with their number."""
    n = len(grade)
    edges = [*range(0, n, FIT_ROWS), n]
    at = np.searchsorted(row, edges)
    parts = [(a, b, slice(x, y)) for a, b, x, y in zip(edges, edges[1:], at, at[1:])]
    share = np.cumsum(np.bincount(grade, minlength=n_grades) + 1.0) / (n + n_grades)
    cut = np.log(share[:-1] / (1 - share[:-1]))
    par = np.zeros(SIZE + n_grades - 1)
    par[SIZE] = cut[0]
    par[SIZE + 1:] = np.log(np.maximum(np.diff(cut), 1e-2))
    first, second = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        gaps = np.exp(par[SIZE + 1:])
        theta = par[SIZE] + np.r_[0.0, np.cumsum(gaps)]
        s = np.concatenate([np.bincount(row[p] - a, par[col[p]] * val[p], b - a) for a, b, p in parts])
        upper = np.where(grade < n_grades - 1, sigmoid(theta[np.minimum(grade, n_grades - 2)] - s), 1.0)
        lower = np.where(grade > 0, sigmoid(theta[np.maximum(grade - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (du - dl) / n  # of the loss -log p by the score
        slope = np.zeros_like(par)
        slope[:SIZE] = decay * par[:SIZE]
        for _, _, p in parts:
            slope[:SIZE] += np.bincount(col[p], ds[row[p]] * val[p], SIZE)
        dtheta = np.zeros(n_grades - 1)
        np.add.at(dtheta, np.minimum(grade, n_grades - 2), np.where(grade < n_grades - 1, -du / n, 0))
        np.add.at(dtheta, np.maximum(grade - 1, 0), np.where(grade > 0, dl / n, 0))
        slope[SIZE] = dtheta.sum()
        for k in range(n_grades - 2):
            slope[SIZE + 1 + k] = dtheta[k + 1:].sum() * gaps[k]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        par -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return par[:SIZE], par[SIZE] + np.r_[0.0, np.cumsum(np.exp(par[SIZE + 1:]))]


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED):
    """(weights, thresholds) fitted on ``ratings`` (doc_id, grade from 0 to
    n_grades - 1) of ``docs`` (doc_id, text), or None without ratings."""
    chosen = (ratings.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rated))
    chosen = chosen.withColumn("rating", F.monotonically_increasing_id())
    rated = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rated narrow rows
    # A rating speaks of one document. Where an id repeats, of the first text
    # (by hash), so that the fit has max_rated rows at most.
    one = Window.partitionBy("rating").orderBy(F.xxhash64("text"), F.octet_length("text"))
    rated = rated.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc_id", "text", "grade")

    def extract(batches):
        for part in slices(batches, "text", TEXT_BYTES):
            texts = raw_texts(part.column(1))
            cols, vals = [[] for _ in texts], [[] for _ in texts]
            for (owner, feature), scale in zip(features(texts), SCALES):
                n = np.bincount(owner, minlength=len(texts))
                both, times = np.unique(owner * SIZE + feature, return_counts=True)
                who = both // SIZE
                for k, a, b in zip(range(len(texts)), *(np.searchsorted(who, np.arange(len(texts)), side=s) for s in ("left", "right"))):
                    cols[k].append(both[a:b] % SIZE)
                    vals[k].append(scale * times[a:b] / max(1, n[k]))
            yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(2),
                                   pa.array([np.concatenate(c).astype(np.int32).tobytes() for c in cols], pa.binary()),
                                   pa.array([np.concatenate(v).astype(np.float32).tobytes() for v in vals], pa.binary())],
                                  names=["id", "grade", "cols", "vals"])

    def learn(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        if not rows:
            return
        grade = np.clip(np.array([r[1] for r in rows]), 0, n_grades - 1)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
        col = np.frombuffer(b"".join(r[2] for r in rows), np.int32)
        val = np.frombuffer(b"".join(r[3] for r in rows), np.float32)
        del rows
        w, theta = fit(row, col, val, grade, n_grades)
        yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()]), pa.array([theta.tobytes()])], names=["w", "theta"])

    got = (rated.mapInArrow(extract, "id long, grade int, cols binary, vals binary").repartition(1)
           .mapInArrow(learn, "w binary, theta binary").collect())  # one row, SIZE weights
    if not got:
        return None
    return np.frombuffer(got[0]["w"], np.float32).astype(np.float64), np.frombuffer(got[0]["theta"], np.float64)


def rate(docs: DataFrame, model, n_grades: int, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all of them by default) with
    expected_grade and tail (array: P(grade >= 1), ..., P(grade >= n_grades - 1)),
    which replace columns of those names. One row per row."""
    cols = [c for c in (carry or docs.columns) if c not in ("expected_grade", "tail")]
    if model is None:
        return docs.select(*cols, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tail"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*cols, *(["text"] if "text" not in cols else []))
    out = T.StructType([*[rows.schema[c] for c in cols], T.StructField("expected_grade", T.DoubleType()),
                        T.StructField("tail", T.ArrayType(T.DoubleType()))])

    def work(batches):
        weights, theta = shared.value
        for part in slices(batches, "text", TEXT_BYTES):
            s = scores(raw_texts(part.column("text")), weights)
            tail = 1 - sigmoid(theta[None, :] - s[:, None])
            k = n_grades - 1
            yield pa.record_batch([*(part.column(c) for c in cols), pa.array(tail.sum(1)),
                                   pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(s) + 1, k, dtype=np.int32)), pa.array(tail.ravel()))],
                                  names=out.names)

    return rows.mapInArrow(work, out)


def keeps(grade: int, at_least: float) -> Column:
    """Selection: P(grade >= ``grade``) is at least ``at_least`` (or unknown)."""
    return F.coalesce(F.col("tail")[grade - 1] >= at_least, F.lit(True))


#: Grades of the tables' labels: 0 junk, 1 sound but toxic, 2 sound.
N_GRADES = 3


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from ``labels`` (doc_id, quality 0/1, toxic 0/1)."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).when(F.col("quality") >= 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
