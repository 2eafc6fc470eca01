"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.session import ensure_checkpoint_dir

#: White space between words: the six ASCII characters, nothing else.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a missing id where ids are ordered: after every real one.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces_of(n: int, each: int) -> int:
    """Number of groups that hold about ``each`` of ``n`` rows."""
    return max(1, math.ceil(n / each))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Numpy arrays as one byte string (see ``unpack_arrays``)."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def unpack_arrays(data: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data[at:at + int(size)], kind))
        at += int(size)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on ``n`` nodes: at most n - 1,
    with the same components as all the given edges."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, label) for each
    node that has an edge, label being the smallest node it is connected to.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so long chains halve. Rounds are cut off by a table
    in the shared folder; only the number of changed rows reaches the driver.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(e.union(e.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(step.join(jump, "label").select(
            "node", F.least("label", "next").alias("label"),
            (F.least("label", "next") != F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels
