"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the row that sorts first by ``order`` and then by
    every remaining column (so ties never depend on partitioning).

    Planned as ``row_number() = 1``, which Spark turns into a partial
    ``WindowGroupLimit`` before the shuffle: each map task forwards one row
    per key, so a key holding a large share of the rows costs no single-task
    sort of all of them.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.NumericType):
        # The keys are every other column: the first row is the key with the
        # smallest order value (null first), a hash aggregate with numeric
        # buffers and map-side combine instead of a sort on the wide keys.
        o = F.col(order[0])
        first = F.when(F.count(F.lit(1)) > F.count(o), F.lit(None)).otherwise(F.min(o))
        return df.groupBy(*keys).agg(first.alias(order[0])).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order + rest])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def pct_half_even(count: Column, total: Column) -> Column:
    """``100 * count / total`` rounded half-to-even at 2 decimals, computed
    exactly in integers (no binary-float tie artefacts), then as DOUBLE."""
    scaled = count.cast("long") * F.lit(10000)
    q = F.floor(scaled / total).cast("long")
    r = scaled - q * total
    q = (F.when(r * 2 > total, q + 1)
          .when((r * 2 == total) & (F.pmod(q, F.lit(2)) == 1), q + 1)
          .otherwise(q))
    return F.when(total > 0, q.cast("double") / F.lit(100.0)).otherwise(F.lit(0.0))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows over ``partitions`` tasks before a Python-heavy stage;
    without a number the input's own splits are kept. Nothing of ``df`` runs
    while the plan is built."""
    return df.repartition(partitions) if partitions else df
