"""Order-dependent steps without a single-partition window (W3, W4, W6, P6,
P7, O7).

``GlobalOrder`` range-partitions the rows on a total order - the order columns,
and after them the place where a row was read, so that rows with equal order
values keep that order and may fall into different ranges - sorts each
partition, and freezes that layout with a reliable checkpoint (written to the
shared folder named by ``spark.checkpoint.dir``). A row's number within its
partition is part of ``monotonically_increasing_id``, so a global position is
that plus the rows of the partitions before it; running quantities are carried
along the rows of a partition in Arrow batches and start from what the
partitions before it hold. That prefix pass runs on Spark, over one row per
partition, and is joined back; nothing else is shuffled a second time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.session import ensure_checkpoint_dir

_LOCAL = (1 << 33) - 1        # bits of the row number in monotonically_increasing_id


class GlobalOrder:
    """``partitions`` fixes the number of ranges; without it there are
    ``spark.sql.shuffle.partitions`` of them, merged by AQE where small."""

    def __init__(self, df: DataFrame, order_cols: list, partitions: int | None = None):
        ensure_checkpoint_dir(df.sparkSession)
        order = [*order_cols, "_tie"]
        tied = df.withColumn("_tie", F.monotonically_increasing_id())
        dealt = tied.repartitionByRange(partitions, *order) if partitions else tied.repartitionByRange(*order)
        ordered = dealt.sortWithinPartitions(*order).drop("_tie").withColumn("_mid", F.monotonically_increasing_id())
        self.df = ordered.checkpoint(eager=True)

    def _partitions(self, *aggs: Column) -> DataFrame:
        """One row per partition that has rows: _pid, _n and ``aggs``."""
        return self.df.groupBy(F.shiftright("_mid", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), *aggs)

    def _started(self, parts: DataFrame, **start: Column) -> DataFrame:
        """The rows with what their partition starts from: ``start`` maps a
        column to its value from ``parts`` (one row per partition)."""
        first = parts.select("_pid", *[c.alias(name) for name, c in start.items()])
        return self.df.withColumn("_pid", F.shiftright("_mid", 33)).join(F.broadcast(first), "_pid")

    def _carried(self, rows: DataFrame, fn, col: str, kind: T.DataType, start: list[str]) -> DataFrame:
        """Add ``col``: ``fn(*start values)`` gives a function from one batch
        of a partition to its values, called in order."""
        keep = [f for f in self.df.schema.fields if f.name != "_mid"]
        out = T.StructType([*keep, T.StructField(col, kind)])
        names = [f.name for f in keep]

        def run(batches):
            step = None
            for batch in batches:
                if batch.num_rows:
                    if step is None:
                        step = fn(*[batch.column(c)[0].as_py() for c in start])
                    yield pa.record_batch([*[batch.column(c) for c in names], step(batch)], names=out.names)

        return rows.mapInArrow(run, out)

    def with_position(self, col: str = "pos", base: int = 0) -> DataFrame:
        """``base``-based global row position."""
        rows = self._started(self._partitions(), _before=_sum_before("_n"))
        return rows.withColumn(col, F.col("_before") + F.lit(base) + F.col("_mid").bitwiseAND(F.lit(_LOCAL))).drop("_pid", "_mid", "_before")

    def running_mean(self, value: str, col: str = "running_mean") -> DataFrame:
        """Mean of ``value`` over all rows up to the current one (missing
        values add nothing but count as rows)."""
        parts = self._partitions(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
        rows = self._started(parts, _rows=_sum_before("_n"), _total=_sum_before("_sum"))

        def carry(rows, total):
            def step(batch):
                nonlocal rows, total
                v = batch.column(value).fill_null(0).to_numpy(zero_copy_only=False)
                sums = total + np.cumsum(v)
                counts = rows + 1 + np.arange(len(v))
                rows, total = rows + len(v), sums[-1]
                return pa.array(sums.astype(np.float64) / counts)

            return step

        return self._carried(rows, carry, col, T.DoubleType(), ["_rows", "_total"])

    def run_ids(self, key: str, col: str = "run_id") -> DataFrame:
        """1 on the first row, +1 whenever ``key`` differs from the
        previous row (gaps and islands). The previous row of a partition's
        first row is the last row of the partition before it: where the two
        keys are equal, the partition goes on with that run."""
        kind = self.df.schema[key].dataType.simpleString()

        def summary(batches):
            step = pid = first = last = runs = None
            for batch in batches:
                if batch.num_rows:
                    if step is None:
                        pid, first, step = batch.column(1)[0].as_py() >> 33, batch.column(0).slice(0, 1), _runs(key, 0)
                    runs, last = step(batch)[-1].as_py(), batch.column(0).slice(batch.num_rows - 1, 1)
            if step:
                yield pa.record_batch([pa.array([pid]), pa.array([runs]), first, last], names=["_pid", "_runs", "_first", "_last"])

        parts = self.df.select(key, "_mid").mapInArrow(summary, f"_pid long, _runs long, _first {kind}, _last {kind}")
        order = Window.orderBy("_pid")
        goes_on = F.lag(F.lit(1)).over(order).isNotNull() & F.lag("_last").over(order).eqNullSafe(F.col("_first"))
        parts = parts.withColumn("_same", goes_on.cast("long"))
        rows = self._started(parts.withColumn("_new", F.col("_runs") - F.col("_same")), _start=_sum_before("_new") - F.col("_same"))
        return self._carried(rows, lambda start: _runs(key, start), col, T.LongType(), ["_start"])


def _sum_before(col: str) -> Column:
    """Sum over the partitions before (one row each)."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(col).over(before), F.lit(0))


def _runs(key: str, runs: int):
    """Run numbers of batch after batch: +1 where the key changes, and on the
    first row."""
    first, last = True, None

    def step(batch):
        nonlocal first, last, runs
        codes = batch.column(key).to_pylist()
        out = np.empty(len(codes), np.int64)
        for k, value in enumerate(codes):
            if first or value != last:
                runs += 1
                first, last = False, value
            out[k] = runs
        return pa.array(out)

    return step


def second_half(df: DataFrame, order_cols: list, reverse: bool = False) -> DataFrame:
    """Rows from position ``floor(n/2)`` on, after an optional reversal
    of the order (``iloc[::-1]`` then ``iloc[len//2:]``)."""
    cols = [(F.col(c) if isinstance(c, str) else c) for c in order_cols]
    if reverse:
        cols = [c.desc() for c in cols]
    pos = GlobalOrder(df, cols).with_position("_pos")
    n = pos.agg(F.count(F.lit(1))).first()[0]
    return pos.where(F.col("_pos") >= n // 2).drop("_pos")


def from_offset(df: DataFrame, order_cols: list[str], start: int) -> DataFrame:
    """Resume from a 0-based position."""
    return GlobalOrder(df, order_cols).with_position("_pos").where(F.col("_pos") >= start) \
                                                            .drop("_pos")


def head(df: DataFrame, order_cols: list, n: int = 10) -> DataFrame:
    """First ``n`` rows after an explicit order (a distributed top-n)."""
    return df.orderBy(*order_cols).limit(n)
