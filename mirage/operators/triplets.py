"""Triplet construction (W1) and global couple dedupe.

For each made-up term, its real terms are grouped by source; sources are
ordered by first appearance (lowest real id). Rotation ``i`` starts with
source ``i``; within a rotation, positions ``0..q-1`` take the real term at
that position as the secondary term and the one ``q`` places further as the
replacement. A couple (secondary, source, replacement, source) is stored only
the first time it appears, in order (made-up id, rotation, position).

Only the first ``2q`` rows of a rotation are ever read, and they come from
the ``2q`` lowest ids of each source, so every (made-up term, source) group is
cut to those rows first (a partial top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirage.functions.common import keep_first
from mirage.schemas import TRIPLET_INPUT_COLUMNS, require_columns

Q_PER_TERM = 3
COUPLE = ["secondary_id", "secondary_source", "replacement_id", "replacement_source"]


def candidate_triplets(links: DataFrame, q: int = Q_PER_TERM, compat: bool = True,
                       exclude_ids: list[int] | None = None) -> DataFrame:
    """W1 over rows ``(fake_term_id, real_term_id, source_id)`` (the combined
    terms view). ``compat`` stores the secondary term's source as the
    replacement's source, as the original does; otherwise the true one.
    Made-up terms with too few real terms yield the positions that exist."""
    fake, real, src = "fake_term_id", "real_term_id", "source_id"
    df = links.select(fake, real, src)
    if exclude_ids:
        df = df.where(~F.col(fake).isin(list(exclude_ids)))       # P2
    top = (df.withColumn("_rn", F.row_number().over(Window.partitionBy(fake, src).orderBy(real)))
             .where(F.col("_rn") <= 2 * q).drop("_rn"))
    top = top.withColumn("_first", F.min(real).over(Window.partitionBy(fake, src)))
    top = top.withColumn("_sr", F.dense_rank().over(Window.partitionBy(fake).orderBy("_first")) - 1)
    top = top.withColumn("_n", F.max("_sr").over(Window.partitionBy(fake)) + 1)
    rot = top.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    w = Window.partitionBy(fake, "rotation").orderBy(
        F.pmod(F.col("_sr") - F.col("rotation"), F.col("_n")), real)
    seq = (rot.withColumn("_pos", F.row_number().over(w))
              .withColumn("_rep", F.lead(real, q).over(w))
              .withColumn("_rep_src", F.lead(src, q).over(w)))
    out = seq.where((F.col("_pos") <= q) & F.col("_rep").isNotNull())
    return out.select(F.col(fake).cast("long").alias("nonexistent_id"),
                      F.col(real).cast("long").alias("secondary_id"),
                      F.col(src).cast("long").alias("secondary_source"),
                      F.col("_rep").cast("long").alias("replacement_id"),
                      F.col(src if compat else "_rep_src").cast("long").alias("replacement_source"),
                      F.col("rotation").cast("int"), (F.col("_pos") - 1).cast("int").alias("position"))


def build_triplets(links: DataFrame, q: int = Q_PER_TERM, compat: bool = True,
                   exclude_ids: list[int] | None = None) -> DataFrame:
    """W1 + W2: stored triplets, first made-up term wins each couple."""
    cand = candidate_triplets(links, q, compat, exclude_ids)
    return keep_first(cand, COUPLE, ["nonexistent_id", "rotation", "position"])


def triplets_from_file(terms: DataFrame, **kw) -> DataFrame:
    """P14 + W1 + W2 over a table of terms from outside, whose columns must be
    those of the combined terms view; the missing ones are named."""
    require_columns(terms, TRIPLET_INPUT_COLUMNS, "triplet input")
    return build_triplets(terms, **kw)


def short_groups(links: DataFrame, q: int = Q_PER_TERM) -> DataFrame:
    """Made-up terms with fewer than ``2q`` real terms (the original stops
    with an index error on them); reported instead of failing."""
    return (links.groupBy("fake_term_id").agg(F.count(F.lit(1)).alias("real_terms"))
                 .where(F.col("real_terms") < 2 * q))
