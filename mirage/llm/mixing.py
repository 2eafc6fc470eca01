"""Mixing sources to target weights: hierarchical budgeting.

Documents are the leaves' contents of a tree domain - language - source. A
token budget flows down the tree: every node deals its budget to its children
by their weights, none above its capacity (``epochs`` times the tokens below
it); what one child cannot take goes to its siblings by their weights, and only
what all of them cannot take stays with the node's own siblings, because a
node's capacity is that of its whole subtree. All amounts are integers
(weights too), so shares are exact: floor(weight * rest / weights of the rest).

A leaf's documents form one sequence per epoch, ordered by a seeded hash, the
epochs one after the other; the leaf takes the prefix of its budget, the last
document possibly in part. The cut is found level by level: token sums by the
first two hex digits of the hash, then, inside the digits where the budget
ends, by the next two, and so on; only the documents that share the digits of
the first ``LEVELS`` levels with the cut are put in order themselves. Where
more than ``CELL`` of a leaf share them, ids repeat: the levels go on, through
the rest of the hash and then its second and third part. No leaf's rows meet in
one task, however large it is; what does meet are the sums of a node's
children, one row for each name below it.

Tokens are words (runs of anything but ASCII white space); null or empty text
has none and is never taken. Missing domains, languages or sources are nodes
named ''. Nodes without a weight get 1; weights below 0 count as 0, and such a
node gets only what its siblings cannot take. Rows with equal ids (or without)
come one after the other in an epoch, in the order of a second hash, of the
text, and rows that repeat the text too in that of a third, of a number stored
with the row: every leaf takes exactly its budget and cuts one document at
most. No rows give no rows. Columns named like an output are replaced.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage.llm.common import materialise, text_of

TREE = ["domain", "lang", "source"]
#: Levels of two hex digits (256 parts each) before rows are ordered.
LEVELS = 3
#: Hex digits of each hash, and the digits of all levels: LEVELS of two in each
#: hash, then the rest of it.
DIGITS = 32
WIDTHS = [DIGITS * part + n for part in range(3) for n in [*range(2, 2 * LEVELS + 1, 2), DIGITS]]
#: Rows of a leaf that may share the digits of LEVELS levels and be ordered.
CELL = 1000
OUT = ["epoch", "n_tokens", "take_tokens"]
BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each row of ``children`` (parent columns, name, weight, capacity,
    and its parent's budget as ``budget``) its own ``budget``.

    Children in order of capacity per weight: one is full if its share of what
    the ones before leave reaches its capacity; from the first that is not, all
    get their share."""
    # Weight 0 comes last: it gets what nothing else can take, by capacity.
    ratio = F.when(F.col("weight") > 0, (F.col("capacity") / F.col("weight")).cast("double"))
    w = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), F.col("capacity"), F.col(name))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (children.withColumn("_spent", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("long"))
            .withColumn("_rest", F.sum("weight").over(after).cast("long"))
            .withColumn("_left", F.greatest(F.col("budget") - F.col("_spent"), F.lit(0)))
            .withColumn("_full", F.col("weight").cast(BIG) * F.col("_left").cast(BIG) >= F.col("capacity").cast(BIG) * F.col("_rest").cast(BIG)))
    # From the first child on that is not full, all shares are of what is left there.
    whole = Window.partitionBy(*parent).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(~F.col("_full"), F.struct("_spent", "_rest"))).over(whole)
    rows = rows.withColumn("_cut", first)
    left = F.greatest(F.col("budget") - F.col("_cut._spent"), F.lit(0))
    share = F.col("weight").cast(BIG) * left.cast(BIG)
    amount = F.when(F.col("_cut").isNull() | (F.col("_spent") < F.col("_cut._spent")), F.least("capacity", "_left")).otherwise(
        F.least("capacity", F.floor(share / F.greatest(F.col("_cut._rest"), F.lit(1)).cast(BIG)).cast("long")))
    return rows.withColumn("budget", amount).drop("_spent", "_rest", "_left", "_full", "_cut")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: Column, epochs: int) -> DataFrame:
    """``leaves`` (the tree's columns, tokens) with ``budget``."""
    def weight(level: str) -> Column:
        of = weights.get(level, {})
        out = F.lit(1)
        for k, v in of.items():
            out = F.when(F.col(level) == k, F.lit(max(0, int(v)))).otherwise(out)
        return out.cast("long")

    capacity = leaves.withColumn("capacity", F.col("tokens") * epochs)
    rows = capacity.groupBy(*TREE[:1]).agg(F.sum("capacity").alias("capacity"))
    root = capacity.agg(F.sum("tokens").alias("_all")).select(total.cast("long").alias("budget"), F.lit(0).alias("_root"))
    rows = rows.withColumn("_root", F.lit(0)).join(F.broadcast(root), "_root")  # one row
    rows = deal(rows.withColumn("weight", weight(TREE[0])), ["_root"], TREE[0]).select(*TREE[:1], "budget")
    for depth in range(1, len(TREE)):
        level = capacity.groupBy(*TREE[:depth + 1]).agg(F.sum("capacity").alias("capacity"))
        level = level.withColumn("weight", weight(TREE[depth])).join(rows, TREE[:depth])
        rows = deal(level, TREE[:depth], TREE[depth]).select(*TREE[:depth + 1], "budget")
    return leaves.join(rows, TREE)


def mix_sources(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: float = 0.9,
                epochs: int = 1, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) that the mix takes,
    with epoch (from 0), n_tokens and take_tokens (fewer only for a leaf's last
    document). The budget is ``share`` of all tokens, rounded down; ``weights``
    maps a level of the tree to integer weights by name (others are an error);
    ``domain`` gives a row's domain."""
    for level, of in weights.items():
        for name, w in of.items():
            if int(w) != w:
                raise ValueError(f"the weight of {level} {name!r} is no integer: {w}")
    if not 0 <= share < float("inf"):
        raise ValueError(f"share: {share}")
    cols = [c for c in docs.columns if c not in OUT]
    rows = docs.select(F.struct(*cols).alias("row"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("string").alias("_id"), F.md5(text_of()).alias("_text"),
                       F.monotonically_increasing_id().alias("_row"), n_words(text_of()).alias("n_tokens"))
    # Stored with the documents' own columns: a row's number is the same in
    # every pass, and words are counted once. (No filter before the table: it
    # would count the words twice.) The narrow columns decide.
    rows = materialise(rows, "tokens").where("n_tokens > 0")
    narrow = rows.drop("row")
    leaves = materialise(narrow.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    part = Fraction(str(share))  # as written: 0.8 is 4/5
    total = F.floor((F.col("_all").cast(BIG) * F.lit(part.numerator).cast(BIG) - F.pmod(
        F.col("_all").cast(BIG) * F.lit(part.numerator).cast(BIG), F.lit(part.denominator).cast(BIG))) / F.lit(part.denominator).cast(BIG))
    budgets = materialise(leaf_budgets(leaves, weights, total, epochs), "budgets")
    # Whole epochs, and the rest that falls into one epoch.
    budgets = budgets.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("tokens"))

    def place(*of: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), *of))

    key = F.concat(place(F.coalesce("_id", F.lit("null"))), place(F.lit("text"), F.col("_text")), place(F.lit("row"), F.col("_row").cast("string")))
    cut = budgets.where("rest > 0").select(*TREE, "whole", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("spent"))
    keyed = narrow.join(cut.select(*TREE, "whole"), TREE).withColumn("_key", key)
    for level, width in enumerate(WIDTHS):
        if level >= LEVELS and not cut.where(F.col("n") > CELL).limit(1).count():
            break
        part = F.substring("_key", 1, width)
        inside = keyed.join(cut.select(*TREE, "prefix"), TREE).where(F.col("_key").startswith(F.col("prefix")))
        sums = inside.groupBy(*TREE, part.alias("part")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))  # 256 rows a leaf at most
        w = Window.partitionBy(*TREE).orderBy("part")
        sums = sums.join(cut.select(*TREE, "whole", "rest", "spent"), TREE).withColumn("_end", F.col("spent") + F.sum("tokens").over(w))
        cut = materialise(sums.where("_end >= rest").groupBy(*TREE, "whole", "rest").agg(
            F.min(F.struct("part", (F.col("_end") - F.col("tokens")).alias("spent"), "n")).alias("_c"))
            .select(*TREE, "whole", "rest", F.col("_c.part").alias("prefix"), F.col("_c.spent").alias("spent"), F.col("_c.n").alias("n")), "cut")
    # Documents at the cut, in order: few, as they share all digits.
    at = keyed.join(cut.select(*TREE, "prefix", "rest", "spent"), TREE).where(F.col("_key").startswith(F.col("prefix")))
    w = Window.partitionBy(*TREE).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    last = at.withColumn("_start", F.col("spent") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    last = last.where("_start < rest").groupBy(*TREE).agg(
        F.max(F.struct("_key", "_start")).alias("_l")).select(*TREE, F.col("_l._key").alias("last"), F.col("_l._start").alias("last_start"))
    plan = materialise(budgets.select(*TREE, "whole", "rest").join(last, TREE, "left"), "plan")

    got = rows.join(plan, TREE).withColumn("_key", key)
    end = F.when(F.col("_key") < F.col("last"), F.col("n_tokens")).when(
        F.col("_key") == F.col("last"), F.least("n_tokens", F.col("rest") - F.col("last_start")))
    taken = F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.coalesce(end, F.lit(0)))
    got = got.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).withColumn("take_tokens", taken)
    return got.where("take_tokens > 0").select(*[F.col("row")[c].alias(c) for c in cols], F.col("epoch").cast("int").alias("epoch"), "n_tokens", "take_tokens")


def taken_text() -> Column:
    """The first take_tokens words of the text, white space between (and
    before) them as it is; the whole text where all are taken."""
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.when(F.col("take_tokens") < F.col("n_tokens"), F.array_join(F.slice(parts, F.lit(1), F.col("take_tokens").cast("int")), "")).otherwise(F.col("text"))
