"""Spelling variants: words one insertion, deletion or replacement apart, found
by sorted permuterm rotations.

1. Words are the maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF in
   whole texts, A-Z in lower case. (A run whose hash with its document's id is
   a multiple of ``DROP_EVERY`` loses one letter first: planted misspellings.)
   Each task counts its own words, the shuffle adds the counts.
2. A word is closed by a mark that no word holds, and rotated. A rotation that
   ends in the letter before the edited place is a row (prefix without that
   letter, the letter); the rotation itself is a row (rotation, no letter).
3. Rows sorted by that prefix stand in groups. Two words with one prefix and
   different letters differ by a replacement, a word whose rotation is the
   prefix itself by the letter's deletion, and by nothing else. A pair that
   differs by one of several equal letters in a row meets once for each of
   them; only the first of the run counts.
4. A group holds a word for each letter of the alphabet at most (91 rows), and
   its words are counted and their best neighbour found in place: no pair is
   emitted. Counts and best neighbours are then added up by word.
5. Forms point to words at least ``RATIO`` times as frequent, so chains are
   short and have no cycle; roots are found by doubling.

Null text has no words; a null id counts as the empty text in the hash. Rows
that repeat count each. No rows, or no word that is frequent enough, give no
rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage.llm.common import materialise, text_of
from mirage.llm.words import raw_texts, slices

MARK = "$"
DROP_EVERY = 31
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Different words a task counts before it hands them on.
HELD = 300_000


def _counter(min_length: int, drop_every: int):
    # After bytes.lower(), which changes A-Z only.
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = [(w, n) for w, n in total.items() if n]
            total.clear()
            return pa.record_batch([pa.array([w for w, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for ident, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                words = run(text.lower().decode("utf-8"))
                total.update(words)
                seed = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for w in set(words):
                    h = zlib.crc32(w.encode(), seed)
                    if h % drop_every == 0:
                        n, at = words.count(w), h % len(w)
                        total[w] -= n
                        if len(w) > min_length:
                            total[w[:at] + w[at + 1:]] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    return count


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): words of at least ``min_length``
    code points that occur ``min_count`` times or more."""
    counts = docs.select("doc_id", text_of().alias("text")).mapInArrow(_counter(min_length, drop_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (key, letter, first, n) of all rotations of ``words`` (word, n):
    the prefix, the letter that is edited ('' for the whole rotation), and
    whether it is the first of its run of equal letters."""
    at = F.col("at")
    head, tail = F.substr("word", F.lit(1), at), F.substr("word", at + 1)
    rows = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    rows = rows.select("n", "at", head.alias("head"), F.concat(tail, F.lit(MARK)).alias("tail"))
    letter = F.right("head", F.lit(1))
    short = F.substr("head", F.lit(1), at - 1)
    whole = F.struct(F.concat("tail", "head").alias("key"), F.lit("").alias("letter"), F.lit(True).alias("first"))
    cut = F.struct(F.concat("tail", short).alias("key"), letter.alias("letter"), (F.right(short, F.lit(1)) != letter).alias("first"))
    return rows.select("n", F.explode(F.when(at > 0, F.array(whole, cut)).otherwise(F.array(whole))).alias("r")).select(
        F.col("r.key").alias("key"), F.col("r.letter").alias("letter"), F.col("r.first").alias("first"), "n")


def _word(key: Column, letter: Column) -> Column:
    """The word whose rotation is ``key`` and ``letter``."""
    at = F.locate(MARK, key)
    return F.concat(F.substr(key, at + 1), letter, F.substr(key, F.lit(1), at - 1))


def neighbours(words: DataFrame) -> DataFrame:
    """For each word of ``words`` (word, n; each word once) that is near
    another: word, n_near, and its near word of largest n (of equal ones the
    first in code-point order) as form with form_n."""
    group = Window.partitionBy("key")
    rows = rotations(words).withColumn("size", F.count(F.lit(1)).over(group)).where("size > 1")
    rows = rows.select("key", "letter", "first", "n", _word(F.col("key"), F.col("letter")).alias("word"))
    whole = F.col("letter") == ""
    best = F.struct((-F.col("n")).alias("rank"), F.col("word"))
    # The letters' rows in order of preference, the whole rotation after them.
    order = group.orderBy(whole, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "word", "first", whole.alias("whole"), best.alias("own"),
        F.count(F.when(~whole, 1)).over(group).alias("letters"),
        F.count(F.when(~whole & F.col("first"), 1)).over(group).alias("firsts"),
        F.min(F.when(~whole & F.col("first"), best)).over(group).alias("best_first"),
        F.min(F.when(whole, best)).over(group).alias("shorter"),
        F.first(F.when(~whole, best)).over(order).alias("best"),
        F.nth_value(F.when(~whole, best), 2).over(order).alias("second"))
    other = F.when(F.col("best") == F.col("own"), F.col("second")).otherwise(F.col("best"))
    shorter = F.when(F.col("first"), F.col("shorter"))
    rows = rows.select(
        "word", F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("letters") - 1 + shorter.isNotNull().cast("int")).alias("near"),
        F.when(F.col("whole"), F.col("best_first")).otherwise(F.least(other, shorter)).alias("best"))
    found = rows.where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last of word, form, form of
    the form and so on. Every round doubles the steps taken."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = materialise(new, "roots")
        state = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return state


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      drop_every: int = DROP_EVERY) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form (its most
    frequent near word, if at least ``ratio`` times as frequent), root (the
    last form from word on; the word itself if it has none), n, n_near, form_n."""
    words = materialise(word_counts(docs, min_length, min_count, drop_every), "words")
    near = words.join(neighbours(words), "word", "left")
    better = F.col("form_n") >= F.col("n") * ratio
    near = materialise(near.select("word", F.when(better, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(better, F.col("form_n")).alias("form_n")), "near")
    chains = roots(near.where("form is not null"))
    return near.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
