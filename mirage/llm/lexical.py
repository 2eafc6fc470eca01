"""Ranked lexical search by bags: equal documents are scored once.

1. Terms are maximal runs of ASCII letters, digits and characters beyond
   ASCII, A-Z in lower case. The items' terms are the vocabulary; documents
   are restricted to it: a bag is the ids and counts of a document's terms
   that are in the vocabulary.
2. Each task combines its documents of equal length (in terms) and equal bag
   before the shuffle. The ``top`` smallest ids of each are kept, as no more
   can be in a result.
3. Totals and document frequencies are sums over those rows. They give each
   term's weight and each document's length factor m.
4. Rows travel to the partition of a hash of (m, bag) and are sorted there;
   neighbours are compared byte by byte, equal ones are one class. Each class
   is scored once against the postings of all items; a task keeps the best
   ``top`` classes of each item (by score, then smallest member).
5. Those classes' members, in ascending order of their ids, give the task's
   best ``top`` documents of each item; the best of all tasks are the result.

The vocabulary and the postings are broadcast. They are bounded: items are
dealt into blocks of about ``BLOCK_TERMS`` terms, and an item of more is a
block of its own (as long as its text). Each block passes over the documents;
all blocks' results are returned.

Documents are rows: rows that repeat are ranked each, a missing id comes after
all others. Null text has no terms and is no document. Rows of the query table
that repeat (item_id, text) count once; different texts of one id are one
item. Items without terms, without a document, or without an id have no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirage.llm.common import NO_ID, materialise, pieces_of, ranges, text_of
from mirage.llm.words import raw_texts, slices

TOP = 20
#: Terms (with repeats) of the items in one block.
BLOCK_TERMS = 500_000
#: Bytes of bags that a task combines before it hands them on.
HELD = 32 << 20
#: Scores (items times classes) and postings computed at a time.
CELLS, POSTINGS = 1 << 21, 1 << 21
#: Largest sum that doubles add up exactly.
EXACT = 1 << 53
SCALE = 1_000_000_000

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM_BYTES else 0x20 for b in range(256))
_RESULT = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        for k, text in enumerate(raw_texts(batch.column(1))):
            got = Counter(terms(text))
            if got:
                yield pa.record_batch([batch.column(0).take(pa.array([k] * len(got))), pa.array(list(got), pa.binary()),
                                       pa.array(list(got.values()), pa.int64())], names=["item_id", "term", "q"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q) of ``items`` (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where("item_id is not null").select("item_id", text_of().alias("text")).distinct()
    split = rows.mapInArrow(_split_items, f"item_id {kind}, term binary, q long")
    return split.groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def bags(docs: DataFrame, vocabulary: list[bytes], top: int = TOP) -> DataFrame:
    """Documents with a term, combined by length and bag within each task:
    n (terms), bag (sorted ids of the vocabulary, then their counts, as 32-bit
    integers), members (smallest ids, ascending), rows."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(known.value)}
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.binary()),
                                   pa.array([v[0] for v in held.values()], pa.list_(pa.int64())),
                                   pa.array([v[1] for v in held.values()], pa.int64())], names=["n", "bag", "members", "rows"])
            held.clear()
            return got

        for batch in slices(batches, "text"):
            for ident, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found = terms(text)
                if not found:
                    continue
                count = Counter(found)
                pairs = sorted([(number[t], c) for t, c in count.items() if t in number])
                bag = np.array(pairs, "<i4").reshape(-1, 2).T.tobytes()
                row = held.get((len(found), bag))
                if row is None:
                    held[len(found), bag] = [[ident], 1]
                    size += len(bag) + 200
                else:
                    row[1] += 1
                    if len(row[0]) < top or ident < row[0][-1]:
                        row[0] = sorted([*row[0], ident])[:top]
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(restrict, "n long, bag binary, members array<long>, rows long")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term id, added up within a task."""
    df = np.zeros(0, np.int64)
    for batch in batches:
        sizes = [len(b) // 8 for b in batch.column(0).to_pylist()]
        ids = np.concatenate([np.frombuffer(b, "<i4", n) for b, n in zip(batch.column(0).to_pylist(), sizes)] or [df])
        got = np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes)).astype(np.int64)
        if len(got) > len(df):
            df, got = got, df
        df[:len(got)] += got
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["id", "df"])


class _Best:
    """The best classes of each item: by score, then smallest member."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item = self.score = self.first = self.at = np.zeros(0, np.int64)
        self.least = np.zeros(n_items, np.int64)  # a class below it is out
        self.members: dict[int, list[int]] = {}
        self.classes = 0

    def add(self, scores: np.ndarray, members: list[list[int]]) -> None:
        """``scores``: a row for each class, a column for each item."""
        least = np.maximum(self.least, 1)
        if len(scores) > self.top:  # of this block alone, as many are better
            least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        first = np.array([m[0] for m in members], np.int64)
        self.members.update(zip(range(self.classes, self.classes + len(members)), members))
        item, score = np.r_[self.item, item], np.r_[self.score, scores[row, item]]
        first, at = np.r_[self.first, first[row]], np.r_[self.at, self.classes + row]
        self.classes += len(members)
        order = np.lexsort((first, -score, item))
        item = item[order]
        start = np.searchsorted(item, item)
        keep = np.arange(len(item)) - start < self.top
        order = order[keep]
        self.item, self.score, self.first, self.at = item[keep], score[order], first[order], at[order]
        last = np.arange(len(item))[keep] - start[keep] == self.top - 1
        self.least[self.item[last]] = self.score[last]
        still = set(self.at.tolist())
        self.members = {k: m for k, m in self.members.items() if k in still}

    def documents(self) -> tuple[list[int], list[int], list[int]]:
        items, ids, scores = [], [], []
        at, now, have = 0, -1, 0
        while at < len(self.item):
            if self.item[at] != now:
                now, have = self.item[at], 0
            end = at  # classes of one item and score
            while end < len(self.item) and self.item[end] == now and self.score[end] == self.score[at]:
                end += 1
            got = sorted(x for k in self.at[at:end].tolist() for x in self.members[k])[:self.top - have]
            have += len(got)
            items += [int(now)] * len(got)
            ids += got
            scores += [int(self.score[at])] * len(got)
            at = end
        return items, ids, scores


def score_classes(m: np.ndarray, bags: list[bytes], start: np.ndarray, item: np.ndarray, weight: np.ndarray, n_items: int, exact: bool) -> np.ndarray:
    """Scores of classes (m, bag) for all items. A term's postings are
    ``item`` and ``weight`` from ``start`` of its id to that of the next.
    ``exact``: doubles hold all sums."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    both = [np.frombuffer(b, "<i4").reshape(2, -1) for b in bags]
    ids = np.concatenate([b[0] for b in both])
    tf = np.concatenate([b[1] for b in both]).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), sizes)
    value = (SCALE * tf) // (1000 * tf + 12 * m[row])
    lengths = start[ids + 1] - start[ids]
    total = np.zeros(len(bags) * n_items, np.int64)
    part = np.cumsum(lengths) // POSTINGS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts, cuts[1:]):
        at = ranges(start[ids[a:b]], lengths[a:b])
        cell = np.repeat(row[a:b] * n_items, lengths[a:b]) + item[at]
        gain = weight[at] * np.repeat(value[a:b], lengths[a:b])
        if exact:
            total += np.bincount(cell, gain, len(total)).astype(np.int64)
        else:
            np.add.at(total, cell, gain)
    return total.reshape(len(bags), n_items)


def _search_block(docs: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """Results of the items of one block, ``words`` (item_id, term, q)."""
    spark = docs.sparkSession
    rows = words.select("item_id", "term", "q").toArrow()  # bounded by the block
    names, owners = np.unique(rows.column(0).to_numpy(), return_inverse=True)
    vocabulary = sorted(set(rows.column(1).to_pylist()))
    number = {t: k for k, t in enumerate(vocabulary)}
    kind = words.schema["item_id"].dataType.simpleString()
    found = materialise(bags(docs, vocabulary, top), "bags")
    totals = found.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("n"))).first()
    n_docs, n_terms = int(totals[0] or 0), int(totals[1] or 0)
    if not n_docs or not vocabulary:
        return spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    counts = found.select("bag", "rows").mapInArrow(_frequencies, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts.toLocalIterator():  # a row a term of the block
        df[r.id] = r.df
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    ids = np.array([number[t] for t in rows.column(1).to_pylist()], np.int64)
    order = np.argsort(ids, kind="stable")
    item = owners[order].astype(np.int64)
    weight = (rows.column(2).to_numpy() * w[ids])[order]
    start = np.searchsorted(ids[order], np.arange(len(vocabulary) + 1))
    exact = bool(np.bincount(item, weight.astype(float)).max() * (SCALE // 1000) < EXACT)
    postings = spark.sparkContext.broadcast((start, item, weight))
    n_items = len(names)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, item, weight = postings.value
        best = _Best(n_items, top)
        ms: list[int] = []
        texts: list[bytes] = []
        members: list[list[int]] = []

        def score(upto: int) -> None:
            if upto:
                best.add(score_classes(np.array(ms[:upto], np.int64), texts[:upto], start, item, weight, n_items, exact), members[:upto])
                del ms[:upto], texts[:upto], members[:upto]

        most = max(1, CELLS // n_items)
        for batch in batches:
            for m, bag, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ms and ms[-1] == m and texts[-1] == bag:
                    members[-1] = sorted(members[-1] + ids)[:top]
                else:
                    if len(ms) >= most:
                        score(len(ms))
                    ms.append(m)
                    texts.append(bag)
                    members.append(ids)
        score(len(ms))
        got = best.documents()
        yield pa.record_batch([pa.array(got[0], pa.int32()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64())],
                              names=["item", "doc_id", "score"])

    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    classes = found.where(F.octet_length("bag") > 0).select(m.cast("long").alias("m"), "bag", "members").withColumn("hash", F.xxhash64("m", "bag"))
    classes = classes.repartition("hash").sortWithinPartitions("hash", "m", "bag").select("m", "bag", "members")
    ranked = classes.mapInArrow(rank, _RESULT)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    label = spark.createDataFrame(list(enumerate(names.tolist())), f"item int, item_id {kind}")
    return ranked.join(F.broadcast(label), "item").select("item_id", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for each row of
    ``items`` (item_id, text): item_id, rank (from 1), doc_id, score (above 0,
    highest first, equal ones by ascending doc_id)."""
    words = materialise(item_terms(items), "items")
    n_blocks = pieces_of(words.agg(F.sum("q")).first()[0] or 0, block_terms)
    found = None
    for k in range(n_blocks):
        block = words.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        got = _search_block(docs, block, top)
        got = materialise(got, "ranked") if n_blocks > 1 else got
        found = got if found is None else found.unionByName(got)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item_id", F.row_number().over(place).alias("rank"), "doc_id", "score")
