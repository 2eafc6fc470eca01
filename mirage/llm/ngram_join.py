"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of five consecutive words (runs of anything but
ASCII white space, unchanged; a shorter text is one shingle of all its words).
Two documents are linked when the Jaccard similarity of their sets is at least
the threshold.

1. Texts with the same words are one class: its size is counted, its copies
   are never expanded into pairs.
2. Each class has ``HASHES`` MinHash values. Classes that agree on a band of
   ``BAND`` values are candidates; with 24 bands of 4, a pair at 0.8 shares no
   band with probability 3e-6.
3. In a band's bucket the values are compared step by step; a pair is dropped
   once the posterior probability (uniform prior) that its similarity reaches
   the threshold is below ``TOLERANCE``. What is left gives a spanning forest
   per bucket, and the forests' components are clusters: every pair still in
   question lies within one.
4. A cluster's members meet once with their texts. Pairs pass the same test
   on their MinHash values and are then verified exactly on the shingles.
   Links are counted where they are found; only counts and a spanning forest
   leave the task.

Buckets and clusters larger than ``CHUNK`` members are split into chunks, one
task group for each pair of chunks, so that no group grows with its key.

Null or empty text has no shingles and is linked with nothing, copies
included. A missing id comes after every other id. Repeated rows are copies.
Other columns are not read.

``near_dedup`` keeps one row of each group. An id that is null or repeats says
nothing about a row's text, so it decides by class: of a group's classes the
one with the smallest id, then digest, stays, by one row with that id.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from mirage.llm.common import NO_ID, components, forest, materialise, text_of
from mirage.llm.words import Words, mix, raw_texts, runs_hash, slices

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BAND = 96, 4
STEP = 16
TOLERANCE = 1e-6
CHUNK = 1024
#: Bytes of the texts of a chunk, about (or one text).
CHUNK_BYTES = 32 << 20

_RNG = np.random.default_rng(20240517)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@lru_cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number n of compared values (STEP, 2 STEP, ...): the fewest
    matches with which P(similarity >= threshold | matches) is at least
    ``tolerance``. With a uniform prior the posterior is Beta(m + 1, n - m + 1),
    whose upper tail is a binomial sum over n + 1 trials."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):
            # P(S >= t) = P(at most m of n + 1 uniform draws lie below t)
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (rows of HASHES) and number of words of each text."""
    words = Words(texts)
    n = len(words.hash)
    out = np.zeros((len(texts), HASHES), np.uint32)
    h = runs_hash(words.hash, SHINGLE)
    inside = np.flatnonzero(words.text[:len(h)] == words.text[SHINGLE - 1:]) if len(h) else np.zeros(0, np.int64)
    owner, h = words.text[inside], h[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        own = [np.frombuffer(hashlib.blake2b(b" ".join(texts[i].split()), digest_size=8).digest(), np.uint64)[0] for i in short.tolist()]
        owner, h = np.r_[owner, short], np.r_[h, np.array(own, np.uint64)]
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    if n:
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for k in range(HASHES):
            out[owner[first], k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out, words.count


def _bands(values: np.ndarray) -> np.ndarray:
    n = HASHES // BAND
    h = np.zeros((len(values), n), np.uint64)
    for k in range(BAND):
        h = mix(h * np.uint64(31) + values[:, k::BAND].astype(np.uint64) + np.uint64(1))
    return mix(h + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that survive the Bayesian test on their
    MinHash values; with ``same`` only pairs of different rows, each once."""
    i = j = None
    got = None
    for step, need in enumerate(least_matches(threshold)):
        cols = range(step * STEP, (step + 1) * STEP)
        if i is None:
            match = np.zeros((len(a), len(b)), np.uint8)
            for k in cols:
                match += a[:, k][:, None] == b[:, k][None, :]
            keep = match >= need
            if same:
                keep = np.triu(keep, 1)
            i, j = np.nonzero(keep)
            got = match[i, j].astype(np.int32)
        elif len(i):
            for lo in range(0, len(i), 200_000):
                s = slice(lo, lo + 200_000)
                got[s] += (a[i[s], cols.start:cols.stop] == b[j[s], cols.start:cols.stop]).sum(1, dtype=np.int32)
            keep = got >= need
            i, j, got = i[keep], j[keep], got[keep]
    return i, j


def jaccard(texts: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact similarity of the shingle sets of the pairs (i, j). Shingles are
    told apart by their words, not by a hash."""
    ids: dict[bytes, int] = {}
    sets = [None] * len(texts)
    for k in np.unique(np.r_[i, j]).tolist():
        w = texts[k].split()
        runs = {b" ".join(w[p:p + SHINGLE]) for p in range(max(1, len(w) - SHINGLE + 1))} if w else set()
        sets[k] = np.array(sorted(ids.setdefault(s, len(ids)) for s in runs), np.int64)
    size = np.array([0 if s is None else len(s) for s in sets], np.int64)
    both = np.zeros(len(i), np.int64)
    if len(i) <= 4 * len(texts):
        for p, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            both[p] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:  # many pairs of few members: by blocks of an incidence matrix
        rows = np.concatenate([np.full(n, k) for k, n in enumerate(size.tolist())])
        cols = np.concatenate([s for s in sets if s is not None])
        total = np.zeros((len(texts), len(texts)), np.float32)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        edges = np.searchsorted(cols, np.arange(0, len(ids) + 4096, 4096))
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = np.zeros((len(texts), 4096), np.float32)
            part[rows[lo:hi], cols[lo:hi] - 4096 * b] = 1
            total += part @ part.T
        both = total[i, j].astype(np.int64)
    return both / (size[i] + size[j] - both)


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns in sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*cols))
        at = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[at]:
                if held and last != rows[at]:
                    yield last, held
                    held = []
                held.append(batch.slice(at, k - at))
                last, at = rows[at], k
    if held:
        yield last, held


def _halves(parts, key, name):
    """The rows of a chunk pair: row numbers of either chunk, or of the one."""
    chunk = np.concatenate([p.column(name).to_numpy() for p in parts])
    lo, hi = key[1], key[2]
    return np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi), lo == hi


def _chunked(rows: DataFrame, key: str, size: str, member: str, chunk: int, held: str | None = None) -> DataFrame:
    """One row per pair of chunks that a member takes part in: key, lo, hi.
    ``held`` is a key's bytes of text: chunks are also of ``CHUNK_BYTES`` or
    less, about."""
    n = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    if held:
        n = F.greatest(n, F.ceil(F.col(held) / F.lit(CHUNK_BYTES)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(member), n).cast("int"))
    other = F.explode(F.sequence(F.lit(0), n - 1))
    rows = rows.withColumn("_o", other)
    return rows.withColumn("lo", F.least("chunk", "_o")).withColumn("hi", F.greatest("chunk", "_o")).drop("_o")


def _column(parts, name):
    return [x for p in parts for x in p.column(name).to_pylist()]


def classes(docs: DataFrame) -> DataFrame:
    """doc_id (stand-in for none), hash and bytes of the text, digest of the
    words (null without words), MinHash values, bands."""
    def work(batches):
        for part in slices(batches, "text"):
            texts = raw_texts(part.column(3))
            values, count = signatures(texts)
            keys = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if n else None for t, n in zip(texts, count.tolist())]
            bands = _bands(values)
            n = HASHES // BAND
            yield pa.record_batch([*part.columns[:3], pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in values], pa.binary()),
                                   pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(texts) + 1, n, dtype=np.int32)), pa.array(bands.ravel()))],
                                  names=["id", "hash", "bytes", "digest", "values", "bands"])

    return _texts(docs).mapInArrow(work, "id long, hash long, bytes long, digest binary, values binary, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    """id, and the text with its hash: together they name a row's text even
    where ids are missing or repeat."""
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("id"), F.xxhash64(text).alias("hash"),
                       F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))


def _forest_edges(batches, threshold: float):
    for key, parts in _groups(batches, 3):
        left, right, same = _halves(parts, key, "chunk")
        if not len(left) or not len(right) or (same and len(left) < 2):
            continue
        digest = _column(parts, "digest")
        values = np.frombuffer(b"".join(_column(parts, "values")), np.uint32).reshape(-1, HASHES)
        i, j = likely(values[left], values[right], same, threshold)
        if len(i):
            got = forest(len(digest), left[i], right[j])
            yield pa.record_batch([pa.array([digest[a] for a, _ in got], pa.binary()), pa.array([digest[b] for _, b in got], pa.binary())],
                                  names=["a", "b"])


def _verify(batches, threshold: float):
    for key, parts in _groups(batches, 3):
        left, right, same = _halves(parts, key, "chunk")
        if not len(left) or not len(right) or (same and len(left) < 2):
            continue
        digest, rows = _column(parts, "digest"), np.array(_column(parts, "rows"), np.int64)
        values = np.frombuffer(b"".join(_column(parts, "values")), np.uint32).reshape(-1, HASHES)
        i, j = likely(values[left], values[right], same, threshold)
        if not len(i):
            continue
        i, j = left[i], right[j]
        texts = [t for p in parts for t in raw_texts(p.column("text"))]
        good = jaccard(texts, i, j) >= threshold
        i, j = i[good], j[good]
        links = np.bincount(i, rows[j], len(digest)) + np.bincount(j, rows[i], len(digest))
        at = np.flatnonzero(links).tolist()
        got = forest(len(digest), i, j)
        yield pa.record_batch([pa.array([digest[k] for k in at] + [digest[a] for a, _ in got], pa.binary()),
                               pa.array([None] * len(at) + [digest[b] for _, b in got], pa.binary()),
                               pa.array([int(links[k]) for k in at] + [0] * len(got), pa.int64())], names=["a", "b", "links"])


def _linked(docs: DataFrame, threshold: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``classes`` of the rows of ``docs``, and one row per class: digest, own
    (smallest id), rows, least and first (smallest id of its group, and digest
    of the first class with it; null where nothing is linked), links."""
    every = materialise(classes(docs), "signatures")
    cls = materialise(every.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("id", "hash", "bytes")).alias("_r"), F.count(F.lit(1)).alias("rows"), F.first("values").alias("values"),
        F.first("bands").alias("bands")).select("digest", "_r.*", "rows", "values", "bands"), "classes")

    # Buckets with at least two classes; their members with MinHash values.
    band = cls.select("digest", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _chunked(band.join(shared, "band"), "band", "n", "digest", chunk)
    buckets = members.join(cls.select("digest", "values"), "digest").select("band", "lo", "hi", "chunk", "digest", "values")
    edges = (buckets.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "digest")
             .mapInArrow(lambda b: _forest_edges(b, threshold), "a binary, b binary"))
    clusters = components(edges)

    # Clusters with texts, verified.
    members = clusters.withColumnRenamed("node", "digest").join(cls.select("digest", "id", "hash", "bytes", "rows", "values"), "digest")
    members = members.join(members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("held")), "label")
    found = _same_text(members.join(_texts(docs).drop("bytes"), ["id", "hash"]))
    pairs = _chunked(found, "label", "n", "digest", chunk, "held").select("label", "lo", "hi", "chunk", "digest", "rows", "values", "text")
    links = materialise(pairs.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "digest")
                        .mapInArrow(lambda b: _verify(b, threshold), "a binary, b binary, links long"), "links")

    label = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    smallest = label.join(cls.select("digest", "id"), "digest").groupBy("label").agg(F.min(F.struct("id", "digest")).alias("_m"))
    smallest = smallest.select("label", F.col("_m.id").alias("least"), F.col("_m.digest").alias("first"))
    count = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    table = (cls.select("digest", F.col("id").alias("own"), "rows").join(label.join(smallest, "label").drop("label"), "digest", "left")
             .join(count, "digest", "left"))
    return every, table


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (smallest
    doc_id that links, directly or through others, connect it to), n_links
    (other rows linked directly, copies included), kept (doc_id = class_id)."""
    every, table = _linked(docs, threshold, chunk)
    out = every.select("id", "digest").join(table, "digest", "left")
    class_id = F.coalesce("least", "own", "id")
    none = F.lit(None).cast("long")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).otherwise(none).alias("doc_id"),
                      F.when(class_id != NO_ID, class_id).otherwise(none).alias("class_id"),
                      (F.coalesce("links", F.lit(0)) + F.coalesce("rows", F.lit(1)) - 1).alias("n_links"),
                      (F.col("id") == class_id).alias("kept"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that stay: one of each group of
    linked texts, and every row without words."""
    every, table = _linked(docs, threshold, chunk)
    keep = table.where("first is null or first = digest").select(F.col("own").alias("_near_id"), F.col("digest").alias("_near_keep"))
    alone = every.where("digest is null").select(F.col("id").alias("_near_id"), F.col("digest").alias("_near_keep")).distinct()
    # The other columns as one struct: they may have any names.
    others = F.struct(*[c for c in docs.columns if c != "text"])
    rows = _with_digest(docs.select("text", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("_near_own"), others.alias("_near_carry")))
    same = (F.col("_near_own") == F.col("_near_id")) & F.col("_near_digest").eqNullSafe(F.col("_near_keep"))
    rows = rows.join(keep.union(alone), same, "left_semi")
    # Only where rows repeat id and words is a second shuffle of the texts needed.
    if every.where("digest is not null").groupBy("digest", "id").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("_near_digest").orderBy(F.xxhash64("_near_carry", "text"), F.to_json(F.struct("_near_carry", "text")))
        wordless = F.col("_near_digest").isNull()
        some = rows.where(~wordless).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        rows = some.unionByName(rows.where(wordless))
    return rows.select(*[F.col("text") if c == "text" else F.col("_near_carry")[c].alias(c) for c in docs.columns])


def _with_digest(docs: DataFrame) -> DataFrame:
    """``docs`` with _near_digest: the digest that ``classes`` gives the text."""
    at = docs.columns.index("text")

    def work(batches):
        for part in slices(batches, "text"):
            words = [t.split() for t in raw_texts(part.column(at))]
            keys = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
            yield pa.record_batch([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "_near_digest"])

    return docs.mapInArrow(work, StructType(list(docs.schema.fields)).add("_near_digest", BinaryType()))


def _same_text(found: DataFrame) -> DataFrame:
    """One row per digest: the text whose words have that digest (rows that
    repeat id and text bring it several times, equal hashes another text)."""
    def check(batches):
        for part in slices(batches, "text"):
            keep = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() == d
                    for t, d in zip(raw_texts(part.column("text")), part.column("digest").to_pylist())]
            yield part.filter(pa.array(keep, pa.bool_()))

    rows = found.select("digest", "label", "n", "held", "rows", "values", "text")
    one = rows.mapInArrow(check, rows.schema)
    w = Window.partitionBy("digest").orderBy(F.xxhash64("text"))
    return one.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
