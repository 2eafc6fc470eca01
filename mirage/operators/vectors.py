"""Nearest-neighbour search over embedding rows.

Vectors travel as blocks: one row holds the ids and the matrix of some
thousand vectors. A search is a join of query blocks with corpus chunks; each
pair is one matrix product in one task, which keeps the best k of every query
over all chunks that it meets with a block and verifies their distances row by
row in double precision. No distance is shuffled, no vector reaches the
driver, and the plan is the same whatever the number of blocks.

* ``exact_knn`` (V1): chunks are dealt over ``splits`` and meet every query
  block there.
* ``two_level_knn`` (V2): the same within each batch of corpus partitions,
  best k per (query, batch), then best k overall.
* ``CellIndex`` and ``approximate_knn`` (V3): k-means cells fitted on a bounded
  sample; all vectors stored as inverted lists, a cell's list in parts of
  ``LIST`` vectors, a folder for each cell. A search joins the queries, by the
  cells that they probe, with the lists. ``cells`` and ``nprobe`` are
  parameters of the caller.

Top-k is ``row_number() <= k``, which Spark plans as a partial
``WindowGroupLimit`` before the shuffle. Rows without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.session import ensure_checkpoint_dir, stored

#: Query vectors in a block, corpus vectors in a chunk, rows of a chunk that
#: one matrix product takes, vectors in a part of a cell's list.
QUERY_BLOCK, CHUNK, PRODUCT, LIST = 4096, 8192, 1024, 8192
#: Queries that one matrix product takes.
TILE = 256
#: Bytes of vectors in a row of blocks and in what a worker copies at a time:
#: longer vectors make shorter blocks.
BYTES = 1 << 21
#: Neighbours that a worker holds before it passes them on.
HELD = 1 << 19
#: Corpus vectors that a split holds, about.
SPLIT = 65_536
#: Vectors that the cells are fitted on at most.
FIT_SAMPLE = 100_000


def top_k(df: DataFrame, by: list[str], k: int, order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _fit(dim: int, copies: int = 1) -> int:
    """Vectors of ``dim`` doubles, each ``copies`` times, in ``BYTES``."""
    return max(1, BYTES // (8 * max(1, dim) * copies))


def _slices(batches: Iterator[pa.RecordBatch], vectors: int, copies: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``vectors``, copied so often, is within
    ``BYTES``."""
    for batch in batches:
        if batch.num_rows:
            step = _fit(len(batch.column(vectors).flatten()) // batch.num_rows, copies)
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)


def pack(rows: DataFrame, key: str, ids: str, vectors: str, size: int) -> DataFrame:
    """``rows`` (long key, long id, vector) as blocks: (key, ids, vectors, n),
    up to ``size`` rows and ``BYTES`` of one key and task in a block, as
    little-endian 64-bit integers and doubles. A task holds ``size`` rows, or
    four blocks, and one batch at most."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                ids, x = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
                step = min(size, _fit(x.shape[1]))
                for lo in range(0, len(ids), step):
                    yield pa.record_batch([pa.array([k], pa.int64()), pa.array([ids[lo:lo + step].tobytes()], pa.binary()),
                                           pa.array([x[lo:lo + step].tobytes()], pa.binary()),
                                           pa.array([len(ids[lo:lo + step])], pa.int32())], names=["key", "ids", "vectors", "n"])

        for batch in _slices(batches, 2):
            keys, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for k in np.unique(keys).tolist():
                held.setdefault(k, []).append((ids[keys == k], x[keys == k]))
            count += len(ids)
            if count >= min(size, 4 * _fit(x.shape[1])):
                yield from out()
                held, count = {}, 0
        yield from out()

    wide = rows.where(F.col(vectors).isNotNull() & F.col(ids).isNotNull())
    wide = wide.select(F.col(key).cast("long"), F.col(ids).cast("long"), F.col(vectors).cast("array<double>"))
    return wide.mapInArrow(blocks, "key long, ids binary, vectors binary, n int")


class _Nearest:
    """The best k of every query of one tile, per group of the corpus."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
        self.qids, self.q, self.k, self.exclude_self = qids, q, k, exclude_self
        self.norms = (q * q).sum(1)
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.limit: dict[int, np.ndarray] = {}

    def meet(self, group: int, ids: np.ndarray, x: np.ndarray) -> None:
        for lo in range(0, len(ids), PRODUCT):
            part, own = x[lo:lo + PRODUCT], ids[lo:lo + PRODUCT]
            limit = self.limit.setdefault(group, np.full(len(self.qids), np.inf))
            size = (part * part).sum(1)
            d = self.q @ part.T
            d *= -2
            d += size
            d += self.norms[:, None]
            if self.exclude_self:
                d[self.qids[:, None] == own[None, :]] = np.inf
            bar = limit
            if len(own) > self.k:
                bar = np.minimum(bar, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            # The product's rounding must lose none: verified below.
            query, row = np.nonzero(d <= (bar + 1e-11 * (1 + size.max() + self.norms))[:, None])
            if self.exclude_self:
                other = own[row] != self.qids[query]
                row, query = row[other], query[other]
            self._keep(group, query, own[row], self._exact(part, row, query))

    def _exact(self, part: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Squared distances of pairs. Among copies every pair is a tie, so
        there may be as many as the product has cells."""
        exact, step = np.empty(len(row)), _fit(part.shape[1])
        for lo in range(0, len(row), step):
            exact[lo:lo + step] = ((part[row[lo:lo + step]] - self.q[query[lo:lo + step]]) ** 2).sum(1)
        return exact

    def _keep(self, group: int, query: np.ndarray, ident: np.ndarray, exact: np.ndarray) -> None:
        none = np.zeros(0, np.int64)
        have = self.found.get(group, (none, none, np.zeros(0)))
        at, ident, dist = np.r_[have[0], query], np.r_[have[1], ident], np.r_[have[2], exact]
        order = np.lexsort((ident, dist, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order = order[place < self.k]
        last = at[place == self.k - 1]
        self.found[group] = at[place < self.k], ident[order], dist[order]
        self.limit[group][last] = self.found[group][2][np.flatnonzero(place[place < self.k] == self.k - 1)]

    def held(self) -> int:
        return sum(len(at) for at, _, _ in self.found.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was found; it is no longer held."""
        found, self.found, self.limit = self.found, {}, {}
        for group, (at, ident, dist) in found.items():
            yield pa.record_batch([pa.array(self.qids[at], pa.int64()), pa.array(np.full(len(at), group), pa.int64()), pa.array(ident, pa.int64()), pa.array(dist)],
                                  names=["query", "grp", "id", "dist2"])


def search_pairs(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Best k per query and group of what each task meets: (query, grp, id,
    dist2) from ``pairs`` of a query block (qids, queries) and a corpus chunk
    (grp, ids, vectors). A worker's memory is bounded by ``BYTES``, ``TILE`` x
    ``PRODUCT`` and ``HELD``, besides Spark's batches; neighbours passed on
    early leave the choice to the caller's top k."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                qids, queries, group, ids, vectors = (batch.column(c)[n].as_py() for c in range(5))
                if (qids, queries) != key:
                    for near in tiles:
                        yield from near.rows()
                    key, at = (qids, queries), np.frombuffer(qids, np.int64)
                    q = np.frombuffer(queries).reshape(len(at), -1)
                    tiles = [_Nearest(at[lo:lo + TILE], q[lo:lo + TILE], k, exclude_self) for lo in range(0, len(at), TILE)]
                own = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors).reshape(len(own), -1)
                for near in tiles:
                    near.meet(group, own, x)
                if sum(near.held() for near in tiles) > HELD:
                    for near in tiles:
                        yield from near.rows()
        for near in tiles:
            yield from near.rows()

    return pairs.select("qids", "queries", "grp", "ids", "vectors").mapInArrow(
        search, "query long, grp long, id long, dist2 double")


def _deal(column: str, n: int, salt: int = 0):
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("long")


def _query_blocks(queries: DataFrame, qid: str, qvec: str) -> tuple[DataFrame, int]:
    """The queries as blocks (block, qids, queries) and the number of blocks;
    their count is the one scalar that the driver sees."""
    n = queries.count() // QUERY_BLOCK + 1
    dealt = queries.select(_deal(qid, n).alias("block"), qid, qvec).repartition(n, "block")
    blocks = pack(dealt, "block", qid, qvec, QUERY_BLOCK)
    return blocks.select(F.col("key").alias("block"), F.col("ids").alias("qids"), F.col("vectors").alias("queries")), n


def _all_pairs(corpus: DataFrame, queries: DataFrame, qid: str, qvec: str, id_col: str, vec_col: str, group, splits: int | None) -> DataFrame:
    """Every chunk of the corpus with every block of queries. A chunk goes to
    one split, a block to all; where there are several blocks, a chunk goes to
    its split once for each."""
    blocks, n_blocks = _query_blocks(queries, qid, qvec)
    n_splits = splits or corpus.count() // SPLIT + 1
    chunks = pack(corpus.withColumn("_g", group), "_g", id_col, vec_col, CHUNK)
    chunks = chunks.select(F.col("key").alias("grp"), "ids", "vectors", _deal("ids", n_splits).alias("split"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    blocks = blocks.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))))
    return blocks.join(chunks, ["split", "block"])


def exact_knn(corpus: DataFrame, queries: DataFrame, qid: str = "query_id", qvec: str = "query_vec",
              k: int = 10, exclude_self: bool = False, id_col: str = "vec_id", vec_col: str = "embedding",
              splits: int | None = None) -> DataFrame:
    """V1: exact k nearest neighbours by L2 distance (in double precision),
    ties by id."""
    pairs = _all_pairs(corpus, queries, qid, qvec, id_col, vec_col, F.lit(0), splits)
    return top_k(_named(search_pairs(pairs, k, exclude_self), qid, id_col).drop("grp"), [qid], k, [F.col("dist2"), F.col(id_col)])


def two_level_knn(corpus: DataFrame, queries: DataFrame, batch_col: str, qid: str = "query_id", qvec: str = "query_vec",
                  k: int = 10, exclude_self: bool = False, id_col: str = "vec_id", vec_col: str = "embedding",
                  splits: int | None = None) -> DataFrame:
    """V2: a search within every batch of partitions (``batch_col``), best k
    per (query, batch), then best k per query."""
    pairs = _all_pairs(corpus, queries, qid, qvec, id_col, vec_col, F.col(batch_col).cast("long"), splits)
    found = _named(search_pairs(pairs, k, exclude_self), qid, id_col)
    first = top_k(found, [qid, "grp"], k, [F.col("dist2"), F.col(id_col)]).drop("rank")
    return top_k(first.drop("grp"), [qid], k, [F.col("dist2"), F.col(id_col)])


def _named(found: DataFrame, qid: str, id_col: str) -> DataFrame:
    return found.select(F.col("query").alias(qid), "grp", F.col("id").alias(id_col), "dist2")


class CellIndex:
    """Inverted lists over a corpus ``(id_col, vec_col)``: ``cells`` k-means
    centres fitted on at most ``fit_sample`` vectors (those whose hashed id is
    smallest); every vector is in the list of its nearest centre. A list is
    stored in parts of about ``list_size`` vectors, so a cell that many vectors
    share is many rows, read and searched by many tasks. ``sizes`` (cell, n)
    are the lengths of the lists."""

    def __init__(self, corpus: DataFrame, cells: int, id_col: str = "vec_id", vec_col: str = "embedding",
                 seed: int = 7, max_iter: int = 10, fit_sample: int = FIT_SAMPLE, list_size: int = LIST):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        self.id_col, self.vec_col = id_col, vec_col
        spark = corpus.sparkSession
        feats = corpus.where(F.col(vec_col).isNotNull()).select(id_col, vec_col, array_to_vector(vec_col).alias("_f"))
        sample = stored(feats.orderBy(F.xxhash64(id_col), id_col).limit(fit_sample), "sample")
        model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cell").fit(sample)
        self.centres = np.array(model.clusterCenters(), dtype=np.float64)         # cells × dim, bounded
        assigned = stored(model.transform(feats).select(id_col, vec_col, F.col("cell").cast("long").alias("cell")), "assigned")
        self.sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        parts = F.broadcast(self.sizes.select("cell", (F.floor(F.col("n") / list_size) + 1).alias("_parts")))  # a row a centre
        dealt = assigned.join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")))
        lists = pack(dealt.repartition("cell", "_part").sortWithinPartitions("cell", "_part"), "cell", id_col, vec_col, list_size)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cells-{model.uid}"
        lists.withColumnRenamed("key", "cell").write.partitionBy("cell").parquet(path)
        self.lists = spark.read.schema("ids binary, vectors binary, n int, cell long").parquet(path)

    def probes(self, queries: DataFrame, nprobe: int, qid: str, qvec: str) -> DataFrame:
        """(cell, query, vector): each query with its ``nprobe`` nearest
        centres."""
        centres = queries.sparkSession.sparkContext.broadcast(self.centres)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, 1, nprobe):
                q, c = _matrix(batch.column(1)), centres.value
                d = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)
                cell = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
                row = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
                yield pa.record_batch([pa.array(cell.ravel(), pa.int64()), batch.column(0).take(row), batch.column(1).take(row)],
                                      names=["cell", "query", "vector"])

        rows = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).cast("long"), F.col(qvec).cast("array<double>"))
        return rows.mapInArrow(near, "cell long, query long, vector array<double>")


def approximate_knn(index: CellIndex, queries: DataFrame, nprobe: int, qid: str = "query_id",
                    qvec: str = "query_vec", k: int = 10, exclude_self: bool = False) -> DataFrame:
    """V3: each query searches the lists of the ``nprobe`` cells whose centres
    are nearest to it. Queries that probe a cell meet its parts in blocks;
    lists that no query probes join with nothing."""
    probes = index.probes(queries, nprobe, qid, qvec)
    blocks = pack(probes.repartition("cell").sortWithinPartitions("cell"), "cell", "query", "vector", QUERY_BLOCK).select(
        F.col("key").alias("cell"), F.col("ids").alias("qids"), F.col("vectors").alias("queries"))
    pairs = blocks.join(index.lists.withColumn("grp", F.lit(0).cast("long")), "cell")
    found = _named(search_pairs(pairs, k, exclude_self), qid, index.id_col).drop("grp")
    return top_k(found, [qid], k, [F.col("dist2"), F.col(index.id_col)])


def compared(index: CellIndex, queries: DataFrame, nprobe: int, qid: str = "query_id", qvec: str = "query_vec") -> DataFrame:
    """Per query, the share of all vectors that a search with ``nprobe``
    cells compares with it: (qid, compared)."""
    total = index.sizes.agg(F.sum("n").alias("_all")).withColumn("_k", F.lit(0))
    rows = index.probes(queries, nprobe, qid, qvec).join(F.broadcast(index.sizes), "cell").withColumn("_k", F.lit(0))
    return (rows.join(F.broadcast(total), "_k").groupBy(F.col("query").alias(qid))
                .agg((F.sum("n") / F.max("_all")).alias("compared")))


def recall(approx: DataFrame, exact: DataFrame, qid: str, id_col: str) -> DataFrame:
    """Share of the exact neighbours the approximate search found, per query."""
    hit = exact.join(approx.select(qid, id_col).withColumn("_hit", F.lit(1)), [qid, id_col], "left")
    return hit.groupBy(qid).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1)))
                                .alias("recall"))


def encode(rows: DataFrame, text_col: str, encoder, dim: int, out_col: str = "embeddings",
           observation: Observation | None = None) -> DataFrame:
    """V4: embed a text column with a pluggable encoder (``list[str] →
    array-like [n, dim]``) in Arrow batches; batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``. ``observation`` collects
    the number of rows and characters as they are written (A14)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def emb(texts: pd.Series) -> pd.Series:
        vecs = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float32)
        if vecs.ndim != 2 or vecs.shape[1] != dim:
            raise ValueError(f"encoder returned shape {vecs.shape}, expected (n, {dim})")
        return pd.Series(list(vecs))
    out = rows.withColumn(out_col, emb(F.col(text_col)))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text_col)).alias("chars"),
                          F.count(F.when(F.col(text_col).isNull(), 1)).alias("empty"))
    return out


def load_vectors(rows: DataFrame, text_col: str, encoder, dim: int, path: str, pos_col: str = "source_pos",
                 per_partition: int = 100_000) -> DataFrame:
    """The load of the vector store: encode ``rows`` and write them in numbered
    partitions (K8). Returns its totals (A14) as one row: rows, chars, empty
    (rows without text), partitions. They are observed while the rows are
    written, so the load is one pass and counts what it wrote."""
    from mirage.sources.sinks import write_vectors
    spark, seen = rows.sparkSession, Observation("load")
    write_vectors(encode(rows, text_col, encoder, dim, observation=seen), path, pos_col, per_partition)
    got = seen.get
    partitions = spark.read.parquet(path).select("partition").distinct().count() if got["rows"] else 0
    return spark.createDataFrame([(got["rows"], got["chars"] or 0, got["empty"], partitions)],
                                 "rows long, chars long, empty long, partitions long")
