"""Approximate nearest neighbours by stable projections and kd-trees.

Nearness is the cosine, in double precision; on unit vectors that is their
Euclidean distance. A Gaussian matrix projects unit vectors to ``DIMS``
dimensions; for two vectors at distance d, the squared distance of their
projections is d * d times a chi-square variable of ``DIMS`` degrees. So once
the next projected neighbour is farther than d * d times the chi-square
quantile of ``CONFIDENCE``, d being the distance of the k-th best verified so
far, a vector nearer than d is left unseen with a probability of at most
1 - ``CONFIDENCE``. That is the stopping test.

1. Equal vectors are one class; the k + 1 smallest ids of each are kept, as no
   more can be in a result. Copies are never compared with one another.
2. The upper levels of the kd-tree over the projections are fitted on at most
   ``FIT`` classes (those of smallest hash); every class goes to its cell, and
   cells of more than a shard are dealt out over several shards.
3. Each shard's kd-tree is built in one task, which at once searches it for
   the shard's own queries: their k-th distance there is a first bound.
4. A query goes to the shards of all cells that are not beyond its bound by
   the stopping test, in blocks of about ``BLOCK`` queries. There leaves are
   opened in the order of their distance from the query's projection, points
   in them verified on the vectors, until the stopping test holds.
5. The best k of all shards, expanded to rows, are the result.

Vectors are compared only within a dimension. Vectors that are null, empty,
zero, or hold null or non-finite components take no part. A row is its id and
vector: repeated rows count once, and rows with a query's id are its own. An
id that has several vectors is a candidate for each of them, and as a query
gets the best of what all of them find. A missing id comes after every other
id and is no query. Fewer than k candidates give fewer rows, no query none.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage.llm.common import NO_ID, materialise, pack_arrays, pieces_of, ranges, unpack_arrays

#: Dimensions of the projections (even) and the stopping test's probability.
DIMS, CONFIDENCE = 8, 0.97
#: Classes, and components of vectors, in a shard; points in a leaf; queries
#: searched in a shard by one task.
SHARD, FLOATS, LEAF, BLOCK = 8192, 1 << 22, 32, 4096
#: Classes the upper tree is fitted on; cells it has at most.
FIT, MOST_CELLS = 16_384, 1 << 14


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by their largest component first, so that
    huge and tiny vectors neither overflow nor vanish)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    half, term, total = x / 2, 1.0, 0.0
    for j in range(degrees // 2):
        total += term
        term *= half / (j + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


def projection(dim: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, dims))


class Cells:
    """Upper levels of a kd-tree: ``axis`` and ``value`` of the splits, in
    heap order, and the box of each cell."""

    def __init__(self, points: np.ndarray, depth: int):
        n = 1 << depth
        self.depth, self.axis, self.value = depth, np.zeros(n - 1, np.int64), np.zeros(n - 1)
        dims = points.shape[1]
        self.low, self.high = np.full((n, dims), -np.inf), np.full((n, dims), np.inf)
        self._split(points, 0, 0, n)

    def _split(self, points: np.ndarray, node: int, first: int, width: int) -> None:
        if width == 1:
            return
        if len(points):
            axis = int(np.ptp(points, axis=0).argmax())
            value = float(np.median(points[:, axis]))
        else:
            axis, value = 0, 0.0
        self.axis[node], self.value[node] = axis, value
        half = width // 2
        left = points[:, axis] <= value
        self.high[first:first + half, axis] = np.minimum(self.high[first:first + half, axis], value)
        self.low[first + half:first + width, axis] = np.maximum(self.low[first + half:first + width, axis], value)
        self._split(points[left], 2 * node + 1, first, half)
        self._split(points[~left], 2 * node + 2, first + half, half)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


def box_distances(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of the boxes from the point ``p``."""
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return (gap * gap).sum(1)


class Tree:
    """kd-tree over projections ``p`` of unit vectors ``x``; ``first`` is the
    order of equally near ones."""

    def __init__(self, x: np.ndarray, p: np.ndarray, first: np.ndarray, leaf: int = LEAF):
        order, stack, starts = np.arange(len(p)), [(0, len(p))], []
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                starts.append(a)
                continue
            part = p[order[a:b]]
            axis, mid = int(np.ptp(part, axis=0).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.order = order
        self.x, self.p, self.first = x[order], p[order], first[order]
        self.starts = np.sort(np.array(starts, np.int64))
        self.sizes = np.diff(np.r_[self.starts, len(p)])
        self.low = np.minimum.reduceat(self.p, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.p, self.starts, axis=0)

    def nearest(self, u: np.ndarray, q: np.ndarray, k: int, stop: float, bound: float, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given) and cosines of the ``k`` best found for
        the unit vector ``u`` with projection ``q``; ``stop`` is the quantile,
        ``bound`` a squared distance within which k others are known, ``own``
        a value of ``first`` to leave out."""
        lows = box_distances(self.low, self.high, q)
        leaves = np.argsort(lows, kind="stable")
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(leaves) and lows[leaves[at]] <= stop * bound:
            some = leaves[at:at + step]
            at, step = at + step, 2 * step
            points = ranges(self.starts[some], self.sizes[some])
            gap = self.p[points] - q
            points = points[(gap * gap).sum(1) <= stop * bound]
            if own is not None:
                points = points[self.first[points] != own]
            # Row by row, so that equal vectors have equal cosines.
            cosines = np.r_[cosines, (self.x[points] * u).sum(1)]
            best = np.r_[best, points]
            keep = np.lexsort((self.first[best], -cosines))[:k]
            best, cosines = best[keep], cosines[keep]
            if len(best) == k:
                # A little more, as rounding must not hide an equal one.
                bound = min(bound, max(0.0, 2 - 2 * float(cosines[-1])) + 1e-12)
        return self.order[best], cosines


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _classes(vectors: DataFrame, asked: Column, k: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """Classes of valid vectors (class, dim, v, p, first, members, asked) and
    the queries (query_id, class)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"),
                          F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 as 0.0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).groupBy("v", "id").agg(F.max("asked").alias("asked"))
    rows = materialise(rows, "rows")
    place = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    members = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members"))
    any_asked = rows.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    cls = members.join(any_asked, "v", "left").select(
        F.monotonically_increasing_id().alias("class"), F.size("v").alias("dim"), "v", F.col("members")[0].alias("first"), "members",
        F.coalesce("asked", F.lit(False)).alias("asked"))

    def project(batches):
        for batch in batches:
            out = []
            for x in batch.column(2):
                u = unit(np.array(x.values.to_numpy(zero_copy_only=False), np.float64)[None, :])
                out.append((u[0].tobytes(), (u @ projection(u.shape[1], dims))[0].tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary()),
                                   *batch.columns[3:]], names=["class", "dim", "u", "p", "first", "members", "asked"])

    numbered = materialise(cls, "numbered")  # the numbers stay what they are
    done = materialise(numbered.mapInArrow(project, "class long, dim int, u binary, p binary, first long, members array<long>, asked boolean"), "classes")
    queries = rows.where("asked").join(numbered.select("v", "class"), "v").select(F.col("id").alias("query_id"), "class")
    return done, queries


def nearest_neighbours(vectors: DataFrame, asked: Column, k: int = 5, dims: int = DIMS, confidence: float = CONFIDENCE,
                       shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` (vec_id,
    embedding) where ``asked``: query_id, rank (from 1), vec_id, score (their
    cosine), nearest first, equally near ones by ascending vec_id."""
    cls, queries = _classes(vectors, asked, k, dims)
    stop = chi_square_quantile(confidence, dims)
    spark = cls.sparkSession
    # Upper tree, on a bounded sample. One depth for all: a dimension with
    # fewer vectors has smaller cells.
    sample = cls.orderBy(F.xxhash64("u", F.lit(5)), "class").limit(FIT).select("dim", "p").toArrow()
    cells_wanted = min(MOST_CELLS, max(1, sample.num_rows // 16), pieces_of(cls.count(), shard))
    depth = max(0, math.ceil(math.log2(cells_wanted)))
    of = sample.column(0).to_numpy()
    points = _floats(sample.column(1), dims)
    trees = spark.sparkContext.broadcast({int(d): Cells(points[of == d], depth) for d in np.unique(of)})

    def place(batches):
        for batch in batches:
            dim, p = batch.column(1).to_numpy(), _floats(batch.column(3), dims)
            cell = np.zeros(len(dim), np.int64)
            for d in np.unique(dim).tolist():
                if d in trees.value:
                    cell[dim == d] = trees.value[d].of(p[dim == d])
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    placed = materialise(cls.drop("members").mapInArrow(place, "class long, dim int, u binary, p binary, first long, asked boolean, cell int"), "placed")
    each = F.greatest(F.least(F.lit(shard), (F.lit(FLOATS) / F.col("dim")).cast("long")), F.lit(1))
    sizes = materialise(placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "dim", "cell", F.ceil(F.col("n") / each).cast("int").alias("shards")), "sizes")
    key = ["dim", "cell", "shard"]
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        dim, first = t.column("dim")[0].as_py(), t.column("first").to_numpy()
        x, p = _floats(t.column("u"), dim), _floats(t.column("p"), dims)
        cls, tree = t.column("class").to_numpy(), Tree(x, p, t.column("class").to_numpy())
        own = np.flatnonzero(t.column("asked").to_numpy(zero_copy_only=False))
        bounds = []
        for i in own.tolist():
            got = tree.nearest(x[i], p[i], k, stop, math.inf, int(cls[i]))[1]
            bounds.append(max(0.0, 2 - 2 * float(got[-1])) if len(got) == k else math.inf)
        return pa.table({**{n: t.column(n).slice(0, 1) for n in key}, "data": pa.array([pack_arrays(x, p, cls, first)], pa.binary()),
                         "own": pa.array([cls[own].tolist()], pa.list_(pa.int64())), "bounds": pa.array([bounds], pa.list_(pa.float64()))})

    shards = materialise(dealt.select(*key, "class", "u", "p", "first", "asked").groupBy(*key).applyInArrow(
        build, "dim int, cell int, shard int, data binary, own array<long>, bounds array<double>"), "shards")
    bound = shards.select(F.explode(F.arrays_zip("own", "bounds")).alias("b")).select(F.col("b.own").alias("class"), F.col("b.bounds").alias("bound"))
    asking = placed.where("asked").join(bound, "class").select("class", "dim", "u", "p", "bound")
    n_blocks = pieces_of(asking.count(), block)

    def route(batches):
        for batch in batches:
            dim, p, bound = batch.column(1).to_pylist(), _floats(batch.column(3), dims), batch.column(4).to_pylist()
            row, cell = [], []
            for i, d in enumerate(dim):
                tree = trees.value.get(d)
                got = np.flatnonzero(box_distances(tree.low, tree.high, p[i]) <= stop * bound[i]) if tree else np.zeros(1, np.int64)
                row.append(np.full(len(got), i))
                cell.append(got)
            row = pa.array(np.concatenate(row or [np.zeros(0, np.int64)]))
            yield pa.record_batch([*[c.take(row) for c in batch.columns], pa.array(np.concatenate(cell or [np.zeros(0, np.int64)]), pa.int32())],
                                  names=[*batch.schema.names, "cell"])

    routed = asking.mapInArrow(route, "class long, dim int, u binary, p binary, bound double, cell int").join(sizes, ["dim", "cell"])
    routed = routed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn(
        "block", F.pmod(F.xxhash64("class", F.lit(3)), F.lit(n_blocks)).cast("int"))

    def search(t: pa.Table, s: pa.Table) -> pa.Table:
        out = [], [], [], []
        if t.num_rows and s.num_rows:
            dim = s.column("dim")[0].as_py()
            x, p, cls, first = unpack_arrays(s.column("data")[0].as_py(), np.float64, np.float64, np.int64, np.int64)
            # Ties go by the smallest id, then class, so ranks them.
            rank = np.argsort(np.lexsort((cls, first)), kind="stable")
            tree = Tree(x.reshape(-1, dim), p.reshape(-1, dims), rank)
            mine, us, ps = t.column("class").to_pylist(), _floats(t.column("u"), dim), _floats(t.column("p"), dims)
            where = {c: int(r) for c, r in zip(cls.tolist(), rank.tolist())}
            for c, u, q, b in zip(mine, us, ps, t.column("bound").to_pylist()):
                at, cosines = tree.nearest(u, q, k, stop, b + 1e-12, where.get(c))
                out[0].extend([c] * len(at))
                out[1].extend(cls[at].tolist())
                out[2].extend(first[at].tolist())
                out[3].extend(cosines.tolist())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())],
                        names=["asking", "class", "first", "score"])

    copies = shards.select(*key, "data", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    found = routed.groupBy(*key, "block").cogroup(copies.groupBy(*key, "block")).applyInArrow(
        search, "asking long, class long, first long, score double")
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "first", "class")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asking", "class", "score")

    def own_score(batches):
        for batch in batches:
            us = [np.frombuffer(u, np.float64) for u in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(0), pa.array([float((u * u).sum()) for u in us], pa.float64())], names=["asking", "class", "score"])

    own = asking.select("class", "u").mapInArrow(own_score, "asking long, class long, score double")
    found = found.unionByName(own).join(cls.select("class", "members"), "class")
    got = queries.withColumnRenamed("class", "asking").join(found, "asking").select(
        "query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = got.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return got.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
