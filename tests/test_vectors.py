"""Vector search as joins of blocks: exact, per batch, by inverted lists."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirage.operators import vectors as VX


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def asked(df, every):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def brute(x, every, k):
    out = {}
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        out[q] = np.lexsort((np.arange(len(x)), d))[:k].tolist()
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(VX, "QUERY_BLOCK", 7)


def points(n=600, dim=6):
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, size=(n, dim)).astype(float)  # many ties
    x[100:140] = x[100]
    return x


@pytest.mark.parametrize("splits", [1, 5])
def test_exact_over_blocks_and_splits(spark, small, splits):
    x = points()
    df = table(spark, x)
    want = brute(x, 10, 10)
    assert found(VX.exact_knn(df, asked(df, 10), exclude_self=True, splits=splits)) == want
    batch = df.withColumn("batch", F.col("vec_id") % 3)
    assert found(VX.two_level_knn(batch, asked(df, 10), "batch", exclude_self=True, splits=splits)) == want


def test_missing_vectors_and_few_candidates(spark):
    df = table(spark, [[0, 0], None, [1, 1], [1, 1]], [0, 1, 2, 3])
    got = found(VX.exact_knn(df, asked(df, 1), exclude_self=True))
    assert got == {0: [2, 3], 2: [3, 0], 3: [2, 0]}
    assert found(VX.exact_knn(df.where("false"), asked(df, 1))) == {}
    assert found(VX.exact_knn(df, asked(df, 1).where("false"))) == {}


def test_products_lose_nothing_to_rounding(spark):
    """Far from the origin the expanded square loses most of its digits."""
    r = np.random.default_rng(3)
    x = 1e6 + r.normal(size=(3000, 4))
    df = table(spark, x)
    assert found(VX.exact_knn(df, asked(df, 150), k=5, exclude_self=True)) == brute(x, 150, 5)


def test_plan_does_not_grow_with_the_blocks(spark, monkeypatch):
    df = table(spark, points(200))

    def nodes():
        plan = VX.exact_knn(df, asked(df, 1), exclude_self=True)._jdf.queryExecution().optimizedPlan().toString()
        return len(plan.split("\n"))

    one = nodes()
    monkeypatch.setattr(VX, "QUERY_BLOCK", 3)
    assert nodes() == one


class Captured:
    """Stands for a DataFrame: the function that its tasks would run."""

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, f, _):  # noqa: N802
        return f


def pairs_of(q, x, groups=1, block=2048):
    """One block of queries (ids from 0) with every chunk of the corpus."""
    ids = np.arange(len(x))
    rows = [(np.arange(len(q)).tobytes(), q.tobytes(), g, ids[lo:lo + block][g::groups].tobytes(), x[lo:lo + block][g::groups].tobytes())
            for lo in range(0, len(x), block) for g in range(groups)]
    for row in rows:
        yield pa.record_batch([pa.array([v]) for v in row], names=["qids", "queries", "grp", "ids", "vectors"])


def best(batches, k):
    """(group, query) -> the k nearest of all that the tasks passed on."""
    out = {}
    for b in batches:
        for q, g, i, d in zip(*(c.to_pylist() for c in b.columns)):
            out.setdefault((g, q), set()).add((d, i))
    return {key: [i for _, i in sorted(v)[:k]] for key, v in out.items()}


@pytest.mark.parametrize("copies", [False, True])
def test_memory_of_a_search_is_bounded(spark, copies):
    """The matrices and the verified pairs of a block with a chunk, whose
    number grows with both, also where all vectors are copies of one."""
    x = np.random.default_rng(7).normal(size=(2048, 32))
    x = np.repeat(x[:1], len(x), axis=0) if copies else x
    search = VX.search_pairs(Captured(), 10, True)
    tracemalloc.start()
    got = best(search(pairs_of(x, x)), 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {q: n for (_, q), n in got.items() if q % 64 == 0} == brute(x, 64, 10)
    assert peak < 48e6


def test_memory_of_many_groups_is_bounded(spark, monkeypatch):
    """Neighbours are passed on while a task still searches; the best of what
    it passed on are those of the whole group."""
    x = points(900)
    monkeypatch.setattr(VX, "HELD", 500, raising=False)
    monkeypatch.setattr(VX, "TILE", 7, raising=False)
    seen, early = [], []
    search = VX.search_pairs(Captured(), 10, True)

    def asked_for():
        for pair in pairs_of(x[:30], x, groups=3, block=100):
            early.append(len(seen))
            yield pair

    for batch in search(asked_for()):
        seen.append(batch)
    assert len(early) == 27 and early[-1] > 0
    got = best(seen, 10)
    for g in range(3):
        for q in range(30):
            d = ((x - x[q]) ** 2).sum(1)
            own = [i for i in np.lexsort((np.arange(len(x)), d)) if i % 100 % 3 == g and i != q]
            assert got[g, q] == own[:10]


def test_wide_vectors_make_short_blocks(spark):
    """Rows of blocks and of probes are bounded in bytes, whatever the length
    of a vector or the number of cells probed."""
    x = np.random.default_rng(8).normal(size=(1500, 2048))
    values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 2048, dtype=np.int32), pa.array(x.ravel()))
    batch = pa.record_batch([pa.array(np.arange(1500) % 2), pa.array(np.arange(1500)), values], names=["key", "id", "vector"])
    blocks = list(VX.pack(Captured(), "key", "id", "vector", 4096)(iter([batch])))
    assert max(b.nbytes for b in blocks) <= 1.1 * (1 << 21)
    back = {}
    for b in blocks:
        ids = np.frombuffer(b.column(1)[0].as_py(), np.int64)
        vectors = np.frombuffer(b.column(2)[0].as_py()).reshape(len(ids), -1)
        assert b.column(3)[0].as_py() == len(ids) and set(ids % 2) == {b.column(0)[0].as_py()}
        back |= dict(zip(ids.tolist(), vectors))
    assert sorted(back) == list(range(1500)) and all((back[i] == x[i]).all() for i in back)

    class Broadcast:
        value = x[:12]

    index = VX.CellIndex.__new__(VX.CellIndex)
    index.centres = x[:12]
    queries = Captured()
    queries.sparkSession = queries.sparkContext = queries
    queries.broadcast = lambda _: Broadcast
    probes = list(index.probes(queries, 10, "id", "vector")(iter([batch.select(["id", "vector"])])))
    assert max(b.nbytes for b in probes) <= 1.1 * (1 << 21)
    near = np.argsort((x * x).sum(1)[:, None] + (x[:12] ** 2).sum(1)[None, :] - 2 * (x @ x[:12].T), axis=1, kind="stable")[:, :10]
    got = {}
    for b in probes:
        for c, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(q, []).append(c)
    assert [got[i] for i in range(1500)] == near.tolist()


def clustered():
    r = np.random.default_rng(5)
    centres = 8 * r.normal(size=(40, 16))
    # One cluster holds a third of all vectors.
    of = np.where(r.random(4000) < 1 / 3, 0, r.integers(0, 40, 4000))
    return centres[of] + r.normal(size=(4000, 16))


def test_lists_recall_and_share_compared(spark):
    x = clustered()
    df = table(spark, x)
    rare = np.flatnonzero(((x - x[of_hot(x)]) ** 2).sum(1) > 400)  # outside the hot cluster
    index = VX.CellIndex(df, 64, list_size=100)
    queries = asked(df, 20).where(F.col("query_id").isin(rare.tolist()))
    got = found(VX.approximate_knn(index, queries, 4, exclude_self=True))
    want = {q: n for q, n in brute(x, 20, 10).items() if q in set(rare.tolist())}
    hits = sum(len(set(got[q]) & set(n)) for q, n in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    share = [r["compared"] for r in VX.compared(index, queries, 4).collect()]
    assert len(share) == len(want) and np.mean(share) <= 0.1


def of_hot(x):
    d = ((x[:300, None, :] - x[None, :300, :]) ** 2).sum(2)
    return int((d < 100).sum(1).argmax())


def test_hot_lists_are_split_and_whole(spark):
    x = clustered()
    df = table(spark, x)
    index = VX.CellIndex(df, 4, list_size=100)
    parts = index.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("longest"), F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in parts) == len(x) and max(r["longest"] for r in parts) <= 100
    assert max(r["parts"] for r in parts) >= 10
    # All cells probed: the search is exact.
    assert found(VX.approximate_knn(index, asked(df, 100), 4, exclude_self=True)) == brute(x, 100, 10)


def test_load_totals(spark, scratch):
    rows = spark.createDataFrame([(0, "ab"), (1, None), (25, "xyz")], "source_pos long, text string")
    got = VX.load_vectors(rows, "text", lambda t: [[len(a)] for a in t], 1, f"{scratch}/v", per_partition=10).first()
    assert tuple(got) == (3, 5, 1, 2)
    back = spark.read.parquet(f"{scratch}/v")
    assert {(r["partition"], r["source_pos"]) for r in back.collect()} == {(1, 0), (1, 1), (3, 25)}
    assert tuple(VX.load_vectors(rows.where("false"), "text", lambda t: np.zeros((len(t), 1)), 1, f"{scratch}/e").first()) == (0, 0, 0, 0)
