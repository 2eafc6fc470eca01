import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirage.llm import queries as Q
from mirage.llm.projection_search import Cells, Tree, box_distances, chi_square_cdf, chi_square_quantile, nearest_neighbours, projection, unit

KIND = "vec_id long, embedding array<float>, label int, rank string, score string, class int, dim string, p int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "r", "s", 2, "d", 3) for i, e in rows], KIND).repartition(3)


def valid(e):
    return e is not None and len(e) and all(a is not None and math.isfinite(a) for a in e) and any(e)


def exact(rows, asked, k=5):
    """Brute force: (query, [(score, id)...])."""
    good = {}
    for i, e in rows:
        if valid(e):
            good[i, tuple(np.float32(a) + np.float32(0) for a in e)] = unit(np.array([e], np.float32).astype(np.float64))[0]
    out = {}
    for (i, _), u in good.items():
        if i is not None and asked(i):
            got = out.setdefault(i, [])
            got += [(-float((u * v).sum()), math.inf if j is None else j) for (j, _), v in good.items() if j != i and len(v) == len(u)]
    return {i: sorted(x)[:k] for i, x in out.items()}


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(got) + 1
        got.append((-r["score"], math.inf if r["vec_id"] is None else r["vec_id"]))
    return out


def recall(got, want):
    """Found ones of the nearest; also checks scores, order and numbers."""
    hits = total = 0
    for i, near in want.items():
        have = got.get(i, [])
        assert have == sorted(have) and len(have) == len(near) and all(j != i for _, j in have)
        hits += len({j for _, j in have} & {j for _, j in near})
        total += len(near)
        # Whatever was found is no nearer than the truth at its rank.
        assert all(h[0] >= n[0] - 1e-12 for h, n in zip(have, near))
    assert set(got) <= set(want)
    return hits / max(1, total)


def test_chi_square():
    assert abs(chi_square_cdf(15.507, 8) - 0.95) < 1e-4 and abs(chi_square_cdf(4.605, 2) - 0.9) < 1e-4
    assert abs(chi_square_quantile(0.99, 8) - 20.090) < 1e-2


def test_cells_and_boxes():
    r = np.random.default_rng(1)
    p = r.normal(size=(3000, 4))
    cells = Cells(p[:500], 4)
    of = cells.of(p)
    assert set(of.tolist()) == set(range(16))
    for k in range(len(p)):
        assert box_distances(cells.low[of[k]:of[k] + 1], cells.high[of[k]:of[k] + 1], p[k])[0] == 0
    assert set(Cells(np.zeros((50, 4)), 3).of(np.zeros((5, 4))).tolist()) == {0}


def test_tree_is_exact_without_a_stop():
    r = np.random.default_rng(2)
    x = unit(np.r_[r.normal(size=(500, 10)), np.ones((40, 10)), r.normal(size=(100, 10))])
    p = x @ projection(10)
    first = r.permutation(len(x))
    tree = Tree(x, p, first, leaf=8)
    for i in range(0, len(x), 7):
        at, cosines = tree.nearest(x[i], p[i], 6, math.inf, 4.0, int(first[i]))
        all_of = (x * x[i]).sum(1)
        want = [k for k in np.lexsort((first, -all_of)) if k != i][:6]
        assert at.tolist() == want and cosines.tolist() == all_of[want].tolist()


def odd_rows():
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 12)).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(base)]
    x = rows[100][1]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, x, x, [2 * a for a in x], [-a for a in x],
           [1e-38] * 12, [3e38] * 12, [1.0, 2.0]]
    rows += [(1000 + 50 * k, e) for k, e in enumerate(odd)]
    rows += [(None, x), (None, x), (1300, x), (50, rows[60][1]), (3000, [1.0, 2.0]), (3050, [0.0, 1.0]), (3051, [-0.0, 1.0]), (3100, [5.0])]
    return rows + [(5000 + k, [1.0] * 12) for k in range(200)]


@pytest.mark.parametrize("shard, block", [(8192, 4096), (40, 7)])
def test_odd_rows_exactly(spark, shard, block):
    """With a confidence that never stops early, the result is exact."""
    rows = odd_rows()
    got = results(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, confidence=1 - 1e-12, shard=shard, block=block))
    want = exact(rows, lambda i: i % 50 == 0)
    want = {i: n for i, n in want.items() if n}
    assert {i: [j for _, j in n] for i, n in got.items()} == {i: [j for _, j in n] for i, n in want.items()}
    assert recall(got, want) == 1


def test_recall_over_many_shards(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 32))
    x = np.r_[centres[r.integers(0, 60, 4000)] + 0.6 * r.normal(size=(4000, 32)), r.normal(size=(1500, 32))].astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = results(nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, shard=400, block=50))
    assert recall(got, exact(rows, lambda i: i % 50 == 0)) >= 0.95


def test_empty(spark):
    asked = F.col("vec_id") % 50 == 0
    for rows in ([], [(50, None)], [(50, [1.0, 2.0])], [(51, [1.0, 2.0]), (None, [1.0, 2.0])]):
        df = nearest_neighbours(frame(spark, rows), asked)
        assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = results(Q.QUERIES["op12_projection_search"](spark, d))
    assert recall(got, exact(rows, lambda i: i % 50 == 0)) >= 0.93
