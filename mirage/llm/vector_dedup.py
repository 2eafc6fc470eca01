"""Embedding near-duplicates through navigable small-world graphs.

Vectors are compared only within a label (and a dimension), by cosine in
double precision.

1. Equal vectors of a label are one class with a size; copies are never
   expanded.
2. A label's classes are dealt into shards of about ``SHARD`` vectors; each
   shard gets a hierarchical navigable small-world graph, built by insertion.
3. Every vector is searched in every shard of its label, in blocks. The beam
   starts ``beam`` wide and doubles while all of it lies within the threshold,
   so a vector with many neighbours gets a beam as wide as they need. What the
   search finds is verified by its cosine in double precision.
4. An audit compares a sample of vectors with all others by matrix products,
   ``audit`` of them and more until they have ``AUDIT_LINKS`` links or all
   have been compared. While the share of these links that the search has
   found is below ``recall``, the beam is doubled and the search repeated.
   Where the widest beam (twice a shard) still misses it, which a graph that
   is not connected can do, all blocks are compared by products.
5. Links are counted per vector where they are found; of the links themselves
   each task passes on a spanning forest, whose components are united.

Vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without a label, link with nothing. Repeated rows count as vectors of
their own. A missing vec_id comes after every other id. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.llm.common import NO_ID, components, forest, materialise, pack_arrays, unpack_arrays

THRESHOLD = 0.93
SHARD = 8192
BLOCK = 4096
M = 16
#: Cosines in single precision this close below the threshold are verified.
SLACK = 1e-4
AUDIT, AUDIT_LINKS = 256, 200
#: Queries that one matrix product takes.
PRODUCT = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (scaled down by their largest component
    first, so that huge and tiny vectors neither overflow nor vanish)."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """Hierarchical navigable small-world graph over unit vectors. Node k is
    on layers 0..level[k]; links[layer][k] are its neighbours there."""

    def __init__(self, vectors: np.ndarray, m: int = M, beam: int = 48, build: bool = True):
        self.x, self.m, self.beam = vectors.astype(np.float32), m, beam
        n = len(vectors)
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64), 12)
        self.top = int(self.level.max()) if n else 0
        self.links = [np.full((n, m * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(self.top + 1)]
        self.used = [np.zeros(n, np.int32) for _ in range(self.top + 1)]
        self.entry, self.height, self.seen = 0, 0, np.zeros(n, np.int64)
        self.mark = 0
        if build:
            self.height = int(self.level[0]) if n else 0
            for k in range(1, n):
                self._insert(k)

    def _near(self, layer: int, nodes: np.ndarray) -> np.ndarray:
        got = self.links[layer][nodes].ravel()
        return got[got >= 0]

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int, until: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes reached from ``start`` and their cosines,
        best first. With ``until`` the beam doubles while all its members
        reach that cosine."""
        self.mark += 1
        seen, mark, x = self.seen, self.mark, self.x
        nodes = np.unique(start)
        seen[nodes] = mark
        sims = x[nodes] @ q
        done = np.zeros(len(nodes), bool)
        while True:
            if len(nodes) > width:
                best = np.argpartition(-sims, width - 1)[:width]
                nodes, sims, done = nodes[best], sims[best], done[best]
            todo = np.flatnonzero(~done)
            if not len(todo):
                if until is not None and len(nodes) == width and width < len(x) and sims.min() >= until:
                    # Start over from what is known: nodes cut off before may lie within now.
                    return self._beam(q, nodes, layer, 2 * width, until)
                order = np.argsort(-sims, kind="stable")
                return nodes[order], sims[order]
            if len(todo) > 8:  # the best first: they raise the bar for the rest
                todo = todo[np.argpartition(-sims[todo], 7)[:max(8, len(todo) // 2)]]
            done[todo] = True
            fresh = self._near(layer, nodes[todo])
            fresh = np.unique(fresh[seen[fresh] != mark])
            if len(fresh):
                seen[fresh] = mark
                got = x[fresh] @ q
                if len(nodes) >= width:
                    ok = got > sims.min()
                    fresh, got = fresh[ok], got[ok]
                nodes, sims = np.r_[nodes, fresh], np.r_[sims, got]
                done = np.r_[done, np.zeros(len(fresh), bool)]

    def _choose(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: a node joins unless one that joined is closer to
        it than the query is; places left go to the closest others."""
        if len(nodes) <= most:
            return nodes
        own = self.x[nodes] @ self.x[nodes].T
        picked, rest = [], []
        for k in range(len(nodes)):
            if len(picked) < most and (not picked or own[k, picked].max() <= sims[k]):
                picked.append(k)
            else:
                rest.append(k)
        return nodes[picked + rest[:most - len(picked)]]

    def _link(self, layer: int, a: int, b: int) -> None:
        row, n = self.links[layer][a], int(self.used[layer][a])
        if n < len(row):
            row[n] = b
            self.used[layer][a] += 1
            return
        nodes = np.r_[row, b]
        sims = self.x[nodes] @ self.x[a]
        order = np.argsort(-sims, kind="stable")
        row[:] = self._choose(nodes[order], sims[order], len(row))

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.array([self.entry])
        for layer in range(self.height, to, -1):
            at = self._beam(q, at, layer, 1)[0][:1]
        return at

    def _insert(self, k: int) -> None:
        q, level = self.x[k], int(self.level[k])
        at = self._descend(q, level)
        for layer in range(min(level, self.height), -1, -1):
            nodes, sims = self._beam(q, at, layer, self.beam)
            for other in self._choose(nodes, sims, self.m).tolist():
                self._link(layer, k, other)
                self._link(layer, other, k)
            at = nodes
        if level > self.height:
            self.entry, self.height = k, level

    def search(self, q: np.ndarray, beam: int, until: float) -> np.ndarray:
        """Nodes with a cosine of about ``until`` or more."""
        nodes, sims = self._beam(q, self._descend(q, 0), 0, beam, until)
        return nodes[sims >= until]

    def dump(self) -> bytes:
        return pack_arrays(np.array([self.entry, self.height, self.m], np.int64), *[a.ravel() for a in self.links])

    @classmethod
    def load(cls, vectors: np.ndarray, data: bytes) -> "Graph":
        g = cls(vectors, build=False)
        head, *links = unpack_arrays(data, np.int64, *[np.int32] * (g.top + 1))
        g.entry, g.height, g.m = head.tolist()
        g.links = [a.reshape(len(vectors), -1) for a in links]
        return g


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Valid vectors as classes of equal ones: label, dim, v, id, rows."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.coalesce(F.col("vec_id"), F.lit(NO_ID)).cast("long").alias("id"), "label",
                          F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 as 0.0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = good.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return (good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
            .withColumn("dim", F.size("v")))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, beam: int = 32, recall: float = 0.99,
                 shard: int = SHARD, audit: int = AUDIT) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id,
    n_links (other rows linked directly), component_id (smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id)."""
    # Stored, so the numbers stay what they are.
    cls = materialise(vector_classes(vectors).withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = materialise(cls.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = counts.withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = cls.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    kind = cls.schema["label"].dataType.simpleString()
    key = ["label", "dim", "shard"]

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("node", "ascending"), ("id", "ascending")])
        x = _matrix(t.column("v"))
        graph = Graph(unit(x))
        return pa.table({**{k: t.column(k).slice(0, 1) for k in key}, "blocks": t.column("blocks").slice(0, 1),
                         "data": pa.array([pack_arrays(x, t.column("node").to_numpy(), t.column("rows").to_numpy(), np.frombuffer(graph.dump(), np.uint8))])})

    graphs = materialise(placed.select(*key, "blocks", "v", "node", "id", "rows").groupBy(*key).applyInArrow(
        build, f"label {kind}, dim int, shard int, blocks int, data binary"), "graphs")
    each = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = (placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
               .select(*key, "block", "v", "node"))

    def searcher(width):
        def search(q: pa.Table, g: pa.Table) -> pa.Table:
            out = [], [], []
            if q.num_rows and g.num_rows:
                dim = g.column("dim")[0].as_py()
                x, node, rows, data = unpack_arrays(g.column("data")[0].as_py(), np.float64, np.int64, np.int64, np.uint8)
                x = unit(x.reshape(-1, dim))
                graph = None if width is None else Graph.load(x, data.tobytes())
                mine, y = q.column("node").to_numpy(), unit(_matrix(q.column("v")))
                where = {n: k for k, n in enumerate(node.tolist())}
                names, left, right = dict(where), [], []
                near = None
                for k, ident in enumerate(mine.tolist()):
                    if graph is None:
                        if k % PRODUCT == 0:
                            near = x @ y[k:k + PRODUCT].T >= threshold - SLACK
                        hit = np.flatnonzero(near[:, k % PRODUCT])
                    else:
                        hit = graph.search(y[k].astype(np.float32), width, threshold - SLACK)
                    hit = hit[(x[hit] @ y[k] >= threshold) & (node[hit] != ident)]
                    out[0].append(ident)
                    out[1].append(None)
                    out[2].append(int(rows[hit].sum()))
                    left += [names.setdefault(ident, len(names))] * len(hit)
                    right += hit.tolist()
                back = list(names)
                for a, b in forest(len(back), np.array(left, np.int64), np.array(right, np.int64)):
                    out[0].append(back[a])
                    out[1].append(back[b])
                    out[2].append(0)
            return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["a", "b", "links"])

        return search

    def search(of, width):
        """Links found from the queries ``of``; without a width, all there are."""
        return materialise(of.groupBy(*key, "block").cogroup(each.groupBy(*key, "block")).applyInArrow(
            searcher(width), "a long, b long, links long"), "links")

    def per_node(found):
        return found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    found = search(queries, beam)
    share, total = min(1.0, audit / max(1, cls.count())), 0
    while True:
        asked = queries.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
        truth = per_node(search(asked, None)).withColumnRenamed("links", "true")
        total = truth.agg(F.sum("true")).first()[0] or 0
        if total >= AUDIT_LINKS or share >= 1:
            break
        share = min(1.0, 8 * share)
    width = beam
    while True:
        links = per_node(found)
        seen = truth.join(links, "node", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()[0] or 0
        if seen >= recall * total or width is None:
            break
        width = 2 * width if width < 2 * shard else None
        found = search(queries, width)

    label = components(found.where("b is not null").select("a", "b"))
    least = label.join(cls.select("node", "id"), "node").groupBy("label").agg(F.min("id").alias("least"))
    reach = label.join(least, "label").select("node", "least")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", F.coalesce(F.col("vec_id"), F.lit(NO_ID)).cast("long").alias("_id"), "label", v.alias("v"))
    known = cls.join(reach, "node", "left").join(links, "node", "left").select(
        "label", "v", F.col("rows").alias("_rows"), F.coalesce("least", "id").alias("_least"), F.coalesce("links", F.lit(0)).alias("_links"))
    got = rows.join(known, ["label", "v"], "left")
    component = F.coalesce("_least", "_id")
    none = F.lit(None).cast("long")
    return got.select("vec_id", (F.coalesce("_links", F.lit(0)) + F.coalesce("_rows", F.lit(1)) - 1).alias("n_links"),
                      F.when(component != NO_ID, component).otherwise(none).alias("component_id"), (F.col("_id") == component).alias("kept"))
