"""Quality classifier, vectors and the pipeline."""

import math

import brute as B
import numpy as np
import pytest
from conftest import frame, prose
from pyspark.sql import functions as F

import corpus_pipeline as C
from mirage.llm import quality
from mirage.llm import queries as Q
from mirage.llm.common import components, forest
from mirage.llm import vector_dedup as V
from mirage.llm.vector_dedup import Graph, near_vectors, unit

SF = "/root/testdata/sf0.001"


# -- quality ----------------------------------------------------------------

def test_held_out_accuracy(spark):
    """Fitted on half of sf0.1's ratings, measured on the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.xxhash64("doc_id", F.lit(3)) % 2 == 0
    model = quality.train(docs, quality.grades(labels.where(half)), quality.N_GRADES)
    rows = quality.rate(docs, model, quality.N_GRADES, ["doc_id"]).join(labels.where(~half), "doc_id")
    got = rows.select("quality", "toxic", "expected_grade", quality.keeps(1, 0.5).alias("kept"), quality.keeps(2, 0.5).alias("best")).toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.05
    sound = got[got.quality == 1]
    assert sound[sound.toxic == 0].expected_grade.mean() > sound[sound.toxic == 1].expected_grade.mean() + 0.3
    # The stricter decision: most clean documents, about half of the toxic ones.
    assert sound[sound.toxic == 0].best.mean() > 0.98 and sound[sound.toxic == 1].best.mean() < 0.55


def test_rates_every_row(spark, docs):
    labels = spark.createDataFrame([(10, 1, 0), (10, 1, 0), (42, 0, 0), (44, 0, None), (20, 1, 1), (None, 1, 1), (20, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades(labels), quality.N_GRADES)
    got = quality.rate(docs, model, quality.N_GRADES)
    assert got.columns == [c for c in docs.columns if c != "tail"] + ["expected_grade", "tail"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(len(r["tail"]) == 2 and r["tail"][0] >= r["tail"][1] for r in rows)
    assert all(math.isclose(r["expected_grade"], sum(r["tail"])) for r in rows)
    empty = {round(r["expected_grade"], 9) for r in rows if not (r["text"] or "")}
    assert len(empty) == 1


def test_without_ratings_all_stay(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades(labels), quality.N_GRADES)
    assert model is None
    got = quality.rate(docs, model, quality.N_GRADES)
    assert got.where(quality.keeps(1, 0.5)).count() == docs.count()
    assert quality.rate(none, (np.zeros(quality.SIZE), np.array([0.0, 1.0])), 3).count() == 0


def test_bound_on_ratings(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.train(docs, quality.grades(labels), quality.N_GRADES, max_rated=3) is not None


def test_the_fit_is_bounded_where_ids_repeat(spark, monkeypatch):
    """A rating of an id that very many rows share brings one row to the fit,
    the same one whatever the order."""
    texts = [(1, f"good text {k % 50}") for k in range(3000)] + [(k, f"bad $$$ {k}") for k in range(2, 30)] + [(99, "good and fine text")]
    labels = spark.createDataFrame([(1, 1, 0), (99, 1, 0)] + [(k, 0, 0) for k in range(2, 30)], "doc_id long, quality int, toxic int")
    models = []
    for parts in (1, 7):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        models.append(quality.train(docs, quality.grades(labels), quality.N_GRADES))
    assert np.allclose(models[0][0], models[1][0]) and np.allclose(models[0][1], models[1][1])
    chosen = min({t for i, t in texts if i == 1}, key=lambda t: spark.sql("SELECT xxhash64(:t)", {"t": t}).first()[0])
    lone = spark.createDataFrame([(1, chosen), *texts[3000:]], "doc_id long, text string")
    same = quality.train(lone, quality.grades(labels), quality.N_GRADES)
    assert np.allclose(models[0][0], same[0]) and np.allclose(models[0][1], same[1])


def test_fit_lowers_the_loss_of_ordered_grades():
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    grade = np.digitize(x + 0.1 * r.normal(size=500), [-0.5, 0.5])
    w, theta = quality.fit(np.arange(500), np.zeros(500, np.int64), x, grade, 3)
    assert w[0] > 1 and theta[0] < theta[1]
    assert (np.digitize(w[0] * x, theta) == grade).mean() > 0.9


# -- vectors ----------------------------------------------------------------

KIND = "vec_id long, embedding array<float>, label int, kept string, v int, rows int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], KIND).repartition(3)


def cloud(seed, n, dim=12, copies=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = np.repeat(base[: n // 2], copies, 0) + 0.08 * r.normal(size=(n // 2 * copies, dim))
    return np.r_[base, near].astype(np.float32)


def result(df):
    return B.ordered((r["vec_id"], r["component_id"], r["n_links"], r["kept"]) for r in df.collect())


def test_vectors(spark):
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(cloud(1, 150))]
    x = rows[5][1]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, x, x, [2 * a for a in x], [-a for a in x], [1e-38] * 12, [3e38] * 12, [1.0, 2.0]]
    rows += [(1000 + k, e, 2) for k, e in enumerate(odd)] + [(2000, x, None), (None, x, 2), (1006, x, 2), (3000, [1.0, 2.0], 2), (3001, [0.0, 1.0], 2), (3002, [-0.0, 1.0], 2)]
    assert result(near_vectors(vector_frame(spark, rows))) == B.ordered(B.vectors([(i, None if e is None else [None if a is None else float(np.float32(a)) for a in e], c) for i, e, c in rows]))


def test_vectors_in_shards_and_wide_beams(spark):
    """Several shards a label; a group far larger than the beam."""
    r = np.random.default_rng(4)
    group = np.ones(16) + 0.05 * r.normal(size=(300, 16))
    x = np.r_[group, cloud(2, 200, 16)].astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    assert result(near_vectors(vector_frame(spark, rows), beam=4, shard=150, audit=1000, recall=1.0)) == B.ordered(B.vectors(rows))


def test_a_search_that_misses_ends_exactly(spark, monkeypatch):
    """A recall that no search can reach: beams widen, then the blocks are
    compared, and the result is exact."""
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(cloud(12, 200, 16))]
    widths = []
    materialise = V.materialise
    monkeypatch.setattr(V, "materialise", lambda df, tag: widths.append(tag) or materialise(df, tag))
    assert result(near_vectors(vector_frame(spark, rows), beam=1, shard=40, audit=3, recall=1.1)) == B.ordered(B.vectors(rows))
    assert widths.count("links") >= 7  # the search, its audits, wider beams and the comparison


def test_rare_links_are_audited(spark):
    """A few pairs among thousands of vectors: the audit goes on until it has
    seen links, all rows if need be."""
    r = np.random.default_rng(21)
    x = r.normal(size=(3000, 24))
    x[2990:] = x[:10] + 0.01 * r.normal(size=(10, 24))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype(np.float32))]
    got = result(near_vectors(vector_frame(spark, rows), beam=8, shard=700))
    assert got == B.ordered(B.vectors(rows)) and sum(g[2] for g in got) == 20


def test_registered_vectors_with_planted_groups(spark, scratch):
    """The registered query over a table with copies, near pairs, a chain and a
    group of hundreds, in labels and without."""
    r = np.random.default_rng(22)
    x = r.normal(size=(1200, 32))
    x[100:400] = x[100] + 0.1 * r.normal(size=(300, 32))
    x[500:520] = x[500]
    for k in range(600, 620):
        x[k + 1] = x[k] + 0.3 * r.normal(size=32)
    rows = [(k, v.tolist(), None if k % 97 == 0 else k // 400) for k, v in enumerate(x.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{scratch}/embeddings.parquet")
    got, want = result(Q.op10_vector_dedup(spark, scratch)), B.ordered(B.vectors(rows))
    links = sum(w[2] for w in want)
    assert links > 80_000 and len(got) == len(want)
    assert sum(min(g[2], w[2]) for g, w in zip(got, want)) >= 0.99 * links and all(g[2] <= w[2] for g, w in zip(got, want))


def test_vectors_empty(spark):
    assert near_vectors(vector_frame(spark, [])).count() == 0
    assert result(near_vectors(vector_frame(spark, [(1, None, 1), (2, [1.0], None)]))) == [(1, 1, 0, True), (2, 2, 0, True)]


def test_registered_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, want = result(Q.op10_vector_dedup(spark, sf)), B.ordered(B.vectors(rows))
    links = sum(r[2] for r in want)
    assert len(got) == len(want) and sum(min(a[2], b[2]) for a, b in zip(got, want)) >= 0.98 * links
    assert all(a[2] <= b[2] for a, b in zip(got, want))  # nothing below the threshold


def test_graph_recall_and_round_trip():
    x = unit(cloud(7, 800, 24).astype(np.float64))
    g = Graph(x)
    h = Graph.load(x, g.dump())
    true = x @ x.T >= 0.93
    found = 0
    for k in range(0, len(x), 7):
        a, b = g.search(x[k].astype(np.float32), 16, 0.93), h.search(x[k].astype(np.float32), 16, 0.93)
        assert sorted(a) == sorted(b)
        found += true[k][a].sum()
    assert found >= 0.97 * true[::7].sum()


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 3), (3, 9), (None, 1)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 7: 3, 9: 3}


def test_forest():
    a, b = np.array([0, 1, 0, 3, 4]), np.array([1, 2, 2, 4, 3])
    got = forest(6, a, b)
    assert len(got) == 3 and B.union(6, got) == B.union(6, list(zip(a, b)))


# -- pipeline ---------------------------------------------------------------

def test_stages(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = [n for n, _ in C.STAGES]
    assert order == ["quality classifier", "exact dedup", "n-gram Jaccard join", "source mixing", "best-fit packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(C.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out = Q_materialise(out)
        ids = sorted(r["doc_id"] for r in out.select("doc_id").distinct().collect())
        if k == 0:
            assert 0 < len(ids) < len(before)
            assert all(i in ids for i, q in labels.items() if q == 1) and not any(i in ids for i, q in labels.items() if q == 0)
        elif k == 1:
            assert ids == sorted(r[0] for r in B.exact(before) if r[3])
        elif k == 2:
            assert ids == sorted(r[0] for r in B.near(before) if r[3])
        elif k == 3:
            rows = out.collect()
            assert len(rows) == len(ids) and all(text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
            n = sum(len(B.words(r["text"])) for r in rows)
            total = sum(len(B.words(t)) for _, t in before)
            assert 0.88 * total < n <= 0.9 * total
            assert sum(text[r["doc_id"]] != r["text"] for r in rows) <= len({(r["lang"], r["source"]) for r in rows})
        else:
            import public_tokenizers
            from tokenizers import Tokenizer
            plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            rows = out.collect()
            want = B.pieces(before, lambda t: plain.encode(t, add_special_tokens=False).ids)
            assert B.ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == B.ordered(want)
            at = {}
            for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == at.get(r["sequence_id"], 0)
                at[r["sequence_id"]] = r["offset"] + r["length"]
            assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(at.values()) / 2048 + 2
        docs = out


def Q_materialise(df):
    from mirage.llm.common import materialise

    return materialise(df, "test")


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, docs, k):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = Q_materialise(C.STAGES[k][1](spark, rows, SF))
    if k < 4:
        assert out.columns == rows.columns
    assert out.count() > 0
    if k == 1:
        assert out.count() == len({(r[1]) for r in B.exact([tuple(x) for x in rows.select("doc_id", "text").collect()])}) + 1  # 51 has two texts
    if k == 4:
        assert out.where("piece = 0").count() == rows.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, texts, k):
    """Columns named like an operator's outputs and helpers come out as they
    went in, with their types and values."""
    names = ["kept", "tail", "epoch", "n_tokens", "take_tokens", "row", "budget", "_near_id", "_near_carry", "_carry", "_text", "_n", "expected_grade",
             "text_sha256", "group_size", "length", "sha", "_id", "_key", "n", "id", "hash"]
    good = [(i, t) for i, t in texts if i is not None and texts.count((i, t)) == 1 and [x for x, _ in texts].count(i) == 1]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or ""), *[f"{c} {i}" for c in names]) for i, t in good],
                               "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)).repartition(3)
    out = C.STAGES[k][1](spark, df, SF)
    assert out.schema.simpleString() == df.schema.simpleString()
    rows = out.collect()
    assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in names)


@pytest.mark.parametrize("k", [1, 2])
def test_repeated_rows_are_chosen_alike(spark, k):
    """Rows that repeat id and text but differ elsewhere: the same one stays
    however they are dealt."""
    rows = [(i, prose(f"same {i}", 50), "en", f"src{c}", 5) for i in (1, 2, None) for c in range(9)]
    kept = set()
    for parts in (1, 2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts, "source")
        kept.add(tuple(sorted((str(r["doc_id"]), r["source"]) for r in C.STAGES[k][1](spark, df, SF).collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 3


def near_survivors(rows):
    """One (id, words) of each group: the smallest id, and how many rows without words."""
    key = lambda i: float("inf") if i is None else i
    sets = [B.shingles(t) for _, t in rows]
    pairs = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if x and len(x & y) >= 0.8 * len(x | y)]
    groups = {}
    for k, r in enumerate(B.union(len(rows), pairs)):
        if sets[k]:
            groups.setdefault(r, []).append(k)
    return [(min((rows[k][0] for k in g), key=key), {" ".join(B.words(rows[k][1])) for k in g}) for g in groups.values()], sum(not s for s in sets)


def one_of_each_group(spark, rows):
    got = [tuple(r) for r in C.near_stage(spark, rows, SF).select("doc_id", "text").collect()]
    groups, blank = near_survivors([tuple(r) for r in rows.select("doc_id", "text").collect()])
    left = [(i, " ".join(B.words(t))) for i, t in got if B.words(t)]
    assert len(got) - len(left) == blank and len(left) == len(groups)
    for ident, texts in groups:
        assert [i for i, t in left if t in texts] == [ident]


def test_near_stage_keeps_one_of_each_group(spark, docs):
    one_of_each_group(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"))


def test_near_stage_on_null_and_repeated_ids(spark):
    def change(text, k):
        words = text.split()
        words[k] = "changed"
        return " ".join(words)

    rows = []
    for g in range(6):
        text = prose(f"group{g}", 120)
        rows += [(None, text), (None, change(text, 50)), (g % 2, change(text, 90)), (7, "  " + text), (7, text)]
    rows += [(None, prose("alone", 50)), (7, prose("alone too", 50)), (None, None), (7, "")]
    rows += [(None, prose("nulls", 100)), (None, change(prose("nulls", 100), 40)), (None, prose("nulls", 100))]
    one_of_each_group(spark, frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_no_rows(spark, none, k):
    rows = none.select("doc_id", "text", "lang", "source", "n_chars")
    assert C.STAGES[k][1](spark, rows, SF).count() == 0


def test_long_and_short(spark):
    rows = frame(spark, [(1, prose("x", 50_000)), (2, "y")])
    assert C.STAGES[4][1](spark, rows, SF).where("piece = 0").count() == 2
