"""Operators without a registered oracle query."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mirage.operators import batch_model as BM
from mirage.operators import evaluate as EV
from mirage.operators import terms as TM
from mirage.operators import vectors as VX
from mirage.sources import sinks


def test_terms_cell(spark):
    cell = ("[{'termId': 3, 'term': 'Solar Kite', 'termSet': 'hypothetical', 'termSetId': 0, "
            "'explanation': None}, {'termId': 9, 'term': \"O'Neil ring\", 'termSet': 'gpt_suggestion', "
            "'termSetId': 1, 'explanation': 'a ring'}]")
    df = spark.createDataFrame([(cell,)], "terms string")
    got = df.select(EV.parse_terms_cell("terms").alias("t")).first().t
    assert [x.term for x in got] == ["Solar Kite", "O'Neil ring"]
    assert got[0].explanation is None and got[1].termSetId == 1


def test_short_layout_check(spark):
    df = spark.createDataFrame([(1, "a", 1, "q", [])],
                               "answer_id long, answer string, question_id long, question string, "
                               "terms array<struct<termId:long,term:string,termSet:string,"
                               "termSetId:long,explanation:string>>")
    try:
        EV.to_wide(df)
        raise AssertionError("expected a failure")
    except ValueError:
        pass


TRIPLETS = "term_triplet_id long, nonexistent_id long, nonexistent_term string, secondary_id long, secondary_term string, " \
           "secondary_source_id long, replacement_id long, replacement_term string, replacement_source_id long, topic string, " \
           "topic_explanation string, nonexistent_explanation string, secondary_explanation string, replacement_explanation string"


def triplet(k, made_up="Zorbl"):
    return (k, 10 + k, made_up, 20 + k, "kite", 1, 30 + k, "sail", 2, "t", "te", "ze", "ke", "se")


STORED = "main_id long, main_source long, secondary_id long, secondary_source long, replacement_type long, question string"


def by_type(df):
    return {(r.triplet_id, r.replacement_type): r.question for r in df.collect()}


def test_question_reuse(spark):
    trip = spark.createDataFrame([triplet(1), triplet(2), triplet(3)], TRIPLETS)
    old = spark.createDataFrame([(11, 0, 21, 1, 0, "Is Zorbl a kite?"), (31, 2, 21, 1, 3, "Old fresh one"),
                                 (12, 0, 22, 1, 0, "Not valid"), (13, 0, 23, 9, 0, "Is Zorbl of another source?")], STORED)
    out = by_type(BM.generate_questions(trip, BM.stub_generator, existing=old))
    assert out[1, 0] == "Is Zorbl a kite?" and out[1, 1] == "Is sail a kite?" and out[1, 3] == "Old fresh one"
    assert out[2, 0] == out[3, 0] == "How does Zorbl relate to kite?"      # an invalid one is asked again
    assert out[2, 3] == "How does sail relate to kite?" and len(out) == 9


def test_model_is_asked_once_per_triplet_and_type(spark):
    """A writer that never says the same twice: type 1 is the swap of the
    type-0 question that is given out."""
    calls = spark.sparkContext.accumulator(0)

    def writer(pdf):
        import uuid
        calls.add(len(pdf))
        return pd.Series([f"{uuid.uuid4().hex} of {n} or {r}" for n, r in zip(pdf["nonexistent_term"], pdf["replacement_term"])], index=pdf.index)

    trip = spark.createDataFrame([triplet(k) for k in range(10)], TRIPLETS)
    out = by_type(BM.generate_questions(trip, writer, partitions=3))
    assert calls.value == 20 and len(out) == 30
    for k in range(10):
        assert out[k, 1] == out[k, 0].replace("Zorbl", "sail")


def test_question_columns_are_checked(spark):
    trip = spark.createDataFrame([triplet(1)], TRIPLETS).drop("secondary_id")
    try:
        BM.generate_questions(trip, BM.stub_generator)
        raise AssertionError("expected a failure")
    except ValueError as e:
        assert "secondary_id" in str(e)


def test_invalid_type0_drops_other_types(spark):
    trip = spark.createDataFrame([triplet(1)], TRIPLETS)

    def bad_writer(pdf):
        return pd.Series(["A question without the term"] * len(pdf), index=pdf.index)
    assert BM.generate_questions(trip, bad_writer).count() == 0


LONG = "answer_id long, question_id long, answer string, question string, term_pos int, term_id long, term string, meaning string, " \
       "term_source string, is_hypothetical boolean"


def test_judge_loses_and_multiplies_no_rows(spark):
    rows = [(k, k, "a kite and a sail", "q", 0, k, "kite", "m", "1", False) for k in range(6)]
    long = spark.createDataFrame(rows, LONG)

    def forgetful(pdfs):
        for pdf in pdfs:
            kept = pdf[pdf["request_id"].str.contains("^[024]:")]
            yield pd.DataFrame({"request_id": kept["request_id"], "reply": '{"certainty": "unreal", "verified": true}'})

    got = EV.judge_terms(long, forgetful, 2).collect()
    assert len(got) == 12
    lost = [r for r in got if r.answer_id % 2]
    assert all(r.eval_label == 0 and r.reflection.startswith("WARNING: Failed to parse response: ") and r.parse_step == 0 for r in lost)
    assert {r.eval_type_id for r in EV.judge_terms(long, forgetful, 2, only=3).collect()} == {3}
    done = spark.createDataFrame([(0, 2, "1", 0, 2), (1, 3, "1", 1, 2), (2, 3, "1", 2, 5)],
                                 "answer_id long, eval_type_id long, term_source string, term_id long, model_id long")
    rest = {(r.answer_id, r.eval_type_id) for r in EV.judge_terms(long, forgetful, 2, done=done).collect()}
    assert len(rest) == 10 and (0, 2) not in rest and (1, 3) not in rest and (2, 3) in rest

    def double(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"request_id": list(pdf["request_id"]) * 2, "reply": "{}"})

    try:
        EV.judge_terms(long, double, 2).collect()
        raise AssertionError("expected a failure")
    except Exception as e:
        assert "two replies" in str(e)


def test_short_answers(spark):
    cell = ("[{'termId': 3, 'term': 'Solar Kite', 'termSet': 'hypothetical', 'termSetId': 0, 'explanation': None}, "
            "{'termId': 9, 'term': 'ring', 'termSet': 'gpt_suggestion', 'termSetId': 1, 'explanation': 'a ring'}]")
    df = spark.createDataFrame([(7, "q7", cell, "a7", 77), (8, "q8", cell, "a8", 78)], "question_id long, question string, terms string, answer string, answer_id long")
    got = EV.to_wide(df.coalesce(1)).orderBy("answer_id").collect()
    assert [(r.answer_id, r.question_id, r.nonexistent, r.nonexistent_meaning, r.secondary, r.replacement) for r in got] == [
        (0, 7, "Solar Kite", None, "ring", ""), (1, 8, "Solar Kite", None, "ring", "")]
    assert EV.inclusion_evals(EV.terms_long(EV.to_wide(df))).count() == 4
    try:
        EV.to_wide(df.withColumn("terms", F.regexp_replace("terms", "'explanation': None", "'x': 1")))
        raise AssertionError("expected a failure")
    except ValueError:
        pass


def test_upsert_keeps_stored_ids(spark):
    cand = spark.createDataFrame([(1, "Delta", "d", 2, 2), (1, "alpha", "a", 1, 1), (2, "ALPHA", "x", 2, 1), (2, "gamma", "g", 1, 5), (3, "Beta", "b", 3, 1)],
                                 "fake_term_id long, term string, explanation string, source_id long, position long")
    old = spark.createDataFrame([(2, "Gamma", "stored", 1), (7, "Omega", "stored", 3)], "id long, term string, explanation string, source_id long")
    real, links = TM.upsert_real_terms(cand, old)
    assert {(r.id, r.term) for r in real.collect()} == {(2, "Gamma"), (7, "Omega"), (8, "alpha"), (9, "Delta"), (10, "Beta")}
    assert {(r.nonexistent_id, r.real_id) for r in links.collect()} == {(1, 8), (1, 9), (2, 8), (2, 2), (3, 10)}
    ids = [r.id for r in TM.upsert_real_terms(cand)[0].collect()]
    assert sorted(ids) == [1, 2, 3, 4]


def test_term_suggestions(spark):
    one = spark.createDataFrame([(1, "a", "x", 1)], "fake_term_id long, term string, explanation string, position long")
    got = TM.term_suggestions(one, None, one.withColumn("extra", F.lit(1)))
    assert sorted((r.source_id, r.term) for r in got.collect()) == [(1, "a"), (3, "a")]


def test_revised_rows(spark):
    from mirage.operators import incremental as I
    kind = "id long, answer_id long, eval_label long, eval_type_id long, reflection string, term_source long, term_id long, model_id long"
    stored = spark.createDataFrame([(5, 1, 0, 4, "", 1, 1, 10), (6, 1, 0, 2, "r", 1, 1, 2)], kind)
    long = spark.createDataFrame([(1, "no such", "kite", "1", 1), (1, "no such", "kite", "1", 1), (2, "a sail", "sail", "2", 4), (2, "a sail", "sail", "2", 4)],
                                 "answer_id long, answer string, term string, term_source string, term_id long")
    got = sorted(tuple(r) for r in I.revised(stored, I.reconcile_inclusion(stored, long)).collect())
    assert got == [(5, 1, 2, 4, "", 1, 1, 10), (6, 1, 0, 2, "r", 1, 1, 2), (7, 2, 0, 4, "", 2, 4, 10)]


def test_failures_ask_the_model_once(spark):
    from mirage.operators import incremental as I
    calls = spark.sparkContext.accumulator(0)

    def model(pdf):
        calls.add(len(pdf))
        return pd.Series(["WARNING! Timeout." if p == "3" else p for p in pdf["prompt"]], index=pdf.index)

    answers = BM.call_model(spark.range(5).select(F.col("id").cast("string").alias("prompt")), model, "answer")
    good, bad = I.split_failures(answers, max_failures=1)
    assert good.count() == 4 and bad.count() == 1 and calls.value == 5
    try:
        I.split_failures(answers, max_failures=0)
        raise AssertionError("expected a failure")
    except RuntimeError:
        pass


def test_retries_and_sentinels():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if prompt == "fail":
            raise RuntimeError("x")
        if prompt == "hang":
            time.sleep(30)
        if prompt == "second" and calls.count("second") == 1:
            raise RuntimeError("x")
        return prompt.upper()
    fn = BM.with_retries(flaky, retries=2, timeout_s=0.2)
    t = time.time()
    out = fn(pd.DataFrame({"prompt": ["ok", "fail", "hang", "second"]})).tolist()
    assert time.time() - t < 2                      # a call that never returns holds nothing up
    assert out == ["OK", "WARNING! Model failure.", "WARNING! Timeout.", "SECOND"]
    assert sorted(calls) == ["fail"] * 2 + ["hang"] * 2 + ["ok"] + ["second"] * 2


def test_unjudged_answers_of_many_judges(spark):
    from mirage.operators import labels as L
    rows = [(k, 1, 0, 2, "", 1, 1, 100 + k) for k in range(50)] + [(99, 2, 2, 4, "", 1, 1, 10)]
    df = spark.createDataFrame(rows, "id long, answer_id long, eval_label long, eval_type_id long, reflection string, "
                                     "term_source long, term_id long, model_id long")
    got = L.answer_labels(df, include_unjudged=True).where("answer_id = 2").collect()
    assert sorted(r.evaluator_model_id for r in got) == list(range(100, 150)) and {r.answer_label for r in got} == {2}
    assert L.answer_labels(df, include_unjudged=True, judges=[7]).where("answer_id = 2").count() == 1


def test_whole_paragraphs(spark):
    pages = spark.createDataFrame([(1, "A", ["A", "x" * 20_000, "short", "a::::b" * 10])], "_id long, wikipedia_title string, text array<string>")
    assert [len(r.text) for r in TM.paragraphs(pages).collect()] == [20_000]
    assert [len(r.text) for r in TM.paragraphs(pages, max_chars=9000).collect()] == [9000]


def test_many_topics_and_blocks_of_terms(spark):
    topics = spark.range(12_000).select("id", F.col("id").alias("pos"), F.concat(F.lit("topic "), F.col("id").cast("string"), F.lit("!")).alias("topic"))
    titles = spark.createDataFrame([("77!",), ("none",), ("",), (None,), ("opic 9",)], "title string")
    got = {r.title: r.topic_pos for r in TM.topic_containing(titles, topics).collect()}
    assert got == {"77!": 77, "none": None, "": 0, None: None, "opic 9": 9}
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(40)], "doc_id long, text string")
    terms = spark.createDataFrame([(f"NUMBER {k} ",) for k in range(60)], "term string")
    got = {(r.term, r.doc_id) for r in TM.phrase_hits(terms, docs, block_chars=200).collect()}
    assert got == {(f"NUMBER {k} ", k) for k in range(40)}


def test_ordering_over_partitions(spark):
    from mirage.operators.ordering import GlobalOrder, from_offset
    keys = [(k * 7) % 100 for k in range(100)]
    df = spark.createDataFrame([(k, "ab"[k // 13 % 2] if k % 29 else None, float(k) if k % 5 else None) for k in keys], "k long, g string, v double")
    for n in (1, 3, 7, None):
        order = GlobalOrder(df, ["k"], n)
        assert [r.pos for r in order.with_position().orderBy("k").collect()] == list(range(100))
        rows = order.run_ids("g").orderBy("k").collect()
        want, last = [], object()
        for r in rows:
            want.append((want[-1] if want else 0) + (r.g != last))
            last = r.g
        assert [r.run_id for r in rows] == want
        means = order.running_mean("v").orderBy("k").collect()
        assert all(abs(r.running_mean - sum(x for x in range(r.k + 1) if x % 5) / (r.k + 1)) < 1e-9 for r in means)
    assert from_offset(df, ["k"], 90).count() == 10
    assert GlobalOrder(df.limit(0), ["k"]).with_position().count() == 0


def test_equal_order_values_are_spread(spark):
    """Half of the rows have one order value: they fall into many partitions,
    in the order in which they were read, and positions stay gapless."""
    from mirage.operators.ordering import GlobalOrder
    n = 8000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id") % 1000).alias("k"), F.lit("same").alias("g"))
    order = GlobalOrder(df, ["k"], 8)
    sizes = [r["n"] for r in order.df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= n / 4
    tied = order.df.where("k = 500").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tied >= 4
    rows = order.with_position().orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(n))
    assert [(r.k, r.id) for r in rows] == sorted((500 if k % 2 == 0 else k % 1000, k) for k in range(n))
    assert [r.run_id for r in order.run_ids("g").collect()] == [1] * n
    got = order.run_ids("k").orderBy("k", "id").collect()
    want = {k: i + 1 for i, k in enumerate(sorted({r.k for r in rows}))}
    assert all(r.run_id == want[r.k] for r in got)
    same = spark.range(3000).select(F.lit(7).alias("k"))  # rows that are all alike
    assert sorted(r.pos for r in GlobalOrder(same, ["k"], 4).with_position().collect()) == list(range(3000))


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from mirage.session import ensure_checkpoint_dir

    class Context:
        master = "spark://x:7077"
        def getConf(self): return {}
        def getCheckpointDir(self): return None

    class Session:
        sparkContext = Context()
        conf = {}

    try:
        ensure_checkpoint_dir(Session())
        raise AssertionError("expected a failure")
    except RuntimeError:
        pass


def test_encode_and_observe(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    enc = VX.encode(rows, "text", lambda xs: np.array([[len(x), 1.0] for x in xs]), 2)
    got = sorted((r.id, list(r.embeddings)) for r in enc.collect())
    assert got == [(1, [2.0, 1.0]), (2, [4.0, 1.0])]


def test_hit_terms(spark):
    pages = spark.createDataFrame([(1, "A", ["A", "first"]), (2, "B", ["B", "B may refer to:"])],
                                  "_id long, wikipedia_title string, text array<string>")
    hits = spark.createDataFrame([(1, "hit1"), (2, "hit2"), (3, "hit3")], "id long, text string")
    t = {r.id: r.explanation for r in TM.hit_terms(hits, pages, "title").collect()}
    assert t == {1: "first"}
    p = {r.id: r.explanation for r in TM.hit_terms(hits, pages, "text").collect()}
    assert p == {1: "first", 2: "hit2", 3: "hit3"}


def test_vector_partitions(spark, scratch):
    rows = spark.range(250001).select(F.col("id").alias("source_pos"),
                                      F.array(F.lit(0.0)).alias("embeddings"))
    sinks.write_vectors(rows, f"{scratch}/v")
    parts = {r.partition: r["count"] for r in
             spark.read.parquet(f"{scratch}/v").groupBy("partition").count().collect()}
    assert parts == {1: 100000, 2: 100000, 3: 50001}


def test_answers_of_model(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "answer_id long, answer_source_id long")
    m = spark.createDataFrame([(2, "x"), (3, "y")], "id long, name string")
    assert [r.answer_id for r in EV.answers_of_model(a, m, "y").collect()] == [2]


def test_phrase_hits_all_paths(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "a string of rings"),
                                  (3, "Quick  Brown\\tFox"), (4, "no match here")],
                                 "doc_id long, text string")
    terms = spark.createDataFrame([("quick brown fox",), ("ring",), ("g of r",), ("",), (" ",),
                                   ("x",), ("brown fox jumps",), ("absent words here",)],
                                  "term string")
    got = {(r.term, r.doc_id) for r in TM.phrase_hits(terms, docs).collect()}
    brute = {(t, d) for t in [r.term for r in terms.collect()]
             for d, txt in [(r.doc_id, r.text) for r in docs.collect()] if t.lower() in txt.lower()}
    assert got == brute


def test_phrase_counts_over_blocks_and_chunks(spark, monkeypatch):
    """Counts and first documents are folded in the tasks, whatever the blocks;
    a term in every document gives a row per task, not per document."""
    monkeypatch.setattr(TM, "CHUNK_CHARS", 60)
    docs = spark.createDataFrame([(k, None if k % 50 == 7 else f"Common text number {k} {'x' * (k % 90)}") for k in range(400)],
                                 "doc_id long, text string").repartition(4)
    terms = ["common", "COMMON", "number 1", "number 399", "xxxxxxxx", "absent", "", "mon t", "common"]
    t = spark.createDataFrame([(x,) for x in terms] + [(None,)], "term string")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is not None]
    want = {x: sum(x.lower() in text.lower() for _, text in rows) for x in terms}
    for block_chars in (10_000, 30):
        got = {r.term: r.hits for r in TM.phrase_exists(t, docs, block_chars=block_chars).collect() if r.term is not None}
        assert got == want
    pairs = TM._term_pairs(t, docs, "term", "doc_id", "text", True, 10_000)
    assert TM._per_task(pairs, 0, lambda n, _: n + 1, "long").where("term = 'common'").count() <= 4
    assert TM.phrase_exists(t, docs.where("false")).where("exists").count() == 0
    assert TM.phrase_exists(t.where("false"), docs).count() == 0


def test_narrow_views_equal_wide_operators(spark):
    """The id-level grouped/labelled views give the rows of the generic
    operators applied to the wide detailed view."""
    from mirage.operators import labels as L
    from mirage.plans import views as V
    from mirage.plans.derived import Pipeline
    p = Pipeline(spark, "/root/testdata/sf0.001")
    wide = V.terms_evals_detailed(p)
    for fast, slow in ((V.ai_grouped_view(p), L.ai_grouped(wide)),
                       (V.labelled_view(p), L.labelled(wide))):
        assert fast.columns == slow.columns
        assert fast.count() == slow.count() > 0
        assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_keep_first_aggregate_path_nulls_first(spark):
    """With every other column as key, keep-first is a min aggregate that
    still puts a null order value first, like the window form."""
    from mirage.functions.common import keep_first
    df = spark.createDataFrame([("x", 1, 5), ("x", 1, None), ("x", 2, 7), ("y", 1, 3), ("y", 1, 2)],
                               "k string, j int, o long")
    got = sorted(keep_first(df, ["k", "j"], ["o"]).collect(), key=lambda r: (r.k, r.j))
    assert [tuple(r) for r in got] == [("x", 1, None), ("x", 2, 7), ("y", 1, 2)]
    assert keep_first(df, ["k", "j"], ["o"]).columns == ["k", "j", "o"]


def test_existence_states(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "term string, exists boolean")
    assert [r.term for r in TM.not_found(df).collect()] == ["b"]
    assert [r.term for r in TM.still_unchecked(df).collect()] == ["c"]


def test_run_stamp(spark):
    import re

    from mirage.functions.text import run_stamp
    assert re.fullmatch(r"20\d{6}_\d{6}", spark.range(1).select(run_stamp()).first()[0])


def test_silent_judge(spark):
    """A judge that gives no reply at all, or only to some requests: what it
    leaves out counts as failed."""
    import pandas as pd

    from mirage.operators import evaluate as EV
    wide = spark.createDataFrame([(1, "the alpha beta", 1, "q", 0, "", 5, "alpha", "m", "1", 6, "beta", "n", "2", 1)],
                                 "answer_id long, answer string, question_id long, question string, nonexistent_id long, nonexistent string, "
                                 "secondary_id long, secondary string, secondary_meaning string, secondary_source string, "
                                 "replacement_id long, replacement string, replacement_meaning string, replacement_source string, replacement_type long")
    long = EV.terms_long(wide)
    for judge in (lambda pdfs: iter([]), lambda pdfs: (pd.DataFrame({"request_id": [], "reply": []}) for _ in pdfs)):
        got = EV.judge_terms(long, judge, 2).collect()
        assert len(got) == 4 and all(r.reflection.startswith("WARNING") for r in got)
    assert EV.judge_terms(long.where("false"), lambda pdfs: iter([]), 2).count() == 0


def test_report_rows_equal_the_deduplicated_view(spark, tmp_path):
    """codes stand for names and repeats go before the joins; the rows
    are those of the wide dedupe, also with repeated and missing keys, and no
    sort or shuffle carries names."""
    from mirage import schemas as S
    from mirage.operators import labels as L
    from mirage.plans import views as V
    from mirage.plans.derived import Pipeline

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    class Small(Pipeline):
        evals = table([(1, 1, 0, 2, "r", 0, 1, 1), (2, 1, 0, 2, "r", 0, 1, 1), (2, 1, 1, 3, "q", 1, 2, 2), (3, 1, 1, 4, "", 1, 2, 10),
                       (3, 1, 2, 4, "", 3, 1, 10), (4, 2, 0, 3, "r", 2, 9, 3), (5, 2, 1, 2, "r", 0, None, 10), (None, 2, 2, 2, "r", 7, 1, 1),
                       (6, 2, 0, 9, "r", 0, 1, 1), (7, None, 0, 2, "r", 0, 1, 1), (8, 3, 2, 4, "", 1, 1, 10), (9, 2, None, 2, "r", 0, 1, 2),
                       (None, 1, 2, 2, "s", 1, 1, 0), (4, 1, 0, 2, "r", 1, 1, 1), (None, 2, 0, 3, None, 1, 2, 1)],
                      "id long, answer_id long, eval_label long, eval_type_id long, reflection string, term_source long, term_id long, model_id long")
        answers = table([(1, 1, 2, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (2, 2, 5, "d"), (2, 9, 5, "e"), (3, 1, 1, "f"), (None, 1, 1, "g")],
                        "id long, question_id long, model_id long, answer string")
        questions = table([(1, 1, 0, "q1"), (1, 1, 1, "q1b"), (2, 1, 3, "q2"), (None, 1, 0, "q")], "id long, triplet_id long, replacement_type long, question string")
        real_terms = table([(1, "x", "e", 1), (1, None, "e", 1), (2, "z", "e", 2), (2, "y", "f", 2)], "id long, term string, explanation string, source_id long")
        nonexistent = table([(1, "m", "e", 1), (None, "n", "e", 1)], "id long, term string, explanation string, topic_id long")

    p = Small(spark, str(tmp_path))
    short = [c for c in S.REPORT_DETAIL_COLUMNS if c not in ("question", "answer")]
    for labels in (None, L.answer_labels(p.evals)):
        want = L.dedupe_report_rows(V.label_term_level(p, labels).select(*short))
        got = V.report_rows(p, labels)
        assert got.columns == short
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 5
        wide = V.with_answer_text(p, want).select(*S.REPORT_DETAIL_COLUMNS)
        assert sorted(map(str, V.report_detail(p, labels).collect())) == sorted(map(str, wide.collect()))


def test_report_lines_are_written_without_a_second_shuffle(spark, tmp_path):
    """lines that lie together are written where they are, compressed."""
    from mirage.operators import report as R
    from mirage.schemas import REPORT_DETAIL_COLUMNS
    from mirage.sources import sinks
    row = {c: "x" for c in REPORT_DETAIL_COLUMNS} | {"answer_id": 2, "isHypotheticalQuestion": True, "term_id": 3, "IsHypotheticalTerm": 0}
    detail = spark.createDataFrame([row | {"eval_id": k, "answer_source": f"m{k % 2}", "question_id": k % 5} for k in range(300)])
    lines = sinks.placed_lines(R.report_lines(detail))
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    sinks.write_report_lines(R.report_lines(detail), f"{tmp_path}/r")
    assert sinks.read_report_documents(spark, f"{tmp_path}/r").count() == 10
    assert list(tmp_path.glob("r/*/*.gz")) and not list(tmp_path.glob("r/*/*.txt"))


def test_report_rows_are_placed_by_question_once(spark):
    """rows travel with codes, by term, answer and question; neither
    the nesting, the lines nor the texts shuffle them again."""
    import re

    import __spark_entry__ as E
    for name in ("nested_report", "report_lines"):
        text = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        placed = re.findall(r"Exchange hashpartitioning\((.*), 4\), (\w+)", text)
        assert not [keys for keys, _ in placed if keys.startswith("answer_source")], placed
        assert [why for keys, why in placed if re.fullmatch(r"question_id#\d+L", keys)].count("REPARTITION_BY_COL") == 2, placed


def test_codes_travel_as_one_number(spark):
    """missing, large and negative codes come back as they were."""
    from mirage.plans import views as V
    rows = [(1, 0, 3, 10), (2, None, 254, 0), (3, None, None, None), (4, 255, 1, None), (5, -1, 2, 3), (6, 1 << 62, None, 2)]
    df = spark.createDataFrame(rows, "id long, a long, b int, c long")
    packed = V._packed(df, ["a", "b", "c"])
    assert packed.columns == ["id", "_codes", "_odd"] and packed.where("_odd is null").count() == 3
    assert sorted(map(tuple, V._unpacked(packed, ["a", "b", "c"]).collect())) == rows


def test_report_of_ids_that_answers_share(spark, tmp_path):
    """an evaluation id (a missing one too) that two answers have
    keeps its first row only; repeated answers' and questions' texts multiply."""
    import json

    from mirage.operators import report as R
    from mirage.plans import views as V
    from mirage.plans.derived import Pipeline

    class Small(Pipeline):
        evals = spark.createDataFrame(
            [(i, a, 0, 2, f"reply {n}", 1, 1, 1) for n, (i, a) in enumerate([(1, 1), (1, 2), (2, 2), (None, 1), (None, 3), (3, 3)])],
            "id long, answer_id long, eval_label long, eval_type_id long, reflection string, term_source long, term_id long, model_id long")
        answers = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, None), (2, 1, 1, "b"), (3, 2, 1, "c")], "id long, question_id long, model_id long, answer string")
        questions = spark.createDataFrame([(1, 0, "q"), (2, 0, "p"), (2, 0, "o")], "id long, replacement_type long, question string")
        real_terms = spark.createDataFrame([(1, "x", "e", 1)], "id long, term string, explanation string, source_id long")
        nonexistent = real_terms.withColumnRenamed("source_id", "topic_id")

    p = Small(spark, str(tmp_path))
    detail = V.report_detail(p)
    got = sorted(((r.question_id, r.answer_id, r.eval_id, r.answer, r.question) for r in detail.collect()), key=str)
    one = [(1, 1, i, text, "q") for i in (None, 1) for text in ("a", None)]
    assert got == sorted([*one, (1, 2, 2, "b", "q"), (2, 3, 3, "c", "p"), (2, 3, 3, "c", "o")], key=str), got
    nested = R.with_json(V.with_answer_text(p, R.nested_rows(V.report_rows(p))))
    found = sorted((r.question_id, str(r.answer), r.question, len(json.loads(r.json)["evaluations"])) for r in nested.collect())
    assert found == [(1, "None", "q", 3), (1, "a", "q", 3), (2, "c", "o", 1), (2, "c", "p", 1)], found


def test_views_place_evaluations_once_a_key(spark):
    """an evaluation row meets the dictionary and its answer once."""
    from mirage.plans import views as V
    from mirage.plans.derived import Pipeline
    p = Pipeline(spark, "/root/testdata/sf0.001")
    wide = V.label_term_level(p, compat=True)._jdf.queryExecution().optimizedPlan().toString()
    assert wide.index("Generate explode") < wide.index("Join LeftOuter")  # rows multiply after it
    narrow = V.terms_evals_detailed_explained(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in narrow


def test_upsert_folds_candidates_before_sorting(spark):
    """Equal candidates of many made-up terms are folded by hash before
    any row is sorted by spelling; repeated, missing and differently spelled
    terms give the same terms and links as before."""
    rows = [(f, t, "e", s, pos) for f in (3, 1, None) for t, s, pos in (("Alpha", 1, 5), ("alpha", 1, 5), ("ALPHA", 2, 1), ("b", 2, None), (None, 1, 1))]
    cand = spark.createDataFrame(rows, "fake_term_id long, term string, explanation string, source_id long, position long").repartition(3)
    real, links = TM.upsert_real_terms(cand)
    terms = {r.id: (r.term, r.source_id) for r in real.collect()}
    assert sorted(terms.values(), key=str) == [("Alpha", 1), ("b", 2), (None, 1)]
    ids = {t: k for k, (t, _) in terms.items()}
    assert sorted(links.collect(), key=str) == sorted(((f, ids[t]) for f in (1, 3, None) for t in ("Alpha", "b")), key=str)
    assert "keys=[_t" in links._jdf.queryExecution().executedPlan().toString()


def test_model_workers_are_kept(spark):
    """an attempt takes no thread of its own."""
    import threading
    seen = set()

    def call(prompt):
        seen.add(threading.get_ident())
        if prompt.endswith("7"):
            raise ValueError("no")
        return prompt

    started, start = [], threading.Thread.start
    threading.Thread.start = lambda self: (started.append(self), start(self))[1]
    try:
        out = BM.with_retries(call, retries=2, threads=4)(pd.DataFrame({"prompt": [str(k) for k in range(5000)]}))
    finally:
        threading.Thread.start = start
    assert len(started) <= 4 and (out == "WARNING! Model failure.").sum() == 500 and out[8] == "8"
    assert BM.with_retries(call, retries=0)(pd.DataFrame({"prompt": ["a"]})).tolist() == ["WARNING! Model failure."]
