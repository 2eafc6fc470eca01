"""Small literal cases with the expected results of FIXTURES.md §3."""

from pyspark.sql import functions as F

from mirage.functions import replies as RP
from mirage.functions import text as X
from mirage.operators import labels as L
from mirage.operators import report as R
from mirage.operators.ordering import GlobalOrder, second_half
from mirage.operators.triplets import build_triplets

EV = "id long, answer_id long, eval_label long, eval_type_id long, reflection string, " \
     "term_source long, term_id long, model_id long"


def _evals(spark):
    rows = [(1, 1, 0, 2, "", 1, 1, 2), (2, 1, 0, 4, "", 1, 1, 10),
            (3, 2, 1, 2, "", 1, 1, 2), (4, 2, 2, 4, "", 1, 1, 10),
            (5, 3, 0, 2, "", 1, 1, 2), (6, 3, 2, 4, "", 1, 2, 10),
            (7, 4, 2, 4, "", 1, 1, 10)]
    return spark.createDataFrame(rows, EV)


def test_answer_labels(spark):
    got = {r.answer_id: r.answer_label for r in L.answer_labels(_evals(spark)).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    got = {r.answer_id: (r.answer_label, r.evaluator_model_id)
           for r in L.answer_labels(_evals(spark), include_unjudged=True).collect()}
    assert got[4] == (2, 2)


def test_dedupe_keeps_lowest_id(spark):
    rows = [(9, 1, 1, 2, "b", 1, 1, 2), (3, 1, 0, 2, "a", 1, 1, 2)]
    got = L.dedupe_evals(spark.createDataFrame(rows, EV)).collect()
    assert [(r.id, r.eval_label) for r in got] == [(3, 0)]


def test_distribution_and_score(spark):
    rows = [("j", "m", True, "valid"), ("j", "m", True, "hallucination"),
            ("j", "m", False, "irrelevant")]
    df = spark.createDataFrame(rows, "evaluator_model string, answer_source string, "
                                     "isHypotheticalQuestion boolean, answer_label string")
    d = {r.answer_label: (r.all_questions, r.hypothetical_questions, r.valid_questions)
         for r in R.label_distribution(df).collect()}
    assert d == {"valid": (33.33, 50.0, 0.0), "hallucination": (33.33, 50.0, 0.0),
                 "irrelevant": (33.33, 0.0, 100.0)}
    assert R.score(R.label_distribution(df)).first().score == 50.0


def test_half_even_percent(spark):
    df = spark.createDataFrame([(1, 8), (1, 4000), (3, 8), (2, 3)], "c long, t long")
    got = [r.p for r in df.select(L.F.col("c"), __import__("mirage.functions.common", fromlist=["x"])
                                  .pct_half_even(F.col("c"), F.col("t")).alias("p")).collect()]
    assert got == [12.5, 0.02, 37.5, 66.67]


def test_inclusion(spark):
    cases = [("The quantum café loop is…", "Quantum Café Loop", True),
             ("A slow burn index rises", "Slow-Burn Index (finance)", True),
             ("ory mapping", "Theory Mapping", True), ("anything", "(all)", True),
             ("solar wind", "solar kite", False)]
    df = spark.createDataFrame(cases, "a string, t string, e boolean")
    for r in df.select("e", X.term_included("a", "t").alias("g"),
                       X.inclusion_label("a", "t").alias("l")).collect():
        assert r.g == r.e and r.l == (0 if r.e else 2)


def test_judge_replies(spark):
    cases = [("c", '{"certainty":"MENTIONED"}', 0, 1, False),
             ("c", '{"certainty":"MENTIONED"}', 1, 0, False),
             ("c", '{"certainty":"UNREAL"}', 0, 0, False),
             ("c", '{"certainty":"UNREAL"}', 1, 1, False),
             ("c", '{"certainty":"UNKNOWN"}', 0, 0, False),
             ("c", '{"certainty":"UNKNOWN"}', 2, 2, False),
             ("c", 'Sure: {"certainty":"unreal"} done', 1, 1, False),
             ("c", 'Sure: {"Certainty":"Unreal"} done', 1, 0, True),
             ("c", '{"certainty":12}', 1, 0, True),
             ("c", "I cannot say", 1, 0, True),
             ("m", '{"verified": false}', 1, 1, False),
             ("m", '{"verified":"TRUE"}', 1, 0, False),
             ("m", "{}", 1, 0, True)]
    df = spark.createDataFrame(cases, "k string, r string, s long, e long, f boolean")
    _check_replies(df.withColumn("p", RP.parse_reply(F.col("r"))))
    _check_replies(RP.parse_replies(df, "r", "p"))


def _check_replies(p):
    lab = F.when(F.col("k") == "c", RP.certainty_label(F.col("p"), F.col("s"))) \
           .otherwise(RP.meaning_label(F.col("p")))
    fail = F.when(F.col("k") == "c", RP.certainty_failed(F.col("p"))) \
            .otherwise(RP.meaning_failed(F.col("p")))
    out = p.select("r", "e", "f", lab.alias("l"), RP.stored_reply(F.col("r"), fail).alias("o"))
    for r in out.collect():
        assert r.l == r.e, r
        assert r.o.startswith("WARNING: Failed to parse response: ") == r.f, r


def test_repair_steps():
    assert RP.extract_json('{"a": "x" "b": "y"}')[1] == 5
    assert RP.extract_json('text {"a": 1} tail')[1] == 2
    assert RP.extract_json('{"A": "x"\n"B": "y"}')[1] == 4


def test_definitions(spark):
    rows = [(["T", "First."],), (["T", "X may refer to:"],), (["T", "Section::::A", "Body"],),
            (["T", "Section::::A"],), (["T"],), (None,)]
    df = spark.createDataFrame(rows, "a array<string>")
    assert [r[0] for r in df.select(X.definition_from_paragraphs("a")).collect()] == \
        ["First.", "ambiguous", "Body", "None", "None", "None"]


def test_triplets(spark):
    rows = [(1, i, 1 if i <= 3 else 2) for i in range(1, 7)] + \
           [(2, i, 1 if i <= 3 else 2) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "fake_term_id long, real_term_id long, source_id long")
    got = sorted((r.nonexistent_id, r.secondary_id, r.replacement_id, r.replacement_source)
                 for r in build_triplets(df).collect())
    assert got == [(1, 1, 4, 1), (1, 2, 5, 1), (1, 3, 6, 1), (1, 4, 1, 2), (1, 5, 2, 2),
                   (1, 6, 3, 2)]
    five = spark.createDataFrame([(3, i, 1 if i <= 3 else 2) for i in range(1, 6)],
                                 "fake_term_id long, real_term_id long, source_id long")
    got = build_triplets(five).groupBy("rotation").count().collect()
    assert sorted((r.rotation, r["count"]) for r in got) == [(0, 2), (1, 2)]


def test_suggested_terms(spark):
    df = spark.createDataFrame([("['solar kite', 'wind loop']",), ("1. solar kite\n2. wind loop",)],
                               "x string")
    assert [r[0] for r in df.select(X.parse_term_list("x")).collect()] == \
        [["solar kite", "wind loop"], ["solar kite", "wind loop"]]


def test_term_swap(spark):
    df = spark.createDataFrame([("Does a solar kite (toy) help?",), ("How does Solar Kite work?",)],
                               "q string")
    got = [r[0] for r in df.select(X.swap_term(F.col("q"), F.lit("solar kite (toy)"),
                                               F.lit("Sail"))).collect()]
    assert got == ["Does a Sail help?", "How does Sail work?"]


def test_topic_runs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "i long, t string")
    got = [r.run_id for r in GlobalOrder(df, ["i"], partitions=3).run_ids("t").orderBy("i").collect()]
    assert got == [1, 1, 2, 3]


def test_second_half(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "i long")
    assert sorted(r.i for r in second_half(df, ["i"]).collect()) == [3, 4, 5, 6]


def test_short_model_name(spark):
    df = spark.createDataFrame([("llama2:70b-chat-q4_K_M",), ("gpt-4-1106-preview",)], "m string")
    assert [r[0] for r in df.select(X.short_model_name("m")).collect()] == ["llama2_70b", "gpt-4"]


def test_grouped_label(spark):
    sets = {1: [0], 2: [0, 1], 3: [0, 2], 4: [1, 2], 5: [0, 1, 2]}
    rows = [(a, lab, "certainty reflection", 1, "q", "x", 1, "m", 2, "j", True)
            for a, labs in sets.items() for lab in labs]
    df = spark.createDataFrame(rows, "answer_id long, eval_label long, eval_type string, "
                                     "question_id long, question string, answer string, "
                                     "answer_source_id long, answer_source string, "
                                     "evaluator_model_id long, evaluator_model string, "
                                     "isHypotheticalQuestion boolean")
    got = {r.answer_id: r.eval_label for r in L.ai_grouped(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 1}


def test_topic_split(spark):
    df = spark.createDataFrame([("A: b: c",)], "x string")
    assert tuple(df.select(*X.split_topic("x")).first()) == ("A", " b")


def test_paragraph_filter(spark):
    paras = ["title", "x" * 19, "y" * 20, "x::::y" + "z" * 30]
    df = spark.createDataFrame([(1, "t", paras)], "_id long, wikipedia_title string, text array<string>")
    from mirage.operators.terms import paragraphs
    assert [r.text for r in paragraphs(df).collect()] == ["y" * 20]
