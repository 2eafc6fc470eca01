"""Sources/sinks round trips, rerun idempotence and partition-count
independence."""

import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from harness import rows_of
from mirage.operators.incremental import insert_ignore, unprocessed
from mirage.sources import files, sinks

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_newlines(spark, scratch):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', "x"), (2, "plain", "ü")],
                               "answer_id long, answer string, t string")
    sinks.append_csv(df, f"{scratch}/a")
    back = files.read_csv(spark, f"{scratch}/a", "answer_id long, answer string, t string")
    assert sorted(back.collect()) == sorted(df.collect())
    sinks.write_csv(df, f"{scratch}/b", sep="\t")
    back = files.read_csv(spark, f"{scratch}/b", "answer_id long, answer string, t string", sep="\t")
    assert sorted(back.collect()) == sorted(df.collect())


def test_latin1(spark, scratch):
    p = f"{scratch}/l.csv"
    with open(p, "wb") as f:
        f.write("id,t\n1,caf\xe9\n".encode("latin-1"))
    got = files.read_csv(spark, p, "id long, t string", encoding="ISO-8859-1").first()
    assert got.t == "café"


def test_json_sources(spark, scratch):
    with open(f"{scratch}/topics.json", "w") as f:
        json.dump(["A: one", "B: two"], f)
    with open(f"{scratch}/samples.json", "w") as f:
        json.dump({"2": [1, 2], "3": [1, 2, 3]}, f)
    with open(f"{scratch}/q.jsonl", "w") as f:
        f.write(json.dumps({"questionId": 5, "question": "q?", "terms": [
            {"termId": 1, "term": "a", "termSet": "hypothetical", "termSetId": 0, "explanation": "e"},
            {"termId": 2, "term": "b", "termSet": "gpt_suggestion", "termSetId": 1,
             "explanation": "f"}]}) + "\n")
    t = files.read_topics(spark, f"{scratch}/topics.json").orderBy("pos").collect()
    assert [(r.pos, r.topic) for r in t] == [(0, "A: one"), (1, "B: two")]
    s = files.read_samples(spark, f"{scratch}/samples.json")
    assert s.where(F.col("sample") == "3").count() == 3
    q = files.read_question_file(spark, f"{scratch}/q.jsonl")
    assert q.first().question_id == 5
    from mirage.operators.evaluate import terms_long, to_wide
    wide = to_wide(q.withColumn("answer_id", F.lit(1).cast("long"))
                    .withColumn("answer", F.lit("a b")))
    long = terms_long(wide).orderBy("term_pos").collect()
    assert [(r.term, r.is_hypothetical) for r in long] == [("b", False), ("a", True)]


def test_rerun_leaves_sink_unchanged(spark, scratch):
    todo = spark.range(10).withColumnRenamed("id", "question_id")
    done = todo.where("question_id < 4")
    sinks.append_table(done, f"{scratch}/t")
    first = unprocessed(todo, spark.read.parquet(f"{scratch}/t"), ["question_id"])
    sinks.append_table(first, f"{scratch}/t")
    again = unprocessed(todo, spark.read.parquet(f"{scratch}/t"), ["question_id"])
    assert again.count() == 0 and spark.read.parquet(f"{scratch}/t").count() == 10
    new = spark.createDataFrame([(1, 5), (1, 3), (20, 1)], "question_id long, o long")
    keep = insert_ignore(spark.read.parquet(f"{scratch}/t"), new, ["question_id"], ["o"])
    assert [r.question_id for r in keep.collect()] == [20]


def test_streaming_answering_resumes(spark, scratch):
    from mirage.operators.batch_model import stub_answerer
    from mirage.streaming.answering import start_answering
    qd, ad, cd = f"{scratch}/q", f"{scratch}/ans", f"{scratch}/ck"
    os.makedirs(qd)
    with open(f"{qd}/a.json", "w") as f:
        f.write('{"id": 1, "question": "x"}\n{"id": 2, "question": "y"}\n')
    start_answering(spark, qd, ad, cd, stub_answerer, 3).awaitTermination()
    with open(f"{qd}/b.json", "w") as f:
        f.write('{"id": 2, "question": "y"}\n{"id": 3, "question": "z"}\n')
    start_answering(spark, qd, ad, cd, stub_answerer, 3).awaitTermination()
    got = sorted(r.question_id for r in spark.read.parquet(ad).collect())
    assert got == [1, 2, 3]


def test_streaming_state_holds_what_was_asked(spark, scratch):
    """Repeats within a batch, across batches and across restarts are asked
    once, answers of other jobs are respected, and the sink is never read."""
    import shutil

    import pandas as pd

    from mirage.streaming.answering import start_answering
    qd, ad, cd, od = f"{scratch}/q", f"{scratch}/ans", f"{scratch}/ck", f"{scratch}/old"
    os.makedirs(qd)
    asked = spark.sparkContext.accumulator(0)

    def model(pdf):
        asked.add(len(pdf))
        return pd.Series([f"re {p}" for p in pdf["prompt"]])

    def run(name, ids):
        with open(f"{qd}/{name}.json", "w") as f:
            f.writelines(json.dumps({"id": i, "question": f"q{i}"}) + "\n" for i in ids)
        start_answering(spark, qd, ad, cd, model, 3, answered_dir=od).awaitTermination()

    spark.createDataFrame([(100,), (101,)], "question_id long").write.parquet(od)
    run("a", [1, 2, 2, 100, None, 1])
    assert asked.value == 2
    shutil.move(f"{ad}/model_id=3", f"{scratch}/moved")  # a batch that read the sink would ask again
    run("b", [2, 3, 101, 1])
    run("c", [3, 2, 1])
    assert asked.value == 3
    rows = [r.question_id for d in (f"{scratch}/moved", ad) for r in spark.read.parquet(d).collect()]
    assert sorted(rows) == [1, 2, 3]
    assert {r.answer for r in spark.read.parquet(ad).collect()} == {"re q3"}


def test_nested_report_json(spark, scratch):
    df = E.queries()["nested_report"](spark, SF)
    from mirage.operators.report import nested_report
    assert df.count() > 0
    one = json.loads(df.first().json)
    assert "evaluations" in one and isinstance(one["evaluations"], list)
    assert nested_report is not None


def test_report_lines_of_a_long_question(spark, scratch):
    """A question with very many evaluations is a sorted run of lines; what is
    written and read back are the same documents as the nested report's."""
    from mirage.operators import report as R
    n = 20_000
    detail = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "m2").otherwise("m1").alias("answer_source"), F.when(F.col("id") < 40, F.col("id") % 5).otherwise(99).alias("question_id"),
        (F.col("id") % 7).alias("answer_id"), F.lit('a "b"\n]}').alias("question"), F.lit(None).cast("string").alias("answer"), F.lit("valid").alias("answer_label"),
        F.lit(True).alias("isHypotheticalQuestion"), F.lit("j").alias("evaluator_model"), ((F.col("id") * 7919) % n).alias("eval_id"),
        F.lit("code_check").alias("eval_type"), F.lit("valid").alias("term_label"), F.lit("t").alias("term"), F.col("id").alias("term_id"),
        F.lit(0).alias("IsHypotheticalTerm"), F.lit("x").alias("term_source"), F.lit("").alias("reflection")).repartition(5)
    lines = R.report_lines(detail)
    assert "collect_list" not in lines._jdf.queryExecution().executedPlan().toString()
    sinks.write_report_lines(lines, f"{scratch}/r")
    got = {(r.answer_source, json.dumps(json.loads(r.json))) for r in sinks.read_report_documents(spark, f"{scratch}/r").collect()}
    want = {(r.answer_source, json.dumps(json.loads(r.json))) for r in R.nested_report(detail).collect()}
    assert got == want and len(got) == 12


def test_partition_count_does_not_change_results(spark):
    names = ["triplets", "answer_labels", "report_detail", "upsert_terms", "topic_runs"]
    out = {}
    for parts in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out[parts] = {n: rows_of(E.queries()[n](spark, SF).toPandas()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[3] == out[11]


def test_replace_table_partitions(spark, scratch):
    """K5: only the partitions that the new rows have are replaced."""
    from mirage.sources import sinks
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "judge int, label string")
    sinks.replace_table(old, f"{scratch}/t", ["judge"])
    sinks.replace_table(spark.createDataFrame([(2, "d")], "judge int, label string"), f"{scratch}/t", ["judge"])
    assert sorted((r.judge, r.label) for r in spark.read.parquet(f"{scratch}/t").collect()) == [(1, "a"), (2, "d")]
    sinks.replace_table(old.limit(0), f"{scratch}/t2")
    assert spark.read.parquet(f"{scratch}/t2").count() == 0


def test_nested_report_files(spark, scratch):
    """K7: one folder per answering model, one JSON record per question."""
    import json

    from mirage.operators.report import nested_report
    from mirage.sources import sinks
    from mirage.schemas import REPORT_DETAIL_COLUMNS
    row = {c: f"{c} \"x\"" for c in REPORT_DETAIL_COLUMNS} | {"question_id": 1, "answer_id": 2, "isHypotheticalQuestion": True, "term_id": 3, "IsHypotheticalTerm": 0}
    detail = spark.createDataFrame([row | {"eval_id": k, "answer_source": s} for k, s in ((5, "m"), (4, "m"), (6, "n"))])
    sinks.write_nested_report(nested_report(detail), f"{scratch}/r")
    back = spark.read.json(f"{scratch}/r").orderBy("answer_source").collect()
    assert [(r.answer_source, [e.eval_id for e in r.evaluations]) for r in back] == [("m", [4, 5]), ("n", [6])]
    assert json.loads(nested_report(detail).where("answer_source = 'm'").first()["json"])["evaluations"][0]["term"] == 'term "x"'


def test_stamped_path():
    import re

    from mirage.sources.sinks import stamped_path
    assert re.fullmatch(r"/d/report_\d{8}_\d{6}_sampled_180_\.csv", stamped_path("/d/", "report", "180", ".csv"))


def test_triplet_columns_are_checked(spark):
    from mirage.operators.triplets import triplets_from_file
    try:
        triplets_from_file(spark.createDataFrame([(1, 2, 3)], "fake_term_id int, real_term_id int, source_id int"))
        raise AssertionError("expected a failure")
    except ValueError as e:
        assert "topic_explanation" in str(e)
