"""Plan shape checks: the operators plan the way the design says."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + \
        df._jdf.queryExecution().optimizedPlan().toString()


def test_collated_lookup_is_not_nested_loop(spark):
    p = plan(E.queries()["term_lookup_ci_ai"](spark, SF))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


OWN = [n for n in E.queries() if not n.startswith("op") and n != "pipeline"]


def test_no_cartesian_products_anywhere(spark):
    for name in OWN:
        assert "CartesianProduct" not in plan(E.queries()[name](spark, SF)), name


def exchanges(name: str, spark) -> int:
    text = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning")


def test_one_shuffle_for_chats(spark):
    assert exchanges("chat_render", spark) == 1


def test_positions_need_no_second_shuffle(spark):
    """What is shuffled after the order is there are sums, a row per partition."""
    for name in ("row_ids", "running_mean", "topic_runs"):
        text = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in text.split("\n") if "Exchange hashpartitioning" in x or "Exchange range" in x]
        assert len(shuffles) <= 1 and all("_groupingexpression" in x for x in shuffles), shuffles


def test_phrase_search_shuffles_no_text(spark):
    text = E.queries()["phrase_exists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.split("\n") if "Exchange hashpartitioning" in x and "_lt" in x]


def test_topk_uses_group_limit(spark):
    for name in ("knn_exact", "triplets"):
        assert "WindowGroupLimit" in plan(E.queries()[name](spark, SF)), name


def test_building_a_query_runs_nothing_upstream(spark):
    """A model behind a lazy frame is not called while a plan is built."""
    from pyspark.sql import functions as F

    from mirage.operators import batch_model as BM
    calls = spark.sparkContext.accumulator(0)

    def model(pdf):
        calls.add(len(pdf))
        return pdf["prompt"]

    rows = spark.range(100).select(F.col("id").cast("string").alias("prompt"))
    first = BM.call_model(rows, model, "a")
    second = BM.call_model(first.withColumn("prompt", F.col("a")).drop("elapsed_s"), model, "b", partitions=4)
    assert calls.value == 0
    assert second.count() == 100 and calls.value == 200


def test_lookups_are_broadcast(spark):
    p = E.queries()["label_answer_level"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_scan_prunes_columns(spark):
    p = E.queries()["answer_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # evaluations only need five lineitem columns
    assert "l_extendedprice" not in p and "l_shipdate" not in p
