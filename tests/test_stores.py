"""Stored pages and bucketed tables: what a lookup or a join reads and moves."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from mirage.operators.terms import lookup_by_title
from mirage.plans import views as V
from mirage.plans.derived import Pipeline, StoredPipeline
from mirage.sources.pages import PageStore, write_pages

SF = "/root/testdata/sf0.001"


def scans(df):
    """Files read by each file scan of a query that has run."""
    out = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            out.append((node.relation().location().rootPaths().mkString(","), node.metrics().apply("numFiles").value()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def pages(spark, n=2000):
    title = F.element_at(F.array(F.lit("Café"), F.lit("CAFE"), F.concat(F.lit("Title "), F.col("id").cast("string"))), (F.least(F.col("id") % 500, F.lit(2)) + 1).cast("int"))
    text = F.array(title, F.concat(F.lit("about "), F.col("id").cast("string")))
    rows = spark.range(n).select(F.col("id").alias("_id"), title.alias("wikipedia_title"), text.alias("text"))
    return rows.unionByName(spark.createDataFrame([(-5, None, None), (None, "lost", ["a", "b"])], "_id long, wikipedia_title string, text array<string>"))


def test_lookup_by_id_reads_the_parts_asked_for(spark, scratch):
    store = write_pages(pages(spark), f"{scratch}/s", per_part=100, buckets=8)
    asked = spark.createDataFrame([(7,), (8,), (8,), (1950,), (-5,), (99999,), (None,)], "_id long")
    got = store.by_id(asked)
    assert sorted(r._id for r in got.collect()) == [-5, 7, 8, 1950]
    read = [n for path, n in scans(got) if path.endswith("by_id")]
    assert read and sum(read) <= 3  # of 21 folders
    assert PageStore(spark, f"{scratch}/s").by_id(asked.where("_id = 7")).first().text == ["Title 7", "about 7"]


def test_lookup_by_title_reads_the_buckets_asked_for(spark, scratch):
    rows = pages(spark)
    store = write_pages(rows, f"{scratch}/s", per_part=100, buckets=16)
    terms = spark.createDataFrame([("cafe",), ("CAFÉ",), ("title 77",), ("none",), (None,), ("cafe",)], "term string")
    got = store.by_title(terms)
    assert sorted(got.collect(), key=str) == sorted(lookup_by_title(terms, rows).collect(), key=str)
    files = {p: n for p, n in scans(got) if p.endswith("by_title")}
    assert files and sum(files.values()) <= 3


def test_bucketed_facts_are_not_shuffled(spark, scratch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = StoredPipeline(spark, SF, "bucketed_test", f"{scratch}/t", buckets=4)
        df = V.label_answer_level(p)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, V.label_answer_level(Pipeline(spark, SF)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grouped_views_scan_and_shuffle_little(spark):
    """One fold of the evaluations: a scan of them, and no shuffle per grain."""
    for name in ("labelled", "ai_grouped"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 6, name
        assert plan.count("lineitem.parquet") == 1, name
