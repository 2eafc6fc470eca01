"""Registered queries over sources, sinks and small text rules, each over a
whole table: what a sink writes to the shared folder is read back by the source
of its format. ``ORACLE`` states what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.functions import text as TX
from mirage.operators import batch_model as BM
from mirage.operators import evaluate as EV
from mirage.operators import incremental as INC
from mirage.operators import terms as TM
from mirage.operators import vectors as VX
from mirage.plans import views as V
from mirage.plans.catalog import register
from mirage.plans.derived import Pipeline, StoredPipeline
from mirage.plans.oracle import with_ctes
from mirage.plans.oracle_queries import _DEF, _PAGES, ORACLE
from mirage.schemas import FAILURE_SENTINELS
from mirage.session import ensure_checkpoint_dir
from mirage.sources import files, sinks
from mirage.sources.pages import write_pages
from mirage.sources.tables import read_table, save_table, scan_table


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


# -- files --------------------------------------------------------------------
@register("csv_answers")
def q_csv_answers(spark, d):
    """Chat turns appended to a CSV folder in two batches, texts
    with line breaks and quotes included, and read back."""
    path = _folder(spark, "csv")
    c = read_table(spark, d, "conversations").where("role in ('user', 'assistant') and text is not null")
    for role in ("user", "assistant"):
        sinks.append_csv(c.where(F.col("role") == role).select("conv_id", "turn", "role", "text"), path)
    return files.read_csv(spark, path, "conv_id long, turn long, role string, text string")


ORACLE["csv_answers"] = """
SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL"""


@register("latin1_passages")
def q_latin1_passages(spark, d):
    """Passages written and read in Latin-1."""
    path = _folder(spark, "latin1")
    b = read_table(spark, d, "benchmark").select("item_id", "text")
    b.write.option("header", True).option("escape", '"').option("quoteAll", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(spark, path, "item_id long, text string", encoding="ISO-8859-1")


ORACLE["latin1_passages"] = "SELECT item_id, text FROM benchmark"


@register("tsv_terms")
def q_tsv_terms(spark, d):
    """S3, K3: real terms as a stamped TSV file. No field holds a line break,
    so the file is read in splits."""
    path = sinks.stamped_path(_folder(spark, "tsv"), "terms", "180")
    sinks.write_csv(Pipeline(spark, d).real_terms, path, sep="\t")
    return files.read_csv(spark, path, "id long, term string, explanation string, source_id long", sep="\t", multi_line=False)


ORACLE["tsv_terms"] = with_ctes("SELECT * FROM real_terms", "real_terms")


@register("question_file")
def q_question_file(spark, d):
    """Questions as JSON lines with their terms; the id column renamed."""
    path = _folder(spark, "questions")
    q = Pipeline(spark, d).questions
    term = F.struct(F.col("triplet_id").alias("termId"), F.lit("t").alias("term"), F.lit("set").alias("termSet"),
                    F.col("replacement_type").alias("termSetId"), F.lit("").alias("explanation"))
    q.select(F.col("id").alias("questionId"), "question", F.array(term).alias("terms")).write.json(path)
    return files.read_question_file(spark, path).select("question_id", "question", F.col("terms")[0].termId.alias("term_id"),
                                                        F.col("terms")[0].termSetId.alias("term_set_id"))


ORACLE["question_file"] = with_ctes(
    "SELECT id AS question_id, question, triplet_id AS term_id, replacement_type AS term_set_id FROM questions", "questions")


@register("topic_file")
def q_topic_file(spark, d):
    """S5 + F10: the topics as one JSON array (by nature a short list)."""
    path = _folder(spark, "topics")
    t = Pipeline(spark, d).topic
    ordered = F.array_sort(F.collect_list(F.struct("id", F.concat("name", F.lit(": "), "explanation").alias("t"))))
    t.agg(F.to_json(ordered.t).alias("value")).write.text(path)
    return TM.topic_rows(files.read_topics(spark, path))


ORACLE["topic_file"] = with_ctes(
    "SELECT row_number() OVER (ORDER BY id) AS id, name, ' ' || explanation AS explanation FROM topic", "topic")


@register("sample_file")
def q_sample_file(spark, d):
    """Samples (a nation's suppliers) as a JSON object of id lists."""
    path = _folder(spark, "samples")
    s = read_table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("k")).agg(F.collect_list("s_suppkey").alias("v"))
    s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path)
    return files.read_samples(spark, path)


ORACLE["sample_file"] = "SELECT CAST(s_nationkey AS VARCHAR) AS sample, CAST(s_suppkey AS BIGINT) AS question_id FROM supplier"


@register("page_files")
def q_page_files(spark, d):
    """Pages as JSON, read with the needed fields only."""
    path = _folder(spark, "pages")
    Pipeline(spark, d).wiki_pages.withColumn("unused", F.lit("x" * 20)).write.json(path)
    return files.read_pages(spark, path).select("_id", "wikipedia_title", F.size("text").alias("paragraphs"))


ORACLE["page_files"] = with_ctes("SELECT _id, wikipedia_title, CAST(len(text) AS INTEGER) AS paragraphs FROM pages_w", extra=[_PAGES])


# -- tables -------------------------------------------------------------------
@register("appended_answers")
def q_appended_answers(spark, d):
    """K4: answers appended one model at a time; J10 decides what is left."""
    path = _folder(spark, "answers")
    a = Pipeline(spark, d).answers
    sinks.append_table(a.where("model_id <= 4"), path)
    sinks.append_table(INC.unprocessed(a, spark.read.schema(a.schema).parquet(path), ["id"]), path)
    return spark.read.schema(a.schema).parquet(path)


ORACLE["appended_answers"] = with_ctes("""
SELECT * FROM answers a WHERE model_id <= 4
UNION ALL SELECT * FROM answers a WHERE NOT EXISTS (SELECT 1 FROM answers b WHERE b.id = a.id AND b.model_id <= 4)""", "answers")


@register("replaced_labels")
def q_replaced_labels(spark, d):
    """K5: the label table partitioned by judge; one judge's labels replaced
    (all valid), the other judges' left as they are."""
    path = _folder(spark, "labels")
    labels = Pipeline(spark, d).labels
    sinks.replace_table(labels, path, ["evaluator_model_id"])
    again = labels.where("evaluator_model_id = 1").withColumn("answer_label", F.lit(0).cast("long"))
    sinks.replace_table(again, path, ["evaluator_model_id"])
    return spark.read.schema(labels.schema).parquet(path).select(*labels.columns)


ORACLE["replaced_labels"] = with_ctes("""
SELECT answer_id, CASE WHEN evaluator_model_id = 1 THEN 0 ELSE answer_label END AS answer_label, evaluator_model_id FROM alabels""", "alabels")


@register("inserted_terms")
def q_inserted_terms(spark, d):
    """K6: all real terms inserted into a table that has every 97th one;
    terms are unique, so later ones of the same name are ignored."""
    t = Pipeline(spark, d).real_terms
    return INC.insert_ignore(t.where("id % 97 = 0"), t, ["term"], ["id"])


ORACLE["inserted_terms"] = with_ctes("""
SELECT * FROM real_terms r WHERE NOT EXISTS (SELECT 1 FROM real_terms o WHERE o.term = r.term AND (o.id % 97 = 0 OR o.id < r.id))""", "real_terms")


@register("report_files")
def q_report_files(spark, d):
    """K7: the streamed report, read back as documents per answer source."""
    from mirage.operators import report as R
    path = _folder(spark, "report")
    sinks.write_report_lines(R.report_lines(V.report_detail(Pipeline(spark, d))), path)
    docs = sinks.read_report_documents(spark, path)
    doc = F.from_json("json", "question_id long, evaluations array<struct<eval_id: long>>")
    return docs.select("answer_source", doc.alias("d")).select(
        "answer_source", "d.question_id", F.size("d.evaluations").cast("long").alias("evaluations"),
        F.array_min("d.evaluations.eval_id").alias("first_eval"))


ORACLE["report_files"] = ORACLE["nested_report"][:ORACLE["nested_report"].rindex("\nSELECT answer_source, question_id,")] + """
SELECT answer_source, question_id, count(*) AS evaluations, min(eval_id) AS first_eval FROM rd GROUP BY answer_source, question_id"""


@register("table_scan")
def q_table_scan(spark, d):
    """Evaluations as a catalog table, scanned by name with a
    condition."""
    name = f"evals_{uuid.uuid4().hex}"
    save_table(Pipeline(spark, d).evals, name, _folder(spark, "evals"))
    return scan_table(spark, name, ["id", "answer_id", "eval_label", "model_id"], F.col("eval_type_id") == 3)


ORACLE["table_scan"] = with_ctes("SELECT id, answer_id, eval_label, model_id FROM evals WHERE eval_type_id = 3", "evals")


@register("label_answer_level_bucketed")
def q_label_answer_level_bucketed(spark, d):
    """S7 + J5: the answer-label view over tables bucketed by answer."""
    p = StoredPipeline(spark, d, f"p{uuid.uuid4().hex}", _folder(spark, "tables"))
    return V.label_answer_level(p)


ORACLE["label_answer_level_bucketed"] = ORACLE["label_answer_level"]


# -- pages --------------------------------------------------------------------
@register("page_by_id")
def q_page_by_id(spark, d):
    """The pages of all rated documents, from the stored pages."""
    store = write_pages(Pipeline(spark, d).wiki_pages, _folder(spark, "store"), per_part=500, buckets=16)
    found = store.by_id(read_table(spark, d, "labels"), "doc_id")
    return TM.page_definitions(found)


ORACLE["page_by_id"] = with_ctes(f"""
SELECT _id AS page_id, wikipedia_title AS title, {_DEF} AS definition FROM pages_w WHERE _id IN (SELECT doc_id FROM labels)""", extra=[_PAGES])


@register("stored_title_lookup")
def q_stored_title_lookup(spark, d):
    """J12 from the stored pages."""
    p = Pipeline(spark, d)
    return write_pages(p.wiki_pages, _folder(spark, "store"), per_part=500, buckets=16).by_title(p.lookup_terms)


ORACLE["stored_title_lookup"] = ORACLE["term_lookup_ci_ai"]


@register("page_titles")
def q_page_titles(spark, d):
    """F15."""
    return TM.titles(Pipeline(spark, d).wiki_pages)


ORACLE["page_titles"] = with_ctes("SELECT _id AS id, wikipedia_title AS title FROM pages_w", extra=[_PAGES])


@register("paragraphs_cut")
def q_paragraphs_cut(spark, d):
    """F16: paragraphs as a store with a limit of 9000 characters takes them."""
    return TM.paragraphs(Pipeline(spark, d).wiki_pages, max_chars=9000)


ORACLE["paragraphs_cut"] = ORACLE["paragraphs"].replace("paragraph AS text", "substring(paragraph, 1, 9000) AS text", 1)


@register("hit_terms")
def q_hit_terms(spark, d):
    """V5: every rated document as a search hit; title hits keep those with a
    definition, text hits fall back to their own text."""
    p = Pipeline(spark, d)
    hits = read_table(spark, d, "labels").select(F.col("doc_id").cast("long").alias("id"), F.concat(F.lit("hit "), F.col("doc_id").cast("string")).alias("text"))
    out = [TM.hit_terms(hits, p.wiki_pages, kind).select("id", F.lit(kind).alias("kind"), "explanation") for kind in ("title", "text")]
    return out[0].unionByName(out[1])


ORACLE["hit_terms"] = with_ctes("""
SELECT h.id, 'title' AS kind, d.definition AS explanation FROM h JOIN d USING (id) WHERE d.definition NOT IN ('None', 'ambiguous')
UNION ALL
SELECT h.id, 'text', CASE WHEN d.definition IS NULL OR d.definition IN ('None', 'ambiguous') THEN h.text ELSE d.definition END
FROM h LEFT JOIN d USING (id)""", extra=[_PAGES, ("h", "SELECT doc_id AS id, 'hit ' || doc_id AS text FROM labels"),
                                         ("d", f"SELECT _id AS id, {_DEF} AS definition FROM pages_w")])


@register("encoded_paragraphs")
def q_encoded_paragraphs(spark, d):
    """V4: paragraphs through an encoder (a stand-in that counts letters)."""
    def count(texts):
        return [[float(len(t)), float(t.count("e")), float(t.count("n"))] for t in texts]

    rows = VX.encode(TM.paragraphs(Pipeline(spark, d).wiki_pages), "text", count, 3)
    at = lambda k: F.col("embeddings")[k].cast("long")
    return rows.select("id", "pos", at(0).alias("chars"), at(1).alias("e"), at(2).alias("n"))


ORACLE["encoded_paragraphs"] = f"""
SELECT id, pos, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 'n', '')) AS n
FROM ({ORACLE["paragraphs"]})"""


# -- answers ------------------------------------------------------------------
@register("answers_of_model")
def q_answers_of_model(spark, d):
    """P5."""
    p = Pipeline(spark, d)
    a = p.answers.withColumnRenamed("model_id", "answer_source_id")
    return EV.answers_of_model(a, p.models, "llama2:7b-chat-q4_1")


ORACLE["answers_of_model"] = with_ctes("""
SELECT id, question_id, model_id AS answer_source_id, answer FROM answers
WHERE model_id = (SELECT id FROM models WHERE name = 'llama2:7b-chat-q4_1')""", "answers")


@register("simple_inclusion")
def q_simple_inclusion(spark, d):
    """answers that hold the secondary term as written, but for case."""
    qa = Pipeline(spark, d).qa
    return qa.select("answer_id", "secondary", TX.simple_included("answer", "secondary").alias("included"))


ORACLE["simple_inclusion"] = with_ctes("SELECT answer_id, secondary, contains(lower(answer), lower(secondary)) AS included FROM qa", "qa")


@register("stamped_runs")
def q_stamped_runs(spark, d):
    """whether each run's stamp has the form of a time (its value is the
    time of the run)."""
    t = F.try_to_timestamp(TX.run_stamp(), F.lit("yyyyMMdd_HHmmss"))
    near = F.abs(F.unix_timestamp(t) - F.unix_timestamp(F.current_timestamp())) <= 1
    return Pipeline(spark, d).topic.select("id", near.alias("is_stamp"))


ORACLE["stamped_runs"] = with_ctes("SELECT id, true AS is_stamp FROM topic", "topic")


@register("failed_answers")
def q_failed_answers(spark, d):
    """Answers of a model that fails for some questions for good
    and for others at first; failures are told apart and quarantined."""
    failed: set[str] = set()

    def call(prompt):
        if prompt.endswith("7"):
            raise ValueError("no")
        if prompt.endswith("3") and prompt not in failed:
            failed.add(prompt)
            raise ValueError("not yet")
        return f"re {prompt}"

    q = Pipeline(spark, d).questions.where("replacement_type = 0")
    answers = BM.answer_questions(q, BM.with_retries(call, retries=2), 5, partitions=2 * spark.sparkContext.defaultParallelism)
    good, bad = INC.split_failures(answers, max_failures=None)
    rows = good.select("question_id", "answer", F.lit(False).alias("failed"))
    return rows.unionByName(bad.select("question_id", "answer", TX.is_failure("answer").alias("failed")))


ORACLE["failed_answers"] = with_ctes(f"""
SELECT id AS question_id, CASE WHEN question LIKE '%7' THEN '{FAILURE_SENTINELS[0]}' ELSE 're ' || question END AS answer,
       question LIKE '%7' AS failed FROM questions WHERE replacement_type = 0""", "questions")
