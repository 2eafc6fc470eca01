"""Registered queries: name → (spark, data folder) → DataFrame.

Every query reads the driver's tables (or tables Spark derives from them) in
full; where a query's terms are made from part of a row (words 3-6 of a
passage, the first word of a turn), its docstring or the derivation says so. ``mirage.plans.oracle_queries`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.operators import labels as L
from mirage.operators import report as R
from mirage.plans import views as V
from mirage.plans.derived import Pipeline

def _cores(spark) -> int:
    """Tasks for a Python-heavy stage over one of the driver's tables, whose
    single row group gives a single split: two a core."""
    return 2 * spark.sparkContext.defaultParallelism


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# -- labels and reports -----------------------------------------------------
@register("evals_dedup")
def q_evals_dedup(spark, d):
    return L.dedupe_evals(Pipeline(spark, d).evals)


@register("answer_labels")
def q_answer_labels(spark, d):
    return L.answer_labels(Pipeline(spark, d).evals)


@register("label_answer_level")
def q_label_answer_level(spark, d):
    return V.label_answer_level(Pipeline(spark, d))


@register("label_distribution")
def q_label_distribution(spark, d):
    return R.label_distribution(V.label_answer_level(Pipeline(spark, d)))


@register("score")
def q_score(spark, d):
    return R.score(R.label_distribution(V.label_answer_level(Pipeline(spark, d))))


@register("stacked_totals")
def q_stacked_totals(spark, d):
    return R.stacked_totals(R.label_distribution(V.label_answer_level(Pipeline(spark, d))))


@register("terms_combined")
def q_terms_combined(spark, d):
    return V.terms_combined(Pipeline(spark, d))


@register("triplets_combined")
def q_triplets_combined(spark, d):
    return V.term_triplets_combined(Pipeline(spark, d))


@register("combined_terms_answers")
def q_combined_terms_answers(spark, d):
    return V.combined_terms_answers(Pipeline(spark, d))


@register("label_term_level")
def q_label_term_level(spark, d):
    return V.label_term_level(Pipeline(spark, d))


@register("detailed_union")
def q_detailed_union(spark, d):
    return V.terms_evals_detailed(Pipeline(spark, d))


@register("detailed_explained")
def q_detailed_explained(spark, d):
    return V.terms_evals_detailed_explained(Pipeline(spark, d))


@register("ai_grouped")
def q_ai_grouped(spark, d):
    return V.ai_grouped_view(Pipeline(spark, d))


@register("labelled")
def q_labelled(spark, d):
    return V.labelled_view(Pipeline(spark, d))


@register("combined_terms_questions")
def q_combined_terms_questions(spark, d):
    """Questions with their three terms."""
    return V.combined_terms_questions(Pipeline(spark, d))


@register("detailed_base")
def q_detailed_base(spark, d):
    """Evaluations with every name resolved, before the terms join."""
    return V.terms_evals_detailed_base(Pipeline(spark, d))


# The views as the original defines them: answer labels joined on the answer
# only (each row once per judge of the answer), inclusion rows folded without
# the term source.
@register("label_term_level_compat")
def q_label_term_level_compat(spark, d):
    return V.label_term_level(Pipeline(spark, d), compat=True)


@register("detailed_base_compat")
def q_detailed_base_compat(spark, d):
    return V.terms_evals_detailed_base(Pipeline(spark, d), compat=True)


@register("detailed_compat")
def q_detailed_compat(spark, d):
    return V.terms_evals_detailed(Pipeline(spark, d), compat=True)


@register("ai_grouped_compat")
def q_ai_grouped_compat(spark, d):
    return V.ai_grouped_view(Pipeline(spark, d), compat=True)


@register("labelled_compat")
def q_labelled_compat(spark, d):
    return V.labelled_view(Pipeline(spark, d), compat=True, by_source=False)


@register("report_detail")
def q_report_detail(spark, d):
    """A11 over the term-level view, restricted to the report's columns."""
    return V.report_detail(Pipeline(spark, d))


@register("nested_report")
def q_nested_report(spark, d):
    """A9, texts joined once per question."""
    p = Pipeline(spark, d)
    return R.with_json(V.with_answer_text(p, R.nested_rows(V.report_rows(p)))).drop("evaluations")


@register("report_lines")
def q_report_lines(spark, d):
    """A9 as K7 writes it: the lines of each question's document."""
    return R.report_lines(R.require_report_columns(V.report_detail(Pipeline(spark, d))))


# -- evaluation ---------------------------------------------------------------
@register("terms_long")
def q_terms_long(spark, d):
    from mirage.operators.evaluate import terms_long
    return terms_long(Pipeline(spark, d).qa)


@register("term_inclusion")
def q_term_inclusion(spark, d):
    from mirage.operators.evaluate import inclusion_evals, terms_long
    return inclusion_evals(terms_long(Pipeline(spark, d).qa), partitions=_cores(spark))


@register("judge_evaluations")
def q_judge_evaluations(spark, d):
    from mirage.operators.evaluate import evaluate_answers, stub_judge
    return evaluate_answers(Pipeline(spark, d).qa, stub_judge, 2, partitions=_cores(spark))


@register("short_answers")
def q_short_answers(spark, d):
    """P11 + P12 + F21: short answer rows - the answers with a text cell of
    two terms, no answer id - brought to the wide layout."""
    from mirage.operators.evaluate import to_wide
    return to_wide(_short_rows(Pipeline(spark, d)), order_cols=["_order"]).drop("_order")


def _short_rows(p):
    quote = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))
    made_up = F.col("replacement_type") == 0

    def entry(tid, term, source, source_id, explanation):
        return F.concat(F.lit("{'termId': "), tid.cast("string"), F.lit(", 'term': "), term, F.lit(", 'termSet': '"), source,
                        F.lit("', 'termSetId': "), source_id.cast("string"), F.lit(", 'explanation': "), explanation, F.lit("}"))

    main = entry(F.when(made_up, F.col("nonexistent_id")).otherwise(F.col("replacement_id")),
                 F.when(made_up, quote("nonexistent")).otherwise(quote("replacement")),
                 F.when(made_up, F.lit("hypothetical")).otherwise(F.lit("gpt_suggestion")),
                 F.col("replacement_type"), F.when(made_up, F.lit("None")).otherwise(quote("replacement_meaning")))
    second = entry(F.col("secondary_id"), quote("secondary"), F.lit("gpt_suggestion"), F.lit(1), quote("secondary_meaning"))
    cta = V.combined_terms_answers(p)
    return cta.select("question_id", "question", F.concat(F.lit("["), main, F.lit(", "), second, F.lit("]")).alias("terms"),
                      "answer", F.col("answer_id").alias("_order"))


@register("judge_reply_labels")
def q_judge_reply_labels(spark, d):
    """F18-F20 over judge replies in every shape the extraction meets."""
    from mirage.functions import replies as RP
    r = Pipeline(spark, d).replies
    p = RP.parse_replies(r, "reply", "_p", partitions=_cores(spark))
    acc = F.col("kind") == 2
    label = F.when(acc, RP.certainty_label(F.col("_p"), F.col("term_source"))) \
             .otherwise(RP.meaning_label(F.col("_p")))
    failed = F.when(acc, RP.certainty_failed(F.col("_p"))).otherwise(RP.meaning_failed(F.col("_p")))
    return p.select("id", "kind", "term_source", label.alias("eval_label"),
                    RP.stored_reply(F.col("reply"), failed).alias("reflection"),
                    F.col("_p.step").alias("parse_step"))


@register("reply_failure_rate")
def q_reply_failure_rate(spark, d):
    """Parse outcome counts per extraction attempt (0 = failed)."""
    return q_judge_reply_labels(spark, d).groupBy("kind", "parse_step").agg(
        F.count(F.lit(1)).alias("n"))


# -- triplets -----------------------------------------------------------------
@register("triplets")
def q_triplets(spark, d):
    from mirage.operators.triplets import build_triplets
    return build_triplets(V.terms_combined(Pipeline(spark, d)))


@register("triplets_excluding")
def q_triplets_excluding(spark, d):
    """P2 + P14: the combined terms view as input, without made-up terms 1-3."""
    from mirage.operators.triplets import triplets_from_file
    return triplets_from_file(V.terms_combined(Pipeline(spark, d)), exclude_ids=[1, 2, 3])


@register("short_groups")
def q_short_groups(spark, d):
    """Made-up terms with too few real terms for a whole rotation."""
    from mirage.operators.triplets import short_groups
    return short_groups(V.terms_combined(Pipeline(spark, d)), q=300)


@register("term_phrases")
def q_term_phrases(spark, d):
    """F26 + F27: every real term with its explanation, and as exact phrase."""
    from mirage.functions.text import exact_phrase, labelled_term
    t = Pipeline(spark, d).real_terms
    return t.select("id", labelled_term("term", "explanation").alias("labelled"),
                    exact_phrase(F.concat(F.lit('"'), "term")).alias("phrase"))


@register("triplets_true_source")
def q_triplets_true_source(spark, d):
    from mirage.operators.triplets import build_triplets
    return build_triplets(V.terms_combined(Pipeline(spark, d)), compat=False)


# -- vectors ------------------------------------------------------------------
# Cells of the approximate index and cells probed per query.
CELLS, NPROBE = 16, 10


def _vectors(spark, d):
    """All vectors, and as queries those whose id is divisible by 20."""
    from mirage.sources.tables import read_table
    emb = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return emb, queries


def _ranked(res):
    return res.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


@register("knn_exact")
def q_knn_exact(spark, d):
    """V1: the 10 nearest of all vectors for every 20th one."""
    from mirage.operators import vectors as VX
    emb, queries = _vectors(spark, d)
    return _ranked(VX.exact_knn(emb, queries, k=10, exclude_self=True))


@register("knn_partitioned")
def q_knn_partitioned(spark, d):
    """V2: a search per batch of 300 ids, then the best of all batches."""
    from mirage.operators import vectors as VX
    emb, queries = _vectors(spark, d)
    emb = emb.withColumn("batch", F.floor(F.col("vec_id") / 300))
    return _ranked(VX.two_level_knn(emb, queries, "batch", k=10, exclude_self=True))


@register("knn_ivf")
def q_knn_ivf(spark, d):
    """V3: approximate; its recall against V1 is ``knn_recall``."""
    from mirage.operators import vectors as VX
    emb, queries = _vectors(spark, d)
    return _ranked(VX.approximate_knn(VX.CellIndex(emb, CELLS), queries, NPROBE, k=10, exclude_self=True))


@register("knn_recall")
def q_knn_recall(spark, d):
    from mirage.operators import vectors as VX
    return VX.recall(q_knn_ivf(spark, d), q_knn_exact(spark, d), "query_id", "vec_id")


def _letters(texts):
    """A stand-in for the sentence encoder: counts of eight letters."""
    return [[float(t.count(c)) for c in "aeiounst"] for t in texts]


@register("vector_load_totals")
def q_vector_load_totals(spark, d):
    """Every page paragraph encoded and written in partitions of
    10 000 source rows; the totals of the load."""
    import uuid

    from mirage.operators import vectors as VX
    from mirage.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows = Pipeline(spark, d).wiki_pages.select("_id", F.explode("text").alias("text"))
    return VX.load_vectors(rows, "text", _letters, 8, path, pos_col="_id", per_partition=10_000)


# -- order-dependent steps -----------------------------------------------------
@register("topic_runs")
def q_topic_runs(spark, d):
    """W3 over the event stream: run id by event type, in event order."""
    from mirage.operators.ordering import GlobalOrder
    from mirage.sources.tables import read_table
    ev = read_table(spark, d, "events").select("event_id", "event_type")
    return GlobalOrder(ev, ["event_id"]).run_ids("event_type")


@register("running_mean")
def q_running_mean(spark, d):
    """Running mean of whole seconds (floor of ``value``) in event order."""
    from mirage.operators.ordering import GlobalOrder
    from mirage.sources.tables import read_table
    ev = read_table(spark, d, "events").select(
        "event_id", F.floor("value").cast("long").alias("seconds"))
    return GlobalOrder(ev, ["event_id"]).running_mean("seconds")


@register("row_ids")
def q_row_ids(spark, d):
    """1-based ids by stored order (documents by doc_id)."""
    from mirage.operators.ordering import GlobalOrder
    from mirage.sources.tables import read_table
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return GlobalOrder(docs, ["doc_id"]).with_position("id", base=1)


@register("second_half")
def q_second_half(spark, d):
    """Answers of one model in reversed order, second half."""
    from mirage.operators.ordering import second_half
    a = Pipeline(spark, d).answers
    return second_half(a.select("id", "question_id", "model_id"), ["id"], reverse=True)


@register("first_answers")
def q_first_answers(spark, d):
    """The first 10 answers by id (a top-n report)."""
    from mirage.operators.ordering import head
    return head(Pipeline(spark, d).answers.select("id", "question_id", "model_id"), ["id"], 10)


# -- term building -------------------------------------------------------------
@register("definitions")
def q_definitions(spark, d):
    from mirage.operators.terms import page_definitions
    return page_definitions(Pipeline(spark, d).wiki_pages)


@register("paragraphs")
def q_paragraphs(spark, d):
    from mirage.operators.terms import paragraphs
    return paragraphs(Pipeline(spark, d).wiki_pages, strict=True)


@register("paragraphs_loose")
def q_paragraphs_loose(spark, d):
    from mirage.operators.terms import paragraphs
    return paragraphs(Pipeline(spark, d).wiki_pages, strict=False)


@register("term_lookup_ci_ai")
def q_term_lookup(spark, d):
    from mirage.operators.terms import lookup_by_title
    p = Pipeline(spark, d)
    return lookup_by_title(p.lookup_terms, p.wiki_pages)


@register("lookup_outcomes")
def q_lookup_outcomes(spark, d):
    from mirage.operators.terms import lookup_by_title, lookup_outcomes
    p = Pipeline(spark, d)
    return lookup_outcomes(lookup_by_title(p.lookup_terms, p.wiki_pages))


def _upsert(spark, d):
    from mirage.operators.terms import upsert_real_terms
    tc = V.terms_combined(Pipeline(spark, d))
    cand = tc.select("fake_term_id", F.col("real_term").alias("term"),
                     F.col("real_term_explanation").alias("explanation"), "source_id",
                     F.col("real_term_id").alias("position"))
    return upsert_real_terms(cand)


@register("upsert_terms")
def q_upsert_terms(spark, d):
    return _upsert(spark, d)[0]


@register("upsert_links")
def q_upsert_links(spark, d):
    return _upsert(spark, d)[1]


@register("upsert_existing")
def q_upsert_existing(spark, d):
    """U4 + I4 against stored terms: suggestions, title hits and text hits
    (the three sources of the term links) meet every tenth part as stored."""
    from mirage.functions.common import keep_first
    from mirage.operators.terms import ci_ai, term_suggestions, upsert_real_terms
    p = Pipeline(spark, d)
    tc = V.terms_combined(p).select("fake_term_id", F.col("real_term").alias("term"), F.col("real_term_explanation").alias("explanation"),
                                    "source_id", F.col("real_term_id").alias("position"))
    of = lambda k: tc.where(F.col("source_id") == k)
    tagged = F.concat_ws(" ", "term", (F.col("position") % 5).cast("string"))
    cand = term_suggestions(of(1), of(2).withColumn("term", tagged), of(3).withColumn("term", F.upper("term")))
    old = p.real_terms.where(F.col("id") % 10 == 0).withColumn("_k", ci_ai("term"))
    return upsert_real_terms(cand, keep_first(old, ["_k"], ["id"]).drop("_k"))[0]


def _topics(p):
    t = p.topic
    return t.select(F.col("id").alias("pos"),
                    F.concat(F.col("name"), F.lit(":"), F.col("explanation")).alias("topic"))


@register("topic_containing")
def q_topic_containing(spark, d):
    """Each supplier's nation name against the topic list."""
    from mirage.operators.terms import topic_containing
    p = Pipeline(spark, d)
    titles = p.t.supplier.join(p.t.nation, F.col("s_nationkey") == F.col("n_nationkey")) \
        .select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("title"))
    return topic_containing(titles, _topics(p))


@register("candidate_terms")
def q_candidate_terms(spark, d):
    """F11 + J15 + F10: split candidate replies and pair them with topics."""
    from mirage.operators.terms import split_candidate_lists, topic_rows, zip_by_position
    p = Pipeline(spark, d)
    good, _ = split_candidate_lists(p.candidate_lists)
    topics = topic_rows(_topics(p).select((F.col("pos") - 1).alias("pos"), "topic")) \
        .select((F.col("id")).alias("pos"), F.col("name").alias("topic_name"),
                F.col("explanation").alias("topic_explanation"))
    return zip_by_position(good, topics, "pos")


@register("candidate_rejects")
def q_candidate_rejects(spark, d):
    from mirage.operators.terms import split_candidate_lists
    _, bad = split_candidate_lists(Pipeline(spark, d).candidate_lists)
    return bad.groupBy("cand_pos").agg(F.count(F.lit(1)).alias("rejected"))


@register("suggested_terms")
def q_suggested_terms(spark, d):
    """parse suggested-term replies into one row per term."""
    from mirage.functions.text import parse_term_list
    s = Pipeline(spark, d).suggestion_lists
    return s.select("part", F.posexplode(parse_term_list(F.col("reply"))).alias("pos", "term"))


@register("phrase_exists")
def q_phrase_exists(spark, d):
    """Do words 3-6 of each benchmark passage occur in the documents?"""
    from mirage.operators.terms import phrase_exists
    from mirage.sources.tables import read_table
    b = read_table(spark, d, "benchmark")
    terms = b.select(F.concat_ws(" ", F.slice(F.split(F.col("text"), " ", -1), 3, 4)).alias("term"))
    return phrase_exists(terms, read_table(spark, d, "documents"))


# -- incremental ----------------------------------------------------------------
@register("unanswered")
def q_unanswered(spark, d):
    """Questions model 1 has not answered."""
    from mirage.operators.incremental import unanswered
    p = Pipeline(spark, d)
    return unanswered(p.questions, p.answers, 1)


def _samples(p):
    lab = p.t.labels
    return (lab.where(F.col("quality") == 1).select(F.lit("quality").alias("sample"),
                                                    F.col("doc_id").alias("question_id"))
               .unionByName(lab.where(F.col("toxic") == 1).select(
                   F.lit("toxic").alias("sample"), F.col("doc_id").alias("question_id"))))


@register("sampled")
def q_sampled(spark, d):
    """Answer-level labels restricted to the 'quality' sample."""
    from mirage.operators.incremental import sample_filter
    p = Pipeline(spark, d)
    return sample_filter(V.label_answer_level(p), _samples(p), "quality")


def _work(p):
    from mirage.operators.evaluate import terms_long
    cta = V.combined_terms_answers(p)
    wide = cta.select("*", F.col("answer_source_id").alias("model_id"))
    long = terms_long(wide.withColumn("secondary_source", F.col("secondary_source").cast("string"))
                          .withColumn("replacement_source",
                                      F.col("replacement_source").cast("string")))
    return long.withColumn("term_source", F.when(F.col("is_hypothetical"), F.lit("0"))
                           .otherwise(F.col("term_source")))


@register("not_yet_evaluated")
def q_not_yet_evaluated(spark, d):
    """Work items (answer, term, kind) with no stored result by judge 2."""
    from mirage.operators.incremental import not_yet_evaluated
    p = Pipeline(spark, d)
    w = _work(p).select("answer_id", "term_id", "term_source", "term_pos")
    return not_yet_evaluated(w, p.evals, 2, [2, 3])


@register("reconcile")
def q_reconcile(spark, d):
    """Stored inclusion labels against recomputed ones."""
    from mirage.operators.incremental import reconcile_inclusion
    p = Pipeline(spark, d)
    return reconcile_inclusion(p.evals, _work(p), _cores(spark))


@register("revised")
def q_revised(spark, d):
    """I3 applied to the stored evaluations."""
    from mirage.operators.incremental import reconcile_inclusion, revised
    p = Pipeline(spark, d)
    return revised(p.evals, reconcile_inclusion(p.evals, _work(p), _cores(spark)))


@register("reconcile_counts")
def q_reconcile_counts(spark, d):
    from mirage.operators.incremental import reconcile_counts
    return reconcile_counts(q_reconcile(spark, d))


@register("model_ids")
def q_model_ids(spark, d):
    """Ids for the market segments taken as new model names, plus the
    answering models' names (known)."""
    from mirage.operators.incremental import model_ids
    p = Pipeline(spark, d)
    m = p.models.alias("m")
    names = p.t.customer.select(F.col("c_mktsegment").alias("name")).unionByName(
        p.answers.alias("a").join(m, F.col("a.model_id") == F.col("m.id")).select("m.name"))
    return model_ids(S_models(spark), names)


def S_models(spark):
    from mirage import schemas
    return schemas.lookup(spark, schemas.MODELS)


@register("run_counts")
def q_run_counts(spark, d):
    from mirage.operators.incremental import run_counts
    return run_counts(L.dedupe_evals(Pipeline(spark, d).evals))


# -- prompts and model calls -------------------------------------------------------
@register("chat_render")
def q_chat_render(spark, d):
    from mirage.functions.prompts import render_chats
    from mirage.sources.tables import read_table
    return render_chats(read_table(spark, d, "conversations"), "You are a careful assistant.")


@register("model_short_name")
def q_model_short_name(spark, d):
    """F24 over the answering models of the answer table."""
    from mirage.functions.text import short_model_name
    p = Pipeline(spark, d)
    m = p.models.alias("m")
    used = p.answers.alias("a").join(m, F.col("a.model_id") == F.col("m.id")) \
        .groupBy("m.id", "m.name").agg(F.count(F.lit(1)).alias("answers"))
    return used.select(F.col("id").alias("model_id"), "name",
                       short_model_name(F.col("name")).alias("short_name"), "answers")


@register("answers_stub")
def q_answers_stub(spark, d):
    """M1 over the questions model 1 has not answered (J10), stub answerer."""
    from mirage.operators.batch_model import answer_questions, stub_answerer
    from mirage.operators.incremental import unanswered
    p = Pipeline(spark, d)
    return answer_questions(unanswered(p.questions, p.answers, 1), stub_answerer, 1,
                            partitions=_cores(spark)).drop("elapsed_s")


@register("generated_questions")
def q_generated_questions(spark, d):
    """M4 with the stub writer over the combined triplet view."""
    from mirage.operators.batch_model import generate_questions, stub_generator
    return generate_questions(V.term_triplets_combined(Pipeline(spark, d)), stub_generator, partitions=_cores(spark))


@register("question_reuse")
def q_question_reuse(spark, d):
    """J17 + M4: every third triplet's terms have a stored question of type 0
    (every ninth one invalid, so it is asked again) and of type 3."""
    from mirage.operators.batch_model import generate_questions, stub_generator
    p = Pipeline(spark, d)
    t = V.term_triplets_combined(p).where(F.col("term_triplet_id") % 3 == 0)
    good = F.concat(F.lit("Is "), "nonexistent_term", F.lit(" a "), "secondary_term", F.lit("?"))
    secondary = [F.col("secondary_id"), F.col("secondary_source_id").cast("long").alias("secondary_source")]
    old = t.select(F.col("nonexistent_id").alias("main_id"), F.lit(0).cast("long").alias("main_source"), *secondary,
                   F.lit(0).cast("long").alias("replacement_type"),
                   F.when(F.col("term_triplet_id") % 9 == 0, F.lit("Nothing of it.")).otherwise(good).alias("question")).unionByName(
        t.select(F.col("replacement_id").alias("main_id"), F.col("replacement_source_id").cast("long").alias("main_source"), *secondary,
                 F.lit(3).cast("long").alias("replacement_type"),
                 F.concat(F.lit("Stored: "), "replacement_term").alias("question")))
    return generate_questions(V.term_triplets_combined(p), stub_generator, existing=old, partitions=_cores(spark))


@register("question_checks")
def q_question_checks(spark, d):
    """Terms with regex marks and parentheses found and swapped in
    questions made of them."""
    from mirage.functions.text import question_checks, swap_term
    t = V.term_triplets_combined(Pipeline(spark, d))
    term = F.concat("nonexistent_term", F.lit(" (a+b$) ["), F.col("term_triplet_id").cast("string"), F.lit("]"))
    k = F.col("term_triplet_id") % 4
    said = F.when(k == 0, term).when(k == 1, F.upper(term)).when(k == 2, F.regexp_replace(term, r"\(a\+b\$\)", "")).otherwise(F.lit("nothing"))
    rows = t.select("term_triplet_id", term.alias("term"), F.concat(F.lit("$1 \\ "), "replacement_term").alias("other"), "secondary_term",
                    F.concat(F.lit("Is "), said, F.lit(" like "), "secondary_term", F.lit("?")).alias("question"))
    valid, second = question_checks(F.col("question"), F.col("term"), F.col("secondary_term"), F.lit(0))
    return rows.select("term_triplet_id", "question", valid.alias("valid"), second.alias("secondary_present"),
                       swap_term(F.col("question"), F.col("term"), F.col("other")).alias("swapped"))


@register("related_terms")
def q_related_terms(spark, d):
    """M5 + F9 + F22: a stub model asked for related terms of each made-up
    term by template; its replies parsed into one row per term."""
    from mirage.functions.text import parse_term_list
    from mirage.operators.batch_model import generate_from_template
    p = Pipeline(spark, d)

    def stub(pdf):
        return pdf["prompt"].map(lambda q: "1. " + q.split(": ")[1] + " kin\n2. other {x}")

    out = generate_from_template(p.nonexistent, stub, "Terms {{like}}: {term}", ["id"], partitions=2, term="term")
    return out.select("id", F.posexplode(parse_term_list(F.col("reply"))).alias("pos", "term"))


@register("answers_from_offset")
def q_answers_from_offset(spark, d):
    """The answers from position 100 on, by id."""
    from mirage.operators.ordering import from_offset
    return from_offset(Pipeline(spark, d).answers.select("id", "question_id", "model_id"), ["id"], 100)


@register("answer_labels_file_mode")
def q_answer_labels_file_mode(spark, d):
    """A3 + J16: file mode over evaluated term rows (lowest model id only)."""
    e = Pipeline(spark, d).evals.withColumnRenamed("eval_label", "eval_label_id")
    return L.answer_labels_file_mode(e)


@register("judges")
def q_judges(spark, d):
    """Sorted distinct evaluator ids."""
    from mirage.operators.report import sorted_distinct
    return sorted_distinct(Pipeline(spark, d).evals, "model_id")


@register("madeup_candidates")
def q_madeup_candidates(spark, d):
    """P1 after X1: benchmark phrases that occur in no document."""
    from mirage.operators.terms import not_found
    return not_found(q_phrase_exists(spark, d))


@register("score_one_pair")
def q_score_one_pair(spark, d):
    """P3 + A7/A8 for one judge and one answering model."""
    from mirage.operators.report import for_judge_and_model
    lal = for_judge_and_model(V.label_answer_level(Pipeline(spark, d)), "gpt-3.5-turbo",
                              "llama2:7b-chat-q4_1")
    return R.score(R.label_distribution(lal))
