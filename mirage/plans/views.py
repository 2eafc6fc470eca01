"""The pipeline's relational views as DataFrame functions.

Dimension lookups with a fixed row count (models, label names, kinds,
sources) are broadcast; the fact-to-fact joins are left to the planner, which
with AQE turns a sort-merge join into a broadcast join only when the measured
side is small.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage import schemas as S
from mirage.operators import labels as L
from mirage.plans.derived import Pipeline
from mirage.schemas import FUNCTION_MODEL_ID


def is_hypothetical_question(replacement_type: Column) -> Column:
    """A question is hypothetical when nothing replaced the made-up term."""
    return F.when(replacement_type == 0, F.lit(True)).otherwise(F.lit(False))


def _names(df: DataFrame, prefix: str) -> DataFrame:
    """A lookup with private key ``_k_<prefix>`` and name ``_n_<prefix>`` columns."""
    return df.select(F.col("id").alias(f"_k_{prefix}"), F.col("name").alias(f"_n_{prefix}"))


def term_dictionary(p: Pipeline) -> DataFrame:
    """Made-up and real terms in one table keyed by (is_hypothetical, id), so
    a fact table needs one join instead of two left joins (P10)."""
    n = p.nonexistent.select(F.lit(1).alias("_hyp"), F.col("id").alias("_tid"),
                             F.col("term").alias("_term"), F.col("explanation").alias("_expl"))
    r = p.real_terms.select(F.lit(0).alias("_hyp"), F.col("id").alias("_tid"),
                            F.col("term").alias("_term"), F.col("explanation").alias("_expl"))
    return n.unionByName(r)


def terms_combined(p: Pipeline) -> DataFrame:
    """Made-up term × link × real term × topic × source name."""
    n, t, l, r = p.nonexistent.alias("n"), p.topic.alias("t"), p.links.alias("l"), \
        p.real_terms.alias("r")
    s = p.term_source.alias("s")
    return (n.join(t, F.col("n.topic_id") == F.col("t.id"))
             .join(l, F.col("l.nonexistent_id") == F.col("n.id"))
             .join(r, F.col("l.real_id") == F.col("r.id"))
             .join(s, F.col("r.source_id") == F.col("s.id"))
             .select(F.col("n.id").alias("fake_term_id"), F.col("n.term").alias("fake_term"),
                     F.col("r.id").alias("real_term_id"), F.col("r.term").alias("real_term"),
                     F.col("s.name").alias("source"),
                     F.col("n.explanation").alias("fake_term_explanation"),
                     F.col("n.topic_id"), F.col("t.name").alias("topic"),
                     F.col("t.explanation").alias("topic_explanation"),
                     F.col("r.explanation").alias("real_term_explanation"),
                     F.col("r.source_id")))


def term_triplets_combined(p: Pipeline, triplets: DataFrame | None = None) -> DataFrame:
    """Triplets with both real terms (self-join), their true sources and
    the topic."""
    tt = (triplets if triplets is not None else p.triplets).alias("tt")
    n, t = p.nonexistent.alias("n"), p.topic.alias("t")
    r1, r2 = p.real_terms.alias("r1"), p.real_terms.alias("r2")
    s1, s2 = p.term_source.alias("s1"), p.term_source.alias("s2")
    return (tt.join(n, F.col("tt.nonexistent_id") == F.col("n.id"))
              .join(t, F.col("n.topic_id") == F.col("t.id"))
              .join(r1, F.col("tt.secondary_id") == F.col("r1.id"))
              .join(r2, F.col("tt.replacement_id") == F.col("r2.id"))
              .join(s1, F.col("r1.source_id") == F.col("s1.id"))
              .join(s2, F.col("r2.source_id") == F.col("s2.id"))
              .select(F.col("tt.id").alias("term_triplet_id"),
                      F.col("n.id").alias("nonexistent_id"),
                      F.col("n.term").alias("nonexistent_term"),
                      F.col("r1.id").alias("secondary_id"),
                      F.col("r1.term").alias("secondary_term"),
                      F.col("r2.id").alias("replacement_id"),
                      F.col("r2.term").alias("replacement_term"),
                      F.col("r1.source_id").alias("secondary_source_id"),
                      F.col("s1.name").alias("secondary_source"),
                      F.col("r1.explanation").alias("secondary_explanation"),
                      F.col("r2.source_id").alias("replacement_source_id"),
                      F.col("s2.name").alias("replacement_source"),
                      F.col("r2.explanation").alias("replacement_explanation"),
                      F.col("n.explanation").alias("nonexistent_explanation"),
                      F.col("n.topic_id"), F.col("t.name").alias("topic"),
                      F.col("t.explanation").alias("topic_explanation")))


def combined_terms_questions(p: Pipeline) -> DataFrame:
    """Questions with the three terms and the sources as stored."""
    q, tt, n = p.questions.alias("q"), p.triplets.alias("tt"), p.nonexistent.alias("n")
    r1, r2 = p.real_terms.alias("r1"), p.real_terms.alias("r2")
    return (q.join(tt, F.col("q.triplet_id") == F.col("tt.id"))
             .join(n, F.col("n.id") == F.col("tt.nonexistent_id"))
             .join(r1, F.col("r1.id") == F.col("tt.secondary_id"))
             .join(r2, F.col("r2.id") == F.col("tt.replacement_id"))
             .select(F.col("q.id").alias("question_id"), F.col("n.term").alias("nonexistent"),
                     F.col("r1.term").alias("secondary"), F.col("r2.term").alias("replacement"),
                     F.col("q.replacement_type"), F.col("q.question"),
                     F.col("tt.nonexistent_id"), F.col("tt.secondary_id"),
                     F.col("tt.secondary_source"), F.col("tt.replacement_id"),
                     F.col("tt.replacement_source"), F.col("q.triplet_id"),
                     F.col("r1.explanation").alias("secondary_meaning"),
                     F.col("r2.explanation").alias("replacement_meaning")))


def combined_terms_answers(p: Pipeline) -> DataFrame:
    """Answers with question, terms, meanings and the answering model.

    The two meaning lookups of the original (real terms joined twice) are
    carried from J3, which already joined those rows."""
    a, m = p.answers.alias("a"), p.models.alias("m")
    tq = combined_terms_questions(p).alias("tq")
    return (a.join(tq, F.col("a.question_id") == F.col("tq.question_id"))
             .join(m, F.col("a.model_id") == F.col("m.id"))
             .select(F.col("a.id").alias("answer_id"), F.col("a.answer"),
                     F.col("a.question_id"),
                     is_hypothetical_question(F.col("tq.replacement_type"))
                      .alias("isHallucinative"),
                     "tq.replacement_type", "tq.question", "tq.nonexistent", "tq.secondary",
                     "tq.replacement", "tq.secondary_meaning", "tq.replacement_meaning",
                     F.col("a.model_id").alias("answer_source_id"),
                     F.col("m.name").alias("answer_source"), "tq.nonexistent_id",
                     "tq.secondary_id", "tq.secondary_source", "tq.replacement_id",
                     "tq.replacement_source"))


def label_answer_level(p: Pipeline, labels: DataFrame | None = None) -> DataFrame:
    """One row per answer label with question, answer, both model names
    and the label name."""
    l = (labels if labels is not None else p.labels).alias("l")
    a = p.answered.alias("a")
    m1, m2 = _names(p.models, "answer_source"), _names(p.models, "evaluator_model")
    n = _names(p.eval_names, "answer_label")
    return (l.join(a, F.col("l.answer_id") == F.col("a.answer_id"))
             .join(m1, F.col("a.model_id") == F.col("_k_answer_source"))
             .join(m2, F.col("l.evaluator_model_id") == F.col("_k_evaluator_model"))
             .join(n, F.col("l.answer_label") == F.col("_k_answer_label"))
             .select(F.col("a.question_id"), F.col("a.question"),
                     is_hypothetical_question(F.col("a.replacement_type"))
                      .alias("isHypotheticalQuestion"),
                     F.col("l.answer_id"), F.col("a.answer"),
                     F.col("a.model_id").alias("answer_source_id"), F.col("_n_answer_source").alias("answer_source"),
                     F.col("l.evaluator_model_id"), F.col("_n_evaluator_model").alias("evaluator_model"),
                     F.col("l.answer_label").alias("answer_label_id"), F.col("_n_answer_label").alias("answer_label")))


def _label_sets(p: Pipeline, labels: DataFrame | None) -> DataFrame:
    """One row per answer with its judges' labels: (``_la``, ``_labels``)."""
    sets = L.label_sets(p.evals) if labels is None else L.label_sets_of(labels)
    return sets.select(F.col("answer_id").alias("_la"), F.col("labels").alias("_labels"))


def _matching(model: Column, compat: bool) -> Column:
    """The labels of its answer that an evaluation meets. The original joins
    answer labels on the answer only, so k judges give k copies of each row
    (``compat``). By default a judge's rows take that judge's label and
    inclusion rows (model 10) take every judge's label."""
    if compat:
        return F.col("_labels")
    return F.filter("_labels", lambda x: (model == F.lit(FUNCTION_MODEL_ID)) | (x.judge == model))


def _matching_labels(model: Column, compat: bool) -> Column:
    """The different ones among them, as the views' UNION has each once."""
    return F.array_distinct(F.transform(_matching(model, compat), lambda x: x.label))


def label_term_level(p: Pipeline, labels: DataFrame | None = None,
                     compat: bool = False) -> DataFrame:
    """One row per evaluation × answer label, with the term text picked by
    the term source (P10) and every name resolved."""
    e, a = p.evals, p.answered.alias("a")
    l = _label_sets(p, labels)
    m1, m2 = _names(p.models, "answer_source"), _names(p.models, "evaluator_model")
    es, s = _names(p.eval_source, "eval_type"), _names(p.term_source, "term_source_name")
    n1, n2 = _names(p.eval_names, "term_label"), _names(p.eval_names, "answer_label")
    d = term_dictionary(p)
    hyp = F.when(F.col("e.term_source") == 0, 1).otherwise(0)
    met = F.explode(F.transform(_matching(F.col("e.model_id"), compat), lambda x: x.label)).alias("_label")
    # Rows are placed twice, by term and by answer; they multiply by their
    # answer's labels after that.
    terms = e.alias("e").join(d, (F.col("e.term_id") == F.col("_tid")) & (hyp == F.col("_hyp")), "left").select("e.*", "_term", "_expl")
    j = (terms.alias("e").join(l, F.col("e.answer_id") == F.col("_la"))
          .join(a, F.col("e.answer_id") == F.col("a.answer_id"))
          .select("e.*", "a.question_id", "a.question", "a.replacement_type", "a.answer", F.col("a.model_id").alias("_source"), met).alias("e")
          .join(m1, F.col("_source") == F.col("_k_answer_source"))
          .join(m2, F.col("e.model_id") == F.col("_k_evaluator_model"))
          .join(es, F.col("e.eval_type_id") == F.col("_k_eval_type"))
          .join(s, F.col("e.term_source") == F.col("_k_term_source_name"))
          .join(n1, F.col("e.eval_label") == F.col("_k_term_label"))
          .join(n2, F.col("_label") == F.col("_k_answer_label")))
    return j.select(
        F.col("e.id").alias("eval_id"), "question_id", "question",
        is_hypothetical_question(F.col("replacement_type")).alias("isHypotheticalQuestion"),
        F.col("e.answer_id"), "answer", F.col("e.term_id"),
        F.col("_term").alias("term"), F.col("_expl").alias("term_explanation"),
        hyp.alias("IsHypotheticalTerm"), F.col("e.eval_type_id"), F.col("_n_eval_type").alias("eval_type"),
        F.col("e.reflection"), F.col("e.eval_label").alias("term_label_id"), F.col("_n_term_label").alias("term_label"),
        F.col("_label").alias("answer_label_id"), F.col("_n_answer_label").alias("answer_label"),
        F.col("e.term_source").alias("term_source_id"),
        F.col("_n_term_source_name").alias("term_source"),
        F.col("_source").alias("answer_source_id"), F.col("_n_answer_source").alias("answer_source"),
        F.col("e.model_id").alias("evaluator_model_id"), F.col("_n_evaluator_model").alias("evaluator_model"))


def _named(rows: list[tuple[int, str]], code: Column) -> Column:
    """The name of a fixed lookup's code (null for others), without a join."""
    return F.create_map(*[F.lit(x) for k, name in rows for x in (k, name)])[code]


def _name_order(rows: list[tuple[int, str]], code: Column) -> Column:
    """A number that orders a fixed lookup's codes as their names."""
    return F.create_map(*[F.lit(x) for n, (k, _) in enumerate(sorted(rows, key=lambda r: r[1])) for x in (k, n)])[code]


def _answer_heads(p: Pipeline) -> DataFrame:
    """One row per answer: its question, the answering model and whether the
    question is hypothetical. Of repeated answers the first by model name
    and question counts, as in the report's order."""
    known = p.answered.where(F.col("model_id").isin([k for k, _ in S.MODELS]))
    hyp = is_hypothetical_question(F.col("replacement_type"))
    heads = known.select(F.col("answer_id").alias("_ha"), F.struct(
        _name_order(S.MODELS, F.col("model_id")).alias("order"), "question_id", hyp.alias("hyp"), "model_id").alias("_h"))
    return heads.groupBy("_ha").agg(F.min("_h").alias("_h"))


#: Codes of an evaluation that travel as one number.
EVAL_CODES = ["eval_label", "eval_type_id", "term_source", "model_id"]


def _packed(df: DataFrame, names: list[str]) -> DataFrame:
    """``names`` (integers, seven at most) as one number, ``_codes``, a byte
    each and 255 for a missing one. A row with a number that a byte doesn't
    hold keeps all of them in ``_odd``."""
    small = reduce(and_, [F.coalesce(F.col(c).between(0, 254), F.lit(True)) for c in names])
    byte = [F.shiftleft(F.coalesce(F.col(c).cast("long"), F.lit(255)), 8 * k) for k, c in enumerate(names)]
    return df.select(*[c for c in df.columns if c not in names], F.when(small, reduce(Column.bitwiseOR, byte)).alias("_codes"),
                     F.when(~small, F.struct(*names)).alias("_odd"))


def _code(names: list[str], name: str) -> Column:
    """One of the numbers that ``_packed`` put together."""
    byte = F.shiftright("_codes", 8 * names.index(name)).bitwiseAND(F.lit(255))
    return F.when(F.col("_codes").isNull(), F.col("_odd")[name]).when(byte != 255, byte)


def _unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *[_code(names, c).alias(c) for c in names]).drop("_codes", "_odd")


def _shared_ids(p: Pipeline) -> DataFrame:
    """(``_sa``, ``_si``): the answer and id of evaluations whose id other
    answers have too, placed by answer. Only ids and answers are shuffled."""
    ids = p.evals.where(F.col("answer_id").isNotNull()).select(F.col("answer_id").alias("_sa"), F.col("id").alias("_si"))
    of = Window.partitionBy("_si")
    return ids.withColumn("_lo", F.min("_sa").over(of)).withColumn("_hi", F.max("_sa").over(of)).where("_lo < _hi").select("_sa", "_si").repartition("_sa")


def report_rows(p: Pipeline, labels: DataFrame | None = None) -> DataFrame:
    """A11 over J6, without the question and answer text. The ids come before
    the texts they determine in the report's columns, so leaving the texts out
    changes neither which rows are equal nor which comes first.

    Equal to ``labels.dedupe_report_rows`` over those columns of
    ``label_term_level``, in which codes stand for names until the end. What a
    row takes from its answer, its term and its answer's labels depends on its
    own ids, so its repeats are dropped before it meets the answer, and of
    each the first (least) is enough, as the rows with the others would go in
    the second dedupe.

    A row is shuffled three times, by its term, its answer and its question,
    with its codes as one number, and the rows of a question lie together. An
    id's repeats are mostly of one answer and meet there; only rows whose id
    several answers have (``_shared_ids``) are shuffled by id."""
    code = lambda rows: [k for k, _ in rows]
    model = F.col("model_id")
    made_up = lambda source: F.when(source == 0, 1).otherwise(0)
    e = _packed(p.evals.where(F.col("answer_id").isNotNull()), EVAL_CODES)
    least = F.when(F.count(F.lit(1)) > F.count("_term"), F.lit(None)).otherwise(F.min("_term"))
    d = term_dictionary(p).groupBy("_hyp", "_tid").agg(least.alias("_term"))
    e = e.join(d, (F.col("term_id") == F.col("_tid")) & (made_up(_code(EVAL_CODES, "term_source")) == F.col("_hyp")), "left").drop("_tid", "_hyp")
    # Placed by answer and sorted once: all windows up to the second dedupe
    # group by a prefix of ``own``.
    e = _unpacked(e.repartition("answer_id"), EVAL_CODES).withColumn("_made_up", made_up(F.col("term_source")))
    key = ["answer_id", "model_id", *[c for c in L.EVAL_KEY if c not in ("answer_id", "model_id")]]
    own = [*key, *[c for c in e.columns if c not in (*key, "id")]]
    rows = e.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("id").asc_nulls_first())))
    if labels is None:
        answer = Window.partitionBy("answer_id")
        rows = rows.withColumn("_sev", L.first_severity(L.first_rank().over(Window.partitionBy(*key))))
        rows = (rows.withColumn("_own", F.max("_sev").over(Window.partitionBy("answer_id", "model_id")))
                    .withColumn("_code", F.max(F.when(model == FUNCTION_MODEL_ID, F.col("_sev"))).over(answer)))
        rows = rows.withColumn("_label", F.when(L.is_judge(model), L.judge_label(F.col("_own"), F.col("_code"))))
        rows = rows.withColumn("_label", F.when(model == FUNCTION_MODEL_ID, F.min("_label").over(answer)).otherwise(F.col("_label")))
        rows = rows.drop("_sev", "_own", "_code")
    else:
        label = F.array_min(F.filter(_matching_labels(model, False), lambda x: x.isin(code(S.EVAL_NAMES))))
        rows = rows.join(_label_sets(p, labels), F.col("answer_id") == F.col("_la")).withColumn("_label", label).drop("_la", "_labels")
    known = (F.col("eval_label").isin(code(S.EVAL_NAMES)) & model.isin(code(S.MODELS)) & F.col("eval_type_id").isin(code(S.EVAL_SOURCES))
             & F.col("term_source").isin(code(S.TERM_SOURCES)) & F.col("_label").isNotNull())
    j = rows.where((F.col("_n") == 1) & known).drop("_n").join(_answer_heads(p), F.col("answer_id") == F.col("_ha")).drop("_ha")
    order = ["_h.order", "_h.question_id", "answer_id", "_h.hyp", _name_order(S.MODELS, F.col("model_id")), _name_order(S.EVAL_SOURCES, F.col("eval_type_id")),
             "eval_label", "_term", "term_id", "_made_up", _name_order(S.TERM_SOURCES, F.col("term_source")), "reflection", "_label"]
    order = [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]
    first = lambda df, *of: df.withColumn("_n", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where("_n = 1").drop("_n")
    kept, shared = first(j, "answer_id", "id"), _shared_ids(p)
    here = (F.col("answer_id") == F.col("_sa")) & F.col("id").eqNullSafe(F.col("_si"))
    kept = kept.join(shared, here, "left_anti").unionByName(first(kept.join(shared, here, "left_semi"), "id"))
    codes = ["_source", "_hyp", *EVAL_CODES, "_label"]
    kept = kept.select("_h.question_id", "answer_id", F.col("_h.model_id").alias("_source"), F.col("_h.hyp").cast("int").alias("_hyp"), *EVAL_CODES, "_label",
                       "id", "term_id", "reflection", "_term")
    kept = _unpacked(_packed(kept, codes).repartition("question_id"), codes)
    return kept.select(
        _named(S.MODELS, F.col("_source")).alias("answer_source"), "question_id", "answer_id", (F.col("_hyp") == 1).alias("isHypotheticalQuestion"),
        _named(S.MODELS, F.col("model_id")).alias("evaluator_model"), F.col("id").alias("eval_id"),
        _named(S.EVAL_SOURCES, F.col("eval_type_id")).alias("eval_type"), F.col("eval_label").alias("term_label_id"),
        _named(S.EVAL_NAMES, F.col("eval_label")).alias("term_label"), F.col("_term").alias("term"), "term_id",
        made_up(F.col("term_source")).alias("IsHypotheticalTerm"), _named(S.TERM_SOURCES, F.col("term_source")).alias("term_source"), "reflection",
        F.col("_label").alias("answer_label_id"), _named(S.EVAL_NAMES, F.col("_label")).alias("answer_label"))


def with_answer_text(p: Pipeline, rows: DataFrame) -> DataFrame:
    """``rows`` (answer_id, question_id: one of the answer's questions) with
    the answer and question text. The texts are brought to the questions and
    meet the rows as a union, not a join on both ids, so rows that lie by
    question, as those of ``report_rows`` do, stay there."""
    a = p.answers.where(F.col("id").isNotNull()).repartition("id").groupBy("id").agg(
        F.collect_set("question_id").alias("_qs"), F.collect_list(F.struct("answer")).alias("_texts"))
    a = a.select(F.col("id").alias("answer_id"), "_texts", F.explode("_qs").alias("question_id")).select(
        "answer_id", "question_id", F.explode("_texts").alias("_text")).repartition("question_id")
    both = rows.withColumn("_row", F.lit(True)).unionByName(a, allowMissingColumns=True)
    texts = F.collect_list("_text").over(Window.partitionBy("question_id", "answer_id"))
    met = both.withColumn("_texts", texts).where("_row").select(*rows.columns, F.explode("_texts").alias("_text"))
    q = p.questions.select(F.col("id").alias("_qid"), "question")
    return met.join(q, F.col("question_id") == F.col("_qid")).select(*rows.columns, "_text.answer", "question")


def report_detail(p: Pipeline, labels: DataFrame | None = None) -> DataFrame:
    """The report's rows; texts are joined once, to those that stay, where
    they lie."""
    return with_answer_text(p, report_rows(p, labels)).select(*S.REPORT_DETAIL_COLUMNS)


def terms_evals_detailed_base(p: Pipeline, labels: DataFrame | None = None,
                              compat: bool = False) -> DataFrame:
    """Evaluations over J4 with kind, source, judge, label and
    replacement-type names and the answer label."""
    e = p.evals.alias("e")
    a = combined_terms_answers(p).alias("a")
    l = _label_sets(p, labels)
    s, ts = _names(p.eval_source, "eval_type"), _names(p.term_source, "term_source_name")
    m, n = _names(p.models, "evaluator_model"), _names(p.eval_names, "eval_label_name")
    r = _names(p.replacement_type, "replacement_type_name")
    met = F.explode(F.transform(_matching(F.col("e.model_id"), compat), lambda x: x.label)).alias("_label")
    j = (e.join(l, F.col("e.answer_id") == F.col("_la")).select("e.*", met).alias("e")
          .join(a, F.col("a.answer_id") == F.col("e.answer_id"))
          .join(s, F.col("e.eval_type_id") == F.col("_k_eval_type"))
          .join(m, F.col("e.model_id") == F.col("_k_evaluator_model"))
          .join(ts, F.col("e.term_source") == F.col("_k_term_source_name"))
          .join(n, F.col("e.eval_label") == F.col("_k_eval_label_name"))
          .join(r, F.col("a.replacement_type") == F.col("_k_replacement_type_name")))
    return j.select(
        F.col("e.id").alias("eval_id"), F.col("a.question"), F.col("a.answer"),
        F.col("e.reflection"), F.col("a.question_id"),
        F.col("a.isHallucinative").alias("isHypotheticalQuestion"),
        F.col("a.replacement_type").alias("replacement_type_id"),
        F.col("_n_replacement_type_name").alias("replacement_type"), F.col("e.eval_label"),
        F.col("_n_eval_label_name").alias("eval_label_name"), F.col("e.answer_id"), F.col("a.answer_source_id"),
        F.col("a.answer_source"), F.col("e.eval_type_id"), F.col("_n_eval_type").alias("eval_type"),
        F.col("e.term_source").alias("term_source_id"),
        F.col("_n_term_source_name").alias("term_source"), F.col("e.term_id"),
        F.col("e.model_id").alias("evaluator_model_id"), F.col("_n_evaluator_model").alias("evaluator_model"),
        F.col("_label").alias("answer_label"))


def _term_kind(source: Column) -> Column:
    """Which side of the union a term source belongs to: 1 made-up, 0 real."""
    return F.when(source == 0, 1).when(source > 0, 0)


def _detailed_narrow(p: Pipeline, labels: DataFrame | None = None,
                     compat: bool = False, explained: bool = False) -> DataFrame:
    """The distinct narrow rows of U1: evaluation columns (``_e_*``), the
    answer label and the term, before any text of the answer is joined.
    Each different label of its answer comes once per evaluation, and rows
    that repeat in the evaluation table itself are dropped where they meet
    their answer's labels, which takes no shuffle of its own (terms are keyed
    by side and id, so the term adds none). ``explained`` adds ``_expl``, the
    term's explanation (J8): a term's key meets its texts and its explanations
    in the dictionary, not once more for each evaluation."""
    e = p.evals
    l = _label_sets(p, labels)
    met = F.explode(_matching_labels(F.col("e.model_id"), compat)).alias("_answer_label")
    rows = e.alias("e").join(l, F.col("e.answer_id") == F.col("_la")).select(
        *[F.col(f"e.{c}").alias(f"_e_{c}") for c in e.columns], met).distinct()
    d = term_dictionary(p).drop("_expl")
    if explained:
        d = d.join(term_dictionary(p).drop("_term"), ["_hyp", "_tid"])
    return (rows.join(d, (F.col("_e_term_id") == F.col("_tid")) & (_term_kind(F.col("_e_term_source")) == F.col("_hyp")))
                .select(*rows.columns, "_term", "_hyp", *(["_expl"] if explained else [])))


def terms_evals_detailed(p: Pipeline, labels: DataFrame | None = None,
                         compat: bool = False) -> DataFrame:
    """Base rows with the made-up term (source 0) or the real term
    (source > 0), as a distinct union; other sources drop out.

    Repeats are avoided where they would arise (``_detailed_narrow``), before
    the answer, question and name columns are joined in. Those joins are on
    primary keys (answer, question, triplet, term and lookup ids), so they
    cannot create or merge duplicates and the result equals the distinct of
    the wide rows, while no shuffle carries question or answer text."""
    return _with_names(p, _detailed_narrow(p, labels, compat))


def _with_names(p: Pipeline, narrow: DataFrame, *more: Column) -> DataFrame:
    """U1's columns for narrow rows, and ``more`` of them."""
    a = combined_terms_answers(p).alias("a")
    s, ts = _names(p.eval_source, "eval_type"), _names(p.term_source, "term_source_name")
    m, n = _names(p.models, "evaluator_model"), _names(p.eval_names, "eval_label_name")
    r = _names(p.replacement_type, "replacement_type_name")
    j = (narrow.join(a, F.col("a.answer_id") == F.col("_e_answer_id"))
               .join(s, F.col("_e_eval_type_id") == F.col("_k_eval_type"))
               .join(m, F.col("_e_model_id") == F.col("_k_evaluator_model"))
               .join(ts, F.col("_e_term_source") == F.col("_k_term_source_name"))
               .join(n, F.col("_e_eval_label") == F.col("_k_eval_label_name"))
               .join(r, F.col("a.replacement_type") == F.col("_k_replacement_type_name")))
    return j.select(
        F.col("_e_id").alias("eval_id"), F.col("a.question"), F.col("a.answer"),
        F.col("_e_reflection").alias("reflection"), F.col("a.question_id"),
        F.col("a.isHallucinative").alias("isHypotheticalQuestion"),
        F.col("a.replacement_type").alias("replacement_type_id"),
        F.col("_n_replacement_type_name").alias("replacement_type"),
        F.col("_e_eval_label").alias("eval_label"),
        F.col("_n_eval_label_name").alias("eval_label_name"),
        F.col("_e_answer_id").alias("answer_id"), F.col("a.answer_source_id"),
        F.col("a.answer_source"), F.col("_e_eval_type_id").alias("eval_type_id"),
        F.col("_n_eval_type").alias("eval_type"), F.col("_e_term_source").alias("term_source_id"),
        F.col("_n_term_source_name").alias("term_source"), F.col("_e_term_id").alias("term_id"),
        F.col("_e_model_id").alias("evaluator_model_id"),
        F.col("_n_evaluator_model").alias("evaluator_model"),
        F.col("_answer_label").alias("answer_label"), F.col("_term").alias("term"),
        F.col("_hyp").alias("IsHypotheticalTerm"), *more)


def terms_evals_detailed_explained(p: Pipeline, labels: DataFrame | None = None,
                                   compat: bool = False) -> DataFrame:
    """U1 rows plus the explanation picked by the term source."""
    return _with_names(p, _detailed_narrow(p, labels, compat, explained=True), F.col("_expl").alias("explanation"))


def _answer_side(p: Pipeline) -> DataFrame:
    """The answer-level columns of U1 (one row per answer id), with the
    replacement-type join the view applies per answer."""
    a = combined_terms_answers(p)
    r = _names(p.replacement_type, "replacement_type_name")
    return (a.join(r, F.col("replacement_type") == F.col("_k_replacement_type_name"))
             .select("answer_id", "question_id", F.col("isHallucinative").alias("isHypotheticalQuestion"),
                     "question", "answer", "answer_source_id", "answer_source"))


def _cells(p: Pipeline, labels: DataFrame | None, compat: bool) -> DataFrame:
    """U1 folded once, per (answer, judge, kind, term): the number of view
    rows with each label (``n0``, ``n1``, ``n2``), the judge's name, placed by
    answer so that both views roll it up without another shuffle.

    One scan: repeated rows are dropped (texts by two hashes) and the rest
    folded, both combined before their shuffle. The answer labels come
    from the same cells (``labels`` None) as severities over the answer, or
    from the stored table. A cell's rows repeat for each different label that
    they meet; cells of unknown kinds, judges, sources or terms take part in
    the labels only."""
    text = [F.xxhash64("reflection").alias("_h"), F.xxhash64(F.lit(1), "reflection").alias("_g")]
    once = p.evals.select("id", *L.EVAL_KEY, "eval_label", *text).distinct()
    cells = once.groupBy(*L.EVAL_KEY).agg(L.first_rank().alias("_rank"), *L.label_counts())
    m = _names(p.models, "evaluator_model")
    d = term_dictionary(p).select("_tid", "_hyp")
    source = F.col("term_source")
    kinds, sources = [k for k, _ in S.EVAL_SOURCES], [k for k, _ in S.TERM_SOURCES]
    known = (F.col("_hyp").isNotNull() & F.col("_n_evaluator_model").isNotNull()
             & F.col("eval_type_id").isin(kinds) & source.isin(sources))
    cells = (cells.join(m, F.col("model_id") == F.col("_k_evaluator_model"), "left")
                  .join(d, (F.col("term_id") == F.col("_tid")) & (_term_kind(source) == F.col("_hyp")), "left")
                  .select(*L.EVAL_KEY, L.first_severity(F.col("_rank")).alias("_sev"), "n0", "n1", "n2", F.col("_n_evaluator_model").alias("evaluator_model"),
                          F.coalesce(known, F.lit(False)).alias("_known"))
                  .repartition("answer_id"))
    model, answer = F.col("model_id"), Window.partitionBy("answer_id")
    if labels is None:
        judge = Window.partitionBy("answer_id", "model_id")
        cells = cells.withColumn("_own", F.max("_sev").over(judge)).withColumn(
            "_code", F.max(F.when(model == FUNCTION_MODEL_ID, F.col("_sev"))).over(answer))
        entry = F.struct(model.alias("judge"), L.judge_label(F.col("_own"), F.col("_code")).alias("label"))
        cells = cells.withColumn("_labels", F.collect_set(F.when(L.is_judge(model), entry)).over(answer))
    else:
        cells = cells.join(_label_sets(p, labels), F.col("answer_id") == F.col("_la"))
    times = F.when(F.col("_known"), F.size(_matching_labels(model, compat))).otherwise(0)
    return cells.select(*L.EVAL_KEY, "evaluator_model", *[(F.col(f"n{k}") * times).alias(f"n{k}") for k in range(3)])


def _judge_counts(rows: DataFrame) -> list[Column]:
    """Rows of the judge kinds with each label, summed."""
    kinds = [k for k, name in S.EVAL_SOURCES if name not in ("HumanEval", "code_check")]
    return [F.sum(F.when(F.col("eval_type_id").isin(kinds), F.col(f"n{k}")).otherwise(0)) for k in range(3)]


def _ai(counts: list[str]) -> tuple[Column, Column]:
    cols = [F.col(c) for c in counts]
    return L.ai_label(*cols), cols[0] + cols[1] + cols[2]


def ai_grouped_view(p: Pipeline, labels: DataFrame | None = None,
                    compat: bool = False) -> DataFrame:
    """A4 over U1, equal to ``labels.ai_grouped(terms_evals_detailed(p))``.

    The grouping columns other than (answer, judge) depend on those ids, so
    the cells are rolled up on ids and the question and answer text is joined
    once per group afterwards; no shuffle carries text per evaluation row."""
    cells = _cells(p, labels, compat)
    sums = [c.alias(f"s{k}") for k, c in enumerate(_judge_counts(cells))]
    label, count = _ai(["s0", "s1", "s2"])
    g = (cells.groupBy("answer_id", "model_id", "evaluator_model").agg(*sums)
              .select("answer_id", F.col("model_id").alias("evaluator_model_id"), "evaluator_model",
                      label.alias("eval_label"), count.alias("count")).where("count > 0"))
    return g.join(_answer_side(p), "answer_id").select(*L.AI_GROUPED_COLUMNS)


def labelled_view(p: Pipeline, labels: DataFrame | None = None, compat: bool = False,
                  by_source: bool = True) -> DataFrame:
    """A6 + J9 over U1, equal to ``labels.labelled(terms_evals_detailed(p))``.

    The same cells give each answer's grouped judge labels, as an array that
    the answer's inclusion cells carry (one entry a judge), and the inclusion
    fold per term; the text is joined once per result row. An answer without
    judge rows has null judge and answer columns, as a left join gives."""
    cells = _cells(p, labels, compat)
    judge, answer = Window.partitionBy("answer_id", "model_id"), Window.partitionBy("answer_id")
    for k, c in enumerate(_judge_counts(cells)):
        cells = cells.withColumn(f"s{k}", c.over(judge))
    label, count = _ai(["s0", "s1", "s2"])
    entry = F.struct(F.col("model_id").alias("judge"), F.col("evaluator_model").alias("name"), label.alias("label"), count.alias("count"))
    cells = cells.withColumn("_ai", F.collect_set(F.when(count > 0, entry)).over(answer))
    largest = F.max(F.when(F.col("n2") > 0, 2).when(F.col("n1") > 0, 1).otherwise(0)).cast("long")
    extra = ["term_source"] if by_source else []
    rc = (cells.where((F.col("eval_type_id") == S.CODE_CHECK) & (F.col("n0") + F.col("n1") + F.col("n2") > 0))
               .groupBy("answer_id", "term_id", *extra).agg(largest.alias("_relevant"), F.any_value("_ai").alias("_ai")))
    rows = rc.select("answer_id", "term_id", *extra, "_relevant", F.explode_outer("_ai").alias("_j")).join(_answer_side(p), "answer_id")
    judged = F.col("_j").isNotNull()
    hal = F.when(F.col("_j.label") == 1, 1).when(F.col("_j.label") == 2, 2).otherwise(F.col("_relevant")).cast("long")
    of_answer = ["question_id", "isHypotheticalQuestion", "question", "answer", "answer_source_id", "answer_source"]
    return rows.select(
        "answer_id", "term_id", *[F.col("term_source").alias("term_source_id") for _ in extra],
        F.col("_j.label").alias("ai_label"), F.col("_relevant").alias("isRelevant_label"), hal.alias("hallucination_label"),
        *[F.when(judged, F.col(c)).alias(c) for c in of_answer],
        F.col("_j.judge").alias("evaluator_model_id"), F.col("_j.name").alias("evaluator_model"), F.col("_j.count").alias("count"))
