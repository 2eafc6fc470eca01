"""Pipeline tables derived from the driver's TPC-H-style tables.

The pipeline's own tables (evaluations, answers, questions, terms, triplets)
are not part of the test data, so they are derived with fixed expressions;
``mirage.plans.oracle`` states the same derivations in SQL. All of them are
narrow projections of one scan (no shuffle) except ``links`` (a distinct).

| table        | from      | rule                                                    |
|--------------|-----------|---------------------------------------------------------|
| evals        | lineitem  | answer = order; line 1 is the inclusion check (model 10) |
| answers      | orders    | question = even order key; model 1 + custkey % 9        |
| questions    | orders    | triplet = custkey; type by orderkey % 3 → 0, 1, 3       |
| triplets     | part      | made-up = partkey % 10; secondary = part; replacement = part / 2 |
| real_terms   | part      | term = p_name (repeats), source 1 + partkey % 3         |
| nonexistent  | supplier  | term = s_name, topic = nation                           |
| topic        | nation    | name = n_name                                           |
| links        | lineitem  | distinct (supplier, part)                               |
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage import schemas as S
from mirage.sources.tables import Tables, save_table, scan_table


# Fixed character map used to derive accent-free lookup terms.
ACCENTED = "àâäáãçéèêëíìîïñóòôöõúùûü"
PLAIN = "aaaaaceeeeiiiinooooouuuu"


def _s(c):
    return F.col(c).cast("string")


class Pipeline:
    """Derived pipeline tables and fixed lookups for one data folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base
        self.t = Tables(spark, base)

    # -- fixed lookups (bounded size: safe to broadcast) -----------------
    @cached_property
    def models(self) -> DataFrame:
        return F.broadcast(S.lookup(self.spark, S.MODELS))

    @cached_property
    def eval_names(self) -> DataFrame:
        return F.broadcast(S.lookup(self.spark, S.EVAL_NAMES))

    @cached_property
    def eval_source(self) -> DataFrame:
        return F.broadcast(S.lookup(self.spark, S.EVAL_SOURCES))

    @cached_property
    def term_source(self) -> DataFrame:
        return F.broadcast(S.lookup(self.spark, S.TERM_SOURCES))

    @cached_property
    def replacement_type(self) -> DataFrame:
        return F.broadcast(S.lookup(self.spark, S.REPLACEMENT_TYPES))

    # -- derived facts -----------------------------------------------------
    @property
    def evals(self) -> DataFrame:
        li = self.t.lineitem
        code = F.col("l_linenumber") == 1
        src = (F.col("l_linenumber") % 4).cast("long")
        return li.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"),
            F.col("l_orderkey").cast("long").alias("answer_id"),
            (F.col("l_partkey") % 3).cast("long").alias("eval_label"),
            F.when(code, F.lit(4)).otherwise(2 + F.col("l_linenumber") % 2).cast("long")
             .alias("eval_type_id"),
            F.when(code, F.lit("")).otherwise(F.concat(F.lit("reply "), F.col("l_returnflag"),
                                                       F.col("l_linestatus")))
             .alias("reflection"),
            src.alias("term_source"),
            F.when(src == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("long")
             .alias("term_id"),
            F.when(code, F.lit(10)).otherwise(1 + F.col("l_suppkey") % 3).cast("long")
             .alias("model_id"))

    @property
    def answers(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").cast("long").alias("id"),
            (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("long").alias("question_id"),
            (1 + F.col("o_custkey") % 9).cast("long").alias("model_id"),
            F.concat(F.lit("Answer "), F.col("o_orderpriority"), F.lit(" "),
                     F.col("o_orderstatus")).alias("answer"))

    @property
    def questions(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey") % 3
        return o.select(
            F.col("o_orderkey").cast("long").alias("id"),
            F.col("o_custkey").cast("long").alias("triplet_id"),
            F.when(k == 0, 0).when(k == 1, 1).otherwise(3).cast("long").alias("replacement_type"),
            F.concat(F.lit("Question "), _s("o_orderkey")).alias("question"))

    @property
    def triplets(self) -> DataFrame:
        p = self.t.part
        src = (1 + F.col("p_partkey") % 3).cast("long")
        return p.select(
            F.col("p_partkey").cast("long").alias("id"),
            (F.col("p_partkey") % 10).cast("long").alias("nonexistent_id"),
            F.col("p_partkey").cast("long").alias("secondary_id"),
            src.alias("secondary_source"),
            F.floor(F.col("p_partkey") / 2).cast("long").alias("replacement_id"),
            src.alias("replacement_source"))

    @property
    def real_terms(self) -> DataFrame:
        p = self.t.part
        return p.select(
            F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("term"),
            F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("explanation"),
            (1 + F.col("p_partkey") % 3).cast("long").alias("source_id"))

    @property
    def nonexistent(self) -> DataFrame:
        s = self.t.supplier
        return s.select(
            F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("term"),
            F.concat(F.lit("made-up term "), F.col("s_name")).alias("explanation"),
            F.col("s_nationkey").cast("long").alias("topic_id"))

    @property
    def topic(self) -> DataFrame:
        n = self.t.nation
        return n.select(F.col("n_nationkey").cast("long").alias("id"),
                        F.col("n_name").alias("name"),
                        F.concat(F.lit("region "), _s("n_regionkey")).alias("explanation"))

    @property
    def links(self) -> DataFrame:
        li = self.t.lineitem
        return li.select(F.col("l_suppkey").cast("long").alias("nonexistent_id"),
                         F.col("l_partkey").cast("long").alias("real_id")).distinct()

    @property
    def qa(self) -> DataFrame:
        """Wide answer rows from chats: an assistant turn answers the user turn
        right before it. The made-up term is word 3 of the question, the
        secondary term words 4-5, the replacement word 6; the question type
        comes from ``conv_id % 3`` (0, 1, 3)."""
        c = self.t.conversations
        a = c.where(F.col("role") == "assistant").alias("a")
        q = c.where(F.col("role") == "user").alias("q")
        j = a.join(q, (F.col("a.conv_id") == F.col("q.conv_id"))
                   & (F.col("q.turn") == F.col("a.turn") - 1))
        w = F.split(F.col("q.text"), " ", -1)
        k = F.col("a.conv_id") % 3
        return j.select(
            (F.col("a.conv_id") * 1000 + F.col("a.turn")).cast("long").alias("answer_id"),
            F.col("a.text").alias("answer"),
            (F.col("a.conv_id") * 1000 + F.col("q.turn")).cast("long").alias("question_id"),
            F.col("q.text").alias("question"),
            F.col("a.conv_id").cast("long").alias("nonexistent_id"),
            F.coalesce(F.get(w, 2), F.lit("")).alias("nonexistent"),
            F.col("q.turn").cast("long").alias("secondary_id"),
            F.concat_ws(" ", F.slice(w, 4, 2)).alias("secondary"),
            F.concat(F.lit("meaning of "), F.concat_ws(" ", F.slice(w, 4, 2)))
             .alias("secondary_meaning"),
            F.lit("1").alias("secondary_source"),
            (F.col("a.conv_id") + 1).cast("long").alias("replacement_id"),
            F.coalesce(F.get(w, 5), F.lit("")).alias("replacement"),
            F.lit("").alias("replacement_meaning"), F.lit("2").alias("replacement_source"),
            F.when(k == 0, 0).when(k == 1, 1).otherwise(3).cast("long").alias("replacement_type"))

    @property
    def replies(self) -> DataFrame:
        """Judge replies in the shapes the extraction must handle, from
        lineitem: the line number picks the shape, the return flag the
        certainty and the line status the verification."""
        li = self.t.lineitem
        cert = (F.when(F.col("l_returnflag") == "A", "mentioned")
                 .when(F.col("l_returnflag") == "N", "unknown").otherwise("unreal"))
        ln = F.col("l_linenumber")
        reply = (F.when(ln == 1, F.concat(F.lit('{"term": "x", "reasoning": "ok", "certainty": "'),
                                          cert, F.lit('"}')))
                  .when(ln == 2, F.concat(F.lit('Sure: {"certainty": "'), F.upper(cert),
                                          F.lit('"} done')))
                  .when(ln == 3, F.concat(F.lit('Sure: {"Certainty": "'), cert, F.lit('"} done')))
                  .when(ln == 4, F.lit('{"certainty": 12}'))
                  .when(ln == 5, F.lit("I cannot say"))
                  .when(ln == 6, F.concat(F.lit('{"term": "a", "verified": '),
                                          F.when(F.col("l_linestatus") == "O", "false")
                                           .otherwise("true"), F.lit("}")))
                  .otherwise(F.concat(F.lit('{"term": "x" "certainty": "'), cert, F.lit('"}'))))
        return li.select((F.col("l_orderkey") * 8 + ln).cast("long").alias("id"),
                         (ln % 4).cast("long").alias("term_source"),
                         F.when(ln == 6, 3).otherwise(2).cast("long").alias("kind"),
                         reply.alias("reply"))

    @property
    def wiki_pages(self) -> DataFrame:
        """Pages ``(_id, wikipedia_title, text)`` from documents: the lines are
        the paragraphs, the first word of the first line is the title."""
        d = self.t.documents
        lines = F.split(F.col("text"), "\n", -1)
        return d.select(F.col("doc_id").cast("long").alias("_id"),
                        F.get(F.split(F.get(lines, 0), " ", -1), 0).alias("wikipedia_title"),
                        lines.alias("text"))

    @property
    def lookup_terms(self) -> DataFrame:
        """Terms to look up: the first word of every user turn, lower-cased
        and with common accents removed by a fixed character map."""
        c = self.t.conversations.where(F.col("role") == "user")
        w = F.lower(F.get(F.split(F.col("text"), " ", -1), 0))
        return c.select(F.translate(w, ACCENTED, PLAIN).alias("term"))

    @property
    def candidate_lists(self) -> DataFrame:
        """One candidate reply per supplier: two ``term: definition`` items
        and one item without a colon, separated by ``/n/n/n``."""
        s = self.t.supplier
        return s.select(F.col("s_suppkey").cast("long").alias("supplier"),
                        F.col("s_nationkey").cast("long").alias("pos"),
                        F.concat(F.col("s_name"), F.lit(": first of nation "),
                                 F.col("s_nationkey").cast("string"), F.lit("/n/n/n"),
                                 F.col("s_name"), F.lit(" bis: second/n/n/nbroken item"))
                         .alias("candidates"))

    @property
    def suggestion_lists(self) -> DataFrame:
        """Suggested-term replies in both shapes: a quoted list for even part
        sizes, a numbered list otherwise."""
        p = self.t.part
        quoted = F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_type"),
                          F.lit("... '"), F.col("p_brand"), F.lit("']"))
        numbered = F.concat(F.lit("1. "), F.col("p_name"), F.lit("\n2. "), F.col("p_brand"))
        return p.select(F.col("p_partkey").cast("long").alias("part"),
                        F.when(F.col("p_size") % 2 == 0, quoted).otherwise(numbered)
                         .alias("reply"))

    @property
    def answered(self) -> DataFrame:
        """Answers with their question, a row per answer."""
        a, q = self.answers.alias("a"), self.questions.alias("q")
        return a.join(q, F.col("a.question_id") == F.col("q.id")).select(
            F.col("a.id").alias("answer_id"), "a.question_id", "q.question", "q.replacement_type", "a.answer", "a.model_id")

    @cached_property
    def labels(self) -> DataFrame:
        """The answer-label table (A2 over ``evals``)."""
        from mirage.operators.labels import answer_labels
        return answer_labels(self.evals)


class StoredPipeline(Pipeline):
    """The facts of the label views as catalog tables, bucketed by answer: a
    load shuffles them once, and every view that joins them on the answer
    reads them as they lie. ``name`` prefixes the tables."""

    def __init__(self, spark: SparkSession, base: str, name: str, path: str, buckets: int = 32):
        super().__init__(spark, base)
        self.name = name
        source = Pipeline(spark, base)
        save_table(source.labels, f"{name}_labels", f"{path}/labels", "answer_id", buckets)
        save_table(source.answered, f"{name}_answered", f"{path}/answered", "answer_id", buckets)

    @property
    def answered(self) -> DataFrame:
        return scan_table(self.spark, f"{self.name}_answered")

    @property
    def labels(self) -> DataFrame:
        return scan_table(self.spark, f"{self.name}_labels")
