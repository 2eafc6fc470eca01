"""DuckDB oracle SQL for each registered query (same names as the catalog)."""

from __future__ import annotations

from mirage.plans.oracle import pct_sql, with_ctes

ORACLE: dict[str, str] = {}

_DIST_EXTRA = [
    ("cnt", """
SELECT evaluator_model, answer_source, answer_label, count(*) AS n_all,
       count(*) FILTER (WHERE isHypotheticalQuestion = true) AS n_hyp,
       count(*) FILTER (WHERE isHypotheticalQuestion = false) AS n_valid
FROM label_answer_level WHERE answer_label IN ('valid', 'hallucination', 'irrelevant')
GROUP BY evaluator_model, answer_source, answer_label"""),
    ("tot", """
SELECT evaluator_model, answer_source, sum(n_all) AS t_all, sum(n_hyp) AS t_hyp,
       sum(n_valid) AS t_valid FROM cnt GROUP BY evaluator_model, answer_source"""),
    ("dist", f"""
SELECT t.evaluator_model, t.answer_source, s.answer_label, s.label_order,
       {pct_sql('coalesce(c.n_all, 0)', 't.t_all')} AS all_questions,
       {pct_sql('coalesce(c.n_hyp, 0)', 't.t_hyp')} AS hypothetical_questions,
       {pct_sql('coalesce(c.n_valid, 0)', 't.t_valid')} AS valid_questions
FROM tot t CROSS JOIN (VALUES (0, 'valid'), (1, 'hallucination'), (2, 'irrelevant'))
     AS s(label_order, answer_label)
LEFT JOIN cnt c ON c.evaluator_model = t.evaluator_model AND c.answer_source = t.answer_source
               AND c.answer_label = s.answer_label"""),
]

ORACLE["evals_dedup"] = with_ctes(
    "SELECT id, answer_id, eval_label, eval_type_id, reflection, term_source, term_id, model_id "
    "FROM dedup_evals", "dedup_evals")

ORACLE["answer_labels"] = with_ctes("SELECT * FROM alabels", "alabels")

ORACLE["label_answer_level"] = with_ctes("SELECT * FROM label_answer_level",
                                         "label_answer_level")

ORACLE["label_distribution"] = with_ctes("SELECT * FROM dist", "label_answer_level",
                                         extra=_DIST_EXTRA)

ORACLE["score"] = with_ctes(
    "SELECT evaluator_model, answer_source, hypothetical_questions AS score FROM dist "
    "WHERE answer_label = 'valid'", "label_answer_level", extra=_DIST_EXTRA)

ORACLE["stacked_totals"] = with_ctes("""
SELECT evaluator_model, answer_source, cohort, answer_label, label_order, value,
       sum(value) OVER w AS bar_top,
       greatest((sum(value) OVER w + (sum(value) OVER w - value) - 12.0) / 2,
                sum(value) OVER w - value) AS text_position
FROM (SELECT evaluator_model, answer_source, answer_label, label_order,
             'all_questions' AS cohort, all_questions AS value FROM dist
      UNION ALL SELECT evaluator_model, answer_source, answer_label, label_order,
             'hypothetical_questions', hypothetical_questions FROM dist
      UNION ALL SELECT evaluator_model, answer_source, answer_label, label_order,
             'valid_questions', valid_questions FROM dist) u
WINDOW w AS (PARTITION BY evaluator_model, answer_source, cohort ORDER BY label_order
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "label_answer_level", extra=_DIST_EXTRA)

ORACLE["terms_combined"] = with_ctes("""
SELECT n.id AS fake_term_id, n.term AS fake_term, r.id AS real_term_id, r.term AS real_term,
       s.name AS source, n.explanation AS fake_term_explanation, n.topic_id, t.name AS topic,
       t.explanation AS topic_explanation, r.explanation AS real_term_explanation, r.source_id
FROM nonexistent n JOIN topic t ON n.topic_id = t.id
JOIN links l ON l.nonexistent_id = n.id JOIN real_terms r ON l.real_id = r.id
JOIN term_source s ON r.source_id = s.id""", "nonexistent", "topic", "links", "real_terms")

ORACLE["triplets_combined"] = with_ctes("""
SELECT tt.id AS term_triplet_id, n.id AS nonexistent_id, n.term AS nonexistent_term,
       r1.id AS secondary_id, r1.term AS secondary_term, r2.id AS replacement_id,
       r2.term AS replacement_term, r1.source_id AS secondary_source_id,
       s1.name AS secondary_source, r1.explanation AS secondary_explanation,
       r2.source_id AS replacement_source_id, s2.name AS replacement_source,
       r2.explanation AS replacement_explanation, n.explanation AS nonexistent_explanation,
       n.topic_id, t.name AS topic, t.explanation AS topic_explanation
FROM triplets tt JOIN nonexistent n ON tt.nonexistent_id = n.id
JOIN topic t ON n.topic_id = t.id
JOIN real_terms r1 ON tt.secondary_id = r1.id JOIN real_terms r2 ON tt.replacement_id = r2.id
JOIN term_source s1 ON r1.source_id = s1.id JOIN term_source s2 ON r2.source_id = s2.id""",
    "triplets", "nonexistent", "topic", "real_terms")

ORACLE["combined_terms_answers"] = with_ctes("SELECT * FROM cta", "cta")

ORACLE["label_term_level"] = with_ctes("""
SELECT e.id AS eval_id, a.question_id, q.question,
       (q.replacement_type = 0) AS isHypotheticalQuestion, e.answer_id, a.answer, e.term_id,
       d.term, d.explanation AS term_explanation,
       CASE WHEN e.term_source = 0 THEN 1 ELSE 0 END AS IsHypotheticalTerm,
       e.eval_type_id, es.name AS eval_type, e.reflection, e.eval_label AS term_label_id,
       n1.name AS term_label, l.answer_label AS answer_label_id, n2.name AS answer_label,
       e.term_source AS term_source_id, s.name AS term_source,
       a.model_id AS answer_source_id, m1.name AS answer_source,
       e.model_id AS evaluator_model_id, m2.name AS evaluator_model
FROM evals e JOIN answers a ON e.answer_id = a.id
JOIN questions q ON a.question_id = q.id
JOIN models m1 ON a.model_id = m1.id JOIN models m2 ON e.model_id = m2.id
JOIN eval_source es ON e.eval_type_id = es.id JOIN term_source s ON e.term_source = s.id
JOIN alabels l ON l.answer_id = a.id AND (e.model_id = 10 OR l.evaluator_model_id = e.model_id)
JOIN eval_names n1 ON e.eval_label = n1.id JOIN eval_names n2 ON l.answer_label = n2.id
LEFT JOIN term_dict d ON e.term_id = d.tid
                     AND d.hyp = CASE WHEN e.term_source = 0 THEN 1 ELSE 0 END""",
    "evals", "answers", "questions", "alabels", "term_dict")

ORACLE["combined_terms_questions"] = with_ctes("SELECT * FROM ctq", "ctq")

ORACLE["detailed_base"] = with_ctes("SELECT * FROM detailed_base", "detailed_base")

ORACLE["detailed_union"] = with_ctes("SELECT * FROM detailed", "detailed")

ORACLE["detailed_explained"] = with_ctes("""
SELECT dd.*, td.explanation FROM detailed dd
LEFT JOIN term_dict td ON dd.term_id = td.tid
                      AND td.hyp = CASE WHEN dd.term_source_id = 0 THEN 1 ELSE 0 END""",
    "detailed", "term_dict")

ORACLE["ai_grouped"] = with_ctes("SELECT * FROM ai_grouped", "ai_grouped")

ORACLE["labelled"] = with_ctes("""
SELECT rc.answer_id, rc.term_id, rc.term_source_id, ag.eval_label AS ai_label,
       rc.eval_label AS isRelevant_label,
       CAST(CASE WHEN ag.eval_label = 1 THEN 1 WHEN ag.eval_label = 2 THEN 2
                 ELSE rc.eval_label END AS BIGINT) AS hallucination_label,
       ag.question_id, ag.isHypotheticalQuestion, ag.question, ag.answer, ag.answer_source_id,
       ag.answer_source, ag.evaluator_model_id, ag.evaluator_model, ag.count
FROM (SELECT answer_id, term_id, term_source_id, max(eval_label) AS eval_label FROM detailed
      WHERE eval_type_id = 4 GROUP BY answer_id, term_id, term_source_id) rc
LEFT JOIN ai_grouped ag ON ag.answer_id = rc.answer_id""", "ai_grouped", "detailed")


def _compat(sql: str) -> str:
    """The same view with answer labels joined on the answer only."""
    for alias in ("ae", "l"):
        sql = sql.replace(f"AND (e.model_id = 10 OR {alias}.evaluator_model_id = e.model_id)", "")
    return sql


for _name, _of in (("label_term_level_compat", "label_term_level"), ("detailed_base_compat", "detailed_base"),
                   ("detailed_compat", "detailed_union"), ("ai_grouped_compat", "ai_grouped")):
    ORACLE[_name] = _compat(ORACLE[_of])
    assert ORACLE[_name] != ORACLE[_of]

ORACLE["labelled_compat"] = _compat(with_ctes("""
SELECT rc.answer_id, rc.term_id, ag.eval_label AS ai_label, rc.eval_label AS isRelevant_label,
       CAST(CASE WHEN ag.eval_label IN (1, 2) THEN ag.eval_label ELSE rc.eval_label END AS BIGINT) AS hallucination_label,
       ag.question_id, ag.isHypotheticalQuestion, ag.question, ag.answer, ag.answer_source_id,
       ag.answer_source, ag.evaluator_model_id, ag.evaluator_model, ag.count
FROM (SELECT answer_id, term_id, max(eval_label) AS eval_label FROM detailed
      WHERE eval_type_id = 4 GROUP BY answer_id, term_id) rc
LEFT JOIN ai_grouped ag ON ag.answer_id = rc.answer_id""", "ai_grouped", "detailed"))

_LTL = ORACLE["label_term_level"].split("\nSELECT e.id AS eval_id", 1)
_LTL_BODY = "SELECT e.id AS eval_id" + _LTL[1]
_REPORT_EXTRA = [
    ("ltl", _LTL_BODY),
    ("rd0", """
SELECT answer_source, question_id, answer_id, question, answer, isHypotheticalQuestion,
       evaluator_model, eval_id, eval_type, term_label_id, term_label, term, term_id,
       IsHypotheticalTerm, term_source, reflection, answer_label_id, answer_label FROM ltl"""),
    ("rd1", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY answer_source, question_id, answer_id, question, answer, isHypotheticalQuestion,
                 evaluator_model, eval_type, term_label_id, term_label, term, term_id,
                 IsHypotheticalTerm, term_source, reflection, answer_label_id, answer_label
    ORDER BY eval_id) AS rn FROM rd0) WHERE rn = 1"""),
    ("rd", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY
    """ + ", ".join(c + " NULLS FIRST" for c in """answer_source question_id answer_id question
    answer isHypotheticalQuestion evaluator_model eval_type term_label_id term_label term term_id
    IsHypotheticalTerm term_source reflection answer_label_id answer_label""".split()) + """)
    AS rn FROM rd1) WHERE rn = 1"""),
]

ORACLE["report_detail"] = with_ctes(
    "SELECT * FROM rd", "evals", "answers", "questions", "alabels", "term_dict",
    extra=_REPORT_EXTRA)

# The first row of each question by eval id, and its evaluations in order.
_FIELDS = "question_id answer_id question answer answer_label isHypotheticalQuestion evaluator_model".split()
_EVALS = "eval_id eval_type term_label term term_id IsHypotheticalTerm term_source reflection".split()


def _json(name: str) -> str:
    """A member as the report writes it: missing ones are left out."""
    return f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\":' || to_json({name}) END"


ORACLE["nested_report"] = with_ctes(f"""
SELECT answer_source, {', '.join(_FIELDS)},
       '{{' || concat_ws(',', {', '.join(_json(c) for c in _FIELDS)}, '"evaluations":[' || evs || ']') || '}}' AS json
FROM (SELECT answer_source, question_id AS qid, unnest(min({{'eval_id': eval_id, {', '.join(f"'{c}': {c}" for c in _FIELDS)}}})),
             string_agg('{{' || concat_ws(',', {', '.join(_json(c) for c in _EVALS)}) || '}}', ',' ORDER BY eval_id) AS evs
      FROM rd GROUP BY answer_source, question_id)""",
    "evals", "answers", "questions", "alabels", "term_dict", extra=_REPORT_EXTRA)

# K7: the same documents line by line.
ORACLE["report_lines"] = with_ctes(f"""
, numbered AS (SELECT *, row_number() OVER w AS n, row_number() OVER w = count(*) OVER (PARTITION BY answer_source, question_id) AS last
  FROM rd WINDOW w AS (PARTITION BY answer_source, question_id ORDER BY {', '.join(c + ' NULLS FIRST' for c in _EVALS)}))
SELECT answer_source, question_id, 0::BIGINT AS line_no,
       '{{' || concat_ws(',', {', '.join(_json(c) for c in _FIELDS)}) || ',"evaluations":[' AS line FROM numbered WHERE n = 1
UNION ALL SELECT answer_source, question_id, n, '{{' || concat_ws(',', {', '.join(_json(c) for c in _EVALS)}) || '}}' || CASE WHEN last THEN '' ELSE ',' END FROM numbered
UNION ALL SELECT answer_source, question_id, n + 1, ']}}' FROM numbered WHERE last""",
    "evals", "answers", "questions", "alabels", "term_dict", extra=_REPORT_EXTRA)

from mirage.plans.oracle import included_sql  # noqa: E402

_LONG = """
SELECT answer_id, question_id, answer, question, 0 AS term_pos, secondary_id AS term_id,
       secondary AS term, secondary_meaning AS meaning, secondary_source AS term_source,
       false AS is_hypothetical FROM qa
UNION ALL
SELECT answer_id, question_id, answer, question, 1 AS term_pos,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement_id
            ELSE nonexistent_id END AS term_id,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement
            ELSE nonexistent END AS term,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement_meaning
            ELSE '' END AS meaning,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement_source
            ELSE '0' END AS term_source,
       NOT (replacement_type IS NULL OR replacement_type <> 0) AS is_hypothetical FROM qa"""

ORACLE["terms_long"] = with_ctes("SELECT * FROM lng", "qa", extra=[("lng", _LONG)])

_INC = f"""
SELECT answer_id,
       CAST(CASE WHEN {included_sql('answer', 'term')} THEN 0 ELSE 2 END AS BIGINT) AS eval_label,
       CAST(4 AS BIGINT) AS eval_type_id, CAST(NULL AS VARCHAR) AS reflection, term_source,
       term_id, CAST(10 AS BIGINT) AS model_id, term_pos, term FROM lng"""

ORACLE["term_inclusion"] = with_ctes("SELECT * FROM inc", "qa",
                                     extra=[("lng", _LONG), ("inc", _INC)])

ORACLE["judge_evaluations"] = with_ctes(f"""
SELECT *, CAST(NULL AS INTEGER) AS parse_step FROM inc
UNION ALL
SELECT answer_id,
       CAST(CASE WHEN (length(term) % 2 = 0) = is_hypothetical THEN 1 ELSE 0 END AS BIGINT),
       CAST(2 AS BIGINT), '{{"term": "t", "reasoning": "stub", "certainty": "' ||
         CASE WHEN length(term) % 2 = 0 THEN 'mentioned' ELSE 'unreal' END || '"}}',
       term_source, term_id, CAST(2 AS BIGINT), term_pos, term, 1
FROM lng WHERE {included_sql('answer', 'term')}
UNION ALL
SELECT answer_id, CAST(CASE WHEN coalesce(meaning, '') <> '' THEN 0 ELSE 1 END AS BIGINT),
       CAST(3 AS BIGINT), '{{"term": "t", "reasoning": "stub", "verified": ' ||
         CASE WHEN coalesce(meaning, '') <> '' THEN 'true' ELSE 'false' END || '}}',
       term_source, term_id, CAST(2 AS BIGINT), term_pos, term, 1
FROM lng WHERE {included_sql('answer', 'term')} AND NOT is_hypothetical""",
    "qa", extra=[("lng", _LONG), ("inc", _INC)])

_TRIP = [
    ("j1", """
SELECT n.id AS fake_term_id, r.id AS real_term_id, r.source_id
FROM nonexistent n JOIN topic t ON n.topic_id = t.id
JOIN links l ON l.nonexistent_id = n.id JOIN real_terms r ON l.real_id = r.id
JOIN term_source s ON r.source_id = s.id"""),
    ("f1", "SELECT *, min(real_term_id) OVER (PARTITION BY fake_term_id, source_id) AS fst FROM j1"),
    ("f2", "SELECT *, dense_rank() OVER (PARTITION BY fake_term_id ORDER BY fst) - 1 AS sr FROM f1"),
    ("f3", "SELECT *, max(sr) OVER (PARTITION BY fake_term_id) + 1 AS n FROM f2"),
    ("f4", "SELECT *, unnest(range(0, n)) AS rotation FROM f3"),
    ("f5", """
SELECT *, row_number() OVER w AS pos, lead(real_term_id, 3) OVER w AS rep,
       lead(source_id, 3) OVER w AS rep_src
FROM f4 WINDOW w AS (PARTITION BY fake_term_id, rotation
                     ORDER BY ((sr - rotation) % n + n) % n, real_term_id)"""),
]


def _trip_sql(compat: bool) -> str:
    rs = "source_id" if compat else "rep_src"
    return f"""
SELECT nonexistent_id, secondary_id, secondary_source, replacement_id, replacement_source,
       rotation, position FROM (
  SELECT *, row_number() OVER (PARTITION BY secondary_id, secondary_source, replacement_id,
                               replacement_source ORDER BY nonexistent_id, rotation, position) AS k
  FROM (SELECT CAST(fake_term_id AS BIGINT) AS nonexistent_id,
               CAST(real_term_id AS BIGINT) AS secondary_id,
               CAST(source_id AS BIGINT) AS secondary_source, CAST(rep AS BIGINT) AS replacement_id,
               CAST({rs} AS BIGINT) AS replacement_source, CAST(rotation AS INTEGER) AS rotation,
               CAST(pos - 1 AS INTEGER) AS position
        FROM f5 WHERE pos <= 3 AND rep IS NOT NULL)) WHERE k = 1"""


ORACLE["triplets"] = with_ctes(_trip_sql(True), "nonexistent", "topic", "links", "real_terms",
                               extra=_TRIP)
ORACLE["triplets_true_source"] = with_ctes(_trip_sql(False), "nonexistent", "topic", "links",
                                           "real_terms", extra=_TRIP)

_KNN = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         list_sum(list_transform(list_zip(q.embedding, e.embedding),
                  lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS dist2
  FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist2, vec_id) AS rank FROM d)
WHERE rank <= 10"""
ORACLE["knn_exact"] = _KNN
ORACLE["knn_partitioned"] = _KNN

ORACLE["vector_load_totals"] = """
SELECT count(*) AS rows, sum(length(line))::BIGINT AS chars, count(*) - count(line) AS empty, count(DISTINCT doc_id // 10000) AS partitions
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""

ORACLE["topic_runs"] = """
SELECT event_id, event_type,
       CAST(sum(CASE WHEN prev_type IS DISTINCT FROM event_type OR rn = 1 THEN 1 ELSE 0 END)
            OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS run_id
FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS prev_type,
             row_number() OVER (ORDER BY event_id) AS rn FROM events)"""

ORACLE["running_mean"] = """
SELECT event_id, seconds,
       CAST(sum(seconds) OVER w AS DOUBLE) / count(*) OVER w AS running_mean
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS seconds FROM events)
WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

ORACLE["row_ids"] = """
SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id FROM documents"""

ORACLE["second_half"] = with_ctes("""
SELECT id, question_id, model_id FROM (
  SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS pos, count(*) OVER () AS n FROM answers)
WHERE pos >= n // 2""", "answers")

ORACLE["first_answers"] = with_ctes(
    "SELECT id, question_id, model_id FROM answers ORDER BY id LIMIT 10", "answers")

from mirage.plans.oracle import WS, strip_sql  # noqa: E402

_PAGES = ("pages_w", """
SELECT CAST(doc_id AS BIGINT) AS _id,
       string_split(string_split(text, chr(10))[1], ' ')[1] AS wikipedia_title,
       string_split(text, chr(10)) AS text FROM documents""")

_DEF = """CASE WHEN text[2] IS NULL THEN 'None'
     WHEN contains(text[2], 'refer to') THEN 'ambiguous'
     WHEN contains(text[2], '::::') THEN coalesce(text[3], 'None')
     ELSE text[2] END"""

ORACLE["definitions"] = with_ctes(
    f"SELECT _id AS page_id, wikipedia_title AS title, {_DEF} AS definition FROM pages_w",
    extra=[_PAGES])


def _para_sql(strict: bool) -> str:
    cond = "NOT contains(paragraph, '::::')"
    if strict:
        cond += " AND NOT contains(paragraph, 'may refer to:') AND length(paragraph) >= 20"
    return with_ctes(f"""
SELECT _id AS id, wikipedia_title AS title, CAST(pos AS INTEGER) AS pos,
       paragraph AS text FROM (
  SELECT _id, wikipedia_title, unnest(text) AS paragraph,
         unnest(generate_series(0, len(text) - 1)) AS pos FROM pages_w)
WHERE pos >= 1 AND {cond}""", extra=[_PAGES])


ORACLE["paragraphs"] = _para_sql(True)
ORACLE["paragraphs_loose"] = _para_sql(False)

_LOOKUP = [
    _PAGES,
    ("lt", """
SELECT DISTINCT translate(lower(string_split(text, ' ')[1]), 'àâäáãçéèêëíìîïñóòôöõúùûü',
                          'aaaaaceeeeiiiinooooouuuu') AS term
FROM conversations WHERE role = 'user'"""),
    ("best", f"""
SELECT strip_accents(lower(wikipedia_title)) AS k, arg_min(_id, _id) AS page_id,
       arg_min({_DEF}, _id) AS definition
FROM pages_w GROUP BY strip_accents(lower(wikipedia_title))"""),
    ("lk", """
SELECT lt.term, b.page_id, coalesce(b.definition, 'None') AS definition
FROM lt LEFT JOIN best b ON strip_accents(lower(lt.term)) = b.k"""),
]
ORACLE["term_lookup_ci_ai"] = with_ctes("SELECT * FROM lk", extra=_LOOKUP)
ORACLE["lookup_outcomes"] = with_ctes("""
SELECT CASE WHEN definition = 'None' THEN 'nonwiki' WHEN definition = 'ambiguous' THEN 'ambiguous'
            ELSE 'wiki' END AS outcome, count(*) AS terms FROM lk GROUP BY 1""", extra=_LOOKUP)

_UPS = [
    ("tc", """
SELECT n.id AS fake_term_id, r.term, r.explanation, r.source_id, r.id AS position
FROM nonexistent n JOIN topic t ON n.topic_id = t.id
JOIN links l ON l.nonexistent_id = n.id JOIN real_terms r ON l.real_id = r.id
JOIN term_source s ON r.source_id = s.id"""),
    ("win", """
SELECT * FROM (SELECT *, strip_accents(lower(term)) AS k, row_number() OVER (
    PARTITION BY strip_accents(lower(term))
    ORDER BY source_id, fake_term_id, position, term, explanation) AS rn FROM tc) WHERE rn = 1"""),
]
_UPS_IDS = [*_UPS, ("ids", """
SELECT *, CAST(row_number() OVER (ORDER BY source_id, fake_term_id, position, term) AS BIGINT) AS id FROM win""")]
ORACLE["upsert_terms"] = with_ctes(
    "SELECT id, term, explanation, CAST(source_id AS BIGINT) AS source_id FROM ids",
    "nonexistent", "topic", "links", "real_terms", extra=_UPS_IDS)
ORACLE["upsert_links"] = with_ctes("""
SELECT DISTINCT CAST(tc.fake_term_id AS BIGINT) AS nonexistent_id, w.id AS real_id
FROM tc JOIN ids w ON strip_accents(lower(tc.term)) = w.k""",
    "nonexistent", "topic", "links", "real_terms", extra=_UPS_IDS)

# Stored terms: every tenth part, by its own id; U4 rows from three places.
_UPS_OLD = [
    ("old", "SELECT id, term, explanation, source_id FROM real_terms WHERE id IN "
            "(SELECT min(id) FROM real_terms WHERE id % 10 = 0 GROUP BY strip_accents(lower(term)))"),
    ("u4", """
SELECT 1 AS source_id, fake_term_id, term, explanation, position FROM tc WHERE source_id = 1
UNION ALL SELECT 2, fake_term_id, term || ' ' || CAST(position % 5 AS VARCHAR), explanation, position FROM tc WHERE source_id = 2
UNION ALL SELECT 3, fake_term_id, upper(term), explanation, position FROM tc WHERE source_id = 3"""),
    ("fresh", """
SELECT * FROM (SELECT *, strip_accents(lower(term)) AS k, row_number() OVER (
    PARTITION BY strip_accents(lower(term)) ORDER BY source_id, fake_term_id, position, term, explanation) AS rn FROM u4)
WHERE rn = 1 AND k NOT IN (SELECT strip_accents(lower(term)) FROM old)"""),
    ("merged", """
SELECT id, term, explanation, source_id FROM old
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY source_id, fake_term_id, position, term), term, explanation, source_id FROM fresh"""),
]
ORACLE["upsert_existing"] = with_ctes(
    "SELECT CAST(id AS BIGINT) AS id, term, explanation, CAST(source_id AS BIGINT) AS source_id FROM merged",
    "nonexistent", "topic", "links", "real_terms", extra=[_UPS[0], *_UPS_OLD])

_TOPICS = ("tp", "SELECT id AS pos, name || ':' || explanation AS topic FROM topic")
ORACLE["topic_containing"] = with_ctes("""
SELECT s.s_suppkey AS supplier, n.n_name AS title,
       (SELECT min(pos) FROM tp WHERE contains(tp.topic, n.n_name)) AS topic_pos,
       (SELECT arg_min(topic, pos) FROM tp WHERE contains(tp.topic, n.n_name)) AS topic
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""", "topic", extra=[_TOPICS])

_CAND = ("cl", """
SELECT CAST(s_suppkey AS BIGINT) AS supplier, CAST(s_nationkey AS BIGINT) AS pos,
       s_name || ': first of nation ' || CAST(s_nationkey AS VARCHAR) || '/n/n/n' || s_name ||
       ' bis: second/n/n/nbroken item' AS candidates FROM supplier""")
_CX = ("cx", """
SELECT supplier, pos, unnest(string_split(candidates, '/n/n/n')) AS c,
       unnest(generate_series(0, len(string_split(candidates, '/n/n/n')) - 1)) AS cand_pos FROM cl""")
ORACLE["candidate_terms"] = with_ctes("""
SELECT cx.pos, cx.supplier, CAST(cx.cand_pos AS INTEGER) AS cand_pos,
       string_split(c, ':')[1] AS term, string_split(c, ':')[2] AS explanation,
       string_split(tp.topic, ':')[1] AS topic_name, string_split(tp.topic, ':')[2] AS topic_explanation
FROM cx JOIN tp ON cx.pos = tp.pos - 1 + 1
WHERE len(string_split(c, ':')) = 2""", "topic", extra=[_TOPICS, _CL := _CAND, _CX])
ORACLE["candidate_rejects"] = with_ctes("""
SELECT CAST(cand_pos AS INTEGER) AS cand_pos, count(*) AS rejected FROM cx
WHERE len(string_split(c, ':')) <> 2 GROUP BY cand_pos""", extra=[_CAND, _CX])

_STRIP = strip_sql("x")
ORACLE["suggested_terms"] = f"""
WITH s AS (
  SELECT CAST(p_partkey AS BIGINT) AS part,
         replace(CASE WHEN p_size % 2 = 0
              THEN '[''' || p_name || ''', ''' || p_type || '... ''' || p_brand || ''']'
              ELSE '1. ' || p_name || chr(10) || '2. ' || p_brand END, '... ', ''' ') AS r
  FROM part),
l AS (
  SELECT part, CASE WHEN contains(r, ',')
    THEN list_transform(string_split(substr(r, 2, greatest(length(r) - 2, 0)), ','),
           lambda x: substr({strip_sql('x')}, 2, greatest(length({strip_sql('x')}) - 2, 0)))
    ELSE list_transform(string_split(r, chr(10)),
           lambda x: {strip_sql("regexp_replace(x, '[0-9.]', '', 'g')")}) END AS terms FROM s)
SELECT part, CAST(pos AS INTEGER) AS pos, term FROM (
  SELECT part, unnest(terms) AS term, unnest(generate_series(0, len(terms) - 1)) AS pos FROM l)"""

ORACLE["phrase_exists"] = """
WITH t AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 3, 6), ' ') AS term
           FROM benchmark),
h AS (SELECT t.term, count(d.doc_id) AS hits FROM t LEFT JOIN documents d
        ON contains(lower(d.text), lower(t.term)) GROUP BY t.term)
SELECT term, CAST(hits AS BIGINT) AS hits, hits > 0 AS "exists" FROM h"""

ORACLE["unanswered"] = with_ctes("""
SELECT * FROM questions q WHERE NOT EXISTS (
  SELECT 1 FROM answers a WHERE a.model_id = 1 AND a.question_id = q.id)""", "questions", "answers")

ORACLE["sampled"] = with_ctes("""
SELECT * FROM label_answer_level WHERE question_id IN (
  SELECT doc_id FROM labels WHERE quality = 1)""", "label_answer_level")

_WORK = ("work", """
SELECT answer_id, secondary_id AS term_id, CAST(secondary_source AS VARCHAR) AS term_source,
       0 AS term_pos, answer, secondary AS term FROM cta
UNION ALL
SELECT answer_id,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement_id ELSE nonexistent_id END,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0
            THEN CAST(replacement_source AS VARCHAR) ELSE '0' END,
       1, answer,
       CASE WHEN replacement_type IS NULL OR replacement_type <> 0 THEN replacement ELSE nonexistent END
FROM cta""")

ORACLE["not_yet_evaluated"] = with_ctes("""
SELECT w.answer_id, w.term_id, w.term_source, w.term_pos, CAST(k.kind AS INTEGER) AS eval_type_id,
       CAST(2 AS BIGINT) AS model_id
FROM work w CROSS JOIN (VALUES (2), (3)) AS k(kind)
WHERE NOT EXISTS (SELECT 1 FROM evals e WHERE e.model_id = 2 AND e.answer_id = w.answer_id
                  AND CAST(e.term_source AS VARCHAR) = w.term_source AND e.term_id = w.term_id
                  AND e.eval_type_id = k.kind)""", "cta", "evals", extra=[_WORK])

_REC = ("rec", f"""
SELECT w.answer_id, CAST(w.term_source AS BIGINT) AS term_source, w.term_id,
       CAST(CASE WHEN {included_sql('w.answer', 'w.term')} THEN 0 ELSE 2 END AS BIGINT) AS new_label,
       o.eval_id, o.old_label,
       CASE WHEN o.eval_id IS NULL THEN 'missing'
            WHEN o.old_label <> CASE WHEN {included_sql('w.answer', 'w.term')} THEN 0 ELSE 2 END
            THEN 'changed' ELSE 'same' END AS status
FROM work w LEFT JOIN (
  SELECT answer_id, term_source, term_id, min(id) AS eval_id, min(eval_label) AS old_label
  FROM evals WHERE eval_type_id = 4 GROUP BY answer_id, term_source, term_id) o
ON o.answer_id = w.answer_id AND o.term_source = CAST(w.term_source AS BIGINT)
   AND o.term_id = w.term_id""")

ORACLE["reconcile"] = with_ctes("SELECT * FROM rec", "cta", "evals", extra=[_WORK, _REC])
ORACLE["reconcile_counts"] = with_ctes(
    "SELECT status, count(*) AS n FROM rec GROUP BY status", "cta", "evals", extra=[_WORK, _REC])

ORACLE["model_ids"] = with_ctes("""
SELECT n.name, CAST(m.id AS BIGINT) AS id FROM n JOIN models m ON n.name = m.name
UNION ALL
SELECT name, CAST((SELECT max(id) FROM models) + row_number() OVER (ORDER BY name) AS BIGINT)
FROM n WHERE name NOT IN (SELECT name FROM models)""", "answers", extra=[("n", """
SELECT DISTINCT c_mktsegment AS name FROM customer
UNION SELECT m.name FROM answers a JOIN models m ON a.model_id = m.id""")])

ORACLE["run_counts"] = with_ctes("""
SELECT model_id, count(*) AS evaluations, count(DISTINCT answer_id) AS answers
FROM dedup_evals GROUP BY model_id""", "dedup_evals")

_IM_S, _IM_E = "<|im_start|>", "<|im_end|>"
ORACLE["chat_render"] = f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i
  FROM conversations WHERE role IN ('user', 'assistant')),
c AS (
  SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS nu,
         count(*) FILTER (WHERE role = 'assistant') AS na,
         arg_min(text, turn) FILTER (WHERE role = 'system') AS sys
  FROM conversations GROUP BY conv_id),
b AS (
  SELECT c.conv_id, 0 AS k1, 0 AS k2,
         '{_IM_S}system' || chr(10) || coalesce(sys, 'You are a careful assistant.') || '{_IM_E}' || chr(10) AS blk
  FROM c
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN role = 'user' THEN 0 ELSE 1 END,
         '{_IM_S}' || role || chr(10) || text || '{_IM_E}' || chr(10)
  FROM t JOIN c ON t.conv_id = c.conv_id WHERE t.i <= least(c.nu, c.na)
  UNION ALL
  SELECT t.conv_id, least(c.nu, c.na) + 1, 0, '{_IM_S}user' || chr(10) || text || '{_IM_E}' || chr(10)
  FROM t JOIN c ON t.conv_id = c.conv_id WHERE t.role = 'user' AND t.i = c.nu AND c.nu > c.na
  UNION ALL
  SELECT conv_id, 4611686018427387904, 0, '{_IM_S}assistant' || chr(10) FROM c)
SELECT conv_id, string_agg(blk, '' ORDER BY k1, k2) AS prompt FROM b GROUP BY conv_id"""

ORACLE["model_short_name"] = with_ctes("""
SELECT m.id AS model_id, m.name,
       replace(replace(replace(replace(replace(replace(replace(m.name, '-chat-q4_K_M', ''),
         '-chat-q4_1', ''), '-q4_1', ''), '_August_3_2023', ''), '-1106-preview', ''), '-turbo', ''),
         ':', '_') AS short_name, count(*) AS answers
FROM answers a JOIN models m ON a.model_id = m.id GROUP BY m.id, m.name""", "answers")

ORACLE["answers_stub"] = with_ctes("""
SELECT q.id AS question_id, CAST(1 AS BIGINT) AS model_id, 'I do not know ' || q.question AS answer
FROM questions q WHERE NOT EXISTS (
  SELECT 1 FROM answers a WHERE a.model_id = 1 AND a.question_id = q.id)""", "questions", "answers")


def _pat(t: str) -> str:
    alt = f"trim(regexp_replace({t}, '\\([^()]*\\)', '', 'g'))"
    return (f"CASE WHEN {alt} = '' THEN '(?i)' || regexp_escape({t}) "
            f"ELSE '(?i)' || regexp_escape({t}) || '|' || regexp_escape({alt}) END")


_TTC = ORACLE["triplets_combined"].split("\nSELECT tt.id AS term_triplet_id", 1)
ORACLE["generated_questions"] = with_ctes(f"""
SELECT triplet_id, CAST(replacement_type AS BIGINT) AS replacement_type, question FROM (
  SELECT term_triplet_id AS triplet_id, 0 AS replacement_type, q0 AS question FROM g WHERE ok
  UNION ALL
  SELECT term_triplet_id, 1, regexp_replace(q0, {_pat('nonexistent_term')},
         replace(replace(replacement_term, '\\', '\\\\'), '$', '\\$'), 'g') FROM g WHERE ok
  UNION ALL
  SELECT term_triplet_id, 3, 'How does ' || replacement_term || ' relate to ' || secondary_term || '?'
  FROM g WHERE ok)""", "triplets", "nonexistent", "topic", "real_terms", extra=[
    ("ttc", "SELECT tt.id AS term_triplet_id" + _TTC[1]),
    ("g0", "SELECT *, 'How does ' || nonexistent_term || ' relate to ' || secondary_term || '?' AS q0 "
           "FROM ttc"),
    ("g", f"SELECT *, (q0 = 'test content' OR regexp_matches(q0, {_pat('nonexistent_term')})) AS ok "
          "FROM g0")])


ORACLE["answer_labels_file_mode"] = with_ctes("""
SELECT e.id, e.answer_id, e.eval_label AS eval_label_id, e.eval_type_id, e.reflection,
       e.term_source, e.term_id, e.model_id, l.answer_label_id, n.name AS answer_label
FROM evals e LEFT JOIN lab l ON e.answer_id = l.answer_id
LEFT JOIN eval_names n ON l.answer_label_id = n.id""", "evals", extra=[
    ("mm", "SELECT min(model_id) AS m FROM evals"),
    ("lab", """
  SELECT e.answer_id,
         CAST(CASE max(CASE e.eval_label WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END)
              WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS answer_label_id
  FROM evals e, mm
  WHERE (e.model_id = mm.m OR e.model_id = 10)
    AND e.answer_id IN (SELECT answer_id FROM evals, mm WHERE model_id = mm.m)
  GROUP BY e.answer_id""")])

ORACLE["judges"] = with_ctes("SELECT DISTINCT model_id FROM evals", "evals")

ORACLE["madeup_candidates"] = """
WITH t AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 3, 6), ' ') AS term
           FROM benchmark),
h AS (SELECT t.term, count(d.doc_id) AS hits FROM t LEFT JOIN documents d
        ON contains(lower(d.text), lower(t.term)) GROUP BY t.term)
SELECT term, CAST(hits AS BIGINT) AS hits, hits > 0 AS "exists" FROM h WHERE hits = 0"""

ORACLE["score_one_pair"] = with_ctes(
    "SELECT evaluator_model, answer_source, hypothetical_questions AS score FROM dist "
    "WHERE answer_label = 'valid'", "label_answer_level", extra=[
        ("lal1", "SELECT * FROM label_answer_level WHERE evaluator_model IN "
                 "('gpt-3.5-turbo', 'function') AND answer_source = 'llama2:7b-chat-q4_1'")]
    + [(k, v.replace("FROM label_answer_level", "FROM lal1")) for k, v in _DIST_EXTRA])


# -- short answers, reuse, revised rows, replies -----------------------------------
ORACLE["short_answers"] = with_ctes("""
SELECT row_number() OVER (ORDER BY answer_id) - 1 AS answer_id, question_id, question, answer, replacement_type,
       CASE WHEN replacement_type = 0 THEN nonexistent_id ELSE 0 END AS nonexistent_id,
       CASE WHEN replacement_type = 0 THEN nonexistent ELSE '' END AS nonexistent,
       CASE WHEN replacement_type = 0 THEN NULL ELSE '' END AS nonexistent_meaning,
       CASE WHEN replacement_type = 0 THEN 0 ELSE replacement_id END AS replacement_id,
       CASE WHEN replacement_type = 0 THEN '' ELSE replacement END AS replacement,
       CASE WHEN replacement_type = 0 THEN '' ELSE replacement_meaning END AS replacement_meaning,
       CASE WHEN replacement_type = 0 THEN '' ELSE 'gpt_suggestion' END AS replacement_source,
       secondary_id, secondary, secondary_meaning, 'gpt_suggestion' AS secondary_source
FROM cta""", "cta")

ORACLE["question_reuse"] = with_ctes(f"""
SELECT triplet_id, CAST(replacement_type AS BIGINT) AS replacement_type, question FROM (
  SELECT term_triplet_id AS triplet_id, 0 AS replacement_type, q0 AS question FROM g WHERE ok
  UNION ALL
  SELECT term_triplet_id, 1, regexp_replace(q0, {_pat('nonexistent_term')},
         replace(replacement_term, '\\', '\\\\'), 'g') FROM g WHERE ok
  UNION ALL
  SELECT term_triplet_id, 3, coalesce(
    (SELECT 'Stored: ' || min(o.replacement_term) FROM old o WHERE o.replacement_id = g.replacement_id
       AND o.replacement_source_id = g.replacement_source_id AND o.secondary_id = g.secondary_id
       AND o.secondary_source_id = g.secondary_source_id),
    'How does ' || replacement_term || ' relate to ' || secondary_term || '?') FROM g WHERE ok)""",
    "triplets", "nonexistent", "topic", "real_terms", extra=[
        ("ttc", "SELECT tt.id AS term_triplet_id" + _TTC[1]),
        ("old", "SELECT * FROM ttc WHERE term_triplet_id % 3 = 0"),
        ("stored0", "SELECT nonexistent_id, secondary_id, secondary_source_id, min(CASE WHEN term_triplet_id % 9 = 0 "
                    "THEN 'Nothing of it.' ELSE 'Is ' || nonexistent_term || ' a ' || secondary_term || '?' END) AS q "
                    "FROM old GROUP BY ALL"),
        ("g0", "SELECT t.*, CASE WHEN s.q LIKE 'Is %' THEN s.q ELSE 'How does ' || nonexistent_term || ' relate to ' "
               "|| secondary_term || '?' END AS q0 FROM ttc t LEFT JOIN stored0 s USING (nonexistent_id, secondary_id, secondary_source_id)"),
        ("g", f"SELECT *, regexp_matches(q0, {_pat('nonexistent_term')}) AS ok FROM g0")])

ORACLE["question_checks"] = with_ctes("""
SELECT term_triplet_id, question, k < 3 AS valid, true AS secondary_present,
       CASE WHEN k < 3 THEN 'Is $1 \\ ' || replacement_term || ' like ' || secondary_term || '?' ELSE question END AS swapped
FROM (SELECT *, term_triplet_id % 4 AS k, 'Is ' || CASE term_triplet_id % 4
        WHEN 0 THEN nonexistent_term || ' (a+b$) [' || term_triplet_id || ']'
        WHEN 1 THEN upper(nonexistent_term || ' (a+b$) [' || term_triplet_id || ']')
        WHEN 2 THEN nonexistent_term || '  [' || term_triplet_id || ']' ELSE 'nothing' END
        || ' like ' || secondary_term || '?' AS question FROM ttc)""",
    "triplets", "nonexistent", "topic", "real_terms", extra=[("ttc", "SELECT tt.id AS term_triplet_id" + _TTC[1])])

ORACLE["revised"] = with_ctes("""
SELECT e.id, e.answer_id, CASE WHEN e.eval_type_id = 4 AND r.status = 'changed' THEN r.new_label ELSE e.eval_label END AS eval_label,
       e.eval_type_id, e.reflection, e.term_source, e.term_id, e.model_id
FROM evals e LEFT JOIN once r ON r.answer_id = e.answer_id AND r.term_source = e.term_source AND r.term_id = e.term_id
UNION ALL
SELECT (SELECT max(id) FROM evals) + row_number() OVER (ORDER BY answer_id, term_source, term_id), answer_id, new_label,
       4, '', term_source, term_id, 10 FROM once WHERE status = 'missing'""", "cta", "evals", extra=[
    _WORK, _REC, ("once", "SELECT answer_id, term_source, term_id, min(new_label) AS new_label, min(status) AS status FROM rec GROUP BY ALL")])

# What each shape of reply holds, by the rules of F18-F20.
_REPLIES = [("rp", """
SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber % 4 AS term_source, l_linenumber AS ln, l_linestatus AS ls,
       CASE l_returnflag WHEN 'A' THEN 'mentioned' WHEN 'N' THEN 'unknown' ELSE 'unreal' END AS cert FROM lineitem"""),
    ("rr", """
SELECT *, CASE WHEN ln = 6 THEN 3 ELSE 2 END AS kind,
       CASE ln WHEN 1 THEN '{"term": "x", "reasoning": "ok", "certainty": "' || cert || '"}'
               WHEN 2 THEN 'Sure: {"certainty": "' || upper(cert) || '"} done'
               WHEN 3 THEN 'Sure: {"Certainty": "' || cert || '"} done'
               WHEN 4 THEN '{"certainty": 12}' WHEN 5 THEN 'I cannot say'
               WHEN 6 THEN '{"term": "a", "verified": ' || CASE WHEN ls = 'O' THEN 'false' ELSE 'true' END || '}'
               ELSE '{"term": "x" "certainty": "' || cert || '"}' END AS reply,
       CASE WHEN ln IN (1, 4, 6) THEN 1 WHEN ln IN (2, 3) THEN 2 WHEN ln = 5 THEN 0 ELSE 5 END AS parse_step,
       ln IN (3, 4, 5) AS failed FROM rp""")]
# Line 7 lacks a comma between its members, which the mend puts in.
_REPLY_LABEL = """CASE WHEN ln = 6 THEN CASE WHEN ls = 'O' THEN 1 ELSE 0 END WHEN failed THEN 0
  WHEN cert = 'unknown' THEN CASE WHEN term_source = 0 THEN 0 ELSE 2 END
  WHEN (cert = 'mentioned') = (term_source = 0) THEN 1 ELSE 0 END"""
ORACLE["judge_reply_labels"] = with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, CAST(kind AS BIGINT) AS kind, CAST(term_source AS BIGINT) AS term_source,
       CAST({_REPLY_LABEL} AS BIGINT) AS eval_label,
       CASE WHEN failed THEN 'WARNING: Failed to parse response: ' ELSE '' END || reply AS reflection,
       CAST(parse_step AS INTEGER) AS parse_step FROM rr""", extra=_REPLIES)
ORACLE["reply_failure_rate"] = with_ctes("""
SELECT CAST(kind AS BIGINT) AS kind, CAST(parse_step AS INTEGER) AS parse_step, count(*) AS n FROM rr GROUP BY ALL""", extra=_REPLIES)

ORACLE["triplets_excluding"] = with_ctes(_trip_sql(True), "nonexistent", "topic", "links", "real_terms", extra=[
    (k, v + (" WHERE n.id NOT IN (1, 2, 3)" if k == "j1" else "")) for k, v in _TRIP])
ORACLE["short_groups"] = with_ctes(
    "SELECT fake_term_id, count(*) AS real_terms FROM tc GROUP BY 1 HAVING count(*) < 600",
    "nonexistent", "topic", "links", "real_terms", extra=[_UPS[0]])
ORACLE["term_phrases"] = with_ctes(
    "SELECT id, term || ': ' || explanation AS labelled, '\"' || replace(term, '\"', '') || '\"' AS phrase FROM real_terms", "real_terms")
# A list without a comma: lines without digits and dots, stripped.
ORACLE["related_terms"] = with_ctes("""
SELECT id, 0 AS pos, trim(regexp_replace(term, '[0-9.]', '', 'g') || ' kin') AS term FROM nonexistent
UNION ALL SELECT id, 1, 'other {x}' FROM nonexistent""", "nonexistent")
ORACLE["answers_from_offset"] = with_ctes(
    "SELECT id, question_id, model_id FROM answers ORDER BY id OFFSET 100", "answers")
