"""DuckDB SQL of the queries that SQL can express over whole tables.

The others - a fitted model, tokenizers, windows and similarity over all
texts, graph search - are tested against plain versions in ``tests/llm``.
"""

from __future__ import annotations

from mirage.llm import queries
from mirage.llm.common import SPACES
from mirage.llm.lexical import TOP
from mirage.llm.licenses import COPYRIGHT, EQUIVALENT, KNOWN, MARKS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted('©|[(]c[)]')}, ' c ', 'g')"
    out = f"regexp_replace({out}, {_quoted(MARKS)}, ' ', 'g')"
    for a, b in EQUIVALENT:
        out = f"regexp_replace({out}, {_quoted(chr(92) + 'b' + a + chr(92) + 'b')}, {_quoted(b)}, 'g')"
    return f"[trim(x) for x in string_split({out}, chr(10)) if trim(x) <> '' and not regexp_matches(trim(x), {_quoted(COPYRIGHT)})]"


def _licenses() -> str:
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    return f"""
WITH k AS (SELECT license_id, {_canonical('text')} AS lines FROM (VALUES {known}) AS v(license_id, text)),
known AS (SELECT sha256(array_to_string(lines, ' ')) AS digest, min(license_id) AS license_id
          FROM (SELECT license_id, lines FROM k UNION ALL SELECT license_id, lines[2:] FROM k) WHERE len(lines) > 0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical("coalesce(text, '')")} AS lines FROM documents),
notice AS (SELECT r, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices, count(*) AS n_notices
           FROM (SELECT r, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS text_digest, license_id,
       coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN notice USING (r)
LEFT JOIN known ON len(lines) > 0 AND known.digest = sha256(array_to_string(lines, ' '))"""


def _mixing() -> str:
    number = "regexp_extract(source, '([0-9]+)$', 1)"
    domains = "[" + ", ".join(_quoted(x) for x in queries.DOMAINS) + "]"

    def level(name: str, above: str, parents: list[str], own: str) -> str:
        # Children in order of capacity per weight; the first that its share does
        # not fill settles the water level of all after it.
        same = " || '/' || ".join(f"c.{p}" for p in parents) or "''"
        on = " AND ".join(f"c.{p} = p.{p}" for p in parents) or "true"
        cols = ", ".join([*parents, own])
        weight = " ".join(f"WHEN c.{own} = {_quoted(k)} THEN {v}" for k, v in queries.WEIGHTS[own].items())
        return f"""
{name}_o AS (SELECT {', '.join('c.' + x for x in [*parents, own])}, c.capacity, c.weight, p.budget AS above, {same} AS same,
    row_number() OVER (PARTITION BY {same} ORDER BY c.capacity / c.weight, c.capacity, c.{own}) AS k
  FROM (SELECT *, CASE {weight} ELSE 1 END AS weight FROM (SELECT {cols}, sum(2 * tokens)::HUGEINT AS capacity FROM leaves GROUP BY ALL) c) c
  JOIN {above} p ON {on}),
{name}_s AS (SELECT a.*, (SELECT coalesce(sum(b.capacity), 0) FROM {name}_o b WHERE b.same = a.same AND b.k < a.k) AS spent,
    (SELECT sum(b.weight) FROM {name}_o b WHERE b.same = a.same AND b.k >= a.k) AS rest FROM {name}_o a),
{name}_f AS (SELECT same, min(k) AS k FROM {name}_s WHERE weight * greatest(above - spent, 0) < capacity * rest GROUP BY same),
{name} AS (SELECT {', '.join('s.' + x for x in [*parents, own])},
    CASE WHEN f.k IS NULL OR s.k < f.k THEN least(s.capacity, greatest(s.above - s.spent, 0))
         ELSE least(s.capacity, s.weight * greatest(s.above - e.spent, 0) // e.rest) END AS budget
  FROM {name}_s s LEFT JOIN {name}_f f ON f.same = s.same LEFT JOIN {name}_s e ON e.same = f.same AND e.k = f.k)"""

    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN coalesce({number}, '') = '' THEN '' ELSE {domains}[CAST({number} AS BIGINT) % {len(queries.DOMAINS)} + 1] END AS domain,
    len([x for x in regexp_split_to_array(coalesce(text, ''), {_quoted(SPACES)}) if x <> '']) AS n_tokens FROM documents),
n AS (SELECT * FROM w WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM n GROUP BY ALL),
root AS (SELECT sum(tokens)::HUGEINT * 800 // 1000 AS budget FROM leaves),
{level('b1', 'root', [], 'domain')}, {level('b2', 'b1', ['domain'], 'lang')}, {level('b3', 'b2', ['domain', 'lang'], 'source')},
copies AS (SELECT n.*, epoch, md5('0:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM n, (VALUES (0), (1)) AS e(epoch)),
ends AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, key) AS upto FROM copies)
SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, budget - (upto - n_tokens))::BIGINT AS take_tokens
FROM ends JOIN b3 USING (domain, lang, source) WHERE upto - n_tokens < budget"""


def _chat() -> str:
    extra = ", ".join(f"({i}, {t}, {_quoted(r)}, {_quoted(x)})" for i, t, r, x in queries.EXTRA_CHAT)

    def escaped(x: str) -> str:
        return f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"

    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) AS v(conv_id, turn, role, text))),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(replace({escaped('role')}, chr(10), '\\n')) + 1 + length({escaped('text')}) + length('<|im_end|>') + 1) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g"""


def _exact() -> str:
    return f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_quoted(SPACES)}, ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""


def _lexical() -> str:
    def terms(table: str, cols: str) -> str:
        folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        found = f"regexp_extract_all({folded}, {_quoted('[^' + chr(92) + 'x00-/:-@[-`{-' + chr(92) + 'x7F]+')})"
        return f"SELECT {cols}, {found} AS ts FROM {table}"

    return f"""
WITH d AS ({terms('documents', 'row_number() OVER () AS r, doc_id')}),
i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(ts) AS term FROM
      ({terms('(SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)', 'item_id')})) GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 75 + ((25 * len(ts)::BIGINT * n_docs) // n_terms) AS m FROM d, totals WHERE len(ts) > 0),
s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
               FROM s WHERE score > 0) WHERE rank <= {TOP}"""


ORACLE: dict[str, str] = {
    "op1_license_scan": _licenses(),
    "op3_source_mixing": _mixing(),
    "op5_chat_formatting": _chat(),
    "op7_exact_dedup": _exact(),
    "op11_lexical_search": _lexical(),
}
