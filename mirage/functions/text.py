"""Text functions as native Column expressions.

All of them compile to JVM expressions inside whole-stage codegen; none
needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirage.schemas import FAILURE_SENTINELS, MODEL_NAME_TAGS

# Characters Python's str.split()/str.strip() treat as whitespace.
WS_CLASS = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# ASCII punctuation (the 32 characters of Python's string.punctuation).
PUNCT_CLASS = r"\p{Punct}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(x), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def squash_ws(x) -> Column:
    """Python ``" ".join(s.split())``."""
    return F.trim(F.regexp_replace(_c(x), f"{WS_CLASS}+", " "))


def clean_text(x) -> Column:
    """drop ``(…)``, lower-case, ``-`` → space, drop ``"``, drop every
    ``the`` then every ``this`` (also inside words), drop ASCII punctuation,
    collapse whitespace."""
    t = F.lower(py_strip(F.regexp_replace(_c(x), r"\([^)]*\)", "")))
    t = F.replace(t, F.lit("-"), F.lit(" "))
    for s in ('"', "the", "this"):
        t = F.replace(t, F.lit(s), F.lit(""))
    t = F.regexp_replace(t, PUNCT_CLASS, "")
    return squash_ws(t)


def term_included(text, term) -> Column:
    """lower-case containment, else containment after F1 on both."""
    t, s = _c(text), _c(term)
    return F.contains(F.lower(t), F.lower(s)) | F.contains(clean_text(t), clean_text(s))


def simple_included(text, term) -> Column:
    """plain lower-case containment (used before the judge kinds)."""
    return F.contains(F.lower(_c(text)), F.lower(_c(term)))


def inclusion_label(text, term) -> Column:
    """0 (valid) when the term is used, else 2 (irrelevant)."""
    return F.when(term_included(text, term), F.lit(0)).otherwise(F.lit(2)).cast("long")


def strip_parenthesised(x) -> Column:
    """F8: remove innermost ``(…)`` groups and surrounding whitespace."""
    return py_strip(F.regexp_replace(_c(x), r"\([^()]*\)", ""))


def _quote(x: Column) -> Column:
    """A regex literal for ``x`` (``\\Q…\\E`` with embedded ``\\E`` split)."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def term_pattern(term, compat: bool = False) -> Column:
    """case-insensitive pattern matching the term or the term without its
    parenthesised part. An empty second alternative would match everywhere;
    it is dropped unless ``compat``."""
    t = _c(term)
    alt = strip_parenthesised(t)
    both = F.concat(F.lit("(?iu)"), _quote(t), F.lit("|"), _quote(alt))
    if compat:
        return both
    return F.when(alt == "", F.concat(F.lit("(?iu)"), _quote(t))).otherwise(both)


def regex_replacement_literal(x) -> Column:
    """Escape ``\\`` and ``$`` so a replacement is inserted literally."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\\", r"\\\\"), r"\$", r"\\\$")


def swap_term(question, term, replacement, compat: bool = False) -> Column:
    """replace every occurrence of the term (or its short form) by the
    replacement."""
    return F.regexp_replace(_c(question), term_pattern(term, compat),
                            regex_replacement_literal(replacement))


def question_checks(question, main_term, secondary_term, replacement_type) -> tuple[Column, Column]:
    """(valid, secondary_present). A question is invalid only when it is
    of type 0 and the main term is absent; ``test content`` always passes."""
    q = _c(question)
    test = q == F.lit("test content")
    main_ok = F.regexp_like(q, term_pattern(main_term))
    sec_ok = F.regexp_like(q, term_pattern(secondary_term))
    valid = test | main_ok | (_c(replacement_type) != 0)
    return valid, test | sec_ok


def parse_term_list(x) -> Column:
    """a suggested-term list as an array. ``... `` becomes ``' ``; with a
    comma the outer characters are cut, items split on ``,``, stripped and
    unquoted (first and last character cut); otherwise split on newlines,
    digits and dots removed, stripped."""
    s = F.replace(_c(x), F.lit("... "), F.lit("' "))
    inner = F.substring(s, 2, F.greatest(F.length(s) - 2, F.lit(0)))
    comma = F.transform(F.split(inner, ",", -1),
                        lambda t: F.substring(py_strip(t), 2,
                                              F.greatest(F.length(py_strip(t)) - 2, F.lit(0))))
    lines = F.transform(F.split(s, "\n", -1),
                        lambda t: py_strip(F.regexp_replace(t, "[0-9.]", "")))
    return F.when(F.contains(s, F.lit(",")), comma).otherwise(lines)


def split_topic(x) -> tuple[Column, Column]:
    """name and explanation at the first two ``:``-separated parts
    (text after a second colon is lost; the leading space is kept)."""
    parts = F.split(_c(x), ":", -1)
    return F.get(parts, 0), F.get(parts, 1)


def split_candidates(x) -> Column:
    """the literal ``/n/n/n`` separates candidates in one reply."""
    return F.split(_c(x), "/n/n/n", -1)


def definition_from_paragraphs(text_array) -> Column:
    """paragraph 1; containing ``refer to`` → ``ambiguous``; containing
    ``::::`` → paragraph 2; anything missing → the string ``None``."""
    a = _c(text_array)
    p1, p2 = F.get(a, 1), F.get(a, 2)
    out = (F.when(p1.isNull(), F.lit("None"))
            .when(F.contains(p1, F.lit("refer to")), F.lit("ambiguous"))
            .when(F.contains(p1, F.lit("::::")), F.coalesce(p2, F.lit("None")))
            .otherwise(p1))
    return F.when(a.isNull(), F.lit("None")).otherwise(out)


def paragraph_kept(p, strict: bool = True) -> Column:
    """paragraphs indexed from 1 are embedded unless they hold
    ``::::``; the strict variant also drops ``may refer to:`` and texts under
    20 characters."""
    p = _c(p)
    keep = ~F.contains(p, F.lit("::::"))
    if strict:
        keep = keep & ~F.contains(p, F.lit("may refer to:")) & (F.length(p) >= 20)
    return keep


def cut(x, n: int) -> Column:
    """F16: the first ``n`` characters."""
    return F.substring(_c(x), 1, n)


def short_model_name(x) -> Column:
    """remove the fixed tags in order, then ``:`` → ``_``."""
    t = _c(x)
    for tag in MODEL_NAME_TAGS:
        t = F.replace(t, F.lit(tag), F.lit(""))
    return F.replace(t, F.lit(":"), F.lit("_"))


def run_stamp() -> Column:
    """``yyyyMMdd_HHmmss`` of the current time."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def labelled_term(term, explanation) -> Column:
    """``term: explanation``."""
    return F.concat(_c(term), F.lit(": "), _c(explanation))


def exact_phrase(term) -> Column:
    """remove ``"`` and wrap the term in quotes."""
    return F.concat(F.lit('"'), F.replace(_c(term), F.lit('"'), F.lit("")), F.lit('"'))


def is_failure(answer) -> Column:
    """the answer is a failure sentinel of the model call."""
    return _c(answer).isin(*FAILURE_SENTINELS)
