"""Building the term tables: page lookup, upserts, topics, candidates and the
corpus existence check (J12-J15, I4, I6, A13, F9-F13, V4, V5, X1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.common import keep_first
from mirage.functions.text import (cut, definition_from_paragraphs, paragraph_kept,
                                   split_candidates, split_topic)
from mirage.operators.ordering import GlobalOrder

COLLATION = "UNICODE_CI_AI"      # equality ignoring case and accents


def ci_ai(c) -> F.Column:
    return F.collate(F.col(c) if isinstance(c, str) else c, COLLATION)


# -- pages ----------------------------------------------------------------------
def page_definitions(pages: DataFrame) -> DataFrame:
    """J13 + F12: the definition of every page ``(_id, wikipedia_title, text)``."""
    return pages.select(F.col("_id").alias("page_id"), F.col("wikipedia_title").alias("title"),
                        definition_from_paragraphs(F.col("text")).alias("definition"))


def lookup_by_title(terms: DataFrame, pages: DataFrame, term_col: str = "term") -> DataFrame:
    """J12 + F12 + I6: for each distinct term, the first page (lowest id)
    whose title equals it ignoring case and accents, and that page's
    definition (``None`` when there is no page).

    The definition is cut out of the page first, and pages that no term names
    leave in a semi-join, so the aggregate to one page per collated title
    carries one paragraph of the pages looked up and nothing else."""
    t = terms.select(F.col(term_col).alias("term")).distinct()
    keyed = pages.select(ci_ai("wikipedia_title").alias("_k"), "_id", definition_from_paragraphs(F.col("text")).alias("_d"))
    named = keyed.join(t.select(ci_ai("term").alias("_k")).distinct(), "_k", "left_semi")
    best = named.groupBy("_k").agg(F.min(F.struct("_id", "_d")).alias("_p"))
    j = t.join(best, ci_ai("term") == F.col("_k"), "left")
    return j.select("term", F.col("_p._id").alias("page_id"),
                    F.coalesce(F.col("_p._d"), F.lit("None")).alias("definition"))


def lookup_outcomes(looked_up: DataFrame) -> DataFrame:
    """Terms with a page, without one, and ambiguous ones."""
    outcome = (F.when(F.col("definition") == "None", "nonwiki")
                .when(F.col("definition") == "ambiguous", "ambiguous").otherwise("wiki"))
    return looked_up.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("terms"))


def paragraphs(pages: DataFrame, strict: bool = True, max_chars: int | None = None) -> DataFrame:
    """V4 text rows (F13/F14): paragraphs from index 1 on, filtered, whole.
    ``max_chars`` cuts them (F16), for a store with a column limit (9 000
    strict, 9 999 loose in the original)."""
    ex = pages.select("_id", "wikipedia_title", F.posexplode("text").alias("pos", "paragraph"))
    ex = ex.where((F.col("pos") >= 1) & paragraph_kept(F.col("paragraph"), strict))
    text = F.col("paragraph") if max_chars is None else cut(F.col("paragraph"), max_chars)
    return ex.select(F.col("_id").cast("long").alias("id"), F.col("wikipedia_title").alias("title"),
                     "pos", text.alias("text"))


def titles(pages: DataFrame) -> DataFrame:
    """title rows ``(int id, title)``."""
    return pages.select(F.col("_id").cast("long").alias("id"),
                        F.col("wikipedia_title").alias("title"))


def hit_terms(hits: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """V5: a search hit becomes a real term. Title hits take the page
    definition and are dropped when it is ``None`` or ``ambiguous``;
    paragraph hits fall back to the hit's own text."""
    d = page_definitions(pages).select(F.col("page_id").alias("id"), "definition")
    j = hits.join(d, "id", "left")
    if kind == "title":
        return (j.where(~F.col("definition").isin("None", "ambiguous") & F.col("definition").isNotNull())
                 .select("*", F.col("definition").alias("explanation")))
    return j.select("*", F.when(F.col("definition").isNull()
                                | F.col("definition").isin("None", "ambiguous"),
                                F.col("text")).otherwise(F.col("definition")).alias("explanation"))


# -- upsert of real terms --------------------------------------------------------------
SUGGESTED, BY_TITLE, BY_TEXT = 1, 2, 3        # sources of real terms, best first


def term_suggestions(suggested: DataFrame | None = None, title_hits: DataFrame | None = None,
                     text_hits: DataFrame | None = None) -> DataFrame:
    """U4: the three sources of real terms as one table ``(fake_term_id, term,
    explanation, source_id, position)``: what a model suggested, what the
    title search found and what the text search found (each with
    ``fake_term_id, term, explanation, position``; any may be missing)."""
    parts = [df.select("fake_term_id", "term", "explanation", F.lit(k).cast("long").alias("source_id"),
                       F.col("position").cast("long").alias("position"))
             for k, df in ((SUGGESTED, suggested), (BY_TITLE, title_hits), (BY_TEXT, text_hits)) if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def upsert_real_terms(candidates: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """I4 over U4 rows ``(fake_term_id, term, explanation, source_id, position)``.

    One real term per collated spelling: an existing row keeps its id; among
    new rows the first by (source, made-up id, position) wins (model
    suggestions 1 before title hits 2 before text hits 3). New ids continue
    after the largest existing one in that order, so they meet no stored id
    and no two sources share one. Returns ``(real_terms, links)``; links are
    distinct (made-up id, real id).

    Ids need the order of the new terms, so building the result runs jobs: the
    new rows are ordered and written to the checkpoint folder, and the largest
    stored id is read."""
    order = ["source_id", "fake_term_id", "position"]
    # Of equal terms that many made-up terms found the first counts, whatever
    # the spelling: a fold with numeric buffers before any sort by spelling.
    found = keep_first(candidates.select(*order, "term", "explanation"), ["source_id", "position", "term", "explanation"], ["fake_term_id"])
    new = keep_first(found.select(ci_ai("term").alias("_k"), *order, "term", "explanation"), ["_k"], order)
    top = 0
    if existing is not None:
        old = existing.select(ci_ai("term").alias("_k"), F.col("id").cast("long").alias("id"), "term", "explanation",
                              F.col("source_id").cast("long").alias("source_id"))
        new = new.join(old.select("_k"), "_k", "left_anti")
        top = existing.agg(F.max("id")).first()[0] or 0                   # one scalar
    numbered = GlobalOrder(new, [*order, "term"]).with_position("id", base=top + 1)
    win = numbered.select("_k", "id", "term", "explanation", F.col("source_id").cast("long").alias("source_id"))
    if existing is not None:
        win = win.unionByName(old)
    real = win.select("id", F.col("term").cast("string").alias("term"), "explanation", "source_id")
    # Spellings meet the ids, made-up terms their spellings: each pair once.
    pairs = candidates.select("fake_term_id", F.col("term").cast("string").alias("_t")).distinct()
    spelled = (pairs.select("_t").distinct().withColumn("_k", ci_ai("_t"))
                    .join(win.select("_k", F.col("id").alias("real_id")), "_k").select("_t", "real_id"))
    links = (pairs.join(spelled, "_t")
                  .select(F.col("fake_term_id").cast("long").alias("nonexistent_id"), "real_id")
                  .distinct())
    return real, links


# -- topics and candidates ---------------------------------------------------------------
def topic_rows(topics: DataFrame, text_col: str = "topic") -> DataFrame:
    """F10 + W6: ``name: explanation`` strings into (id, name, explanation);
    ids follow the position column ``pos``."""
    name, expl = split_topic(F.col(text_col))
    return topics.select((F.col("pos") + 1).cast("long").alias("id"), name.alias("name"),
                         expl.alias("explanation"))


def topic_containing(titles_df: DataFrame, topics: DataFrame, title_col: str = "title") -> DataFrame:
    """The first topic (by ``pos``) whose text contains the title. All
    titles are matched in one pass over the topics (see ``phrase_hits``); a
    task passes on the first topic of each title, not every match."""
    pairs = _term_pairs(titles_df, topics.where(F.col("pos").isNotNull()), title_col, "pos", "topic", False, BLOCK_CHARS)
    found = _per_task(pairs, None, lambda least, pos: pos if least is None or pos < least else least, topics.schema["pos"].dataType.simpleString())
    first = found.groupBy("term").agg(F.min("value").alias("topic_pos"))
    first = first.join(topics.select(F.col("pos").alias("topic_pos"), "topic"), "topic_pos")
    j = titles_df.join(first, titles_df[title_col] == first["term"], "left")
    return j.select(*titles_df.columns, "topic_pos", "topic")


def split_candidate_lists(lists: DataFrame, text_col: str = "candidates") -> tuple[DataFrame, DataFrame]:
    """each reply holds candidates separated by ``/n/n/n``; each is
    ``title:definition`` with exactly one colon. Returns ``(rows, rejected)``."""
    ex = lists.select("*", F.posexplode(split_candidates(F.col(text_col)))
                      .alias("cand_pos", "_c")).drop(text_col)
    parts = F.split(F.col("_c"), ":", -1)
    ok = F.size(parts) == 2
    good = ex.where(ok).select(*[c for c in ex.columns if c != "_c"],
                               F.get(parts, 0).alias("term"), F.get(parts, 1).alias("explanation"))
    bad = ex.where(~ok)
    return good, bad


def zip_by_position(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Pair two lists by position (an equi-join on the position)."""
    return left.join(right, pos)


# -- X1: does a term occur in a corpus? -------------------------------------------------
#: Characters of terms in one block, and of documents in one chunk.
BLOCK_CHARS, CHUNK_CHARS = 4_000_000, 2_000_000
#: Splits of the corpus where there is more than one block of terms.
SPLITS = 256


def _chunks(docs: DataFrame, kind: str) -> DataFrame:
    """Documents (_doc, _lt) as chunks (docs, texts) of about ``CHUNK_CHARS``
    bytes, or one document, packed where they are read."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pa.compute.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_CHARS)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part, ends = batch.slice(lo, hi - lo), pa.array([0, hi - lo], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.concat_arrays([part.column(c)])) for c in (0, 1)], names=["docs", "texts"])

    return docs.mapInArrow(pack, f"docs array<{kind}>, texts array<string>")


def _term_pairs(terms: DataFrame, docs: DataFrame, term_col: str, doc_id: str, text_col: str, fold_case: bool, block_chars: int) -> DataFrame:
    """Every chunk of documents with every block of terms: (block, terms,
    folded, docs, texts). One block, whose size is checked, is broadcast and no
    text is shuffled. Several blocks and the chunks meet in a join by split."""
    fold = F.lower if fold_case else (lambda c: c)
    t = terms.select(F.col(term_col).alias("term")).where(F.col("term").isNotNull()).distinct()
    t = t.withColumn("folded", fold(F.col("term")))
    n = int((t.agg(F.sum(F.length("folded") + 16)).first()[0] or 0) // block_chars) + 1  # one scalar
    d = docs.select(F.col(doc_id).alias("_doc"), fold(F.col(text_col)).alias("_lt")).where(F.col("_lt").isNotNull())
    chunks = _chunks(d, docs.schema[doc_id].dataType.simpleString())
    blocks = t.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("term", "folded"))).alias("t")).select(
        "block", F.col("t.term").alias("terms"), F.col("t.folded").alias("folded"))
    if n == 1:
        return chunks.withColumn("block", F.lit(0)).join(F.broadcast(blocks), "block").select("block", "terms", "folded", "docs", "texts")
    chunks = chunks.withColumn("split", F.pmod(F.xxhash64("docs", F.size("texts")), F.lit(SPLITS)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    blocks = blocks.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    return blocks.join(chunks, ["split", "block"]).select("block", "terms", "folded", "docs", "texts")


class _Finder:
    """All terms of a block, found in one pass over a text."""

    def __init__(self, folded: list[str]):
        import ahocorasick

        by: dict[str, list[int]] = {}
        for k, f in enumerate(folded):
            by.setdefault(f, []).append(k)
        self.always = by.pop("", [])
        self.finder = ahocorasick.Automaton()
        for f, ks in by.items():
            self.finder.add_word(f, tuple(ks))
        self.some = bool(by)
        self.finder.make_automaton()

    def of(self, text: str) -> set[int]:
        """Numbers of the terms in ``text``; the empty term is in every one."""
        found = {x for _, ks in self.finder.iter(text) for x in ks} if self.some else set()
        return found.union(self.always)


def _each_chunk(batches):
    """(terms, finder, documents, texts) of each pair; a block's automaton is
    built once as long as its chunks follow one another."""
    block, finder, terms = None, None, None
    for batch in batches:
        for n in range(batch.num_rows):
            if batch.column(0)[n].as_py() != block:
                block, terms = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                finder = _Finder(batch.column(2)[n].as_py())
            yield block, terms, finder, batch.column(3)[n].values, batch.column(4)[n].as_py()


def phrase_hits(terms: DataFrame, docs: DataFrame, term_col: str = "term",
                doc_id: str = "doc_id", text_col: str = "text", fold_case: bool = True,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each term, the documents whose lower-cased text contains the
    lower-cased term (``(term, doc_id)`` pairs; ``fold_case=False`` compares
    as written). The empty term is in every document that has a text.

    A row per pair is what is asked here; where a count or the first document
    is enough, ``phrase_exists`` and ``topic_containing`` emit a row per term
    and task. All terms of a block are matched in one pass over a document by
    a multi-pattern automaton; blocks and chunks of documents are joined by
    Spark (``_term_pairs``)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def match(batches):
        for _, terms, finder, ids, texts in _each_chunk(batches):
            row, hit = [], []
            for k, text in enumerate(texts):
                for x in sorted(finder.of(text)):
                    row.append(k)
                    hit.append(terms[x])
            yield pa.record_batch([pa.array(hit, pa.string()), ids.take(pa.array(row, pa.int64()))], names=["term", doc_id])

    return _term_pairs(terms, docs, term_col, doc_id, text_col, fold_case, block_chars).mapInArrow(match, f"term string, {doc_id} {kind}")


def _per_task(pairs: DataFrame, start, fold_in, kind: str) -> DataFrame:
    """(term, value): for each block that a task meets, one row for each term
    found, with ``fold_in(value so far or start, document)`` over its
    documents. A term in every document costs the shuffle one row a task."""

    def match(batches):
        def out():
            return pa.record_batch([pa.array([names[x] for x in held], pa.string()), pa.array(list(held.values()))], names=["term", "value"])

        held: dict[int, object] = {}
        now, names = None, None
        for block, terms, finder, ids, texts in _each_chunk(batches):
            if block != now and held:
                yield out()
                held = {}
            now, names = block, terms
            for ident, text in zip(ids.to_pylist(), texts):
                for x in finder.of(text):
                    held[x] = fold_in(held.get(x, start), ident)
        if held:
            yield out()

    return pairs.mapInArrow(match, f"term string, value {kind}")


def phrase_exists(terms: DataFrame, docs: DataFrame, term_col: str = "term", doc_id: str = "doc_id",
                  text_col: str = "text", fold_case: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """X1 summary: number of documents and existence per distinct term,
    counted in the tasks."""
    pairs = _term_pairs(terms, docs, term_col, doc_id, text_col, fold_case, block_chars)
    found = _per_task(pairs, 0, lambda n, _: n + 1, "long")
    counts = found.groupBy("term").agg(F.sum("value").alias("hits"))
    t = terms.select(F.col(term_col).alias("term")).distinct()
    return (t.join(counts, "term", "left")
             .select("term", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
                     (F.coalesce("hits", F.lit(0)) > 0).alias("exists")))


def not_found(candidates: DataFrame, exists_col: str = "exists") -> DataFrame:
    """Candidates the existence check did not find (NULL is dropped)."""
    return candidates.where(~F.col(exists_col))


def still_unchecked(candidates: DataFrame, exists_col: str = "exists") -> DataFrame:
    """I1 for the existence check: candidates whose result is still empty."""
    return candidates.where(F.col(exists_col).isNull())
