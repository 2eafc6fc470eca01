import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import frame
from harness import compare

from mirage.llm import lexical
from mirage.llm import queries as Q
from mirage.llm.lexical import lexical_search, score_classes
from mirage.llm.oracle import ORACLE

ITEMS = [(1, "one two three w1 w2 W2 copy that"), (2, "naïve 漢字 q x1 changed"), (3, None), (4, "!? .."), (5, "nowhere to_be-found zzz"),
         (6, "one"), (6, "ONE two"), (7, "w1 w2"), (7, "w1 w2"), (None, "one two"), (8, "copy " * 30 + "words"), (9, "v3 v4 base w7 w8 w9")]
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=20):
    bags = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in set(items):
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, want in asked.items():
        got = []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m))
                    for t, q in want.items() if b[t])
            if s > 0:
                got.append((-s, i is None, i, s))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(got, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "d", 2) for i, t in ITEMS], "item_id long, text string, score int, doc_id string, rank int")


@pytest.mark.parametrize("top, block", [(20, 1000), (20, 8), (3, 1000)])
def test_against_plain(spark, docs, texts, items, top, block):
    assert rows(lexical_search(docs, items, top, block)) == ranked(texts, ITEMS, top)


def test_names_as_ids(spark, docs, texts):
    items = [("b", "one two"), ("a", "copy of w3")]
    got = lexical_search(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert rows(got) == ranked(texts, items)


def test_empty(spark, docs, none, items):
    assert rows(lexical_search(none, items)) == []
    assert rows(lexical_search(docs, items.where("false"))) == []
    assert rows(lexical_search(docs, items.where("item_id = 3"))) == []


def test_small_blocks_and_buffers(spark, docs, texts, items, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 30)
    monkeypatch.setattr(lexical, "HELD", 500)
    monkeypatch.setattr(lexical, "POSTINGS", 3)
    best = lexical._Best(2, 2)
    for scores, ids in ([[5, 0], [5, 1]], [[4], [9]]), ([[5, 1], [7, 0]], [[1], [8]]), ([[5, 1]], [[2, 3]]):
        best.add(np.array(scores), ids)
    assert best.documents() == ([0, 0, 1, 1], [8, 1, 1, 2], [7, 5, 1, 1])
    assert rows(lexical_search(docs, items)) == ranked(texts, ITEMS)


def test_sums_beyond_doubles():
    # A sum above 2**53 that needs all its digits.
    bag = np.array([[0, 1], [1, 1]], "<i4").tobytes()
    start, item, weight = np.array([0, 1, 2]), np.array([0, 0]), np.array([2**40, 1])
    value = 10**9 // (1000 + 12 * 75)
    got = score_classes(np.array([75]), [bag], start, item, weight, 1, exact=False)
    assert int(got[0, 0]) == (2**40 + 1) * value


def test_many_copies(spark, items):
    texts = [(5000 - k, "one two three") for k in range(3000)] + [(9000 + k, "one one two") for k in range(30)]
    assert rows(lexical_search(frame(spark, texts), items)) == ranked(texts, ITEMS)


def test_registered(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        ok, why = compare(spark, "op11_lexical_search", d, Q.QUERIES, ORACLE)
        assert ok, why
