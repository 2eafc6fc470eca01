import random
import re
import zlib
from collections import Counter

from mirage.llm import queries
from mirage.llm.spelling import neighbours, spelling_variants, word_counts

from conftest import frame

LETTERS = "abcdefghijklmnopqrstuvwxyzàéßø"


def counted(docs):
    total = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def grouped(count):
    of, by = {}, {}
    for w in count:  # words without one of their letters, as a quick filter
        for k in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by.setdefault(k, set()).add(w)
    for same in by.values():
        for a in same:
            of.setdefault(a, set()).update(b for b in same if b != a and near(a, b))
    form = {}
    for w, n in count.items():
        best = min(of[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * n else None
    rows = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(of[w]), count[form[w]] if form[w] else None))
    return sorted(rows)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_tricky_texts(spark, docs, texts):
    extra = [(k, "Strasse straSSE Straße strasser  caféteria ×÷×÷×÷× caféteria ÀÉÎÕÜßß") for k in range(70)]
    df = docs.unionByName(frame(spark, extra))
    assert rows(spelling_variants(df)) == grouped(counted(texts + extra))


def test_empty(spark, none):
    assert rows(spelling_variants(none)) == []
    assert spelling_variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_runs_of_equal_letters_and_chains(spark):
    r = random.Random(3)
    count = {}
    for k in range(400):
        w = "".join(r.choice("abé") for _ in range(r.randint(7, 9)))
        count[w] = r.choice([2, 5, 30, 300, 3000, 3000, 40000])
    count |= {"a" * k: 2 * 10 ** (k - 7) for k in range(7, 15)}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    want = [(w, n) for w, _, _, _, n, _ in grouped(count) if n]
    assert sorted(tuple(x) for x in neighbours(df).select("word", "n_near").collect()) == want
    texts = [(k, " ".join([w] * min(n, 3000))) for k, (w, n) in enumerate(count.items())]
    assert rows(spelling_variants(frame(spark, texts))) == grouped(counted(texts))


def test_one_word_of_all_letters(spark):
    # A full group: every letter in the same place, and the place left out.
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    count = {"abcd" + c + "xyz": 2 + k for k, c in enumerate(letters)} | {"abcdxyz": 900}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in neighbours(df).collect()}
    want = {w: (n, f) for w, f, _, _, n, _ in grouped(count)}
    assert {w: g[0] for w, g in got.items()} == {w: n for w, (n, _) in want.items()}
    assert got["abcdbxyz"][1:] == ("abcdxyz", 900)


def test_flushes_and_rows(spark, monkeypatch):
    texts = [(k, "repeated " + " ".join(f"{a}{b}repeat" for a in LETTERS[:5] for b in LETTERS)) for k in range(20)] + [(None, "repeated")] * 2
    df = frame(spark, texts)
    assert {r.word: r.n for r in word_counts(df).collect()} == counted(texts)


def test_registered(spark):
    for d in ("/root/testdata/sf0.001",):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        got = rows(queries.QUERIES["op13_spelling_variants"](spark, d))
        assert got and got == grouped(counted(docs))
