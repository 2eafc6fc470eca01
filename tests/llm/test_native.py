"""Licences, mixing and chat formatting: cases, oracles and edge rows."""

import random
import hashlib

import pytest
from conftest import frame, prose
from harness import compare
from pyspark.sql import functions as F

from mirage.llm import chat, licenses, mixing
from mirage.llm import queries as Q
from mirage.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    ok, said = compare(spark, name, SF, Q.QUERIES, ORACLE)
    assert ok, said


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_source_mixing", "op5_chat_formatting"])
def test_no_python_on_the_main_path(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if x in plan]


# -- licences ---------------------------------------------------------------

MIT = licenses.KNOWN[0][1]
LICENSE_CASES = [
    (1, MIT, "MIT", ""),
    (2, MIT.replace("<year> <copyright holders>", "2019-2021 Some Body\nCopyright 2020 by Another\nAll rights reserved."), "MIT", ""),
    (3, MIT.upper().replace('"', "''").replace(",", " ,\t"), "MIT", ""),
    (4, MIT.split("\n", 2)[2], "MIT", ""),
    (5, MIT.replace("sublicense", "sub-licence"), "MIT", ""),
    (6, MIT.replace("free of charge", "for a fee"), None, ""),
    (7, "Some text.\nReleased under the MIT Licence!\nmore", None, "MIT"),
    (8, "  licensed under the APACHE license version 2.0\n\nReleased under the MIT License.\nreleased under the mit license", None, "Apache-2.0,MIT"),
    (9, "Released under the MIT License.", "MIT", "MIT"),
    (10, "Not released under the MIT License.", None, ""),
    (11, None, None, ""), (12, "", None, ""), (13, " \n--\n© 2020 X", None, ""),
    (14, "x" * 200_000 + "\nLicensed under CC BY-NC 4.0.", None, "CC-BY-NC-4.0"),
    (None, MIT, "MIT", ""), (15, MIT, "MIT", ""), (15, MIT, "MIT", ""),
]


def test_license_cases(spark):
    docs = frame(spark, [(i, t) for i, t, _, _ in LICENSE_CASES])
    got = licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["license_id"], ",".join(r["notices"])) for r in got), key=key) \
        == sorted(((i, a, b) for i, _, a, b in LICENSE_CASES), key=key)
    by = {r["doc_id"]: r for r in got}
    assert by[8]["n_notices"] == 3 and by[15]["n_notices"] == 0
    assert by[11]["text_digest"] is None and by[13]["text_digest"] is None and by[1]["text_digest"] == by[2]["text_digest"]


COMMON = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-3", "LGPL-3.0-only"),
          ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")]
NOTICES = [("Licensed under the GNU General Public License, version 2.", "GPL-2.0-only"), ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
           ("Licensed under CC0 1.0.", "CC0-1.0"), ("This file is licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
           ("# SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("Distributed under the GNU Lesser General Public License, version 2.1 or later.", "LGPL-2.1-or-later"),
           ("Not licensed under CC0 1.0.", None)]


def test_common_licenses(spark):
    assert len(licenses.KNOWN) <= licenses.MOST_KNOWN  # broadcast
    files = []
    for name, i in COMMON:
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            files.append((f.read(), i))
    rows = [(t, i, "") for t, i in files] + [(f"text\n{t}\nmore", None, i or "") for t, i in NOTICES]
    got = licenses.scan_licenses(frame(spark, [(k, t) for k, (t, _, _) in enumerate(rows)]), licenses.known_licenses(spark)).collect()
    assert sorted((r["doc_id"], r["license_id"], ",".join(r["notices"])) for r in got) == [(k, i, n) for k, (_, i, n) in enumerate(rows)]


def test_license_empty(spark, none):
    assert licenses.scan_licenses(none, licenses.known_licenses(spark)).count() == 0
    docs = frame(spark, [(1, MIT)])
    assert licenses.scan_licenses(docs, licenses.known_licenses(spark).limit(0)).first()["license_id"] is None


def test_many_known_licenses(spark, monkeypatch):
    """Beyond the bound the table is not broadcast by hint; same result."""
    monkeypatch.setattr(licenses, "MOST_KNOWN", 3)
    got = licenses.scan_licenses(frame(spark, [(1, MIT)]), licenses.known_licenses(spark))
    assert got.first()["license_id"] == "MIT"


# -- mixing -----------------------------------------------------------------

def fill(budget, children):
    """Plain water filling: name -> (weight, capacity); exact shares."""
    left, open_, out = budget, dict(children), {}
    while True:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if w * left >= c * total and w > 0}
        if not full:
            break
        k = min(full, key=lambda k: (open_[k][1] / open_[k][0], open_[k][1], k))
        out[k] = open_.pop(k)[1]
        left -= out[k]
    for k, (w, c) in open_.items():
        out[k] = min(c, w * left // sum(x for x, _ in open_.values())) if w else 0
    rest = budget - sum(out.values()) if all(w == 0 for w, _ in open_.values()) else 0
    for k in sorted((k for k, (w, _) in open_.items() if w == 0), key=lambda k: (open_[k][1], k)):
        out[k] = min(open_[k][1], max(0, rest))
        rest -= out[k]
    return out


def plan(tokens, weights, share, epochs):
    cap = lambda prefix: sum(epochs * t for leaf, t in tokens.items() if leaf[:len(prefix)] == prefix)
    budget = {(): sum(tokens.values()) * round(share * 1000) // 1000}
    for depth, level in enumerate(mixing.TREE):
        below = {leaf[:depth + 1] for leaf in tokens}
        new = {}
        for parent, b in budget.items():
            kids = {x[-1]: (max(0, weights.get(level, {}).get(x[-1], 1)), cap(x)) for x in below if x[:-1] == parent}
            new |= {(*parent, k): v for k, v in fill(b, kids).items()}
        budget = new
    return budget


CASES = [({}, 0.5, 1), (Q.WEIGHTS, 0.8, 2), ({"domain": {"web": 1, "books": 50}, "lang": {"en": 9, "": 0}, "source": {"src0": 3, "odd": 7}}, 1.4, 3),
         ({"lang": {"en": 0, "de": 0, "": 0}}, 0.3, 1), ({}, 5.0, 2), ({}, 0.0, 1)]


@pytest.mark.parametrize("weights,share,epochs", CASES)
def test_mix(spark, weights, share, epochs):
    rows = [(k, prose(k, 3 + (k * 37) % 90)) for k in range(150)] + [(None, "no id"), (900, None), (901, ""), (902, prose("l", 5000))]
    docs = frame(spark, rows)
    # the row's leaf is what its columns say
    all_rows = docs.select("doc_id", Q.domain().alias("domain"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), "text").collect()
    n = {r["doc_id"]: len((r["text"] or "").split()) for r in all_rows}
    leaf = {r["doc_id"]: tuple(r[1:4]) for r in all_rows}
    tokens = {}
    for i, k in n.items():
        if k:
            tokens[leaf[i]] = tokens.get(leaf[i], 0) + k
    want = {}
    for where, budget in plan(tokens, weights, share, epochs).items():
        own = [i for i in n if leaf[i] == where and n[i]]
        for e in range(epochs + 1):
            for i in sorted(own, key=lambda i: hashlib.md5(f"0:{e}:{'null' if i is None else i}".encode()).hexdigest()):
                if budget > 0:
                    want[i, e] = min(n[i], budget)
                    budget -= want[i, e]
    got = mixing.mix_sources(docs, Q.domain(), weights, share, epochs)
    assert {(r["doc_id"], r["epoch"]): r["take_tokens"] for r in got.collect()} == want


def test_mix_empty_and_columns(spark, none):
    got = mixing.mix_sources(none, Q.domain(), Q.WEIGHTS)
    assert got.count() == 0
    assert got.columns == [c for c in none.columns if c != "epoch"] + ["epoch", "n_tokens", "take_tokens"]


def test_mix_repeated_rows(spark):
    docs = frame(spark, [(1, "a b c d")] * 6 + [(2, "x y")] * 4)
    rows = mixing.mix_sources(docs, Q.domain(), {}, 0.5).collect()
    assert rows and all(r["take_tokens"] <= r["n_tokens"] for r in rows)


@pytest.mark.parametrize("cell", [1000, 0, 5])
def test_mix_cuts_one_document_of_equal_ids(spark, monkeypatch, cell):
    """A third of the rows without id, a third with one id, copies among both."""
    monkeypatch.setattr(mixing, "CELL", cell)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 1000 + k, prose(k % 40, 5 + (k * 37) % 30) if k % 5 else "same words in every copy here") for k in range(240)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(i, t, ["en", "de"][k % 2], "src0") for k, (i, t) in enumerate(rows)], schema).repartition(3)
    for share, epochs in [(0.37, 1), (0.5, 1), (1.3, 2)]:
        tokens = {}
        for k, (_, t) in enumerate(rows):
            leaf = ("web", ["en", "de"][k % 2], "src0")
            tokens[leaf] = tokens.get(leaf, 0) + len(t.split())
        got = mixing.mix_sources(docs, F.lit("web"), {}, share, epochs).collect()
        for (_, lang, _), budget in plan(tokens, {}, share, epochs).items():
            own = [r for r in got if r["lang"] == lang]
            assert sum(r["take_tokens"] for r in own) == budget
            assert sum(r["take_tokens"] < r["n_tokens"] for r in own) <= 1


def test_taken_text(spark):
    rows = spark.createDataFrame([("  a b\n\tc  d ", 4, 2), ("a b", 2, 2), (" x", 1, 1), ("a b c", 2, 1)], "text string, n_tokens long, take_tokens long")
    assert [r[0] for r in rows.select(mixing.taken_text()).collect()] == ["  a b", "a b", " x", "a b"]


def test_word_counts(spark):
    texts = ["", " ", "a", " a ", "a b", "a\n\t b\x0bc\x0c", "a b", "\x1ca"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words(F.col("text"))).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 1, 2, 3, 1, 1]


# -- chat -------------------------------------------------------------------

RECORDS = [
    ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', "messages", [("user", "q"), ("assistant", "a")]),
    ('{"messages": [{"content": "q", "role": "user"}, {"role": "assistant", "content": null}]}', "messages", [("user", "q"), ("assistant", "")]),
    ('{"messages": []}', None, []),
    ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}', "conversations",
     [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ('{"conversations": [{"from": "human", "value": "q"}], "system": "s"}', "system_conversations", [("system", "s"), ("user", "q")]),
    ('{"prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"response": "r", "prompt": 5}', "prompt_response", [("user", "5"), ("assistant", "r")]),
    ('{"instruction": "i", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"instruction": "i", "input": "x", "output": null}', "instruction_input", [("system", "i"), ("user", "x")]),
    ('{"question": "q", "answer": "a"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ('{"role": "user", "text": "t"}', "turn_row", [("user", "t")]),
    ('{"role": null, "text": null}', "turn_row", [("", "")]),
    ('{"other": 1}', None, []), ("[1, 2]", None, []), ("null", None, []), (None, None, []), ('"text"', None, []), ("{}", None, []),
]


def test_layouts(spark):
    rows = spark.createDataFrame([(k, r, "clash") for k, (r, _, _) in enumerate(RECORDS)], "k int, json string, layout string")
    got = chat.canonical_turns(rows.withColumn("record", F.try_parse_json("json"))).orderBy("k").collect()
    assert [(r["layout"], [tuple(t) for t in r["turns"]]) for r in got] == [(n, t) for _, n, t in RECORDS]


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\n", "<\\|", "<", "<|", "|>", "a\nb\n", "\\\\<|\\|", "<|im_end|>\n", "漢字 é \U0001f600", "<<||>>"]


def test_format_is_reversible(spark):
    turns = [(r, t) for t in TEXTS for r in ("user", "assistant", "odd\nrole", "a\\nb", "<|im_start|>", "\\\\\n|", "")]
    convs = [(0, turns), (1, []), (2, [("assistant", t) for t in TEXTS]), (3, [("user", "x" * 300_000)])]
    df = spark.createDataFrame([(k, t) for k, t in convs], "k int, turns array<struct<role:string,text:string>>")
    done = chat.format_chats(df)
    got = done.select("k", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r, (_, t) in zip(sorted(got), convs):
        assert [tuple(x) for x in r["t"]] == t
        assert r["loss"] == "".join(x for role, x in t if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(t)


def test_turn_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "n"), (None, 0, "user", "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a")],
                                 "conv_id long, turn long, role string, text string")
    records = rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    got = chat.gather_turns(chat.canonical_turns(records), "conv_id", "turn").collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == {
        1: [("", "n"), ("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")], None: [("user", "x")]}
    assert chat.gather_turns(chat.canonical_turns(records.limit(0)), "conv_id", "turn").count() == 0


def test_long_conversations(spark):
    """More turns and spans than any block holds; clashing names pass through."""
    r = random.Random(6)
    for n in (0, 1, 255, 256, 257, 9000):
        turns = [(r.choice(["user", "assistant", "a\nb"]), r.choice(["", "x", "é漢\\ <|im_end|>", "plain text"]) + str(k)) for k in range(n)]
        df = spark.createDataFrame([(1, turns, "z", 7)], "_z long, turns array<struct<role:string,text:string>>, _b string, _row long")
        done = chat.format_chats(df)
        assert done.columns == ["_z", "turns", "_b", "_row", "formatted", "loss_spans"]
        got = done.select("_z", "_b", "_row", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
        assert (got["_z"], got["_b"], got["_row"]) == (1, "z", 7)
        assert [(x["role"], x["text"]) for x in got["t"]] == turns
        assert got["loss"] == "".join(x for role, x in turns if role == "assistant")


def test_mix_is_exact_or_refused(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "en", f"src{k % 2}") for k in range(500)], "doc_id long, text string, lang string, source string")

    def taken(share, weights):
        return mixing.mix_sources(docs, F.lit("d"), weights, share=share).agg(F.sum("take_tokens")).first()[0]

    # Two sources share alike, each rounded down.
    assert taken(0.0004, {}) == 2 and taken(0.0002, {}) is None and taken(1 / 3, {}) == 1666
    assert taken(1, {"source": {"src0": 3}}) == 5000
    for weights, share in (({"source": {"src0": 0.5}}, 0.5), ({"lang": {"en": 1.5}}, 0.5), ({}, -0.1), ({}, float("nan"))):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, F.lit("d"), weights, share=share)
