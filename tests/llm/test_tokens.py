"""Packing and token files against plain versions."""

import brute as B
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mirage.llm import packing
from mirage.llm import queries as Q
from mirage.llm.common import shared_path
from mirage.llm.packing import nnls, pack, pack_lengths, patterns, tokenise
from mirage.llm.token_files import read_token_files, token_rows, write_token_files
from mirage.llm.tokens import encoder

BYTE, WORD = Q.tokenizer("byte_bpe_50k.json"), Q.tokenizer("word_bpe_49k.json")
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids(path):
    return lambda t: PLAIN[path].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0 　'aAsStTrRé́ñİΣς漢1½٣.,!<|>\x00-_"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_agrees_with_the_library(path, text):
    assert np.frombuffer(encoder(path).ids(text.encode()), np.uint32).tolist() == ids(path)(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y  z", "it's  they'll\n\nwe've", "a \n b", "\n a", "a  b", "A\x1c\x1db c"])
def test_encoder_cases(path, text):
    assert np.frombuffer(encoder(path).ids(text.encode()), np.uint32).tolist() == ids(path)(text)


def test_encoder_store_starts_anew():
    for path in (BYTE, WORD):
        e = encoder(path)
        old, e.known.most = e.known.most, 5
        try:
            for k in range(30):
                t = f"some words, {k} again! and again {k * 7} né, né {'x' * k}. some"
                assert np.frombuffer(e.ids(t.encode()), np.uint32).tolist() == ids(path)(t)
                assert len(e.known) <= 5
        finally:
            e.known.most = old


def placed_well(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, texts):
    pieces = tokenise(docs, BYTE).withColumn("crc", F.crc32("ids"))
    got = pack(pieces.drop("ids").withColumn("offset", F.lit("clash")), 2, ["doc_id", "piece", "crc"]).collect()
    assert B.ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in got) == B.ordered(B.pieces(texts, ids(BYTE)))
    total = sum(r["length"] for r in got)
    assert placed_well(got) <= -(-total // 2048) + 2


def test_packing_empty(none):
    assert pack(tokenise(none, BYTE), 1, ["doc_id", "piece"]).count() == 0


def test_packing_null_and_zero_lengths(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([None, 0, 0, 10, 10, 3, 7])], "k int, length int")
    got = pack(rows, 1, ["k"], capacity=10).collect()
    by = {}
    for r in got:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + (r["length"] or 0)
    assert len(got) == 7 and max(by.values()) <= 10 and len(by) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 256), max_size=400))
def test_pack_lengths(lengths):
    n = np.array(lengths, np.int64)
    seq, place = pack_lengths(n, 256)
    for s in set(seq.tolist()):
        at = np.flatnonzero(seq == s)
        order = at[np.lexsort((n[at], place[at]))]
        assert (place[order] == np.cumsum(n[order]) - n[order]).all() and n[at].sum() <= 256


def test_few_sequences():
    r = np.random.default_rng(3)
    for n in (np.minimum(2048, r.lognormal(6.5, 1, 6000).astype(int) + 1), r.integers(1, 700, 5000)):
        seq, _ = pack_lengths(n, 2048)
        assert seq.max() + 1 <= 1.005 * n.sum() / 2048 + 1


def test_nnls():
    r = np.random.default_rng(2)
    a = r.random((12, 20))
    x = np.maximum(r.normal(size=20), 0)
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    for b in (r.normal(size=12), a @ r.random(20) - 2, r.random(12), np.zeros(12), -np.ones(12)):
        got = nnls(a, b)
        slope = a.T @ (b - a @ got)
        # Optimal: no column would lower the error, and those in use are at rest.
        assert (got >= 0).all() and slope.max() < 1e-6 and abs(slope[got > 0]).max(initial=0) < 1e-6
    assert not nnls(a, -np.ones(12)).any()  # the best is nothing at all


def test_nnls_on_histograms_reaches_the_optimum():
    r = np.random.default_rng(4)
    all_of = patterns()
    for counts in (r.poisson(30, packing.BINS), r.poisson(0.2, packing.BINS), np.r_[np.zeros(60), 1, 500, 0, 3], np.eye(packing.BINS)[5] * 40):
        usable = all_of[:, counts == 0].sum(1) == 0
        a, b = all_of[usable].T, counts.astype(float)
        got = nnls(a, b)
        slope = a.T @ (b - a @ got)
        assert not len(slope) or slope.max() < 1e-6 * max(1, b.max())


def test_patterns_fill_a_sequence():
    p = patterns()
    room = p @ (np.arange(packing.BINS) + 0.5)
    assert (p.sum(1) <= 3).all() and (room <= packing.BINS).all() and (room >= packing.BINS - 1).all()
    assert len({tuple(x) for x in p}) == len(p)


def test_token_files(spark, docs, texts):
    keyed = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    got = token_rows(spark, docs, WORD).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    want = B.token_rows(texts, ids(WORD))
    # Rows that share an id may come in either order: compare without starts, then starts.
    assert B.ordered((r[0], r[2], r[3]) for r in got) == B.ordered((w[0], w[2], w[3]) for w in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [texts[k][0] for k in keyed]


def test_token_files_round_trip_and_random_access(spark, docs):
    import pyarrow as pa

    folder = shared_path(spark, "test-tokens").removeprefix("file:")
    manifest = write_token_files(docs, WORD, folder, length=64, shard_docs=20)
    assert manifest.count() > 2
    back = read_token_files(manifest, folder)
    plain = {i: t for i, t in [tuple(r) for r in docs.select("doc_id", "text").collect()] if i is not None and i not in (50, 51)}
    seen = 0
    for r in back.collect():
        if r["doc_id"] in plain:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids(WORD)(plain[r["doc_id"]] or "") + [1]
            seen += 1
    assert seen == len(plain)
    for m in manifest.collect():
        f = pa.ipc.open_file(pa.memory_map(f"{folder}/{m['ids_path']}"))
        assert f.schema.field("ids").type == pa.list_(pa.uint16(), 64)
        masks = [x for b in range(f.num_record_batches) for x in f.get_batch(b).column("mask").flatten().to_pylist()]
        assert sum(masks) == m["n_tokens"] and masks == sorted(masks, reverse=True) and len(masks) - sum(masks) < 64


def test_token_files_empty(spark, none):
    assert token_rows(spark, none, WORD).count() == 0


@pytest.mark.parametrize("name", ["op4_pattern_packing", "op9_token_files"])
def test_registered(spark, name):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.QUERIES[name](spark, sf).collect()
    if name.startswith("op4"):
        assert B.ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == B.ordered(B.pieces(texts, ids(BYTE)))
        assert placed_well(got) <= 1.01 * sum(r["length"] for r in got) / 2048 + 2  # as few as can be, about
    else:
        assert B.ordered(tuple(r) for r in got) == B.ordered(B.token_rows(texts, ids(WORD)))
