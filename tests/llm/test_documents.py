"""Document operators against plain versions on rows with every oddity."""

import hashlib
import random

import brute as B
import numpy as np
import pyarrow as pa
import pytest
from conftest import frame, prose
from pyspark.sql import functions as F

from mirage.llm import exact_dedup as E
from mirage.llm import queries as Q
from mirage.llm.exact_dedup import Trie, common_prefix, exact_dedup
from mirage.llm import ngram_join as N
from mirage.llm.ngram_join import least_matches, ngram_join
from mirage.llm.substring_dedup import remove_repeats, super_kmers, window_owners
from mirage.llm.words import Words, sliding_min


def rows(df, *cols):
    return B.ordered(tuple(r) for r in df.select(*cols).collect())


def test_exact(docs, texts):
    got = exact_dedup(docs)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == B.ordered(B.exact(texts))
    assert got.columns == [c for c in docs.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert got.where("length <> 'l' or rows <> 2").count() == 0  # clashing names pass through


def test_exact_empty(none):
    assert exact_dedup(none).count() == 0


def test_trie_holds_smallest_id_and_rows():
    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(3000)]
    trie, plain = Trie(), {}
    for k, key in enumerate(keys):
        ident = r.randint(0, 10_000)
        trie.insert(key, ident, 2, key)
        old = plain.get(key, (ident, 0))
        plain[key] = (min(old[0], ident), old[1] + 2)
    assert {v[2]: (v[0], v[1]) for v in trie.values()} == plain
    assert trie.size == len(plain)


@pytest.mark.parametrize("limit", [40, 400, 1 << 20])
def test_tries_spill_by_subtree(monkeypatch, limit):
    """Tasks' tries and owners' tries that hold next to nothing: what is given
    out in parts adds up to the whole, with texts of all lengths in one trie
    and content hashes that collide."""
    monkeypatch.setattr(E, "TRIE_BYTES", limit)
    r = random.Random(3)
    same = b"the same long beginning of many texts "
    pool = [same + bytes(r.choice(b"xyz") for _ in range(r.randint(0, 6))) for _ in range(150)]
    pool += [bytes(r.choice(b"ab\xff\x00") for _ in range(r.randint(0, 20))) for _ in range(150)] + [b"", b"a" * 1000, b"a" * 1001]
    rows = [(k, r.choice(pool)) for k in range(4000)]

    def batch(part):
        return pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()),
                                pa.array([hashlib.sha256(t).digest() for _, t in part], pa.binary()), pa.array([t for _, t in part], pa.binary())],
                               names=["ident", "hash", "sha", "text"])

    combined = [b for lo in range(0, 4000, 500) for b in E._combine(iter([batch(rows[lo:lo + 300]), batch(rows[lo + 300:lo + 500])]))]
    table = pa.Table.from_batches(combined)
    assert sum(table.column("rows").to_pylist()) == 4000
    order = sorted(range(table.num_rows), key=lambda k: table.column("text")[k].as_py()[:E.HEAD])
    got, parts = {}, 0
    for b in E._own(iter(table.take(order).combine_chunks().to_batches(max_chunksize=97))):
        for length, sha, owner, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            old = got.get((length, sha), (owner, 0))
            got[length, sha] = (min(old[0], owner), old[1] + n)
            parts += 1
    want = {}
    for k, t in rows:
        old = want.get(t, (k, 0))
        want[t] = (min(old[0], k), old[1] + 1)
    assert {x: v for x, v in got.items() if v[1] > 1} == {(len(t), hashlib.sha256(t).digest()): v for t, v in want.items() if v[1] > 1}
    assert (parts > len(got)) == (limit < 1000)  # the small ones have to give out unfinished subtrees


def test_finished_subtrees():
    trie = Trie()
    words = [b"a", b"ab", b"abc", b"b", b"ba", b"bab", b"bb", b"c"]
    for w in words:
        trie.insert(w, 1, 1, w)
    assert sorted(v[2] for v in trie.finished(b"bab")) == [b"a", b"ab", b"abc"]
    assert sorted(v[2] for v in trie.finished(b"bb")) == [b"ba", b"bab"]
    assert sorted(v[2] for v in trie.finished(b"zz")) == [b"b", b"bb", b"c"] and (trie.size, trie.bytes) == (0, 0)


def test_common_prefix():
    assert [common_prefix(a, b) for a, b in [(b"", b"x"), (b"abc", b"abd"), (b"abc", b"abc"), (b"x" * 1000 + b"a", b"x" * 1000 + b"b"), (b"a", b"b")]] \
        == [0, 2, 3, 1000, 0]


def test_substrings(docs, texts):
    got = remove_repeats(docs).withColumn("sha", F.sha2("kept_text", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == B.ordered(B.substrings(texts))


def test_substrings_small_windows(spark):
    r = random.Random(5)
    texts = [(k // 2 if k % 7 == 0 else k, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for k in range(120)]
    texts.sort(key=lambda x: (x[0], x[1]))
    got = remove_repeats(frame(spark, texts), window=5, m=2).withColumn("sha", F.sha2("kept_text", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == B.ordered(B.substrings(texts, 5))


@pytest.mark.parametrize("limit", [0, 3000])
def test_hot_buckets_are_dealt_again(spark, texts, monkeypatch, limit):
    """Buckets beyond the limit (all of them, or some) go by window; spans are
    the same."""
    import mirage.llm.substring_dedup as S

    monkeypatch.setattr(S, "HOT_BYTES", limit)
    monkeypatch.setattr(S, "HOT_PARTS", 3)
    got = remove_repeats(frame(spark, texts)).withColumn("sha", F.sha2("kept_text", 256))
    assert rows(got, "doc_id", "n_words", "n_removed", "sha") == B.ordered(B.substrings(texts))


def test_dealt_windows(monkeypatch):
    import zstandard

    import mirage.llm.substring_dedup as S

    monkeypatch.setattr(S, "HOT_WINDOWS", 20)
    strings = [prose("s", 13).encode(), prose("t", 40).encode(), prose("u", 14).encode()]
    block = zstandard.ZstdCompressor().compress(S.pack_arrays(
        np.array([5, 6, 7]), np.array([1, 2, 1]), np.array([50, 60, 61, 70]), np.array([0, 3, 9, 4]), np.frombuffer(b"\n".join(strings), np.uint8)))
    got = set()
    for to, data in S._deal_windows(block, 13, 2, 4):
        assert 8 <= to < 12
        ids, times, keys, places, text = S.unpack_arrays(zstandard.ZstdDecompressor().decompress(data), *[np.int64] * 4, np.uint8)
        at = 0
        for w, i, n in zip(text.tobytes().split(b"\n"), ids.tolist(), times.tolist()):
            got |= {(w, i, k, p, to) for k, p in zip(keys[at:at + n].tolist(), places[at:at + n].tolist())}
            at += n
    want = set()
    for s, i, where in zip(strings, (5, 6, 7), ([(50, 0)], [(60, 3), (61, 9)], [(70, 4)])):
        w = s.split()
        want |= {(b" ".join(w[p:p + 13]), i, k, q + p) for p in range(len(w) - 12) for k, q in where}
    assert {g[:4] for g in got} == want and len({(w, to) for w, *_, to in got}) == len({w for w, *_ in got})


def test_substrings_empty(none):
    assert remove_repeats(none).count() == 0


def test_super_kmers_cover_every_window_once():
    texts = [prose(k, n).encode() for k, n in enumerate([0, 5, 13, 14, 300])] + [b"x " * 500]
    w = Words(texts)
    start, count, _ = super_kmers(w)
    got = sorted(s + k for s, c in zip(start.tolist(), count.tolist()) for k in range(c))
    want = [p for p in range(len(w.hash) - 12) if w.text[p] == w.text[p + 12]]
    assert got == want and count.max() <= 64


def test_window_hash_collisions_are_settled_by_bytes(monkeypatch):
    import mirage.llm.substring_dedup as S

    monkeypatch.setattr(S, "runs_hash", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    strings = [b"a b c d", b"b c d e", b"a b c x"]
    words, at, least = window_owners(strings, np.array([3, 2, 1]), 3)
    assert least.tolist() == [1, 2, 2, 2, 1, 1]


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 7, 2])
    for n in range(1, 8):
        assert sliding_min(x, n).tolist() == [x[k:k + n].min() for k in range(len(x) - n + 1)]


def test_near(docs, texts):
    assert rows(ngram_join(docs), "doc_id", "class_id", "n_links", "kept") == B.ordered(near_of(texts))


def near_of(texts):
    """Plain version; rows without words link with nothing."""
    return B.near(texts)


def test_near_chunks(spark):
    """Groups split into chunk pairs give the same result."""
    r = random.Random(9)
    base = prose("chunk", 80).split()
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 60)}"
        texts.append((k, " ".join(w)))
    assert rows(ngram_join(frame(spark, texts), chunk=16), "doc_id", "class_id", "n_links", "kept") == B.ordered(B.near(texts))


def hot_ids():
    """A third of the rows under no id, another under one id, near copies and
    copies with other white space among them."""
    r = random.Random(11)
    out = []
    for g in range(60):
        base = prose(f"hot {g}", 60).split()
        for k in range(4):
            w = list(base)
            if k:
                w[r.randrange(60)] = f"y{k}"
            text = (" " if k != 2 else "\n\t").join(w)
            out += [((None, 7, 1000 + 10 * g + k)[(g + k) % 3], text)]
        out.append((None, "  ".join(base)))
    return out + [(None, None), (None, ""), (7, "a lone text"), (7, "a lone text")]


@pytest.mark.parametrize("held", [1 << 25, 1500])
def test_near_under_one_missing_id(spark, monkeypatch, held):
    monkeypatch.setattr(N, "CHUNK_BYTES", held)
    texts = hot_ids()
    assert rows(ngram_join(frame(spark, texts)), "doc_id", "class_id", "n_links", "kept") == B.ordered(B.near(texts))


def test_near_joins_grow_with_the_rows_only(spark):
    """Rows without ids meet their own texts, not all texts without an id."""
    def met(ids):
        texts = [(i, prose(f"own {k // 2}", 40) + f" {'x' if k % 2 else 'y'}") for k, i in enumerate(ids)]
        docs = frame(spark, texts)
        cls = N.classes(docs).select("id", "hash")
        return cls.join(N._texts(docs), ["id", "hash"]).count()

    assert met(range(600)) == met([None] * 600) == 600


def test_near_empty(none):
    assert ngram_join(none).count() == 0


def test_posterior_bounds():
    need = least_matches(0.8)
    assert need == sorted(need) and all(0 < m <= 16 * (k + 1) * 0.8 for k, m in enumerate(need))


@pytest.mark.parametrize("name", ["op6_substring_dedup", "op8_ngram_jaccard_join"])
def test_registered(spark, name):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.QUERIES[name](spark, sf)
    want = B.substrings(texts) if name.startswith("op6") else B.near(texts)
    assert rows(got, *(["doc_id", "n_words", "n_removed", "kept_sha256"] if name.startswith("op6") else ["doc_id", "class_id", "n_links", "kept"])) == B.ordered(want)
