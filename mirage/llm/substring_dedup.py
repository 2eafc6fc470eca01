"""Substring deduplication by super-k-mers.

A window is ``WINDOW`` consecutive words (runs of anything but ASCII white
space) of one document. A word is removed when a window covers it whose word
sequence also starts in a document with a smaller ``doc_id``; windows are
judged on the input.

1. Each window has a minimiser: the smallest hash among its runs of ``M``
   words. Consecutive windows with the same minimiser are one super-k-mer: the
   words they span, joined by single spaces. Equal windows have equal
   minimisers, so they meet in the minimiser's bucket.
2. A task combines what it reads: of equal super-k-mers only the occurrence in
   the smallest document travels (whatever else it holds, every window of the
   others also starts there, so they are removed on the spot). Copies thus
   cost one occurrence a block, and a bucket gets one compressed string of
   its super-k-mers from each block.
3. In its bucket each super-k-mer is cut into windows again; sorting them by
   hash brings equal ones together, their bytes are compared, and each window
   that a smaller document has gives a span of words to remove.
4. A bucket of more than ``HOT_BYTES`` of strings (a minimiser that very many
   different windows share) is not judged as one: its windows, one by one, are
   dealt again by their own hash over many buckets, and judged there. Equal
   windows have equal hashes, so the second deal is as exact as the first.
5. Spans go back to their documents.

Null or empty text has no words. Documents with fewer words than a window lose
none. A missing id comes after every other id. Rows that share a ``doc_id`` do
not remove each other's words; each such row is judged by its own text. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.llm.common import NO_ID, materialise, pack_arrays, pieces_of, ranges, text_of, unpack_arrays
from mirage.llm.words import Words, mix, raw_texts, runs_hash, slices, sliding_min

WINDOW = 13
#: Words of the runs that minimisers are chosen from: shorter runs give longer
#: super-k-mers, so fewer bytes, and more windows to a minimiser.
M = 3
#: Windows in a super-k-mer at most; longer runs are cut, which changes no
#: window's bucket.
MOST_WINDOWS = 64
#: Documents per bucket, about, and bytes of distinct strings in a block.
BUCKET_DOCS = 1000
BLOCK_BYTES = 24 << 20
#: Of compression: higher ones cost more time than they save bytes.
LEVEL = 3
#: Bytes of a bucket's strings that one task judges; buckets that each bucket
#: of more is dealt over, and windows dealt at a time.
HOT_BYTES = 96 << 20
HOT_PARTS, HOT_WINDOWS = 64, 200_000
_DEALT = ["bucket", "kind", "data"]
SPAN = "_id long, _key long, start int, end int"


def super_kmers(words: Words, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of windows of each super-k-mer, and its minimiser."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    least = sliding_min(runs_hash(words.hash, m), window - m + 1)
    valid = np.flatnonzero(words.text[:n] == words.text[window - 1:])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) != 1) | (least[valid[1:]] != least[valid[:-1]]) | (words.text[valid[1:]] != words.text[valid[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(valid)])
    parts = -(-sizes // MOST_WINDOWS)
    within = ranges(np.zeros(len(first), np.int64), parts) * MOST_WINDOWS
    start = np.repeat(valid[first], parts) + within
    count = np.minimum(np.repeat(sizes, parts) - within, MOST_WINDOWS)
    return start, count, np.repeat(least[valid[first]], parts)


class _Block:
    """Distinct super-k-mers of what a task has read so far, by bucket."""

    def __init__(self, n_buckets: int, window: int, m: int):
        self.n, self.window, self.m = n_buckets, window, m
        self.buckets: dict[int, dict[bytes, list]] = {}
        self.bytes = 0
        self.spans: list[tuple[int, int, int, int]] = []

    def add(self, ids: list[int], keys: list[int], texts: list[bytes]) -> None:
        words = Words([b" ".join(t.split()) for t in texts])
        start, count, least = super_kmers(words, self.window, self.m)
        bucket = (mix(least) % np.uint64(self.n)).tolist()
        data, span = words.data, self.window - 1
        text = words.text[start]
        place = (start - words.first[text]).tolist()
        lo, hi = words.start[start].tolist(), words.end[start + count - 1 + span].tolist()
        for b, t, p, c, x, y in zip(bucket, text.tolist(), place, count.tolist(), lo, hi):
            have = self.buckets.setdefault(b, {})
            s = data[x:y]
            got, ident = have.get(s), ids[t]
            if got is None:
                have[s] = [ident, c, [(keys[t], p)]]
                self.bytes += len(s)
            elif ident == got[0]:
                got[2].append((keys[t], p))
            elif ident > got[0]:
                self.spans.append((ident, keys[t], p, p + c + span))
            else:
                self.spans += [(got[0], k, q, q + c + span) for k, q in got[2]]
                got[0], got[2] = ident, [(keys[t], p)]

    def out(self):
        press = zstandard.ZstdCompressor(level=LEVEL)
        bucket, data = [], []
        for b, have in self.buckets.items():
            strings = list(have)
            values = list(have.values())
            places = [x for v in values for x in v[2]]
            bucket.append(b)
            data.append(press.compress(pack_arrays(
                np.array([v[0] for v in values], np.int64), np.array([len(v[2]) for v in values], np.int64),
                np.array([k for k, _ in places], np.int64), np.array([p for _, p in places], np.int64),
                np.frombuffer(b"\n".join(strings), np.uint8))))
        kind = [0] * len(data)
        for at in range(0, len(self.spans), 50_000):  # found here already: any bucket takes them on
            part = np.array(self.spans[at:at + 50_000], np.int64)
            bucket.append(int(mix(part[:1, 1].astype(np.uint64))[0] % np.uint64(self.n)))
            data.append(press.compress(part.tobytes()))
            kind.append(1)
        for at in range(0, len(data), 64):
            yield pa.record_batch([pa.array(bucket[at:at + 64], pa.int64()), pa.array(kind[at:at + 64], pa.int32()),
                                   pa.array(data[at:at + 64], pa.binary())], names=["bucket", "kind", "data"])


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether raw[a:a+size] equals raw[b:b+size_b], for many at once."""
    same = size == size_b
    at = np.flatnonzero(same & (size > 0))
    for lo in range(0, len(at), 100_000):
        i = at[lo:lo + 100_000]
        n = size[i]
        equal = raw[ranges(a[i], n)] == raw[ranges(b[i], n)]
        same[i] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def window_owners(strings: list[bytes], owner: np.ndarray, window: int = WINDOW) -> tuple[Words, np.ndarray, np.ndarray]:
    """For every window of every string: its first word and the smallest owner
    among the strings that have an equal window."""
    words = Words(strings)
    n = max(0, len(words.hash) - window + 1)
    at = np.flatnonzero(words.text[:n] == words.text[window - 1:window - 1 + n])
    if not len(at):
        return words, at, np.zeros(0, np.int64)
    h, own = runs_hash(words.hash, window)[at], owner[words.text[at]]
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    lo, size = words.start[at[order]], words.end[at[order] + window - 1] - words.start[at[order]]
    raw = np.frombuffer(words.data, np.uint8)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    head = np.repeat(first, np.diff(np.r_[first, len(h)]))
    least = own[head].copy()
    other = np.flatnonzero(head != np.arange(len(h)))
    same = _same_bytes(raw, lo[other], lo[head[other]], size[other], size[head[other]])
    if not same.all():  # different words with one hash: settle those groups by their bytes
        for g in np.unique(head[other[~same]]).tolist():
            group = np.flatnonzero(head == g)
            best: dict[bytes, int] = {}
            for i in group.tolist():
                best.setdefault(words.data[lo[i]:lo[i] + size[i]], int(own[i]))
            least[group] = [best[words.data[lo[i]:lo[i] + size[i]]] for i in group.tolist()]
    out = np.empty(len(h), np.int64)
    out[order] = least
    return words, at, out


def _deal_windows(block: bytes, window: int, bucket: int, parts: int):
    """The windows of a block of super-k-mers as blocks (bucket, data) of
    single windows, dealt over ``parts`` buckets by their own hash."""
    ids, times, keys, places, text = unpack_arrays(zstandard.ZstdDecompressor().decompress(block), np.int64, np.int64, np.int64, np.int64, np.uint8)
    press = zstandard.ZstdCompressor(level=3)
    strings = text.tobytes().split(b"\n")
    first = np.cumsum(times) - times
    lo = 0
    sizes = np.cumsum([s.count(b" ") + 1 for s in strings])
    while lo < len(strings):  # some strings at a time
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + HOT_WINDOWS, "right")))
        words = Words(strings[lo:hi])
        n = max(0, len(words.hash) - window + 1)
        at = np.flatnonzero(words.text[:n] == words.text[window - 1:window - 1 + n])
        own = words.text[at] + lo
        place = at - words.first[words.text[at]]
        part = (mix(runs_hash(words.hash, window)[at]) % np.uint64(parts)).astype(np.int64)
        x, y = words.start[at], words.end[at + window - 1]
        for p in np.unique(part).tolist():
            k = np.flatnonzero(part == p)
            many = times[own[k]]
            where = ranges(first[own[k]], many)
            yield bucket * parts + p, press.compress(pack_arrays(
                ids[own[k]], many, keys[where], places[where] + np.repeat(place[k], many),
                np.frombuffer(b"\n".join([words.data[a:b] for a, b in zip(x[k].tolist(), y[k].tolist())]), np.uint8)))
        lo = hi


def _bucket_spans(blocks: list[bytes], window: int):
    """Spans to remove among the super-k-mers of one bucket."""
    open_ = zstandard.ZstdDecompressor()
    have: dict[bytes, list] = {}
    spans: list[tuple[int, int, int, int]] = []
    for block in blocks:
        ids, times, keys, places, text = unpack_arrays(open_.decompress(block), np.int64, np.int64, np.int64, np.int64, np.uint8)
        at, where = 0, list(zip(keys.tolist(), places.tolist()))
        for s, ident, n in zip(text.tobytes().split(b"\n"), ids.tolist(), times.tolist()):
            mine, at = where[at:at + n], at + n
            got = have.get(s)
            if got is None:
                have[s] = [ident, mine]
                continue
            if ident == got[0]:
                got[1] += mine
                continue
            if ident < got[0]:
                ident, mine, got[0], got[1] = got[0], got[1], ident, mine
            size = s.count(b" ") + 1
            spans += [(ident, k, p, p + size) for k, p in mine]
    strings, values = list(have), list(have.values())
    owner = np.array([v[0] for v in values], np.int64)
    words, at, least = window_owners(strings, owner, window)
    hit = np.flatnonzero(least < owner[words.text[at]]) if len(at) else np.zeros(0, np.int64)
    if len(hit):
        text, place = words.text[at[hit]], at[hit] - words.first[words.text[at[hit]]]
        new = np.r_[True, (text[1:] != text[:-1]) | (np.diff(place) != 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(hit)] - 1
        for t, a, b in zip(text[first].tolist(), place[first].tolist(), place[last].tolist()):
            ident, where = values[t]
            spans += [(ident, k, p + a, p + b + window) for k, p in where]
    return spans


def spans_to_remove(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """Spans of words [start, end) to remove, by _id and _key (the document's
    id, or the stand-in for none, and a hash of its text). They may overlap."""
    n_buckets = pieces_of(docs.count(), BUCKET_DOCS)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("id"),
                       F.xxhash64(text_of()).alias("key"), text_of().alias("text"))

    def deal(batches):
        block = _Block(n_buckets, window, m)
        for part in slices(batches, "text", 2 << 20):
            block.add(part.column(0).to_pylist(), part.column(1).to_pylist(), raw_texts(part.column(2)))
            if block.bytes > BLOCK_BYTES or len(block.spans) > 500_000:
                yield from block.out()
                block = _Block(n_buckets, window, m)
        yield from block.out()

    def judge(batches, limit=None):
        """Spans (kind 1) of each bucket; with a ``limit`` on a bucket's bytes,
        the windows of buckets beyond it (kind 0), dealt again."""
        blocks: dict[int, list[bytes]] = {}
        held: dict[int, int] = {}

        def packed(spans):
            press = zstandard.ZstdCompressor(level=3)
            for lo in range(0, len(spans), 100_000):
                yield pa.record_batch([pa.array([0], pa.int64()), pa.array([1], pa.int32()),
                                       pa.array([press.compress(np.array(spans[lo:lo + 100_000], np.int64).tobytes())], pa.binary())], names=_DEALT)

        for batch in batches:
            for b, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    yield pa.record_batch([pa.array([b], pa.int64()), pa.array([1], pa.int32()), pa.array([data], pa.binary())], names=_DEALT)
                    continue
                held[b] = held.get(b, 0) + zstandard.get_frame_parameters(data).content_size
                blocks.setdefault(b, []).append(data)
                if limit is not None and held[b] > limit:
                    for block in blocks.pop(b):
                        for to, windows in _deal_windows(block, window, b, HOT_PARTS):
                            yield pa.record_batch([pa.array([to], pa.int64()), pa.array([0], pa.int32()), pa.array([windows], pa.binary())], names=_DEALT)
        for b in list(blocks):
            yield from packed(_bucket_spans(blocks.pop(b), window))

    def table(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = np.frombuffer(open_.decompress(data), np.int64).reshape(-1, 4)
                for lo in range(0, len(part), 100_000):
                    p = part[lo:lo + 100_000]
                    yield pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2].astype(np.int32)),
                                           pa.array(p[:, 3].astype(np.int32))], names=["_id", "_key", "start", "end"])

    kind = "bucket long, kind int, data binary"
    judged = materialise(rows.mapInArrow(deal, kind).repartition(n_buckets, "bucket")
                         .mapInArrow(lambda b: judge(b, HOT_BYTES), kind), "judged")
    done = judged.where("kind = 1").select("data")
    again = judged.where("kind = 0")
    if again.limit(1).count():
        done = done.union(again.repartition(n_buckets * HOT_PARTS, "bucket").mapInArrow(judge, kind).select("data"))
    return done.mapInArrow(table, SPAN)


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed,
    kept_text (the kept words joined by one space)."""
    spans = spans_to_remove(docs, window, m).groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long")).withColumn("_key", F.xxhash64("text"))
    found = rows.join(spans, ["_id", "_key"], "left").select("doc_id", "text", "spans.start", "spans.end")

    def cut(batches):
        for part in slices(batches, "text"):
            total, gone, kept = [], [], []
            for text, start, end in zip(raw_texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = text.split()
                total.append(len(words))
                if start is None:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    continue
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, start, 1)
                np.add.at(covered, end, -1)
                stay = np.cumsum(covered)[:-1] == 0
                gone.append(len(words) - int(stay.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.record_batch([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                   pa.array(kept, pa.binary()).cast(pa.string())],
                                  names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
