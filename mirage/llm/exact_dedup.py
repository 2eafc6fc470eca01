"""Exact deduplication: Patricia-trie owners.

Texts are equal when identical after every run of ASCII white space is
replaced by one space. Each task first puts the texts it reads into a
compressed radix trie, so a group of copies costs the shuffle one row per task,
whatever its size. The distinct texts travel to the partition of their byte
length and content hash. There the full bytes of all texts of the partition go
into one trie, in the order of their first ``HEAD`` bytes; terminal nodes keep
the smallest identifier and the number of rows. Equal means that the trie says
so: the content hash only deals the texts.

Tries spill by subtree. Where rows come in order, the subtrees before the
current head are finished: they are given out and dropped as soon as a trie
holds more than ``TRIE_BYTES`` of text. What is not finished by then (a first
task's trie, or more text than that under one head) is given out too, largest
subtrees first, as partial counts that are added up at the end by length and
SHA-256. Terminals of more than one row are then joined to the documents by
these two.

Null text counts as empty, so missing and empty texts are one group. A missing
id comes after every other id: it is the owner only where no row of its group
has one. Rows that repeat both id and text are the same document: each is kept
if that document is. Other columns pass through; those named like an output
are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.llm.common import NO_ID, SPACES, text_of

TRIE_BYTES = 32 << 20
#: First bytes of a text that order a partition's rows.
HEAD = 16
OUT = ["keep_id", "group_size", "kept", "text_sha256"]


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix: halving over slices, compared whole."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value = label, {}, value


class Trie:
    """Compressed radix trie over byte strings. A terminal's value is
    [smallest id, rows, tag of the string]."""

    def __init__(self):
        self.root, self.bytes, self.size = _Node(b""), 0, 0

    def insert(self, key: bytes, ident: int, rows: int, tag) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.value is None:
                    node.value = [ident, rows, tag]
                    self.size += 1
                else:
                    node.value[0] = min(node.value[0], ident)
                    node.value[1] += rows
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], [ident, rows, tag])
                self.bytes += len(key) - at
                self.size += 1
                return
            rest = key[at:]
            n = common_prefix(child.label, rest)
            if n < len(child.label):  # split the edge
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
            node, at = child, at + n

    def values(self):
        """Values of all terminals."""
        yield from _terminals(self.root)

    def _drop(self, parent: _Node, byte: int) -> list:
        child = parent.children.pop(byte)
        got = list(_terminals(child))
        self.size -= len(got)
        self.bytes -= _held(child)
        return got

    def finished(self, head: bytes) -> list:
        """Take out the subtrees of all strings that come before ``head``
        and do not begin with it, and return their values."""
        out, node, at = [], self.root, 0
        while at < len(head):
            for byte in [b for b in node.children if b < head[at]]:
                out += self._drop(node, byte)
            child = node.children.get(head[at])
            if child is None:
                break
            n = common_prefix(child.label, head[at:])
            if n < len(child.label):
                if at + n < len(head) and child.label[n] < head[at + n]:
                    out += self._drop(node, head[at])
                break
            node, at = child, at + n
        return out

    def spill(self, most: int) -> list:
        """Take out subtrees, the largest first, until ``most`` bytes are
        left, and return their values."""
        out, node = [], self.root
        while len(node.children) == 1 and node.value is None:  # below what all share
            node = next(iter(node.children.values()))
        for byte in sorted(node.children, key=lambda b: -_held(node.children[b])):
            if self.bytes <= most:
                return out
            out += self._drop(node, byte)
        if self.bytes > most:  # one long path
            out += list(self.values())
            self.root, self.bytes, self.size = _Node(b""), 0, 0
        return out


def _terminals(node: _Node):
    stack = [node]
    while stack:
        node = stack.pop()
        if node.value is not None:
            yield node.value
        stack.extend(node.children.values())


def _held(node: _Node) -> int:
    """Bytes of text in a subtree."""
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node.label)
        stack.extend(node.children.values())
    return total


_FIELDS = ["length", "hash", "sha", "text", "ident", "rows"]


def _combine(batches):
    """Equal texts of one task as one row, as far as a trie holds them."""
    def out(got):
        return pa.record_batch([pa.array([len(v[2][2]) for v in got], pa.int64()), pa.array([v[2][0] for v in got], pa.int64()),
                                pa.array([v[2][1] for v in got], pa.binary()), pa.array([v[2][2] for v in got], pa.binary()),
                                pa.array([v[0] for v in got], pa.int64()), pa.array([v[1] for v in got], pa.int64())], names=_FIELDS)

    trie = Trie()
    for batch in batches:
        for ident, short, sha, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            trie.insert(text, ident, 1, (short, sha, text))
            if trie.bytes > TRIE_BYTES:
                yield out(trie.spill(TRIE_BYTES // 2))
    yield out(list(trie.values()))


def _own(batches):
    """(length, sha, owner, rows) of a partition's texts, which come in order
    of their heads: of finished ones those that more than one row has, of
    others (``whole`` false) all."""
    def out(got, whole):
        got = [v for v in got if v[1] > 1 or not whole]
        return pa.record_batch([pa.array([v[2][0] for v in got], pa.int64()), pa.array([v[2][1] for v in got], pa.binary()),
                                pa.array([v[0] for v in got], pa.int64()), pa.array([v[1] for v in got], pa.int64())],
                               names=["length", "sha", "owner", "rows"])

    trie, partial = Trie(), None
    for batch in batches:
        for length, _, sha, text, ident, rows in zip(*(batch.column(n).to_pylist() for n in _FIELDS)):
            if trie.bytes > TRIE_BYTES:
                head = text[:HEAD]
                if partial != head:  # what was given out in part under an earlier head goes on so
                    yield out(trie.finished(head), partial is None)
                    partial = None if not trie.size else partial
                if trie.bytes > TRIE_BYTES:
                    partial = head
                    yield out(trie.spill(TRIE_BYTES // 2), False)
            trie.insert(text, ident, rows, (length, sha))
    yield out(list(trie.values()), partial is None)


def owners(docs: DataFrame) -> DataFrame:
    """One row per text that more than one row of ``docs`` (doc_id, text) has:
    length (bytes), sha (binary SHA-256), owner (smallest id), rows."""
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("ident"), _normal().alias("text"))
    ready = texts.select("ident", F.crc32("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha"), F.encode("text", "UTF-8").alias("text"))
    found = (ready.mapInArrow(_combine, "length long, hash long, sha binary, text binary, ident long, rows long")
             .repartition("length", "hash").sortWithinPartitions(F.substring("text", 1, HEAD))
             .mapInArrow(_own, "length long, sha binary, owner long, rows long"))
    return found.groupBy("length", "sha").agg(F.min("owner").alias("owner"), F.sum("rows").alias("rows")).where("rows > 1")


def _normal():
    return F.regexp_replace(text_of(), SPACES, " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with keep_id (doc_id of the row of its text that stays),
    group_size (rows of its text), kept, text_sha256 (of the normalised text);
    one row per row of ``docs``."""
    cols = [c for c in docs.columns if c not in OUT]
    rows = docs.select(F.struct(*cols).alias("_row"), F.col("doc_id").cast("long").alias("_id"), _normal().alias("_text"))
    rows = rows.select("_row", "_id", F.octet_length("_text").cast("long").alias("length"), F.sha2("_text", 256).alias("_sha"))
    found = rows.withColumn("sha", F.unhex("_sha")).join(owners(docs), ["length", "sha"], "left")
    keep = F.when(F.col("owner").isNull(), F.col("_id")).when(F.col("owner") != NO_ID, F.col("owner"))
    return found.select(*[F.col("_row")[c].alias(c) for c in cols], keep.alias("keep_id"),
                        F.coalesce("rows", F.lit(1)).alias("group_size"),
                        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))
