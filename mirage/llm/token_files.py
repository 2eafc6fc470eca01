"""Token-ID output: Arrow files of equal-length sequences with masks.

The texts of all documents, in ascending ``doc_id`` order (missing ids first,
equal ids by their text), are one stream of ids: each document's ids followed
by one end id. The stream is cut into shards by ranges of ``doc_id``; a shard
is two Arrow IPC files in the shared folder:

``shard-NNNNN.ids.arrow``
    record batches of two fixed-size-list columns: ``ids`` (uint16 when the
    vocabulary allows it, else uint32) and ``mask`` (bool, false on padding,
    which only the shard's last sequence can have). Row r is tokens
    [r * length, (r + 1) * length) of the shard; the fixed width lets a
    memory-mapped file give any sequence without copying or parsing.
``shard-NNNNN.docs.arrow``
    ``doc_id``, ``start`` (first token within the shard), ``n_tokens``.

Files are named by shard and written under a task's own name first, then
moved into place, so a repeated or speculative task leaves the same file.

Null text counts as empty (one end id). A table without rows gives a manifest
without rows. Repeated rows are kept, each with its own ids. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirage.llm.common import materialise, pieces_of, shared_path, text_of
from mirage.llm.tokens import encoder
from mirage.llm.words import raw_texts

#: Documents a shard holds, about.
SHARD_DOCS = 8192
#: Sequences in a record batch.
BATCH_SEQUENCES = 256


def _store(path: str):
    """File system and path for a folder that Spark names by URI."""
    import pyarrow.fs as fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _put(store, path: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId()}"
    with store.open_output_stream(own) as sink, pa.ipc.new_file(sink, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    store.move(own, path)


class _Sequences:
    """Collects ids and gives full record batches of equal-length sequences."""

    def __init__(self, length: int, kind):
        self.length, self.kind = length, kind
        self.rest, self.held, self.total = [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
                                 ("mask", pa.list_(pa.bool_(), length))])

    def batch(self, ids: np.ndarray, real: int) -> pa.RecordBatch:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema)

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rest.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * BATCH_SEQUENCES
        if self.held >= full:
            have = np.concatenate(self.rest)
            cut = len(have) // full * full
            for at in range(0, cut, full):
                yield self.batch(have[at:at + full], full)
            self.rest, self.held = [have[cut:]], len(have) - cut

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            have = np.concatenate(self.rest)
            padded = np.zeros(-(-len(have) // self.length) * self.length, self.kind)
            padded[:len(have)] = have
            yield self.batch(padded, len(have))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, length: int = 2048, end_id: int = 1,
                      shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into the files described above; gives
    the manifest: shard, ids_path, docs_path, n_docs, n_tokens, and ``start``,
    the number of ids in the shards before it."""
    n = docs.count()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_t").asc()]
    rows = (docs.select("doc_id", text_of().alias("text"))
            .withColumn("_t", F.xxhash64("text"))
            .repartitionByRange(pieces_of(n, shard_docs), *order)
            .sortWithinPartitions(*order).select("doc_id", "text"))

    def write(batches):
        enc = encoder(tokenizer)
        kind = np.uint16 if max(enc.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:05d}"
        out, doc_ids, sizes = _Sequences(length, kind), [], []
        end = np.array([end_id], np.uint32)

        def sequences():
            for batch in batches:
                doc_ids.append(batch.column(0))
                for text in raw_texts(batch.column(1)):
                    ids = np.frombuffer(enc.ids(text), np.uint32)
                    sizes.append(len(ids) + 1)
                    yield from out.add(ids)
                    yield from out.add(end)
            yield from out.close()

        stream = sequences()
        first = next(stream, None)
        if not sizes:
            return

        def all_of():
            if first is not None:
                yield first
            yield from stream

        _put(store, f"{base}/{name}.ids.arrow", out.schema, all_of())
        n_tokens = np.array(sizes, np.int64)
        index = pa.record_batch([pa.concat_arrays(doc_ids), np.cumsum(n_tokens) - n_tokens, n_tokens],
                                names=["doc_id", "start", "n_tokens"])
        _put(store, f"{base}/{name}.docs.arrow", index.schema,
             (index.slice(a, 65536) for a in range(0, index.num_rows, 65536)))
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{name}.ids.arrow"]), pa.array([f"{name}.docs.arrow"]),
                               pa.array([len(sizes)], pa.int64()), pa.array([out.total], pa.int64())],
                              names=["shard", "ids_path", "docs_path", "n_docs", "n_tokens"])

    written = materialise(rows.mapInArrow(write, "shard long, ids_path string, docs_path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, doc_type: str = "long") -> DataFrame:
    """Read the files of ``manifest`` back: one row per document with doc_id,
    start (ids of all documents before it), n_tokens and ids (its ids, end id
    included, as little-endian unsigned 32-bit integers in a binary)."""
    def read(batches):
        store, base = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                def opened(name):
                    local = hasattr(store, "type_name") and store.type_name == "local"
                    return pa.ipc.open_file(pa.memory_map(f"{base}/{name}") if local else store.open_input_file(f"{base}/{name}"))

                ids_file = opened(row["ids_path"])
                length = ids_file.schema.field("ids").type.list_size
                per = length * BATCH_SEQUENCES
                index = opened(row["docs_path"])
                last = (-1, None)

                def at(k):
                    nonlocal last
                    if last[0] != k:
                        last = (k, ids_file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
                    return last[1]

                for b in range(index.num_record_batches):
                    part = index.get_batch(b)
                    start, count = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    for lo in range(0, part.num_rows, 512):
                        out = []
                        for s, c in zip(start[lo:lo + 512].tolist(), count[lo:lo + 512].tolist()):
                            got = []
                            while c:
                                values = at(s // per)[s % per:s % per + c]
                                got.append(values)
                                s += len(values)
                                c -= len(values)
                            out.append(np.concatenate(got).astype("<u4").tobytes())
                        cut = part.slice(lo, 512)
                        yield pa.record_batch([cut.column("doc_id"), pa.array(cut.column("start").to_numpy() + row["start"]),
                                               cut.column("n_tokens"), pa.array(out, pa.binary())],
                                              names=["doc_id", "start", "n_tokens", "ids"])

    spark = manifest.sparkSession
    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 4 * spark.sparkContext.defaultParallelism + n // 16), "shard")
    return spread.mapInArrow(read, f"doc_id {doc_type}, start long, n_tokens long, ids binary")


def token_rows(spark: SparkSession, docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Write the files to a new folder beside the checkpoints and read them back."""
    folder = shared_path(spark, "tokens")
    manifest = write_token_files(docs, tokenizer, folder, length, end_id)
    return read_token_files(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
