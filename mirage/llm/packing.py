"""Best-fit packing by patterns fitted with non-negative least squares.

Pieces (rows with a length of at most ``capacity``) are packed into sequences.
They are dealt into groups of a few thousand, each packed by one task:

1. a histogram of the group's lengths in bins of equal width;
2. patterns: all sets of one to three bins whose mid-lengths fill a sequence
   within one bin's width;
3. repeat counts by non-negative least squares: the counts whose patterns use
   the histogram best, rounded down;
4. each repeat takes pieces of the pattern's bins, the last of them the
   longest one that still fits; where no such piece fills the sequence, the
   pattern's remaining repeats are left to the residual;
5. the residual pieces go, longest first, into a sequence each, which is then
   filled with the longest pieces that fit.

Pieces of full length are sequences of their own and take no part. Zero
lengths take a place but no room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.llm.common import pieces_of, text_of
from mirage.llm.tokens import encoder
from mirage.llm.words import raw_texts

#: Documents whose pieces are packed together, about.
GROUP_DOCS = 4096
BINS = 64


def patterns(bins: int = BINS) -> np.ndarray:
    """One row per pattern: how many pieces of each bin it takes. Bin i holds
    lengths around (i + 1/2) / bins of a sequence; up to three pieces fill
    between one bin less than the sequence and all of it."""
    mids = np.arange(bins) + 0.5
    rows = [[i] for i in range(bins) if bins - 1 <= mids[i] <= bins]
    rows += [[i, j] for i in range(bins) for j in range(i, bins) if bins - 1 < mids[i] + mids[j] <= bins]
    rows += [[i, j, k] for i in range(bins) for j in range(i, bins) for k in range(j, bins)
             if bins - 1 < mids[i] + mids[j] + mids[k] <= bins]
    out = np.zeros((len(rows), bins))
    for r, row in enumerate(rows):
        np.add.at(out[r], row, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ``|a @ x - b|``, by active sets: the column that
    lowers the error most joins; columns that would turn negative leave. Every
    step lowers the error, so no set comes twice and the end is the optimum (a
    column that cannot join for rounding waits until another one has)."""
    x = np.zeros(a.shape[1])
    on = np.zeros(a.shape[1], bool)
    wait = np.zeros(a.shape[1], bool)
    enough = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    while True:
        slope = a.T @ (b - a @ x)
        slope[on | wait] = -np.inf
        if not len(x) or slope.max() <= enough:
            return x
        new = int(slope.argmax())
        on[new] = True
        first = True
        while True:
            cols = np.flatnonzero(on)
            fit = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if first and fit[cols == new] <= 0:
                on[new], wait[new] = False, True
                break
            if first:
                wait[:] = False
                first = False
            if not len(cols) or fit.min() > 0:
                x[:] = 0
                x[cols] = fit
                break
            low = fit <= 0
            room = x[cols][low] / np.maximum(x[cols][low] - fit[low], 1e-300)
            x[cols] += room.min() * (fit - x[cols])
            gone = cols[low][room <= room.min()]
            x[gone] = 0
            on[gone] = False


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place for each length."""
    n = len(lengths)
    sequence, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stacks: dict[int, list[int]] = {}
    order = np.argsort(-lengths, kind="stable")
    seq = 0
    for i in order.tolist():
        size = int(lengths[i])
        if size >= capacity:
            sequence[i] = seq
            seq += 1
        else:
            stacks.setdefault(size, []).append(i)
    have = sum(1 << size for size in stacks)  # bit s: a piece of length s is left

    def longest(room: int) -> int:
        """The longest length left that fits, or -1."""
        return (have & ((1 << (room + 1)) - 1)).bit_length() - 1

    def take(size: int, at: int) -> int:
        nonlocal have
        stack = stacks[size]
        i = stack.pop()
        if not stack:
            have &= ~(1 << size)
        sequence[i], place[i] = seq, at
        latest.append(i)
        return at + size

    def give_back(size: int) -> None:
        nonlocal have
        stacks[size].append(latest.pop())
        have |= 1 << size

    width, slack, latest = -(-capacity // BINS), capacity // 512, []
    small = lengths[(lengths < capacity) & (lengths > 0)]
    if len(small):
        all_of = patterns()
        counts = np.bincount(np.minimum(small // width, BINS - 1), minlength=BINS).astype(float)
        usable = all_of[:, counts == 0].sum(1) == 0
        repeats = np.floor(nnls(all_of[usable].T, counts)).astype(int)
        for row, times in zip(all_of[usable], repeats.tolist()):
            bins = np.repeat(np.arange(BINS), row.astype(int))[::-1].tolist()
            for _ in range(times):
                at, taken = 0, []
                for k, b in enumerate(bins):
                    room = capacity - at
                    size = longest(room if k == len(bins) - 1 else min(room, (b + 1) * width - 1))
                    if size < (b * width if k < len(bins) - 1 else 1):
                        break
                    taken.append(size)
                    at = take(size, at)
                if capacity - at > slack:  # not filled: its pieces are residual
                    for size in reversed(taken):
                        give_back(size)
                    break
                seq += 1
    while have:
        at = take(have.bit_length() - 1, 0)
        while have and (size := longest(capacity - at)) >= 0:
            at = take(size, at)
        seq += 1
    return sequence, place


def pack(pieces: DataFrame, n_groups: int, key: list[str], length: str = "length", capacity: int = 2048) -> DataFrame:
    """``pieces`` with the columns sequence_id and offset (the place of its
    first token in the sequence; gapless from 0), replacing columns of those
    names. ``length`` must lie between 0 and ``capacity``; ``key`` are columns
    that tell pieces apart: they deal the groups and settle the order of equal
    lengths, so a repeated task packs alike. Null lengths count as 0. No rows
    give no rows."""
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct(*cols).alias("row"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("size"),
                         F.xxhash64(*key).alias("tie"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(n_groups)).cast("long"))
    out = T.StructType([*[pieces.schema[c] for c in cols], T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("tie", "ascending")])
        sequence, place = pack_lengths(t.column("size").to_numpy(), capacity)
        row = t.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        base = t.column("part")[0].as_py() << 32
        return pa.table([*row.flatten(), pa.array(sequence + base), pa.array(place)], names=out.names)

    return rows.groupBy("part").applyInArrow(group, out)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece (from 0), start (the
    document's ids before it), length, ids (little-endian unsigned 32-bit, in
    a binary). A document is its ids and one end id. Only documents longer
    than ``capacity`` are cut, into pieces of ``capacity`` ids, of which the
    first may be shorter. Null text counts as empty (the end id alone)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids_of = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                owner, number, start, length, out = [], [], [], [], []
                for k, text in enumerate(raw_texts(part.column(1))):
                    ids = enc.ids(text) + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        owner.append(lo + k)
                        number.append(p)
                        start.append(a)
                        length.append(b - a)
                        out.append(ids[4 * a:4 * b])
                yield pa.record_batch([ids_of.take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                                       pa.array(length, pa.int64()), pa.array(out, pa.binary())],
                                      names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def groups_for(docs: DataFrame) -> int:
    return pieces_of(docs.count(), GROUP_DOCS)
