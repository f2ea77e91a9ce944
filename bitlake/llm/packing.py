"""Best-fit packing of documents into sequences of bounded length by exact-complement hashing.

Only the numbers of pieces per length matter for who shares a sequence with whom, and there are at most
``capacity`` lengths. So the driver packs that histogram: for each length, longest first, it looks up
single lengths, pairs and triples whose sum is exactly the gap left, and consumes as many such
combinations at once as are available; what no combination fills goes, longest first, into the fullest
open sequences that still hold it. The result is a short list of patterns, each with a number of
sequences. Executors number the pieces of each length and find their pattern by binary search.

Defined cases: null and empty texts give the end id alone; documents longer than the capacity are cut
into pieces of the full capacity and a last one that may be shorter; repeated rows and null doc_ids are
ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import materialize, released
from bitlake.llm.tokens import slices, store, vocabulary_path

CAPACITY = 4096
END_ID = 1
ROWS_PER_RANGE = 20_000
#: Chunks of texts that a worker keeps, and bytes of text that it encodes at once; the pipeline's executors are short of memory here.
CHUNKS, BYTES = 300_000, 2 << 20


def complement(free: np.ndarray, gap: int, index: dict) -> tuple[int, ...] | None:
    """Lengths (at most three, longest first) that sum to gap and are all available in free (a count per length)."""
    if free[gap]:
        return (gap,)

    def pair(total: int, least_spare: int = 0) -> tuple[int, int] | None:
        # least_spare: a length of which one is already spoken for.
        if total < 2:
            return None
        a = index["lengths"]
        a = a[(a < total) & (2 * a >= total)]
        b = total - a
        need_a = 1 + (a == least_spare) + (a == b)
        need_b = 1 + (b == least_spare) + (a == b)
        fits = np.flatnonzero((free[a] >= need_a) & (free[b] >= need_b))
        return (int(a[fits[-1]]), int(b[fits[-1]])) if len(fits) else None

    if found := pair(gap):
        return found
    for c in index["lengths"][::-1]:
        # Of three lengths one is at least a third of the gap.
        if c < gap and 3 * c >= gap and free[c] and (found := pair(gap - int(c), int(c))):
            return tuple(sorted((int(c), *found), reverse=True))
    return None


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) patterns that use up counts (pieces per length 0..capacity)."""
    free = counts.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []
    index = {"lengths": np.flatnonzero(free)}
    for length in range(capacity, 0, -1):
        while free[length]:
            gap = capacity - length
            if not gap:
                patterns.append(((length,), int(free[length])))
                free[length] = 0
                break
            free[length] -= 1
            found = complement(free, gap, index)
            free[length] += 1
            if found is None:
                break
            need = np.bincount((length, *found), minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((free[used] // need[used]).min())
            free[used] -= times * need[used]
            patterns.append(((length, *found), times))
            index["lengths"] = index["lengths"][free[index["lengths"]] > 0]
    return patterns + _best_fit(free, capacity)


def _best_fit(free: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on what is left, many equal sequences at a time."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    room = np.zeros(capacity + 1, bool)
    done: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        left = int(free[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                # New sequences: each takes as many of this length as it holds.
                per = capacity // length
                full, rest = divmod(left, per)
                for n, k in ((per, full), (rest, 1 if rest else 0)):
                    if k:
                        open_[capacity - n * length].append(((length,) * n, k))
                        room[capacity - n * length] = True
                break
            at = length + int(fits[0])
            held, k = open_[at].pop()
            use = min(k, left)
            if k > use:
                open_[at].append((held, k - use))
            room[at] = bool(open_[at])
            open_[at - length].append(((*held, length), use))
            room[at - length] = True
            left -= use
    for at in range(capacity + 1):
        done += open_[at]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """(key, first, sequence, offset) sorted by key and first: pieces first, first + 1, ... of a length go to
    sequence, sequence + 1, ... at offset. key is length * 2**40 + first, for one binary search."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return (table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with ids also its ids (little-endian 32-bit binary)."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches):
        chunks = store(path, CHUNKS)
        for batch in (part for b in batches for part in slices(b, 1, BYTES)):
            whole, ends = chunks.encoded(batch.column(1), end_id)
            starts = np.concatenate([[0], ends[:-1]])
            many = -(-(ends - starts) // capacity)
            row = np.repeat(np.arange(len(ends)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = starts[row] + piece * capacity
            length = np.minimum(capacity, ends[row] - at)
            raw = memoryview(whole.astype("<u4", copy=False)).cast("B")
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, parts), pa.binary())] * ids, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), T.StructType(fields))


def pack(made: DataFrame, capacity: int = CAPACITY, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """made (a table with doc_id, piece, length) with sequence_id and offset; read several times, so materialised."""
    histogram = made.groupBy("length").count().collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    key, first, sequence, offset = slots(pack_histogram(counts, capacity), capacity)
    # Pieces of one length are numbered within ranges of a hash, then ranges are put one after the other.
    ranges = max(1, -(-int(counts.max()) // rows_per_range))
    placed = made.withColumn("__range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)))
    sums = placed.groupBy("length", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__range").orderBy("doc_id", "piece")) - 1
    numbered = placed.join(sums, ["length", "__range"]).withColumn("__i", within + F.col("__before"))
    names = made.columns
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            i = batch.column("__i").to_numpy().astype(np.int64)
            at = np.searchsorted(key, (length << 40) + i, side="right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + i - first[at]), pa.array(offset[at])], names=schema.names)

    return numbered.select(*names, "__i").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) with their places in sequences."""
    return pack(materialize(pieces(docs, vocabulary, end_id, capacity, ids), "pieces"), capacity)
