"""Repeated passages by sparse suffix arrays.

A passage counts as repeated where a window of ``length`` words occurs twice or more in the corpus, in
other documents or in the same one. Of all suffixes only those at minimisers are kept: positions whose
k-word hash is least in some run of ``length - k + 1`` such hashes. Content alone selects them, so
every window holds one, at the same place in each of its copies. Kept suffixes are sorted by their
first k words; those that stand alone cannot be in a repeat and go. The others take along the words around
them. A task sorts its suffixes word by word and compares neighbours: how many words they have in common from
the kept place on. It sorts them once more by the words to the left, read backwards, and compares neighbours
likewise. Two suffixes then share a window of ``length`` words that begins a words to the left just where
they are in one run of at least length - a common words in the one order, and in one run of at least a in
the other. The union of the shared windows is the union of the maximal matches of at least ``length`` words.

Equal texts are one text here, with a count; each kept suffix of very frequent first words (more than
``hot``) goes through a grouped aggregate with map-side sums instead of a sort within one task; there whole
windows are compared by a 64-bit hash. Elsewhere each word is compared by its own 64-bit hash; texts by MD5.

The first occurrence of a window, by least doc_id (nulls last), then by place, stays; the words of its
other occurrences are removed.

Defined cases: texts that are null, empty or under ``length`` words have no repeats and stay as they
are, equal or not; null doc_ids are ordinary rows; of rows equal in doc_id and text one is the first;
documents from which all words go are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import materialize, released, scratch

LENGTH = 50
K = 20
#: Kept suffixes a task sorts, and those of one k-word start that a single task may get.
ROWS_PER_TASK = 50_000
HOT = 50_000
#: Rows whose texts a worker holds as Python values at once.
ROWS = 512
#: Bits of the filter that tells which texts have a partner in a join.
FILTER_BITS = 27

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone modulo 2**64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 7)
        return h


_HASHES = _Hashes()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)]))
    return _POWERS


class Grams:
    """Hashes of all word windows of one text, by any length."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        up, self.down = _powers(self.n + 1)
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, self.n)
        self.words = h
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: self.n])])

    def around(self, places: np.ndarray, left: int, right: int) -> np.ndarray:
        """A row per place with the hashes of the words from left before it up to right after, 0 past either end."""
        at = places[:, None] + np.arange(-left, right)
        inside = (at >= 0) & (at < self.n)
        return np.where(inside, np.maximum(self.words, np.uint64(1))[np.clip(at, 0, self.n - 1)], np.uint64(0))

    def hashes(self, length: int) -> np.ndarray:
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        x = (self.sums[length:] - self.sums[:m]) * self.down[:m]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each run of w entries."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def minimisers(grams: Grams, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k-word hash is least in some run of length - k + 1 of them, and those hashes."""
    x, w = grams.hashes(k), length - k + 1
    if len(x) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _slide(x, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == x)
    return at, x[at]


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(v) for v in values]).astype(np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _kept(docs: DataFrame, k: int, length: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("tkey", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            n, starts, at = [], [], []
            for text in batch.column(2):
                g = Grams(text.as_py())
                p, h = minimisers(g, k, length)
                n.append(g.n), at.append(p.astype(np.int32)), starts.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), _lists(starts, pa.int64()), _lists(at, pa.int32())], names=schema.names)

    text = F.col("text").cast("binary")
    return docs.where("text is not null").select("doc_id", F.unhex(F.md5(text)).alias("tkey"), text.alias("t")).mapInArrow(lambda batches: released(run(batches)), schema).where(F.col("n") >= length)


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    n, width = len(matrix), matrix.itemsize * matrix.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _row_words(column: pa.Array, width: int) -> np.ndarray:
    """The 64-bit numbers of equally long binary values, a row for each; no copy."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width * 8].view(np.uint64).reshape(len(column), width)


def _windows(texts: DataFrame, k: int, length: int, flat: bool) -> DataFrame:
    """flat = False: (start, tkey, first, at, around) of the kept places, with the hashes of the words around each in one
    binary; flat = True: (w, tkey, first, at) of those with hot starts (often), a row for each window around the place,
    at the place where it begins, with the window's hash.
    """
    first = texts.schema["first"].dataType
    schema = T.StructType([T.StructField("w" if flat else "start", T.LongType()), T.StructField("tkey", T.BinaryType()), T.StructField("first", first), T.StructField("at", T.IntegerType())])
    if not flat:
        schema = schema.add("around", T.BinaryType())
    w = length - k + 1

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                start, at, left, n = [], [], [], []
                for text, places in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                    g, p = Grams(text.as_py()), np.array(places, np.int64)
                    if flat:
                        # Windows around neighbouring places overlap: each counts once.
                        x, begin = g.hashes(length), np.unique(p[:, None] - np.arange(w))
                        begin = begin[(begin >= 0) & (begin < len(x))]
                        left.append(x[begin].view(np.int64)), at.append(begin.astype(np.int32)), n.append(len(begin))
                    else:
                        left.append(g.around(p, w - 1, length)), start.append(g.hashes(k)[p].view(np.int64)), at.append(p.astype(np.int32)), n.append(len(p))
                rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                keys = [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(at))]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), *keys], names=schema.names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(start)), *keys, _binary_rows(np.concatenate(left))], names=schema.names)

    places = "often" if flat else "places"
    return texts.where(F.size(places) > 0).select("tkey", "first", "text", places).mapInArrow(lambda batches: released(run(batches)), schema)


def _span_schema(first) -> T.StructType:
    return T.StructType([T.StructField("tkey", T.BinaryType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("stays", T.BooleanType()), T.StructField("source", first)])


def in_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted word by word, and how many leading words each has in common with the one before it (-1: the first)."""
    order = np.lexsort(words.T[::-1])
    same = words[order[1:]] == words[order[:-1]]
    return order, np.concatenate([[-1], np.where(same.all(1), words.shape[1], same.argmin(1))])


def neighbour_spans(rows: pa.Table, length: int) -> pa.Table:
    """Sorts the suffixes of a task to the right and to the left, compares neighbours, and gives the spans they share."""
    rows = rows.sort_by([("first", "ascending"), ("tkey", "ascending"), ("at", "ascending")]).combine_chunks()
    n = rows.num_rows
    at = rows.column("at").to_numpy()
    width = len(rows.column("around")[0].as_py()) // 8
    w = width - length + 1
    around = _row_words(rows.column("around").chunk(0), width)
    sides = []
    for words in (around[:, w - 1 :], around[:, : w - 1][:, ::-1]):
        order, common = in_order(words)
        sides.append((order, common, (words != 0).sum(1)))
    source = np.full((n, w), -1, np.int32)  # row of the first occurrence of each shared window
    for a in range(w):
        key, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for (order, common, held), least in zip(sides, (length - a, a), strict=True):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(common < least)
            key, whole = key * (n + 1) + run, whole & (held >= least)
        here = np.flatnonzero(whole)
        if not len(here):
            continue
        order = here[np.argsort(key[here], kind="stable")]
        head = np.concatenate([[True], np.diff(key[order]) != 0])
        begin, group = np.flatnonzero(head), np.cumsum(head) - 1
        twice = np.diff(np.append(begin, len(order)))[group] > 1
        source[order[twice], a] = order[begin[group[twice]]]
    # Windows that differ by one word to the left and share a source make one span.
    turn = np.ones((n, w + 1), bool)
    turn[:, 1:w] = source[:, 1:] != source[:, :-1]
    edges = np.flatnonzero(turn.ravel())
    row, a = edges // (w + 1), edges % (w + 1)
    same = row[1:] == row[:-1]
    row, low, high = row[:-1][same], a[:-1][same], a[1:][same] - 1
    of = source[row, low]
    row, low, high, of = (x[of >= 0] for x in (row, low, high, of))
    taken = rows.column("tkey").take(pa.array(row))
    return pa.table({"tkey": taken, "begin": pa.array((at[row] - high).astype(np.int32)), "end": pa.array((at[row] - low + length).astype(np.int32)), "stays": pa.array(of == row), "source": rows.column("first").take(pa.array(of))})


def _merged(pairs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for b, e in sorted(pairs):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [{"begin": b, "end": e} for b, e in out]


def _spread(flat: DataFrame, length: int, windows: int) -> DataFrame:
    """Spans of kept suffixes too frequent for one task: rows of window hashes, summed before they are shuffled.

    Windows that make up a hundred-thousandth of all rows or more are few, and go to the rows; the others are joined.
    """
    flat = materialize(flat.withColumn("me", F.struct(F.col("first").isNull(), "first", "tkey", "at")), "flat")
    ends = flat.groupBy("w").agg(F.min("me").alias("lo"), F.max("me").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("w", "lo", "m")
    ends = materialize(ends, "ends")
    often = max(1_000, windows // 100_000)
    hot, rest = F.broadcast(ends.where(F.col("m") >= often).drop("m")), ends.where(F.col("m") < often).drop("m")
    met = flat.join(hot, "w").unionByName(flat.join(hot.select("w"), "w", "left_anti").join(rest, "w"))
    return met.select("tkey", F.col("at").alias("begin"), (F.col("at") + length).alias("end"), (F.col("me") == F.col("lo")).alias("stays"), F.col("lo.first").alias("source"))


def _marked(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """df with a flag that is false only where the key (binary) is not among keys (one column), so that rows
    without a partner need not move. The filter has a fixed number of bits: 4096 rows of 4 KB at most."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bucket, bits = scratch(df, "bucket"), scratch(df, "bits")
    chosen = keys.select(place(F.col(keys.columns[0])).alias("p")).distinct().select(F.shiftright("p", 15).cast("int").alias(bucket), F.col("p").bitwiseAND(F.lit(32767)).alias("p"))
    held = chosen.repartition(bucket).groupBy(bucket).agg(F.call_function("bitmap_construct_agg", F.col("p")).alias(bits))
    at = place(F.col(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flag = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    joined = df.join(F.broadcast(held), F.shiftright(at, 15).cast("int") == F.col(bucket), "left")
    return joined.withColumn(out, F.coalesce(F.col(key).isNotNull() & flag, F.lit(False))).drop(bucket, bits)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), F.col("text").cast("binary").alias("text"))


def find_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows has doc_id, tkey, n of the documents with at least length words; texts has, per distinct
    text with copies or repeats, tkey, first, copies, n and the lists repeated, removed (begin, end in words) and sources."""
    rows = materialize(_kept(docs, k, length), "kept")
    spark = docs.sparkSession
    texts = rows.groupBy("tkey").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"))
    kept = rows.groupBy("tkey").agg(F.first(F.arrays_zip("starts", "at")).alias("s")).select("tkey", F.explode("s").alias("s")).select("tkey", "s.starts", "s.at")
    common = materialize(kept.groupBy("starts").agg(F.count("*").alias("m")).where("m > 1"), "common")
    of = lambda flag: F.collect_list(F.when(flag, F.col("at")))
    places = kept.join(common.select("starts", (F.col("m") > hot).alias("hot")), "starts").groupBy("tkey").agg(of(~F.col("hot")).alias("places"), of(F.col("hot")).alias("often"))
    wanted = materialize(places.join(texts.select("tkey", "first"), "tkey"), "wanted")
    # Texts without a start in common stay where they are.
    found = _marked(_keyed(docs), "tkey", wanted.select("tkey"), "maybe").where("maybe").drop("maybe")
    found = found.join(wanted.hint("merge"), "tkey").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("tkey", "first", "text", "places", "often")
    if rows.groupBy("tkey", "doc_id").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(["tkey"])
    size = common.agg(F.sum("m"), F.max("m")).first()
    total, most = size[0] or 0, size[1] or 0
    spans = _span_schema(rows.schema["doc_id"].dataType)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from neighbour_spans(pa.Table.from_batches(held), length).to_batches()

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))
    out = _windows(found, k, length, False).repartition(tasks, "start").mapInArrow(lambda batches: released(run(batches)), spans)
    if most > hot:
        out = out.union(_spread(_windows(found, k, length, True), length, total * (length - k + 1)))
    gathered = out.groupBy("tkey").agg(F.collect_set(F.struct("begin", "end", "stays")).alias("spans"), F.collect_set("source").alias("sources"))
    pair = "array<struct<begin:int,end:int>>"
    schema = T.StructType([T.StructField("tkey", T.BinaryType()), T.StructField("repeated", T._parse_datatype_string(pair)), T.StructField("removed", T._parse_datatype_string(pair)), gathered.schema["sources"]])

    def merge(batches):
        for batch in batches:
            spans_ = batch.column(1).to_pylist()
            every = [_merged([(s["begin"], s["end"]) for s in x]) for x in spans_]
            gone = [_merged([(s["begin"], s["end"]) for s in x if not s["stays"]]) for x in spans_]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, kind), pa.array(gone, kind), batch.column(2)], names=schema.names)

    merged = gathered.mapInArrow(merge, schema)
    full = texts.join(merged, "tkey", "left").where("copies > 1 or repeated is not null")
    return rows, materialize(full, "texts")


def _first_rows(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """keyed (doc_id, tkey, ...) joined to texts, with ``copy``: whether another row with the same text comes first."""
    joined = keyed.join(texts, "tkey")
    mine = F.col("doc_id").eqNullSafe(F.col("first"))
    again = F.row_number().over(Window.partitionBy("tkey").orderBy(F.lit(1))) > 1
    return joined.where(mine).withColumn("copy", again).unionByName(joined.where(~mine).withColumn("copy", F.lit(True)))


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """Documents with a passage of ``length`` words or more that stands elsewhere too.

    doc_id, n_words, repeated and removed (lists of begin and end in words, end exclusive), n_repeated and
    n_removed (words in them), sources (doc_ids with the passages' first occurrences). One row per such row of docs.
    """
    rows, texts = find_repeats(docs, length, k, hot)
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    out = _first_rows(rows.select("doc_id", "tkey"), texts)
    out = out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("repeated", none)).alias("repeated"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(F.col("copy") | F.col("sources").isNull(), F.array("first")).otherwise(F.col("sources")).alias("sources"),
    )
    words = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", "repeated", "removed", words("repeated").alias("n_repeated"), words("removed").alias("n_removed"), "sources")


def cut_words(text: str, spans: list[dict]) -> str:
    """text without the words of spans and the white space after each of them."""
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, from_ = [], 0
    for s in spans:
        out.append(text[from_ : at[s["begin"]]])
        from_ = at[s["end"]]
    return "".join([*out, text[from_:]])


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """docs with only the first occurrence of each repeated passage; documents left without words go."""
    _, texts = find_repeats(docs, length, k, hot)
    tkey, first, removed, many, again, maybe = (scratch(docs, x) for x in ("tkey", "first", "removed", "many", "again", "maybe"))
    changed = texts.where("copies > 1 or size(removed) > 0").select(F.col("tkey").alias(tkey), F.col("first").alias(first), F.col("removed").alias(removed), (F.col("copies") > 1).alias(many))
    # Only texts that may have a verdict move to it; null texts have none.
    marked = _marked(docs.withColumn(tkey, F.unhex(F.md5(F.col("text").cast("binary")))), tkey, changed.select(tkey), maybe)
    joined = marked.where(F.col(maybe)).join(changed.hint("merge"), tkey, "left")
    copy = F.coalesce(F.col(many) & ~F.col("doc_id").eqNullSafe(F.col(first)), F.lit(False))
    kept = joined.where(~copy)
    if _repeated_rows(docs, changed.where(F.col(many)), tkey, first):
        place = F.when(F.coalesce(F.col(many), F.lit(False)), F.row_number().over(Window.partitionBy(tkey).orderBy(F.lit(1)))).otherwise(1)
        kept = kept.withColumn(again, place).where(F.col(again) == 1)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts_, gone = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            new = [cut_words(t, g) if g and t is not None else t for t, g in zip(texts_, gone, strict=True)]
            stay = pa.array([not g or bool(t and t.strip(" \t\n\x0b\x0c\r")) for t, g in zip(new, gone, strict=True)], pa.bool_())
            columns = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stay)

    return marked.where(~F.col(maybe)).select(*names).union(kept.select(*names, removed).mapInArrow(lambda batches: released(run(batches)), docs.schema))


def _repeated_rows(docs: DataFrame, copied: DataFrame, tkey: str, first: str) -> bool:
    """Whether a first copy stands in several rows."""
    many = copied.select(F.col(tkey).alias("tkey"), F.col(first).alias("first"))
    rows = _keyed(docs).select("doc_id", "tkey").join(many, "tkey").where(F.col("doc_id").eqNullSafe(F.col("first")))
    return bool(rows.groupBy("tkey").count().where("count > 1").limit(1).count())
