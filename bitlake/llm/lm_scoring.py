"""Log-probabilities of texts by context-tree weighting over bytes, with a word unigram beside it.

The model reads a text as its lower-cased (A-Z) words joined by single spaces and ended by a line end,
which holds what its tokens hold. A byte is eight binary decisions; each decision has a context tree
over the preceding bytes, up to ``depth``. A node's Krichevsky-Trofimov estimate and the product of its
children's weighted probabilities are mixed half and half at every depth, from the counts of the whole
training part. The weights that follow say, for each node, how far to trust it against longer contexts.

Counts of all (depth + 1)-byte strings of the training part are summed by Spark, and every one of them
is in the tree. Its deep levels stand in parts by the last ``TOP`` context bytes, each built on its own;
the levels above, which hold at most the contexts of two bytes, are summed from all parts and broadcast.
Each distinct string of any row gets its value once, in its part. Texts then add up values: those of
the ``max_strings`` most frequent strings are broadcast, all others joined; words likewise (``max_words``).
The two bounds say what is broadcast and change no result.

Defined cases: null and empty texts have the end token alone; without training documents the tree
gives each bit one half and the unigram has N = V = 0; a null doc_id counts as the id "" in the fold;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import materialize, scratch
from bitlake.llm.tokens import text_batches

DEPTH = 5
MAX_STRINGS = 1 << 19
MAX_WORDS = 1 << 17
END = b"\n"
_STEP = 1 << 20
TOP = 3
PART = 60_000


def normal(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.lower().split() if text else []


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (depth + 1)-byte strings that end at each byte of each text and at its end, and the texts' first codes.

    The last byte stands in the lowest eight bits. Before a text stand line ends.
    """
    pad = END * depth
    raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    code = raw[depth:].astype(np.uint64)
    for i in range(1, depth + 1):
        code |= raw[depth - i : len(raw) - i].astype(np.uint64) << np.uint64(8 * i)
    # A text of n bytes has n + 1 codes; then come depth - 1 line ends that belong to no text.
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(size + depth - 1)[:-1]]).astype(np.int64)
    keep = np.ones(len(code), bool)
    for d in range(depth - 1):
        keep[begin + size + d] = False
    return code[keep], np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[head], np.diff(np.append(head, len(codes)))


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, string, n): a row per distinct word (string null), end token (word null, string null) and string (word null)
    of docs (text, held_out). Strings that only held-out texts have come with n = 0; their words and ends do not count."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("string", T.LongType()), T.StructField("n", T.LongType())])

    def rows(words: Counter, codes: np.ndarray, n: np.ndarray):
        for i in range(0, len(codes), 1 << 18):
            c, m = codes[i : i + (1 << 18)], n[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c.view(np.int64)), pa.array(m.astype(np.int64))], names=schema.names)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], names=schema.names)

    def run(batches):
        words, ends, held, size = Counter(), 0, [], 0
        for batch in batches:
            apart = batch.column(1).to_pylist()
            for first, texts in text_batches(batch.column(0).to_pylist(), _STEP):
                split = [[], []]
                for t, out in zip(texts, apart[first : first + len(texts)], strict=True):
                    split[out].append(normal(t))
                for w in split[0]:
                    words.update(w)
                ends += len(split[0])
                for out, some in enumerate(split):
                    if some:
                        codes, n = _tally(strings([b" ".join(w) for w in some], depth)[0])
                        held.append((codes, n * (1 - out)))
                        size += len(codes)
                if size > 1_500_000 or len(words) > 200_000:
                    codes, n = _add(held)
                    yield from rows(words, codes, n)
                    words, held, size = Counter(), [], 0
        if held:
            yield from rows(words, *_add(held))
        if ends:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([ends], pa.int64())], names=schema.names)

    return docs.select(F.col("text").cast("binary"), "held_out").mapInArrow(run, schema).groupBy("word", "string").agg(F.sum("n").alias("n"))


def _add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[head], np.add.reduceat(n, head)


def frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """The rows whose count n is at least the least frequency that at most ``most`` rows reach."""
    bins = table.groupBy(F.floor(F.log2(n) * 8).alias("b")).count().collect()  # a few hundred rows
    kept, least = 0, None
    for b, m in sorted(map(tuple, bins), reverse=True):
        if kept + m > most:
            break
        kept, least = kept + m, b
    return table.where(F.lit(False)) if least is None else table.where(F.floor(F.log2(n) * 8) >= least)


def collected(table: DataFrame) -> list[pa.Array]:
    """The columns of table on the driver. As Arrow: rows as Python objects take some twenty times their size there."""
    return [c.combine_chunks() for c in table.toArrow().columns]


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""

    def lgamma(x: np.ndarray) -> np.ndarray:
        # Stirling's series after a shift by eight; errors stay under 1e-12.
        shift = np.zeros_like(x)
        for i in range(8):
            shift += np.log(x + i)
        y = x + 8
        return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


class ContextTree:
    """Per depth, sorted node keys (context bytes, then the byte's leading bits after a 1) with what prediction needs."""

    def __init__(self, d: np.ndarray, string: np.ndarray, n: np.ndarray, depth: int):
        self.depth, tables = depth, []
        for level in range(depth + 1):
            rows = np.flatnonzero(d == level)
            rows = rows[np.argsort(string[rows])]
            tables.append(self._nodes(string[rows].astype(np.uint64), n[rows].astype(np.float64)))
        self.key, self.one, self.rest, self.stop = [], [], [], []
        below = None
        for level in range(depth, -1, -1):
            key, a, b = tables.pop()
            own = _kt(a, b)
            if below is None:
                weighted, stop, rest = own, np.ones(len(key)), np.full(len(key), 0.5)
            else:
                up = np.searchsorted(key, below[0] & np.uint64((1 << (8 * level + 8)) - 1))
                left = np.maximum(0, a - np.bincount(up, below[1], len(key))), np.maximum(0, b - np.bincount(up, below[2], len(key)))
                longer = np.bincount(up, below[3], len(key)) + _kt(*left)
                weighted = np.logaddexp(own, longer) - np.log(2)
                stop = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
                rest = (left[1] + 0.5) / (left[0] + left[1] + 1)
            below = key, a, b, weighted
            self.key.insert(0, key)
            self.one.insert(0, ((b + 0.5) / (a + b + 1)).astype(np.float32))
            self.rest.insert(0, rest.astype(np.float32))
            self.stop.insert(0, stop.astype(np.float32))
        self.context = [(c := k >> np.uint64(8))[np.flatnonzero(np.diff(c, prepend=c[:1] + np.uint64(1)) != 0)] for k in self.key]

    @staticmethod
    def _nodes(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, zeros, ones) of the nodes that strings of one depth pass, from sorted codes. For each of a
        byte's bits the keys of sorted codes are sorted too, so that runs can be summed in place."""
        if not len(code):
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        context, symbol = code & ~np.uint64(255), code & np.uint64(255)
        parts = []
        for i in range(8):
            key = context | np.uint64(1 << i) | (symbol >> np.uint64(8 - i))
            bit = ((symbol >> np.uint64(7 - i)) & np.uint64(1)).astype(np.float64)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            one = np.add.reduceat(n * bit, head)
            parts.append((key[head], np.add.reduceat(n, head) - one, one))
        key, zero, one = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.argsort(key)
        return key[order], zero[order], one[order]

    def shorten(self, code: np.ndarray) -> np.ndarray:
        """Codes with the context bytes that the tree does not have replaced by a mark, so that equal predictions share a code."""
        out, open_ = code.copy(), np.ones(len(code), bool)
        for level in range(self.depth, 0, -1):
            at = np.flatnonzero(open_)
            known = self.context[level]
            if len(known):
                c = (code[at] >> np.uint64(8)) & np.uint64((1 << (8 * level)) - 1)
                i = np.minimum(np.searchsorted(known, c), len(known) - 1)
                hit = known[i] == c
            else:
                hit = np.zeros(len(at), bool)
            full = np.uint64((1 << (8 * level + 8)) - 1)
            out[at[hit]] = (code[at[hit]] & full) | np.uint64(level << 56)
            open_[at[hit]] = False
        out[open_] = code[open_] & np.uint64(255)
        return out

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the others; codes as shorten() gives them."""
        level_of = (code >> np.uint64(56)).astype(np.int64)
        code = code & np.uint64((1 << 56) - 1)
        context, symbol = code & ~np.uint64(255), code & np.uint64(255)
        total = np.zeros(len(code))
        for i in range(8):
            node = np.uint64(1 << i) | (symbol >> np.uint64(8 - i))
            one, seen = np.full(len(code), 0.5), np.zeros(len(code), bool)
            for level in range(self.depth, -1, -1):
                key = self.key[level]
                rows = np.flatnonzero(level_of >= level)
                if not len(key) or not len(rows):
                    continue
                want = (context[rows] & np.uint64((1 << (8 * level + 8)) - 1)) | node[rows]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                hit = key[at] == want
                rows, at = rows[hit], at[hit]
                inner = np.where(seen[rows], one[rows], self.rest[level][at])
                stop = self.stop[level][at].astype(np.float64)
                one[rows] = stop * self.one[level][at] + (1 - stop) * inner
                seen[rows] = True
            bit = ((symbol >> np.uint64(7 - i)) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(bit, one, 1 - one))
        return total


class WholeTree(ContextTree):
    """The tree of all strings: levels are put in from the deepest up, and those of another tree can stand above."""

    def __init__(self, depth: int, above: WholeTree | None = None):
        self.depth = depth
        names = ("key", "one", "rest", "stop")
        for name, kind in zip(names, (np.uint64, float, float, float), strict=True):
            setattr(self, name, list(getattr(above, name)) if above else [np.zeros(0, kind)] * (depth + 1))

    def put(self, level: int, key: np.ndarray, zero: np.ndarray, one: np.ndarray, longer: np.ndarray | None) -> np.ndarray:
        """Adds the nodes of a level, longer being the sum over their children's weighted; gives their own."""
        own = _kt(zero, one)
        self.key[level], self.one[level], self.rest[level] = key, (one + 0.5) / (zero + one + 1), np.full(len(key), 0.5)
        if longer is None:
            self.stop[level] = np.ones(len(key))
            return own
        self.stop[level] = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
        return np.logaddexp(own, longer) - np.log(2)

    def climb(self, level: int, nodes: tuple, last: int) -> tuple:
        """Puts in the levels from this one, with nodes (key, zeros, ones, longer), to last; gives the sums for the one above."""
        while True:
            key, zero, one, longer = nodes
            weighted = self.put(level, key, zero, one, longer)
            level -= 1
            up, at = np.unique(key & np.uint64((1 << (8 * max(level, 0) + 8)) - 1), return_inverse=True)
            nodes = up, *(np.bincount(at, x, len(up)) for x in (zero, one, weighted))
            if level < last:
                return nodes

    def grow(self, code: np.ndarray, n: np.ndarray, last: int) -> tuple:
        """climb() from counted strings of full depth."""
        code, n = code[n > 0], n[n > 0].astype(np.float64)
        order = np.argsort(code)
        return self.climb(self.depth, (*self._nodes(code[order], n[order]), None), last)


def values(table: DataFrame, depth: int = DEPTH, part: int = PART) -> DataFrame:
    """(string, n, value) with the log10 probability of each string's last byte, from (string, n), a row per string."""
    spark, low = table.sparkSession, min(TOP, depth)
    parts = int(max(1, -(-table.count() // part)))
    place = F.shiftrightunsigned("string", 8).bitwiseAND(F.lit((1 << (8 * low)) - 1).cast("long"))
    groups = table.withColumn("part", F.pmod(F.xxhash64(place), F.lit(parts)).cast("int")).groupBy("part")

    def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("string").to_numpy().view(np.uint64), rows.column("n").to_numpy()

    def sums(rows: pa.Table) -> pa.Table:
        key, *more = WholeTree(depth).grow(*columns(rows), low)
        return pa.table([pa.array(key.view(np.int64)), *map(pa.array, more)], names=["key", "zero", "one", "longer"])

    top = WholeTree(depth)
    if low:
        nodes = groups.applyInArrow(sums, "key long, zero double, one double, longer double")
        key, *more = collected(nodes.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "longer")]))
        order = np.argsort(key := key.to_numpy().view(np.uint64))
        top.climb(low - 1, (key[order], *(x.to_numpy()[order] for x in more)), 0)
    shared = spark.sparkContext.broadcast(top)

    def evaluate(rows: pa.Table) -> pa.Table:
        code, n = columns(rows)
        tree = WholeTree(depth, shared.value)
        tree.grow(code, n, low)
        return pa.table({"string": rows.column("string"), "n": rows.column("n"), "value": pa.array(tree.log10(code | np.uint64(depth << 56)))})

    return groups.applyInArrow(evaluate, "string long, n long, value double")


class Store:
    """Values of some codes, found by hash first and by bisection where two share a slot."""

    def __init__(self, code: np.ndarray, value: np.ndarray, bits: int = 21):
        order = np.argsort(code)
        self.code, self.value, self.shift = code[order], value[order], np.uint64(64 - bits)
        self.at = np.zeros(1 << bits, np.int32)
        self.at[self._slot(self.code)] = np.arange(len(code), dtype=np.int32)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's value, 0 where it has none here, and the indexes of those."""
        if not len(self.code):
            return np.zeros(len(code)), np.arange(len(code))
        at = self.at[self._slot(code)]
        miss = np.flatnonzero(self.code[at] != code)
        at[miss] = np.minimum(np.searchsorted(self.code, code[miss]), len(self.code) - 1)
        miss = miss[self.code[at[miss]] != code[miss]]
        out = self.value[at]
        out[miss] = 0
        return out, miss


_MODELS: dict[str, tuple] = {}


def fold(doc_id, folds: int = 5):
    """crc32 of doc_id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def score(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = DEPTH, max_strings: int = MAX_STRINGS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    table = materialize(counts(rows, depth), "counts")
    words = table.where("word is not null").select("word", "n")
    ends = table.where("word is null and string is null").agg(F.sum("n")).first()[0] or 0
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    known, c = collected(frequent(words, "n", max_words))
    known = known, np.log10((c.to_numpy() + 0.5) / below)
    every = materialize(values(table.where("string is not null").select("string", "n"), depth), "values")
    often, value = collected(frequent(every.where("n > 0"), "n", max_strings).select("string", "value"))
    shared = spark.sparkContext.broadcast(((often.to_numpy().view(np.uint64), value.to_numpy()), known))
    del often, value, known
    end_value = float(np.log10((ends + 0.5) / below))
    label = uuid.uuid4().hex  # a worker keeps one model, and knows it by this

    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("m", T.LongType())]))
    rid = scratch(docs, "rid")
    schema = T.StructType([T.StructField(rid, T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("known_", T.LongType()), T.StructField("base_", T.DoubleType()), T.StructField("score_", T.DoubleType()), T.StructField("rare", rare), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches):
        if label not in _MODELS:
            _MODELS.clear()
            store, known = shared.value
            _MODELS[label] = Store(*store), dict(zip(known[0].to_pylist(), known[1].tolist(), strict=True))
        store, known = _MODELS[label]
        kind = pa.struct([("word", pa.binary()), ("m", pa.int64())])
        for batch in batches:
            for first, texts in text_batches(batch.column(3).to_pylist(), _STEP):
                split = [normal(t) for t in texts]
                code, begin = strings([b" ".join(w) for w in split], depth)
                found, miss = store.find(code)
                at = pa.array(np.searchsorted(miss, np.append(begin, len(code))).astype(np.int32))
                codes = pa.ListArray.from_arrays(at, pa.array(code[miss].view(np.int64)))
                found = np.add.reduceat(found, begin)
                n_known, base, word, many, ends_ = [], [], [], [], [0]
                for w in split:
                    value = list(map(known.get, w))
                    other = Counter([x for x, v in zip(w, value) if v is None]) if None in value else {}
                    n_known.append(len(w) - sum(other.values()) + (ends > 0))
                    base.append(sum(v for v in value if v is not None) + end_value)
                    word += other.keys()
                    many += other.values()
                    ends_.append(len(word))
                part = batch.slice(first, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(many, pa.int64())], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([len(w) + 1 for w in split], pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(found, pa.float64()), lists, codes], names=schema.names)

    scored = materialize(rows.withColumn(rid, F.monotonically_increasing_id()).select(rid, "doc_id", "held_out", "text").mapInArrow(run, schema), "scored")
    looked = scored.select(rid, F.explode("rare").alias("r")).select(rid, F.col("r.word").alias("word"), F.col("r.m").alias("m")).join(words.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = looked.groupBy(rid).agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * F.log10((c + 0.5) / below)).alias("more_base"))
    deep = scored.select(rid, F.explode("codes").alias("string")).join(every.select("string", "value"), "string").groupBy(rid).agg(F.sum("value").alias("more_score"))
    out = scored.drop("rare", "codes").join(more, rid, "left").join(deep, rid, "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known_") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score_") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
