"""A quality classifier on random-indexing word vectors.

Every word has a sparse random index vector: a few places of +1 or -1 that its hash chooses. A word's
context vector is the sum of the index vectors of its neighbours over all documents, kept for hash
buckets of words, so that the table has a fixed size whatever the vocabulary. Words appear twice: as
themselves (lower case) and as their shape (letters as a or A, digits as 0, runs shortened), so that
unseen words still say something. A document is the mean of its words' unit context vectors, the mean
of their index vectors, and the lengths of both means, which repetition makes large.

A two-layer network in numpy, trained on a bounded sample of the labelled rows (``max_rows``, in hash
order), scores these. A temperature fitted on a part of the sample kept from training calibrates it.

Folds: rows whose crc32 of the doc_id as text leaves ``held`` modulo ``folds`` are never learned from.

Defined cases: null and empty texts are scored, as documents without words (all measures zero); a null
doc_id counts as the id "" in the fold; without labels of both kinds the score is the labelled share
of label 1 (0.5 without labels); conflicting labels of one id count each; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.tokens import text_batches

DIM = 64
BUCKETS = 1 << 13
ONES = 2
REACH = 2
MAX_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
_STEP = 2 << 20
_BLOCK = 128
_SHAPES = re.compile(rb"([aA0])\1+")
_LETTERS = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


class _Words(dict):
    """word -> bucket of the word, bucket of its shape * 2**32."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = _SHAPES.sub(rb"\1", word.translate(_LETTERS))
        self[word] = both = zlib.crc32(b"w" + word.lower()) % BUCKETS | (zlib.crc32(b"s" + shape) % BUCKETS) << 32
        return both


_WORDS = _Words()


def index_vectors(dim: int = DIM, ones: int = ONES, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (BUCKETS, ones)), rng.choice([-1.0, 1.0], (BUCKETS, ones))


def _buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    return both & 0xFFFFFFFF, both >> 32


def context_sums(docs: DataFrame, dim: int = DIM, reach: int = REACH) -> np.ndarray:
    """The context vectors of all buckets, over all documents. Each task sends one table of fixed size."""
    place, sign = index_vectors(dim)

    def run(batches):
        sums, seen = np.zeros(BUCKETS * dim), False
        for batch in batches:
            for _, texts in text_batches(batch.column(0).to_pylist(), _STEP):
                seen = True
                # Texts are set apart by words of no bucket, so that windows stay within one text.
                gap = np.full(reach, -1, np.int64)
                split = [x for t in texts if t for x in (_buckets(t.split()), (gap, gap))]
                if not split:
                    continue
                kinds = [np.concatenate([s[i] for s in split]) for i in (0, 1)]
                n = len(kinds[0])
                for near in range(1, reach + 1):
                    for a, b in ((slice(near, n), slice(0, n - near)), (slice(0, n - near), slice(near, n))):
                        for me in kinds:
                            for other in kinds:
                                x, y = me[a], other[b]
                                both = (x >= 0) & (y >= 0)
                                x, y = x[both], y[both]
                                for k in range(place.shape[1]):
                                    sums += np.bincount(x * dim + place[y, k], sign[y, k], BUCKETS * dim)
        if seen:
            blocks = sums.astype(np.float32).reshape(BUCKETS // _BLOCK, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK * dim)
        for b in table.column("sums"):
            total += np.frombuffer(b.as_py(), np.float32)
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
    out = np.zeros((BUCKETS // _BLOCK, _BLOCK * dim))
    for block, sums in parts:  # a table of fixed size: BUCKETS vectors
        out[block] = np.frombuffer(sums, np.float64)
    return out.reshape(BUCKETS, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Pooler:
    """Document vectors from bucket tables."""

    def __init__(self, sums: np.ndarray):
        dim = sums.shape[1]
        place, sign = index_vectors(dim)
        index = np.zeros((BUCKETS, dim))
        np.add.at(index, (np.arange(BUCKETS)[:, None], place), sign)
        # What all words share says nothing about any of them.
        context = unit(sums)
        used = np.linalg.norm(sums, axis=1) > 0
        if used.any():
            context[used] = unit(context[used] - context[used].mean(0))
        self.table = np.concatenate([context, index], axis=1).astype(np.float32)
        self.size = 4 * dim + 5

    def pool(self, text: bytes | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.zeros(self.size)
        parts, norms = [], []
        for b in _buckets(words):
            mean = np.bincount(b, minlength=BUCKETS)
            used = np.flatnonzero(mean)
            mean = (mean[used] @ self.table[used]) / len(words)
            parts.append(mean)
            norms += [np.linalg.norm(mean[: len(mean) // 2]), np.linalg.norm(mean[len(mean) // 2 :])]
        return np.concatenate([*parts, norms, [np.log1p(len(words))]])


class Network:
    """Two layers, trained by Adam on the logistic loss; scores are divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 40, seed: int = 22):
        rng = np.random.default_rng(seed)
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = rng.permutation(len(y))
        aside = order[: max(1, len(y) // 5)]
        train = order[len(aside) :]
        if y[train].min() == y[train].max():
            train = order
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        d = z.shape[1]
        w = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=hidden) * np.sqrt(1 / hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                h = np.maximum(0, z[rows] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                g = (p - t[rows]) / len(rows)
                back = np.outer(g, w[2]) * (h > 0)
                grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum(keepdims=True)]
                step += 1
                for i, q in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * q
                    v[i] = 0.999 * v[i] + 0.001 * q * q
                    w[i] = w[i] - 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w = w
        logits, want = self._logits(x[aside]), t[aside]
        loss = lambda s: np.mean(np.logaddexp(0, -np.where(want > 0, 1, -1) * logits / s))
        self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -50, 50)
        return np.maximum(0, z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -500, 500)))


def fold(folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, held: int = HELD) -> tuple[Pooler, Network]:
    """Word vectors from all texts, and the network from at most max_rows labelled rows outside the held fold."""
    pooler = Pooler(context_sums(docs))
    shared = docs.sparkSession.sparkContext.broadcast(pooler.table)
    chosen = labels.where(F.col("quality").isin(0, 1) & (fold(folds) != held)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.col("text").cast("binary").alias("text"))
    if rows.count() > max_rows:  # ids may repeat among the documents, so the rows are bounded once more
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).limit(max_rows).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.select("quality", "text")

    def run(batches):
        pool = Pooler.__new__(Pooler)
        pool.table, pool.size = shared.value, 2 * shared.value.shape[1] + 5
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([pool.pool(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["quality", "x"])

    found = sorted(rows.mapInArrow(run, "quality int, x binary").collect(), key=lambda r: (bytes(r[1]), r[0]))
    x = np.array([np.frombuffer(r[1], np.float32) for r in found], np.float64).reshape(-1, pooler.size)
    return pooler, Network(x, np.array([r[0] for r in found]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    pooler, network = fit(docs, labels, max_rows, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast((pooler, network))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        pool, net = shared.value
        for batch in batches:
            for first, texts in text_batches(batch.column(2).to_pylist(), _STEP):
                score = net.scores(np.array([pool.pool(t) for t in texts]).reshape(-1, pool.size))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", (fold(folds) == held).alias("held_out"), F.col("text").cast("binary")).mapInArrow(run, schema)
