"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits.

Fingerprints are compared once each, however many documents share one. A vantage-point tree deals the
distinct fingerprints into shards: each node sends a fingerprint left or right by its Hamming distance
to the node's vantage point. By the triangle inequality two linked fingerprints that part at a node
both lie within the radius of its border, so those on the left side of a border also visit the right
side, and every link is met in exactly one shard. A shard goes on splitting by the same rule until
few remain, and gives back a spanning forest of its links, never all pairs of a group. Components of
the forests' union come from rounds of contraction on distributed tables.

Defined cases: null and wordless texts have fingerprint zero, which links like any other; texts under
three words have one shingle, the whole sequence; repeated rows stay rows of their own; a null doc_id
never names a component unless all ids in it are null; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import materialize, released, scratch

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Rows whose texts a worker holds as Python values at once.
ROWS = 512
#: Distinct fingerprints per shard that the tree aims at, and tree nodes at most; shards split further by themselves.
SHARD = 8_192
MAX_SHARDS = 1 << 14
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else [b" ".join(words)]
    n = len(parts)
    h = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    seen = np.bincount((h.view(np.uint8).reshape(n, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()  # little-endian: bit i of the number stands at i
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row of docs (doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(lambda batches: released(run(batches)), schema)


def _distance(x: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(point)).astype(np.int16)


def _vantage(x: np.ndarray, rng) -> tuple[int, int]:
    """A vantage point among x and the distance at its middle, such that the middle is least crowded."""
    best = None
    for p in rng.choice(x, min(8, len(x)), replace=False):
        d = _distance(x, p)
        mid = int(np.median(d))
        crowd = np.count_nonzero(np.abs(d - mid) <= RADIUS)
        if best is None or crowd < best[0]:
            best = crowd, int(p), mid
    return best[1], best[2]


def plant(sample: np.ndarray, shards: int, seed: int = 1) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, middle, left, right) of a tree with about ``shards`` leaves; a child below zero is leaf ~child."""
    rng, nodes, leaves = np.random.default_rng(seed), [], iter(range(1 << 30))

    def grow(x: np.ndarray, want: int) -> int:
        if want < 2 or len(x) < 16:
            return ~next(leaves)
        point, mid = _vantage(x, rng)
        left = _distance(x, point) <= mid
        if left.all() or not left.any():
            return ~next(leaves)
        at = len(nodes)
        nodes.append(None)
        low = round(want * float(left.mean()))
        nodes[at] = point, mid, grow(x[left], low), grow(x[~left], want - low)
        return at

    root = grow(sample, shards)
    return nodes if root >= 0 else []


def route(x: np.ndarray, nodes: list, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index into x, home) of every shard that each fingerprint belongs to or visits."""
    if not nodes:
        return np.zeros(len(x), np.int32), np.arange(len(x)), np.ones(len(x), bool)
    out, held = [], [(0, np.arange(len(x)), np.ones(len(x), bool))]
    while held:
        node, at, home = held.pop()
        if node < 0:
            out.append((np.full(len(at), ~node, np.int32), at, home))
            continue
        point, mid, left, right = nodes[node]
        d = _distance(x[at], point)
        low = np.where(home, d <= mid, d <= mid + radius)
        high = d > mid - radius
        for child, mine, own in ((left, low, home[low]), (right, high, home[high] & (d[high] > mid))):
            if mine.any():
                held.append((child, at[mine], own))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))


class Forest:
    """Roots of 0..n-1 under links given in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def link(x: np.ndarray, home: np.ndarray, radius: int = RADIUS, small: int = 1024) -> np.ndarray:
    """Roots of the forest over x that all links with at least one home end make."""
    forest, rng = Forest(len(x)), np.random.default_rng(2)

    def brute(h: np.ndarray, v: np.ndarray) -> None:
        of, step = x[h], max(1, (1 << 20) // max(1, len(h)))
        for own, rows in ((True, h), (False, v)):
            for i in range(0, len(rows), step):
                near = np.bitwise_count(x[rows[i : i + step], None] ^ of[None, i if own else 0 :]) <= radius
                a, b = np.nonzero(near)
                a, b = rows[i : i + step][a], h[i if own else 0 :][b]
                apart = a != b
                forest.join(a[apart], b[apart])

    held = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while held:
        h, v = held.pop()
        if len(h) <= small or len(h) + len(v) <= 2 * small:
            brute(h, v)
            continue
        point, mid = _vantage(x[h], rng)
        d, e = _distance(x[h], point), _distance(x[v], point)
        left, border = d <= mid, (d <= mid) & (d > mid - radius)
        if left.all() or not left.any() or border.sum() > 0.6 * len(h):
            brute(h, v)  # a tight group: no border keeps its members apart
            continue
        held.append((h[left], v[e <= mid + radius]))
        held.append((h[~left], np.concatenate([v[e > mid - radius], h[border]])))
    return forest.root


def forest_links(found: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """found: distinct fp. Links (a, b) whose components are those of all links within radius bits."""
    spark, n = found.sparkSession, found.count()
    shards = min(MAX_SHARDS, -(-n // shard))
    nodes = []
    if shards > 1:
        # 16 fingerprints a shard choose the tree; they decide where work goes, not what is found.
        sample = found.orderBy(F.xxhash64("fp"), "fp").limit(16 * shards).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        nodes = plant(sample, shards)

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            leaf, at, home = route(x, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def within(table: pa.Table) -> pa.Table:
        x = table.column("fp").to_numpy().view(np.uint64)
        root = link(x, table.column("home").to_numpy(zero_copy_only=False).astype(bool), radius)
        tied = root != np.arange(len(x))
        return pa.table({"a": pa.array(x[tied].view(np.int64)), "b": pa.array(x[root[tied]].view(np.int64))})

    dealt = found.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    links = dealt.groupBy("shard").applyInArrow(within, "a long, b long")
    return links.where("a <> b")


def contract(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): rounds in which each node points to its least neighbour.

    Pointers are followed twice a round and edges renamed to their ends' roots; those within one root
    go, so the table of edges shrinks until none is left.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "up")
        twice = up.select("node", F.col("root").alias("mid")).join(up.select(F.col("node").alias("mid"), "root"), "mid").select("node", "root")
        thrice = materialize(twice.select("node", F.col("root").alias("mid")).join(up.select(F.col("node").alias("mid"), "root"), "mid").select("node", "root"), "up")
        named = edges.join(thrice.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(thrice.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = materialize(named.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
        if roots is None:
            roots = thrice
        else:
            moved = thrice.select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text)."""
    rows = materialize(fingerprints(docs, shingle, seed), "fp")
    return rows.join(_classes(rows, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of rows (doc_id, fp)."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = contract(forest_links(classes.select("fp"), radius))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """docs with a further column, the fingerprint."""
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = np.array([fingerprint(None if x is None else x.encode()) for x in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of its least doc_id (of rows that share it, the least text)."""
    rows = materialize(fingerprints(docs), "fp")
    classes = _classes(rows, radius)
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        name = scratch(docs, "id")
        stays = rows.join(classes, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name))
        return docs.join(stays, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    # Rows that share a doc_id are told apart by their fingerprints, and within a component by their texts.
    fp, root, component, first = (scratch(docs, x) for x in ("fp", "root", "component", "first"))
    named = classes.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component))
    least = _with_fingerprint(docs, fp).join(named, fp).where(F.col("doc_id").eqNullSafe(F.col(component)))
    place = F.row_number().over(Window.partitionBy(root).orderBy("text"))
    return least.withColumn(first, place).where(F.col(first) == 1).select(*docs.columns)
