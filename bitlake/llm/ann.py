"""Approximate nearest neighbours by an inverted file with adaptive dimension scans.

Vectors are turned by a fixed random rotation, so that any run of dimensions is a fair sample of the
whole distance, and dealt to the list of their nearest centroid. A query probes the nearest lists.
Within a list the scan goes through blocks of columns: after each block a candidate's partial distance,
scaled up to all dimensions, is tested against the query's tenth best so far in its list, and the candidate is
abandoned once the test is surer than its margin ``epsilon`` allows to doubt. Survivors' distances are
computed anew from the original vectors in double precision.

Centroids come from a bounded sample (``sample`` vectors, in hash order); every vector is indexed. How
many lists a query probes is measured on the same sample: so many that they hold ``SHARE`` of the
sample's own nearest neighbours. Large lists are split into parts of bounded size by a hash of the id, so that copies of one vector spread.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, nor
do those whose length is not the most frequent one; null ids take no part; rows that repeat an id and a
vector are one candidate; an id with several vectors is as near as its nearest; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlake.llm.common import materialize

NEIGHBOURS = 10
QUERY_STEP = 100
SAMPLE = 20_000
BLOCK = 16
EPSILON = 2.1
PART = 20_000
#: Candidates that a query is held against before its bound is drawn tighter.
STEP = 2_048
#: Share of a sample's nearest neighbours that the probed lists must hold.
SHARE = 0.98


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 12) -> np.ndarray:
    """k-means on a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest centroids of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (c**2).sum(1) - 2 * (x[i : i + 4096] @ c.T)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, min(k, len(c))), np.int64)


def choose_probes(x: np.ndarray, center: np.ndarray, k: int, share: float = SHARE, asked: int = 256) -> int:
    """Lists to probe so that they hold the given share of sample vectors' nearest neighbours among the sample."""
    queries = x[:asked]
    order, home = nearest(queries, center, len(center)), nearest(x, center, 1)[:, 0]
    need = []
    for i, q in enumerate(queries):
        d = ((x - q) ** 2).sum(1)
        d[i] = np.inf
        place = np.empty(len(center), np.int64)
        place[order[i]] = np.arange(len(center))
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        need += place[home[near[np.isfinite(d[near])]]].tolist()
    return int(np.quantile(need, share, method="higher")) + 1 if need else len(center)


def scan(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON, turn: np.ndarray | None = None, step: int = STEP) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, distances) of its k nearest among vectors, ties to smaller ids, its own id left out.

    Candidates come in steps; after each the k-th best distance so far is the bound that the next are tested against.
    """
    dim = vectors.shape[1]
    turn = rotation(dim) if turn is None else turn
    columns = np.ascontiguousarray((vectors @ turn).T)  # column blocks: one dimension after the other
    out = []
    for q, me in zip(queries, own, strict=True):
        p, others = q @ turn, np.flatnonzero(ids != me)
        # The first candidates, scanned in full, give the first bound.
        head = others[: 4 * k]
        held, far, bound = head, ((columns[:, head] - p[:, None]) ** 2).sum(0), np.inf
        for first in range(len(head), len(others) + step, step):
            if len(held) > k:
                # Distances after the rotation differ by rounding only; ties at the edge stay for the exact comparison.
                edge = np.partition(far, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
                held, far = held[far <= edge], far[far <= edge]
            if len(held) >= k:
                bound = far.max()
            alive = others[first : first + step]
            part = np.zeros(len(alive))
            for s in range(0, dim, block):
                e = min(s + block, dim)
                part += ((columns[s:e, alive] - p[s:e, None]) ** 2).sum(0)
                if e < dim and bound < np.inf:
                    stay = part <= bound * (1 + 1e-9) * min(1.0, e / dim * (1 + epsilon / np.sqrt(e)) ** 2)
                    alive, part = alive[stay], part[stay]
            near = part <= bound
            held, far = np.concatenate([held, alive[near]]), np.concatenate([far, part[near]])
        exact = np.sqrt(((vectors[held] - q) ** 2).sum(1))
        best = np.lexsort((ids[held], exact))[:k]
        out.append((ids[held][best], exact[best]))
    return out


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(vec_col, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding"))
    return rows


def search(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, sample: int = SAMPLE, probes: int | None = None, part: int = PART, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by step."""
    spark = vectors.sparkSession
    kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = valid_vectors(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], kind)
    dim, n = sizes[0]
    rows = rows.where(F.size("embedding") == dim)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    turn = rotation(dim)
    lists = int(max(1, min(4096, round(np.sqrt(n) / 2))))
    some = np.array(some["embedding"].tolist()).reshape(-1, dim)
    center = centroids(some, lists)
    lists = len(center)
    probes = min(lists, probes or choose_probes(some, center, k))

    def assign(batches):
        for batch in batches:
            at = nearest(_matrix(batch.column(1), dim), center, 1)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), batch.column(0), batch.column(1)], names=["list", "vec_id", "embedding"])

    indexed = materialize(rows.mapInArrow(assign, "list int, vec_id long, embedding array<double>"), "ann").distinct()
    parts = {at: -(-m // part) for at, m in indexed.groupBy("list").count().collect()}  # at most 4096 rows
    split = np.array([parts.get(i, 0) for i in range(lists)], np.int64)
    # Ids with several vectors may stand in several lists, so only those with one are counted on.
    once = indexed.groupBy("vec_id").agg(F.count("*").alias("m"), F.min("list").alias("list")).where("m = 1").groupBy("list").count().collect()
    single = np.zeros(lists, np.int64)
    single[[at for at, _ in once]] = [m for _, m in once]
    n_parts = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in split]), F.col("list") + 1)
    indexed = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int"))

    def probe(batches):
        for batch in batches:
            at = nearest(_matrix(batch.column(1), dim), center, lists)
            # On to further lists until k candidates are held beside the query itself, or no list is left.
            enough = (np.cumsum(single[at], axis=1) <= k).sum(1) + 1
            row, place = np.nonzero(np.arange(lists) < np.maximum(probes, enough)[:, None])
            list_ = at[row, place]
            # Every part of a list that is probed.
            row, list_, n = np.repeat(row, split[list_]), np.repeat(list_, split[list_]), split[list_]
            part_ = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows_ = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(part_.astype(np.int32))], names=["list", "vec_id", "embedding", "part"])

    asked = rows.where(F.pmod("vec_id", F.lit(step)) == 0).distinct().mapInArrow(probe, "list int, vec_id long, embedding array<double>, part int")

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(kind.fields, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)})
        queries, found = _matrix(left.column("embedding").combine_chunks(), dim), []
        own, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        # An id with several vectors counts once per query, so room is kept for its other vectors.
        again = int(np.unique(ids, return_counts=True)[1].max())
        for me, (near, far) in zip(own, scan(queries, _matrix(right.column("embedding").combine_chunks(), dim), ids, own, k * again, turn=turn), strict=True):
            found.append((np.full(len(near), me), np.arange(len(near)), near, far))
        q, r, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(q), "rank": pa.array(r.astype(np.int32)), "vec_id": pa.array(v), "score": pa.array(d)})

    near = asked.groupBy("list", "part").cogroup(indexed.groupBy("list", "part")).applyInArrow(within, kind)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
