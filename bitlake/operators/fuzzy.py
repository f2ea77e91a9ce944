"""Edit distance and approximate search over bytes.

Distances between whole strings run in the JVM: the bytes of the UTF-8 form, read as ISO-8859-1, are
characters, one each. Search within texts advances one bit-parallel column per byte in Python integers,
which hold patterns of any length; texts that cannot contain the pattern within k edits are dropped in the JVM
by a test for k + 1 exact pieces first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Remains of a string after deletions, so many at most, that fuzzy_join() spells out.
VARIANTS = 2048


def as_bytes(s: Column) -> Column:
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def distance(pattern: Column, text: Column, longest: int | None = None) -> Column:
    """Levenshtein distance in bytes; null for patterns longer than ``longest`` bytes, where that is given."""
    d = F.levenshtein(as_bytes(pattern), as_bytes(text))
    return d if longest is None else F.when(F.octet_length(pattern) <= longest, d)


def within(pattern: Column, text: Column, k: int) -> Column:
    """The distance where it is at most k, else null; the JVM stops early beyond k."""
    near = F.abs(F.octet_length(pattern) - F.octet_length(text)) <= k
    return F.nullif(F.when(near, F.levenshtein(as_bytes(pattern), as_bytes(text), k)), F.lit(-1))


def columns(pattern: bytes, text: bytes) -> Iterator[int]:
    """After each byte of text, the least distance of pattern to any stretch that ends there.

    Two integers hold where the column of the distance table rises and falls from row to row; adding the
    match bits to the rises carries matches down the column.
    """
    m = len(pattern)
    if not m:
        return
    full, top, at = (1 << m) - 1, 1 << (m - 1), {}
    for i, b in enumerate(pattern):
        at[b] = at.get(b, 0) | 1 << i
    rise, fall, score = full, 0, m
    for b in text:
        match = at.get(b, 0)
        diagonal = ((((match & rise) + rise) ^ rise) | match | fall) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        score += bool(up & top) - bool(down & top)
        up = up << 1 & full
        down = down << 1 & full
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        yield score


def search(pattern: bytes, text: bytes, k: int) -> list[tuple[int, int]]:
    """(end, distance) of every place where a stretch within k edits of the pattern ends."""
    return [(i, d) for i, d in enumerate(columns(pattern, text), 1) if d <= k]


def substring_distance(pattern: bytes, text: bytes) -> int:
    """The least distance of the pattern to any stretch of text, the empty one included."""
    return min(columns(pattern, text), default=len(pattern)) if pattern else 0


def _whole_distances(pattern: bytes, text: bytes) -> Iterator[int]:
    """Distance of pattern to text[:1], text[:2], ..."""
    row = list(range(len(pattern) + 1))
    for j, b in enumerate(text, 1):
        last, row[0] = row[0], j
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != b))
        yield row[-1]


def occurrences(pattern: bytes, text: bytes, k: int) -> list[tuple[int, int, int]]:
    """(start, end, distance): one per run of neighbouring ends, at its first best end; of equal starts that nearest the pattern's length."""
    out, m = [], len(pattern)
    ends = search(pattern, text, k)
    i = 0
    while i < len(ends):
        j = i
        while j + 1 < len(ends) and ends[j + 1][0] == ends[j][0] + 1:
            j += 1
        end, best = min(ends[i : j + 1], key=lambda e: (e[1], e[0]))
        back = text[max(0, end - m - best) : end][::-1]
        lengths = [(d, abs(n - m), n) for n, d in enumerate([m, *_whole_distances(pattern[::-1], back)])]
        out.append((end - min(lengths)[2], end, best))
        i = j + 1
    return out


def pieces(pattern: bytes, k: int) -> list[bytes]:
    """k + 1 pieces of the pattern, one of which any stretch within k edits holds unchanged."""
    n = min(k + 1, len(pattern))
    cuts = [i * len(pattern) // n for i in range(n + 1)]
    return [pattern[a:b] for a, b in zip(cuts, cuts[1:])]


def find(df: DataFrame, text: str, pattern: str, k: int, what: str = "occurrences") -> DataFrame:
    """df with a row for each occurrence (start, end, distance), or for each end (end, distance) with what = "search".

    Patterns must not be empty. Null texts have none. Texts without any of k + 1 pieces of the pattern cannot
    hold it and are dropped before they leave the JVM.
    """
    needle = pattern.encode()
    if not needle:
        raise ValueError("an empty pattern has no occurrences")
    fields = [T.StructField(n, T.IntegerType()) for n in (("start", "end", "distance") if what == "occurrences" else ("end", "distance"))]
    parts = pieces(needle, k) if k < len(needle) else None
    schema = T.StructType([*df.schema.fields, *fields])
    at, names = df.columns.index(text), [f.name for f in schema.fields]
    run_one = occurrences if what == "occurrences" else search

    def run(batches):
        for batch in batches:
            row, found = [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                hits = run_one(needle, t.encode(), k)
                row += [i] * len(hits)
                found += hits
            rows_ = pa.array(row, pa.int64())
            cols = [pa.array([f[j] for f in found], pa.int32()) for j in range(len(fields))]
            yield pa.RecordBatch.from_arrays([c.take(rows_) for c in batch.columns] + cols, names=names)

    kept = df.where(F.col(text).isNotNull())
    if parts is not None:
        kept = kept.where(reduce(lambda a, b: a | b, [F.contains(as_bytes(F.col(text)), F.lit(p.decode("latin-1"))) for p in parts]))
    return kept.mapInArrow(run, schema)


def with_substring_distance(df: DataFrame, text: str, pattern: str, out: str = "distance") -> DataFrame:
    needle = pattern.encode()
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            d = [None if t is None else substring_distance(needle, t.encode()) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def nearest(df: DataFrame, text: Column, pattern: str, n: int) -> DataFrame:
    """The n rows nearest to the pattern, ties by text: a top-k that keeps n rows per task."""
    return df.withColumn("distance", distance(F.lit(pattern), text)).orderBy("distance", text).limit(n)


def longest_varied(k: int, variants: int = VARIANTS) -> int:
    """The greatest length of a string that has at most ``variants`` ways to lose up to k places."""
    if k == 0:
        return (1 << 31) - 1
    m = k
    while sum(math.comb(m + 1, i) for i in range(k + 1)) <= variants:
        m += 1
    return m


def _variants(s: Column, k: int) -> Column:
    """64-bit hashes of s without any up to k of its characters."""
    every = step = F.array(s)
    for _ in range(k):
        shorter = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
        step = F.array_distinct(F.flatten(F.transform(F.filter(step, lambda v: F.length(v) > 0), shorter)))
        every = F.array_union(every, step)
    return F.transform(every, lambda v: F.xxhash64(v))


def _by_pieces(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Candidate pairs (i, j) of (i, x) and (j, y): a string within k edits of x holds one of k + 1 pieces of x, at most k places off."""
    n = k + 1
    cut = lambda i: f"({i} * m div {n})"
    a = a.withColumn("m", F.length("x"))
    owned = F.expr("CASE WHEN m < " + str(n) + " THEN array(struct(m, -1 AS i, '' AS p)) ELSE array(" + ", ".join(f"struct(m, {i} AS i, substr(x, {cut(i)} + 1, {cut(i + 1)} - {cut(i)}) AS p)" for i in range(n)) + ") END")
    keyed_a = a.select("i", F.explode(owned).alias("key"))
    b = b.select("j", "y", F.explode(F.sequence(F.greatest(F.length("y") - k, F.lit(0)), F.length("y") + k)).alias("m"))
    tries = ", ".join(f"struct(m, {i} AS i, substr(y, {cut(i)} + 1 + {d}, {cut(i + 1)} - {cut(i)}) AS p)" for i in range(n) for d in range(-k, k + 1))
    offsets = F.expr(f"CASE WHEN m < {n} THEN array(struct(m, -1 AS i, '' AS p)) ELSE array_distinct(array({tries})) END")
    return keyed_a.join(b.select("j", F.explode(offsets).alias("key")), "key").select("i", "j")


def fuzzy_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, k: int, variants: int = VARIANTS) -> DataFrame:
    """Rows of both sides whose distinct texts are within k edits, with ``distance``.

    Two strings within k edits become equal when each loses some k places or fewer. So strings meet on the
    hashes of what deletions leave of them, however much of their text all of them share. Texts with more
    than ``variants`` such remains are long; those meet on one of k + 1 pieces of the left one that the right one
    must hold unchanged, so that a piece common to very many long texts still makes many candidates. Texts
    travel as 64-bit hashes until the candidates are known; the distance is then taken from the texts, so
    that hashes decide nothing. Null texts match nothing.
    """
    a = left.select(F.col(left_text).alias("a")).where("a is not null").distinct().withColumn("x", as_bytes(F.col("a"))).withColumn("i", F.xxhash64("a"))
    b = right.select(F.col(right_text).alias("b")).where("b is not null").distinct().withColumn("y", as_bytes(F.col("b"))).withColumn("j", F.xxhash64("b"))
    most = longest_varied(k, variants)
    short, long = F.length("x") <= most, F.length("x") > most
    met = lambda d, me, s, keep: d.where(keep).select(me, F.explode(_variants(F.col(s), k)).alias("key"))
    pairs = met(a, "i", "x", short).join(met(b, "j", "y", F.length("y") <= most + k), "key").select("i", "j")
    if k:
        pairs = pairs.union(_by_pieces(a.where(long).select("i", "x"), b.where(F.length("y") > most - k).select("j", "y"), k))
    near = pairs.distinct().join(a, "i").join(b, "j").withColumn("distance", F.levenshtein("x", "y", k)).where("distance >= 0").select("a", "b", "distance")
    return left.join(near, F.col(left_text) == F.col("a")).join(right, F.col(right_text) == F.col("b")).drop("a", "b")
