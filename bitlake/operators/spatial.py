"""Rectangles on points: an index is a table sorted by curve key, a query a few key ranges that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.operators import curves
from bitlake.plans import cover as plan


def build_index(df: DataFrame, path: str, x: Column, y: Column, key: str = "cell_key", curve: str = "hilbert", order: int = curves.ORDER2, files: int | None = None, block_bytes: int = 1 << 20) -> None:
    """Write df sorted by key: range partitions, each sorted, in row groups small enough for their key bounds to prune."""
    keyed = curves.with_key(df, key, x, y, curve, order)
    files = files or max(1, df.sparkSession.sparkContext.defaultParallelism)
    ordered = keyed.repartitionByRange(files, key).sortWithinPartitions(key)
    ordered.write.option("parquet.block.size", block_bytes).parquet(path)


def key_predicate(key: Column, ranges: list[plan.Range]) -> Column:
    """An OR of BETWEENs, which Parquet scans take as a pushed filter."""
    return reduce(lambda a, b: a | b, [key.between(a, b) for a, b in ranges], F.lit(False))


def range_query(df: DataFrame, x: str, y: str, xs: tuple, ys: tuple, key: str = "cell_key", curve: str = "hilbert", order: int = curves.ORDER2, budget: int = 16) -> DataFrame:
    """Rows of an index (a table that holds its keys) inside the rectangle: key ranges first, then the exact test.

    Keys computed in the same plan would be computed once per range: write them with build_index() first.
    """
    ranges = plan.cover(curve, order, xs, ys, budget)
    exact = F.lit(True)
    for c, (low, high) in ((x, xs), (y, ys)):
        if low is not None:
            exact = exact & (F.col(c) >= low)
        if high is not None:
            exact = exact & (F.col(c) <= high)
    return df.where(key_predicate(F.col(key), ranges)).where(exact)


def zones_of_keys(df: DataFrame, key: str, rows: int = 1024) -> DataFrame:
    """(key, block, n) for every run of ``rows`` rows in key order: how many rows of a key stand in a block.

    Equal keys are counted first. Ranges of keys, written sorted, give each range the rows before it and each
    key its first place; a frequent key spans many blocks, which are spelt out in two steps.
    """
    from bitlake import sources

    spark = df.sparkSession
    counted = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("c"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    path = sources.scratch_path(spark, "keys")
    counted.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.schema("key long, c long, part int").parquet(path)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    before = held.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("c").over(within), F.lit(0)))
    first, last = F.expr(f"start div {rows}"), F.expr(f"(start + c - 1) div {rows}")
    step = 1 << 16
    runs = placed.select("key", "start", "c", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("b"), last.alias("last"))
    blocks = runs.select("key", "start", "c", F.explode(F.sequence("b", F.least(F.col("b") + step - 1, F.col("last")))).alias("block"))
    n = F.least(F.col("start") + F.col("c"), (F.col("block") + 1) * rows) - F.greatest("start", F.col("block") * rows)
    return blocks.select("key", "block", n.alias("n"))


def zone_map(df: DataFrame, key: str, rows: int = 1024) -> DataFrame:
    """(block, first, last, rows) of runs of ``rows`` rows in key order; the last may be shorter. Null keys stand first."""
    return zones_of_keys(df, key, rows).groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("n").alias("rows"))


def prune(zones: DataFrame, xs: tuple, ys: tuple, curve: str = "hilbert", order: int = curves.ORDER2) -> DataFrame:
    """The blocks of a zone map that can hold a point of the rectangle."""
    from pyspark.sql import types as T

    schema = T.StructType(zones.schema.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            first, last = batch.column("first").to_pylist(), batch.column("last").to_pylist()
            yield batch.filter(pa.array([plan.intersects(curve, order, (a, b), xs, ys) for a, b in zip(first, last, strict=True)], pa.bool_()))

    return zones.mapInArrow(run, schema)


def range_join(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """points joined to every box (x0, x1, y0, y1, inclusive) they lie in.

    Both sides meet on cells of grids, so that the join is an equi-join. Each box has the level of its own longer
    side: its cells are at least as long as that, so that it touches four at most, however large other boxes are.
    Points get one cell on each level that a box has, of which there are at most 64.
    """
    b = boxes.where("x0 <= x1 and y0 <= y1")
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("long") + 1
    b = b.withColumn("__level", F.length(F.bin(side)))
    levels = sorted(r[0] for r in b.select("__level").distinct().collect())  # at most 64 numbers
    down = lambda c: F.call_function("shiftright", F.floor(c).cast("long"), F.col("__level"))
    b = b.withColumn("__cx", F.explode(F.sequence(down("x0"), down("x1")))).withColumn("__cy", F.explode(F.sequence(down("y0"), down("y1"))))
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__cx", down(x)).withColumn("__cy", down(y))
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return p.join(b, ["__level", "__cx", "__cy"]).where(inside).drop("__level", "__cx", "__cy")


def quadtree_rollup(df: DataFrame, key: str, levels: int) -> DataFrame:
    """Rows per cell ``levels`` levels up: (cell, n)."""
    return df.groupBy(F.shiftrightunsigned(F.col(key), 2 * levels).alias("cell")).agg(F.count("*").alias("n"))
