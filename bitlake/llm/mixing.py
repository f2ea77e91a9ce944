"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a token budget by water filling: shares in proportion to weights, stopped at
``max_epochs`` times the source's size, the excess shared again by weight. Within a source documents
stand in the order of a hash key; the hash prefix splits every source, hot ones included, into ranges
of bounded size, whose sums give each range its offset. A document's place in the running sum then
decides how much of it the last, partial epoch takes.

Defined cases: null or empty text has size 0 and is taken 0; a null source is a source of its own and
comes last; null and repeated doc_ids are ordinary rows (equal keys are ordered by id, then size); an
empty table gives an empty result; further columns of the input are neither read nor clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitlake.llm.common import WORD, materialize, scratch, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
ROWS_PER_RANGE = 20_000


def sized(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, skey (the source, never null) and hash key of every document, and the columns to keep."""
    return docs.select(
        "doc_id",
        *keep,
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("skey"),
        F.col("source").isNull().alias("snull"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals: skey, snull, source_size. Adds target (double), budget, epochs and rest (long).

    One row per source, so the windows below see the sources only, never documents.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy("snull", "skey")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % n + 1).cast("int")).cast("long")
    src = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "snull", "skey")
    everything = Window.partitionBy()
    src = src.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("w").over(everything) - F.sum("w").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")).alias("w_left"),
        (F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("cap_before"),
    )
    # The first source in level order that the shared level does not fill fixes the level for all after it.
    left = F.col("total") - F.col("cap_before")
    open_ = F.when(left * F.col("w") <= F.col("cap") * F.col("w_left"), F.struct((F.col("cap") / F.col("w")).alias("level"), "snull", "skey", left.alias("left"), "w_left"))
    src = src.withColumn("fix", F.min(open_).over(everything))
    share = (F.col("fix.left") * F.col("w")).cast("double") / F.col("fix.w_left")
    target = F.when(F.col("fix").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share))
    src = src.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    src = src.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    return src.select("skey", "source_size", "target", "epochs", "rest")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, source, text), then its columns to keep."""
    rows = materialize(sized(docs, seed, keep), "sized")
    digits, n = 1, rows.count()
    while n > rows_per_range * 16**digits and digits < 12:
        digits += 1
    # Rows without an id share one key: beside the ranges below and above it they make ranges by their size, next in the order.
    none = F.md5(F.lit(f"{seed}:"))
    side = F.when(F.col("key") < none, "0").when(F.col("key") > none, "2").otherwise(F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 12, "0")))
    rows = rows.withColumn("range", F.concat(F.substring("key", 1, digits), F.lit("-"), side))
    ranges = rows.groupBy("skey", "range").agg(F.sum("size").alias("range_size"), F.first("snull").alias("snull"))
    targets = source_targets(ranges.groupBy("skey").agg(F.first("snull").alias("snull"), F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = F.sum("range_size").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    ranges = ranges.select("skey", "range", before.alias("before")).join(targets, "skey")
    within = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(ranges, ["skey", "range"]).withColumn("upto", F.sum("size").over(within) - F.col("size") + F.col("before"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("upto")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document taken k times stands k times; one cut by its budget keeps its first words.

    Documents that the mix does not take go, and so do those without words. Each row has a key of its
    own, so that rows which share doc_id, source and size keep what each of them was given.
    """
    columns = docs.columns
    row, size, taken, i = (scratch(docs, x) for x in ("row", "size", "taken", "i"))
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    given = mix(keyed, **options, keep=(row,)).where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(taken))
    joined = keyed.join(given.hint("merge"), row)
    copies = joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.expr(f"cast((`{taken}` + `{size}` - 1) div `{size}` as int)"))))
    left = F.col(taken) - (F.col(i) - 1) * F.col(size)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")")), 1, left.cast("int")), "")
    text = F.when(left >= F.col(size), F.col("text")).otherwise(cut)
    return copies.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in columns])


#: DuckDB SQL for mix() over documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM t),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
        ((sum(w) OVER ()) - (sum(w) OVER o) + w)::BIGINT AS w_left, ((sum(cap) OVER o) - cap)::BIGINT AS cap_before FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT total - cap_before AS rest, w_left FROM l WHERE (total - cap_before) * w <= cap * w_left ORDER BY cap / w, source NULLS LAST LIMIT 1),
s AS (SELECT l.source, l.source_size, least(l.cap::DOUBLE, (f.rest * l.w)::DOUBLE / f.w_left) AS target FROM l, f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM s),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT d.doc_id, d.size, e.source_size, e.target,
  (e.epochs * d.size + greatest(0, least(d.size, e.budget - e.epochs * e.source_size
     - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size))))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
