"""Bitmaps as tables of words: (bitmap_id, word_idx, word), bit i of word j at place 64 * j + i; absent words are zero.

A rank/select directory holds the set bits before each word. Sums go through blocks of words, so a
single bitmap of any length is spread over tasks: first block totals, then words within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.functions import bits as B
from bitlake.functions import words as W
from bitlake.functions.words import word

ID, AT, WORD = "bitmap_id", "word_idx", "word"
#: Words per block of a directory.
BLOCK = 4096
#: select() groups set bits by their number shifted by this.
GROUP = 4


def from_positions(df: DataFrame, bitmap_id: Column, position: Column) -> DataFrame:
    one = F.call_function("shiftleft", word(1), position.bitwiseAND(F.lit(63)).cast("int"))
    return df.where(position >= 0).groupBy(bitmap_id.alias(ID), F.shiftright(position.cast("long"), 6).alias(AT)).agg(F.bit_or(one).alias(WORD))


def positions(bitmap: DataFrame) -> DataFrame:
    """(bitmap_id, position) of every set bit."""
    return bitmap.select(ID, AT, F.explode(B.positions(F.col(WORD))).alias("i")).select(ID, (F.col(AT) * 64 + F.col("i")).alias("position"))


def count_ones(bitmap: DataFrame) -> DataFrame:
    return bitmap.groupBy(ID).agg(F.sum(F.bit_count(WORD)).alias("ones"))


def extent(bitmap: DataFrame) -> DataFrame:
    """(bitmap_id, words, bits, is_empty): the length up to the last word held, absent words included, and whether no bit is set."""
    words = F.max(AT) + 1
    return bitmap.groupBy(ID).agg(words.alias("words"), (words * 64).alias("bits"), (F.bit_or(WORD) == 0).alias("is_empty"))


def followed(bitmap: DataFrame, gap: int) -> DataFrame:
    """(bitmap_id, position) of the set bits whose next set bit is exactly ``gap`` places on."""
    asked = positions(bitmap).select(ID, (F.col("position") + 1).alias("position"))
    return next_set_from(bitmap, asked).where(F.col("next") == F.col("position") + gap - 1).select(ID, (F.col("position") - 1).alias("position"))


def bit(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (bitmap_id, position) with ``bit``; null past the last word."""
    return _at(bitmap.select(ID, AT, WORD), queries).withColumn("bit", F.getbit(WORD, F.col("position").bitwiseAND(F.lit(63)).cast("int")) == 1).drop(AT, WORD)


def _at(words: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.withColumn(AT, F.shiftright("position", 6)).join(words, [ID, AT], "left")


def set_bits(bitmap: DataFrame, changes: DataFrame) -> DataFrame:
    """bitmap with the positions of changes (bitmap_id, position) set."""
    return bitmap.select(ID, AT, WORD).unionByName(from_positions(changes, F.col(ID), F.col("position"))).groupBy(ID, AT).agg(F.bit_or(WORD).alias(WORD))


def clear_bits(bitmap: DataFrame, changes: DataFrame) -> DataFrame:
    gone = from_positions(changes, F.col(ID), F.col("position")).withColumnRenamed(WORD, "gone")
    return bitmap.join(gone, [ID, AT], "left").select(ID, AT, F.col(WORD).bitwiseAND(F.bitwise_not(F.coalesce("gone", word(0)))).alias(WORD))


def combine(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """and, or, xor or andnot of two bitmap tables, word by word."""
    l, r = left.select(ID, AT, F.col(WORD).alias("l")), right.select(ID, AT, F.col(WORD).alias("r"))  # noqa: E741
    join = {"and": "inner", "andnot": "left", "or": "full", "xor": "full"}[how]
    a, b = F.coalesce("l", word(0)), F.coalesce("r", word(0))
    out = {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "andnot": a.bitwiseAND(F.bitwise_not(b))}[how]
    return l.join(r, [ID, AT], join).select(ID, AT, out.alias(WORD)).where(F.col(WORD) != 0)


def directory(bitmap: DataFrame, block: int = BLOCK) -> DataFrame:
    """bitmap with ``before`` (set bits of earlier words) and ``ones`` (of this one)."""
    d = bitmap.select(ID, AT, WORD).withColumn("ones", F.bit_count(WORD).cast("long")).withColumn("blk", F.floor(F.col(AT) / block))
    sums = d.groupBy(ID, "blk").agg(F.sum("ones").alias("s"))
    upto = Window.partitionBy(ID).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(ID, "blk", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy(ID, "blk").orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(sums, [ID, "blk"]).select(ID, AT, WORD, "ones", (F.col("base") + F.coalesce(F.sum("ones").over(within), F.lit(0))).alias("before"))


def _directory(bitmap: DataFrame) -> DataFrame:
    """bitmap itself where it is a directory already, such as a stored one; else the directory of its words."""
    return bitmap if {"before", "ones"} <= set(bitmap.columns) else directory(bitmap)


def _merged(words: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with the distinct words asked for, flagged ``asked``; the blocks of both). A block has a bounded
    number of words, so that windows over blocks spread one bitmap over tasks, however often one of its places is asked."""
    block = F.floor(F.col(AT) / BLOCK)
    wanted = queries.where("position is not null").select(ID, F.shiftright("position", 6).alias(AT)).distinct().withColumn("asked", F.lit(True))
    rows = words.withColumn("asked", F.lit(False)).unionByName(wanted, allowMissingColumns=True).withColumn("blk", block)
    return rows, wanted.select(ID, block.alias("blk")).distinct()


def _counted(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """(bitmap_id, word_idx, word, before) of every word asked for, present or not."""
    d = _directory(bitmap).select(ID, AT, WORD, "before", "ones")
    rows, blocks = _merged(d, queries)
    upto = Window.partitionBy(ID, "blk").orderBy(AT, "asked").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(~F.col("asked"), F.struct(AT, WORD, "before", "ones")), ignorenulls=True).over(upto)
    found = rows.withColumn("near", near).where("asked").select(ID, AT, "blk", "near")
    # Where a block has no word at or before the one asked for, the blocks before it say how many bits they hold.
    tops = d.groupBy(ID, F.floor(F.col(AT) / BLOCK).alias("blk")).agg(F.max(F.col("before") + F.col("ones")).alias("top")).unionByName(blocks, allowMissingColumns=True)
    earlier = Window.partitionBy(ID).orderBy("blk").rangeBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("base", F.max("top").over(earlier)).groupBy(ID, "blk").agg(F.max("base").alias("base"))
    own = F.col(f"near.{AT}") == F.col(AT)
    before = F.when(own, F.col("near.before")).otherwise(F.coalesce(F.col("near.before") + F.col("near.ones"), "base", F.lit(0)))
    return found.join(tops, [ID, "blk"], "left").select(ID, AT, F.when(own, F.col(f"near.{WORD}")).alias(WORD), before.alias("before"))


def rank(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (bitmap_id, position) with ``rank``: set bits below the position. bitmap may be a directory, as
    read_directory() gives it; then nothing is counted anew. A null position has a null rank."""
    asked = queries.withColumn(AT, F.shiftright("position", 6)).join(_counted(bitmap, queries), [ID, AT], "left")
    inside = F.bit_count(F.col(WORD).bitwiseAND(W.low_ones(F.col("position").bitwiseAND(F.lit(63)))))
    value = F.when(F.col("position").isNotNull(), F.coalesce("before", F.lit(0)) + F.coalesce(inside, F.lit(0)))
    return asked.select(ID, "position", value.alias("rank"))


def rank0(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """Clear bits below each position; positions past the last word count to its end."""
    size = bitmap.groupBy(ID).agg(((F.max(AT) + 1) * 64).alias("size"))
    ranked = rank(bitmap, queries).join(size, ID, "left")
    return ranked.select(ID, "position", (F.least("position", F.coalesce("size", F.lit(0))) - F.col("rank")).alias("rank0"))


def select(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (bitmap_id, k) with ``position`` of the k-th set bit (from 0), null past the last. bitmap may be a directory.

    Words meet queries on groups of GROUP neighbouring bits, of which a word holds five at most and a group's words are as few.
    """
    last = F.col("before") + F.col("ones") - 1
    groups = F.explode(F.sequence(F.shiftright("before", GROUP), F.shiftright(last, GROUP)))
    held = _directory(bitmap).where("ones > 0").select(ID, AT, WORD, "before", "ones", groups.alias("group"))
    asked = queries.select(ID, F.col("k").cast("long").alias("k")).distinct().withColumn("group", F.shiftright("k", GROUP))
    met = asked.join(held, [ID, "group"]).withColumn("r", F.col("k") - F.col("before")).where("r >= 0 and r < ones").drop("group", "ones")
    # The filter must not be pushed below the rounds, so it comes first.
    found = W.layered(met, place=lambda let: W.select_lowest(F.col(WORD), F.col("r"), let))
    found = found.select(ID, "k", (F.col(AT) * 64 + F.col("place")).alias("position"))
    return queries.select(ID, F.col("k").cast("long").alias("k")).join(found, [ID, "k"], "left").select(ID, "k", "position")


def next_set_from(bitmap: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (bitmap_id, position) with ``next``: the first set bit at or after it, null past the last or for a null position."""
    words = bitmap.where(F.col(WORD) != 0).select(ID, AT, WORD)
    rows, blocks = _merged(words, queries)
    # From the block's end down: what has been passed lies behind, nearest last.
    down = Window.partitionBy(ID, "blk").orderBy(F.desc(AT), "asked").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.last(F.when(~F.col("asked"), F.struct(AT, WORD)), ignorenulls=True).over(down))
    rows = rows.withColumn("near", F.last(F.when(~F.col("asked"), F.struct(AT, WORD, "after")), ignorenulls=True).over(down)).where("asked")
    firsts = words.groupBy(ID, F.floor(F.col(AT) / BLOCK).alias("blk")).agg(F.min(F.struct(AT, WORD)).alias("first")).unionByName(blocks, allowMissingColumns=True)
    later = Window.partitionBy(ID).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    # A block may stand here as held and as asked for; the one that comes later in this order must not see its own twin.
    firsts = firsts.groupBy(ID, "blk").agg(F.min("first").alias("first"))
    firsts = firsts.withColumn("beyond", F.last("first", ignorenulls=True).over(later)).select(ID, "blk", "beyond")
    own = F.col(f"near.{AT}") == F.col(AT)
    then = F.coalesce(F.when(own, F.col("near.after")).otherwise(F.struct(f"near.{AT}", f"near.{WORD}")), "beyond")
    near = rows.join(firsts, [ID, "blk"], "left").select(ID, AT, F.when(own, F.col(f"near.{WORD}")).alias("own"), F.when(F.col("near").isNull(), F.col("beyond")).otherwise(then).alias("then"))
    asked = queries.withColumn(AT, F.shiftright("position", 6)).join(near, [ID, AT], "left")
    mine = F.col("own").bitwiseAND(F.bitwise_not(W.low_ones(F.col("position").bitwiseAND(F.lit(63)))))
    value = F.when(mine != 0, F.col(AT) * 64 + W.trailing_zeros(mine)).otherwise(F.col(f"then.{AT}") * 64 + W.trailing_zeros(F.col(f"then.{WORD}")))
    return asked.select(ID, "position", value.alias("next"))


def find_run(bitmap: DataFrame, k: int) -> DataFrame:
    """(bitmap_id, start) of the first run of k set bits (1..64), which may go on into the next word.

    Every word goes to its own place and, as the next one, to the place before: one grouped sum, no order.
    """
    W._within(k, 1, 64, "run")
    halves = F.explode(F.array(F.struct(F.col(AT).alias("at"), F.col(WORD).alias("low"), word(0).alias("high")), F.struct((F.col(AT) - 1).alias("at"), word(0).alias("low"), F.col(WORD).alias("high"))))
    d = bitmap.select(ID, halves.alias("h")).groupBy(ID, F.col("h.at").alias(AT)).agg(F.bit_or("h.low").alias("low"), F.bit_or("h.high").alias("high"))

    def starts(let):
        low, high, have = F.col("low"), F.col("high"), 1
        while have < k:
            # Two words as one of 128 bits: shifting down brings the next word's low bits in.
            step = min(have, k - have)
            moved = F.shiftrightunsigned(low, step).bitwiseOR(F.shiftleft(high, 64 - step)) if step < 64 else high
            low, high = let(low.bitwiseAND(moved)), let(high.bitwiseAND(F.shiftrightunsigned(high, step) if step < 64 else word(0)))
            have += step
        return low

    # Words without a start give null; a filter on them would be pushed below the rounds, and repeat them.
    d = W.layered(d, starts=starts)
    first = F.min(F.when(F.col("starts") != 0, F.col(AT) * 64 + W.trailing_zeros(F.col("starts"))))
    return d.groupBy(ID).agg(first.alias("start")).where("start is not null")


def filter_pack(values: DataFrame, mask: DataFrame) -> DataFrame:
    """The bits of values at the mask's set places, packed end to end: (bitmap_id, word_idx, word).

    The mask's directory gives each word's new place; its bits straddle at most two words there.
    """
    d = directory(mask).join(values.select(ID, AT, F.col(WORD).alias("value")), [ID, AT], "left")
    d = d.withColumn("packed", W.pext_by(F.coalesce("value", word(0)), F.col(WORD))).withColumn("s", F.col("before").bitwiseAND(F.lit(63)).cast("int"))
    low = F.struct(F.shiftright("before", 6).alias(AT), F.call_function("shiftleft", F.col("packed"), F.col("s")).alias(WORD))
    over = F.when(F.col("s") + F.col("ones") > 64, F.call_function("shiftrightunsigned", F.col("packed"), (F.lit(64) - F.col("s")).cast("int")))
    high = F.struct((F.shiftright("before", 6) + 1).alias(AT), over.alias(WORD))
    parts = d.where("ones > 0").select(ID, F.explode(F.array(low, high)).alias("p")).select(ID, f"p.{AT}", f"p.{WORD}").where(F.col(WORD).isNotNull())
    return parts.groupBy(ID, AT).agg(F.bit_or(WORD).alias(WORD))
