"""Fixed-width unsigned words in BIGINT columns (the bit pattern of the word, bit 0 the lowest).

Functions take and give Columns. ``width`` is the carrier's width (8, 16, 32 or 64); narrower words are
held masked. Plain + and - raise on overflow in ANSI mode, so sums wrap through try_add. Where an
intermediate is used several times it goes through ``let``: by default it is inlined, and
``layered()`` makes each one a projection of its own, so that expressions stay small and codegen whole.

Domain: a literal argument outside its documented range raises ValueError; null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN = -(1 << 63)
Let = Callable[[Column], Column]


def inline(c: Column) -> Column:
    return c


def signed(value: int) -> int:
    """A 64-bit pattern as BIGINT holds it."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def word(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def ones(width: int) -> int:
    return (1 << width) - 1


def mask(x: Column, width: int) -> Column:
    return x if width == 64 else x.bitwiseAND(word(ones(width)))


def layered(df: DataFrame, **outputs: Callable[[Let], Column]) -> DataFrame:
    """df with columns output = build(let); every let() becomes a projection below, gone from the result.

    Filter before this, or on a written result: a filter on an output would be pushed below the projections,
    with all that they compute written out in it.
    """
    state, made = df, []

    def let(c: Column) -> Column:
        nonlocal state
        made.append(f"__let{len(made)}")
        state = state.withColumn(made[-1], c)
        return F.col(made[-1])

    built = {name: build(let) for name, build in outputs.items()}
    return state.withColumns(built).drop(*made)


def and_(x: Column, y: Column) -> Column:
    return x.bitwiseAND(y)


def or_(x: Column, y: Column) -> Column:
    return x.bitwiseOR(y)


def xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def not_(x: Column, width: int = 64) -> Column:
    return mask(F.bitwise_not(x), width)


def shl(x: Column, n: int | Column, width: int = 64) -> Column:
    if isinstance(n, int):
        _within(n, 0, width - 1, "shift")
        return mask(F.shiftleft(x, n), width)
    shifted = F.call_function("shiftleft", x, n.cast("int"))
    return mask(F.when((n >= 0) & (n < width), shifted), width)


def shr(x: Column, n: int | Column, width: int = 64) -> Column:
    if isinstance(n, int):
        _within(n, 0, width - 1, "shift")
        return F.shiftrightunsigned(x, n)
    return F.when((n >= 0) & (n < width), F.call_function("shiftrightunsigned", x, n.cast("int")))


def _within(n: int, low: int, high: int, what: str) -> None:
    if not low <= n <= high:
        raise ValueError(f"{what} {n} is outside {low}..{high}")


def wadd(x: Column, y: Column, width: int = 64) -> Column:
    """x + y modulo 2**width. Where the signed sum overflows, flipping the top bit before and after does not."""
    if width < 64:
        return mask(x + y, width)
    return F.coalesce(F.try_add(x, y), F.try_add(xor(x, word(MIN)), y).bitwiseXOR(word(MIN)))


def wsub(x: Column, y: Column, width: int = 64) -> Column:
    if width < 64:
        return mask(x - y, width)
    return F.coalesce(F.try_subtract(x, y), F.try_subtract(xor(x, word(MIN)), y).bitwiseXOR(word(MIN)))


def wmul(x: Column, y: Column, width: int = 64) -> Column:
    """x * y modulo 2**width, from products of 32 by 16 bits, summed in halves."""
    if width <= 31:
        return mask(x * y, width)
    low, high = x.bitwiseAND(word(ones(32))), F.shiftrightunsigned(x, 32)
    part = [F.shiftrightunsigned(y, 16 * i).bitwiseAND(word(0xFFFF)) for i in range(4)]
    terms = [F.shiftleft(low * part[i], 16 * i) for i in range(4)] + [F.shiftleft(high * part[i], 32 + 16 * i) for i in range(2)]
    lower = sum((t.bitwiseAND(word(ones(32))) for t in terms[1:]), terms[0].bitwiseAND(word(ones(32))))
    upper = sum((F.shiftrightunsigned(t, 32) for t in terms[1:]), F.shiftrightunsigned(terms[0], 32)) + F.shiftrightunsigned(lower, 32)
    return mask(F.shiftleft(upper, 32).bitwiseOR(lower.bitwiseAND(word(ones(32)))), width)


def splat_byte(b: Column, width: int = 64) -> Column:
    b = b.cast("long").bitwiseAND(word(255))
    for s in (8, 16, 32):
        if s < width:
            b = b.bitwiseOR(F.shiftleft(b, s))
    return b


def low_byte(x: Column) -> Column:
    return x.bitwiseAND(word(255))


def count_ones(x: Column) -> Column:
    return F.bit_count(x)


def low_ones(n: Column, width: int = 64) -> Column:
    """The n lowest bits set; all of them for n >= width."""
    return F.when(n >= width, word(ones(width))).when(n >= 0, mask(F.bitwise_not(F.call_function("shiftleft", word(-1), n.cast("int"))), width))


def lowest_set_mask(x: Column) -> Column:
    """The lowest set bit alone; zero for zero."""
    return x.bitwiseAND(F.coalesce(F.try_add(F.bitwise_not(x), F.lit(1).cast("long")), word(MIN)))


def trailing_zeros(x: Column, width: int = 64) -> Column:
    below = F.bitwise_not(x).bitwiseAND(F.coalesce(F.try_subtract(x, F.lit(1).cast("long")), word(MIN - 1)))
    return F.bit_count(mask(below, width))


def smear_up(x: Column, width: int = 64, op: str = "or", let: Let = inline) -> Column:
    s = 1
    while s < width:
        y = mask(F.shiftleft(x, s), width)
        x = let(x.bitwiseOR(y) if op == "or" else x.bitwiseXOR(y))
        s *= 2
    return x


def smear_down(x: Column, width: int = 64, op: str = "or", let: Let = inline) -> Column:
    s = 1
    while s < width:
        y = F.shiftrightunsigned(x, s)
        x = let(x.bitwiseOR(y) if op == "or" else x.bitwiseXOR(y))
        s *= 2
    return x


def leading_zeros(x: Column, width: int = 64, let: Let = inline) -> Column:
    return F.lit(width) - F.bit_count(smear_down(x, width, let=let))


def trailing_ones(x: Column, width: int = 64) -> Column:
    return trailing_zeros(not_(x, width), width)


def leading_ones(x: Column, width: int = 64, let: Let = inline) -> Column:
    return leading_zeros(not_(x, width), width, let)


def clear_lowest_set(x: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(lowest_set_mask(x)))


def is_zero(x: Column) -> Column:
    return x == 0


def bit(x: Column, i: int | Column) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i >= 0) & (i < 64), F.getbit(x, i.cast("int")) == 1)


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2 == 1


def xor_scan(x: Column, width: int = 64, let: Let = inline) -> Column:
    return smear_up(x, width, "xor", let)


def xor_scan_down(x: Column, width: int = 64, let: Let = inline) -> Column:
    return smear_down(x, width, "xor", let)


def mask_runs(mask_: int, width: int = 64) -> list[tuple[int, int, int]]:
    """(start, length, place among the mask's bits) of each run of ones in a literal mask."""
    out, i, place = [], 0, 0
    while i < width:
        if mask_ >> i & 1:
            j = i
            while j < width and mask_ >> j & 1:
                j += 1
            out.append((i, j - i, place))
            place += j - i
            i = j
        else:
            i += 1
    return out


def pext(x: Column, mask_: int, width: int = 64) -> Column:
    """The bits of x under a literal mask, moved together at the low end: one shift per run of the mask."""
    out = word(0)
    for start, n, place in mask_runs(mask_ & ones(width), width):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, start).bitwiseAND(word(ones(n))), place))
    return out


def pdep(x: Column, mask_: int, width: int = 64) -> Column:
    """The low bits of x, moved to the places of a literal mask."""
    out = word(0)
    for start, n, place in mask_runs(mask_ & ones(width), width):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, place).bitwiseAND(word(ones(n))), start))
    return out


def _moved(x, m, spread: bool):
    x, m = x.to_numpy(np.int64).view(np.uint64), m.to_numpy(np.int64).view(np.uint64)
    out, place, one = np.zeros_like(x), np.zeros_like(x), np.uint64(1)
    for i in map(np.uint64, range(64)):
        on = (m >> i) & one
        out |= ((((x >> place) & on) << i) if spread else (((x >> i) & on) << place)).astype(np.uint64)
        place += on
    return out.view(np.int64)


def _column_mask(spread: bool):
    @F.pandas_udf("long")
    def move(x: pd.Series, m: pd.Series) -> pd.Series:
        known = x.notna() & m.notna()
        out = pd.Series(_moved(x.fillna(0).astype("int64"), m.fillna(0).astype("int64"), spread)).astype("Int64")
        out[~known.to_numpy()] = pd.NA
        return out

    return move


def pext_by(x: Column, mask_: Column) -> Column:
    """pext under a mask column; columns go through numpy in Arrow batches."""
    return _column_mask(False)(x, mask_)


def pdep_by(x: Column, mask_: Column) -> Column:
    return _column_mask(True)(x, mask_)


#: Fixed values: (shift, mask) of the rounds that spread or gather every second and every third bit.
LADDER2 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
LADDER3 = ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def spread(x: Column, ladder=LADDER2, let: Let = inline) -> Column:
    x = x.bitwiseAND(word(ones(32 if ladder is LADDER2 else 21)))
    for s, m in ladder:
        x = let(x.bitwiseOR(F.shiftleft(x, s)).bitwiseAND(word(m)))
    return x


def gather(x: Column, ladder=LADDER2, let: Let = inline) -> Column:
    x = x.bitwiseAND(word(ladder[-1][1]))
    masks = [m for _, m in ladder[-2::-1]] + [ones(32 if ladder is LADDER2 else 21)]
    for (s, _), m in zip(ladder[::-1], masks, strict=True):
        x = let(x.bitwiseOR(F.shiftrightunsigned(x, s)).bitwiseAND(word(m)))
    return x


def unzip(x: Column, let: Let = inline) -> tuple[Column, Column]:
    return gather(x, let=let), gather(F.shiftrightunsigned(x, 1), let=let)


def zip_(x: Column, y: Column, let: Let = inline) -> Column:
    return spread(x, let=let).bitwiseOR(F.shiftleft(spread(y, let=let), 1))


def select_lowest(x: Column, k: Column, let: Let = inline) -> Column:
    """The place of the k-th set bit (from 0), 64 where there is none: halving by popcounts."""
    k, at = k.cast("int"), F.lit(0)
    none = (k < 0) | (k >= F.bit_count(x))
    rest, want = x, k
    for half in (32, 16, 8, 4, 2, 1):
        low = let(F.bit_count(rest.bitwiseAND(word(ones(half)))))
        upper = let(want >= low)
        at = let(at + F.when(upper, half).otherwise(0))
        want, rest = let(want - F.when(upper, low).otherwise(0)), let(F.when(upper, F.shiftrightunsigned(rest, half)).otherwise(rest))
    return F.when(none, 64).otherwise(at)
