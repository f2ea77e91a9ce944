"""Space-filling-curve keys as columns: Morton and Hilbert, in two and three dimensions.

2D keys take ``order`` bits per axis (31 by default, so that keys are never negative and BIGINT order is
key order); 3D keys take 21. Coordinates must lie below 2**order: higher bits are dropped. All stay in
generated JVM code; build them with words.layered() so that each round is a projection of its own, or use with_key().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitlake.functions import words as W
from bitlake.functions.words import LADDER2, LADDER3, Let, inline, ones, word

ORDER2, ORDER3 = 31, 21
MASK2, MASK3 = 0x5555555555555555, 0x1249249249249249


def morton2(x: Column, y: Column, let: Let = inline) -> Column:
    return W.spread(x, LADDER2, let).bitwiseOR(F.shiftleft(W.spread(y, LADDER2, let), 1))


def morton2_xy(key: Column, let: Let = inline) -> tuple[Column, Column]:
    return W.gather(key, LADDER2, let), W.gather(F.shiftrightunsigned(key, 1), LADDER2, let)


def morton3(x: Column, y: Column, z: Column, let: Let = inline) -> Column:
    parts = [W.spread(c, LADDER3, let) for c in (x, y, z)]
    return parts[0].bitwiseOR(F.shiftleft(parts[1], 1)).bitwiseOR(F.shiftleft(parts[2], 2))


def morton3_xyz(key: Column, let: Let = inline) -> tuple[Column, Column, Column]:
    return tuple(W.gather(F.shiftrightunsigned(key, i), LADDER3, let) for i in range(3))


def dilated_mask(d: int, width: int = 64) -> int:
    """Bits 0, d, 2d, ... of a word."""
    return sum(1 << i for i in range(0, width, d))


def dilated_width(d: int, width: int = 64) -> int:
    return -(-width // d)


def dilate(x: Column, d: int = 2, let: Let = inline) -> Column:
    return W.spread(x, {2: LADDER2, 3: LADDER3}[d], let)


def undilate(x: Column, d: int = 2, let: Let = inline) -> Column:
    return W.gather(x, {2: LADDER2, 3: LADDER3}[d], let)


def dilated_add(a: Column, b: Column, mask_: int = MASK2) -> Column:
    """Sum of dilated numbers, wrapping: filling the gaps lets carries through."""
    return W.wadd(a.bitwiseOR(word(~mask_)), b).bitwiseAND(word(mask_))


def dilated_incr(a: Column, mask_: int = MASK2) -> Column:
    return W.wadd(a.bitwiseOR(word(~mask_)), word(1)).bitwiseAND(word(mask_))


def dilated_decr(a: Column, mask_: int = MASK2) -> Column:
    return W.wsub(a, word(1)).bitwiseAND(word(mask_))


def morton_x(key: Column) -> Column:
    return key.bitwiseAND(word(MASK2))


def morton_y(key: Column) -> Column:
    return F.shiftrightunsigned(key, 1).bitwiseAND(word(MASK2))


def morton_with_x(key: Column, x: Column) -> Column:
    """key with its x replaced by a dilated one."""
    return key.bitwiseAND(word(~MASK2)).bitwiseOR(x)


def morton_with_y(key: Column, y: Column) -> Column:
    return key.bitwiseAND(word(MASK2)).bitwiseOR(F.shiftleft(y, 1))


def step_x(key: Column) -> Column:
    return morton_with_x(key, dilated_incr(morton_x(key)))


def step_y(key: Column) -> Column:
    return morton_with_y(key, dilated_incr(morton_y(key)))


def _turns(x: Column, low: Column, order: int, let: Let) -> tuple[Column, Column]:
    """Per level, whether the axes' difference and the complement are turned by the levels above.

    The curve's frame at a level is (u, c): c says that coordinates are complemented, u that they are
    complemented or swapped but not both. With the level's bits x and low = x xor y, a level maps
    (u, c) to (u + 1 + x + c, c) where low is 0 and to (u, c + x + u) where it is 1: affine maps over
    two bits. Their products over all higher levels come from a scan in log2(order) rounds, with one
    word for each entry of the maps' matrices and vectors.
    """
    all_ = word(ones(order))
    above = lambda v, s, fill: F.shiftrightunsigned(v, s).bitwiseOR(word(ones(order) & ~ones(max(order - s, 0)))) if fill else F.shiftrightunsigned(v, s)
    high = F.bitwise_not(low).bitwiseAND(all_)
    # Shifted by one: a level is turned by those above it.
    a = d = None
    b, c = let(above(high, 1, False)), let(above(low, 1, False))
    p, q = let(above(high.bitwiseAND(F.bitwise_not(x)), 1, False)), let(above(low.bitwiseAND(x), 1, False))
    a = d = all_
    s = 1
    while s < order:
        ah, bh, ch, dh, ph, qh = above(a, s, True), above(b, s, False), above(c, s, False), above(d, s, True), above(p, s, False), above(q, s, False)
        mul = lambda m, n, k, l: m.bitwiseAND(k).bitwiseXOR(n.bitwiseAND(l))  # noqa: E731, E741
        p2, q2 = mul(a, b, ph, qh).bitwiseXOR(p), mul(c, d, ph, qh).bitwiseXOR(q)
        if 2 * s < order:
            new = mul(a, b, ah, ch), mul(a, b, bh, dh), mul(c, d, ah, ch), mul(c, d, bh, dh)
            p, q = let(p2), let(q2)
            a, b, c, d = map(let, new)
        else:
            p, q = let(p2), let(q2)
        s *= 2
    return p, q


def hilbert2(x: Column, y: Column, order: int = ORDER2, let: Let = inline) -> Column:
    """The index on the curve of ``order`` levels (quadrants lower-left, upper-left, upper-right, lower-right)."""
    W._within(order, 1, 32, "order")
    x, y = let(x.bitwiseAND(word(ones(order)))), y.bitwiseAND(word(ones(order)))
    low = let(x.bitwiseXOR(y))
    u, c = _turns(x, low, order, let)
    high = let(x.bitwiseXOR(c.bitwiseXOR(u.bitwiseXOR(c).bitwiseAND(low))))
    return morton2(low, high, let)


def hilbert2_xy(key: Column, order: int = ORDER2, let: Let = inline) -> tuple[Column, Column]:
    """The coordinates: digits alone say which levels swap and complement, so two parities from the top give the frames."""
    W._within(order, 1, 32, "order")
    low, high = morton2_xy(key, let)
    low, high = let(low), let(high)
    complement = let(F.shiftrightunsigned(W.smear_down(let(low.bitwiseAND(high)), 32, "xor", let), 1))
    both = let(F.bitwise_not(low.bitwiseXOR(high)).bitwiseAND(word(ones(order))))
    swap = let(F.shiftrightunsigned(W.smear_down(both, 32, "xor", let), 1))
    a = let(high.bitwiseXOR(complement))
    differ = let(low.bitwiseAND(swap))
    return a.bitwiseXOR(differ).bitwiseAND(word(ones(order))), a.bitwiseXOR(low).bitwiseXOR(differ).bitwiseAND(word(ones(order)))


def hilbert_from_morton(key: Column, order: int = ORDER2, let: Let = inline) -> Column:
    x, y = morton2_xy(key, let)
    return hilbert2(let(x), let(y), order, let)


def morton_from_hilbert(key: Column, order: int = ORDER2, let: Let = inline) -> Column:
    x, y = hilbert2_xy(key, order, let)
    return morton2(x, y, let)


#: Fixed values of the 3D curve: for each index digit 0..7 the frame it leads to, as (factor, offset) in
#: the field of four elements 0, 1, w, w + 1, written 0, 1, 2, 3.
FRAMES3 = ((2, 0), (3, 0), (3, 0), (1, 1), (1, 1), (3, 2), (3, 2), (2, 3))
_POWER = (1, 2, 3)


def _times(a: int, b: int) -> int:
    return 0 if not a or not b else _POWER[(_POWER.index(a) + _POWER.index(b)) % 3]


def tables3() -> tuple[list[int], list[int]]:
    """(encode, decode): entry 8 * frame + octant (or digit) is 8 * frame below + digit (or octant)."""
    encode, decode = [0] * 96, [0] * 96
    for frame in range(12):
        factor, offset = _POWER[frame // 4], frame % 4
        for octant in range(8):
            parity = bin(octant).count("1") & 1
            element = ((octant & 1) ^ parity) | ((octant >> 2) ^ parity) << 1
            seen = _times(_times(factor, factor), element ^ offset)
            digit = parity | (seen & 1) << 1 | ((seen >> 1) ^ parity) << 2
            f, t = FRAMES3[digit]
            below = _POWER.index(_times(factor, f)) * 4 + (offset ^ _times(factor, t))
            encode[8 * frame + octant] = 8 * below + digit
            decode[8 * frame + digit] = 8 * below + octant
    return encode, decode


def _walk(code: Column, table: list[int], order: int, let: Let) -> Column:
    """Three bits per level from the top through a table of steps, one lookup a level."""
    steps, entry, out = F.array(*map(F.lit, table)), F.lit(0), word(0)
    for level in range(order - 1, -1, -1):
        digit = F.shiftrightunsigned(code, 3 * level).bitwiseAND(F.lit(7)).cast("int")
        entry = let(F.get(steps, entry.bitwiseAND(F.lit(~7)).bitwiseOR(digit)))
        out = let(out.bitwiseOR(F.shiftleft(entry.bitwiseAND(F.lit(7)).cast("long"), 3 * level)))
    return out


def hilbert3_from_morton(key: Column, order: int = ORDER3, let: Let = inline) -> Column:
    W._within(order, 1, 21, "order")
    return _walk(key, tables3()[0], order, let)


def morton3_from_hilbert(key: Column, order: int = ORDER3, let: Let = inline) -> Column:
    W._within(order, 1, 21, "order")
    return _walk(key, tables3()[1], order, let)


def hilbert3(x: Column, y: Column, z: Column, order: int = ORDER3, let: Let = inline) -> Column:
    """Index on the 3D curve of ``order`` levels: twelve frames, the walk starts in the first at every order."""
    W._within(order, 1, 21, "order")
    m = word(ones(order))
    return hilbert3_from_morton(let(morton3(*(c.bitwiseAND(m) for c in (x, y, z)), let)), order, let)


def hilbert3_xyz(key: Column, order: int = ORDER3, let: Let = inline) -> tuple[Column, Column, Column]:
    return morton3_xyz(let(morton3_from_hilbert(key, order, let)), let)


def with_key(df: DataFrame, out: str, x: Column, y: Column, curve: str = "hilbert", order: int = ORDER2) -> DataFrame:
    """df with a 2D key column; its metadata names the curve and its order."""
    build = {"hilbert": lambda let: hilbert2(x, y, order, let), "morton": lambda let: morton2(x.bitwiseAND(word(ones(order))), y.bitwiseAND(word(ones(order))), let)}[curve]
    return W.layered(df, **{out: build}).withMetadata(out, {"curve": curve, "order": order})


def with_xy(df: DataFrame, key: Column, x: str, y: str, curve: str = "hilbert", order: int = ORDER2) -> DataFrame:
    decode = {"hilbert": lambda let: hilbert2_xy(key, order, let), "morton": lambda let: morton2_xy(key, let)}[curve]
    pair: list = []
    def first(let):
        pair.extend(decode(let))
        return pair[0]
    return W.layered(df, **{x: first, y: lambda let: pair[1]})


def quantise(v: Column, low: float, high: float, order: int = ORDER2) -> Column:
    """The cell 0..2**order - 1 of a coordinate; what lies outside goes to the border cells."""
    top = (1 << order) - 1
    return F.least(F.greatest(F.floor((v - low) / (high - low) * top), F.lit(0)), F.lit(top)).cast("long")
