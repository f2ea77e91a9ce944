"""Vectors of bytes as ARRAY<INT> columns with entries 0..255, one lane an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.affine import REVERSE, Affine8
from bitlake.functions.words import word


def of_text(text: Column, offset: Column | int = 0, lanes: int = 16) -> Column:
    """Bytes offset..offset + lanes of a text's UTF-8 form; null if there are not so many."""
    part = F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, F.lit(lanes)))
    at = lambda i: F.conv(F.substring(part, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(part) == 2 * lanes, F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), at))


def splat(b: int, lanes: int = 16) -> Column:
    return F.array_repeat(F.lit(b & 255), lanes)


def zero(lanes: int = 16) -> Column:
    return splat(0, lanes)


def lane(x: Column, i: int) -> Column:
    return F.get(x, F.lit(i))


def _both(f):
    def op(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, f)

    return op


_and = lambda a, b: a.bitwiseAND(b)
and_ = _both(_and)
or_ = _both(lambda a, b: a.bitwiseOR(b))
xor = _both(lambda a, b: a.bitwiseXOR(b))
add = _both(lambda a, b: (a + b).bitwiseAND(F.lit(255)))
sub = _both(lambda a, b: (a - b).bitwiseAND(F.lit(255)))
add_sat = _both(lambda a, b: F.least(a + b, F.lit(255)))
sub_sat = _both(lambda a, b: F.greatest(a - b, F.lit(0)))
minimum = _both(lambda a, b: F.least(a, b))
maximum = _both(lambda a, b: F.greatest(a, b))
avg_floor = _both(lambda a, b: F.shiftright(a + b, 1))
avg_round = _both(lambda a, b: F.shiftright(a + b + 1, 1))
_flag = lambda c: F.when(c, 255).otherwise(0)
cmp_eq = _both(lambda a, b: _flag(a == b))
cmp_le = _both(lambda a, b: _flag(a <= b))
cmp_lt = _both(lambda a, b: _flag(a < b))
cmp_ge = _both(lambda a, b: _flag(a >= b))
cmp_gt = _both(lambda a, b: _flag(a > b))


def not_(x: Column) -> Column:
    return F.transform(x, lambda a: F.lit(255) - a)


def shl(x: Column, n: int) -> Column:
    return F.transform(x, lambda a: F.shiftleft(a, min(n, 8)).bitwiseAND(F.lit(255)))


def shr(x: Column, n: int) -> Column:
    return F.transform(x, lambda a: F.shiftright(a, min(n, 8)))


def lut16(x: Column, table: Column) -> Column:
    """table[low nibble], 0 where the top bit is set."""
    return F.transform(x, lambda a: F.when(a >= 128, 0).otherwise(F.element_at(table, a.bitwiseAND(F.lit(15)) + 1)))


def lut16_nibbles(x: Column, low: list[int], high: list[int]) -> Column:
    """low[low nibble] & high[high nibble], folded into one table of bytes."""
    table = F.lit([low[b & 15] & high[b >> 4] for b in range(256)])
    return F.transform(x, lambda a: F.element_at(table, a + 1))


def to_bitmask(x: Column) -> Column:
    """The top bit of each lane as bits of a word, lane 0 the lowest."""
    bits = F.transform(x, lambda a, i: F.call_function("shiftleft", F.shiftright(a, 7).cast("long"), i))
    return F.aggregate(bits, word(0), lambda s, b: s.bitwiseOR(b))


def blend(x: Column, y: Column, m: Column) -> Column:
    """Bits of y where m is set, of x elsewhere."""
    return xor(x, and_(xor(x, y), m))


def shuffle(x: Column, index: Column) -> Column:
    """Lane index mod lanes of x for each lane of index, 0 where its top bit is set."""
    return F.transform(index, lambda i: F.when(i >= 128, 0).otherwise(F.element_at(x, F.pmod(i, F.size(x)) + 1)))


def concat_shift(x: Column, y: Column, n: int) -> Column:
    """Lanes n, n + 1, ... of x followed by y, then zeros."""
    return F.slice(F.concat(x, y, F.transform(x, lambda a: F.lit(0))), min(n, 32) + 1, F.size(x))


def unpack_lo(x: Column, y: Column) -> Column:
    half = F.shiftright(F.size(x), 1)
    return F.flatten(F.zip_with(F.slice(x, F.lit(1), half), F.slice(y, F.lit(1), half), lambda a, b: F.array(a, b)))


def unpack_hi(x: Column, y: Column) -> Column:
    half = F.shiftright(F.size(x), 1)
    return F.flatten(F.zip_with(F.slice(x, half + 1, half), F.slice(y, half + 1, half), lambda a, b: F.array(a, b)))


def sum_abs_diff(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)


def mul_add_pairs(x: Column, w: Column) -> Column:
    """Per pair of lanes the dot product of unsigned x and signed w, held to 16 bits, little-endian in the pair's lanes."""
    products = F.zip_with(x, w, lambda a, b: a * F.when(b >= 128, b - 256).otherwise(b))
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x), 1) - 1), lambda k: F.element_at(products, 2 * k + 1) + F.element_at(products, 2 * k + 2))
    held = F.transform(pairs, lambda p: F.least(F.greatest(p, F.lit(-32768)), F.lit(32767)))
    return F.flatten(F.transform(held, lambda p: F.array(p.bitwiseAND(F.lit(255)), F.shiftright(p, 8).bitwiseAND(F.lit(255)))))


def affine(x: Column, by: Affine8) -> Column:
    table = F.lit(by.table())
    return F.transform(x, lambda a: F.element_at(table, a + 1))


def reverse_bits(x: Column) -> Column:
    return affine(x, REVERSE)


def sra(x: Column, n: int) -> Column:
    return affine(x, Affine8.sra(n))


def rotl(x: Column, n: int) -> Column:
    return affine(x, Affine8.rotl(n))


def rotr(x: Column, n: int) -> Column:
    return affine(x, Affine8.rotr(n))


def ternary(a: Column, b: Column, c: Column, table: int) -> Column:
    """Any boolean function of three vectors, bit by bit: bit 4a + 2b + c of the table."""
    out = F.transform(a, lambda v: F.lit(0))
    for case in range(8):
        if table >> case & 1:
            picked = [v if case >> s & 1 else not_(v) for v, s in ((a, 2), (b, 1), (c, 0))]
            out = or_(out, and_(and_(picked[0], picked[1]), picked[2]))
    return out
