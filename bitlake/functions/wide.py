"""Words of several 64-bit limbs as ARRAY<BIGINT>, lowest limb first; carries cross limbs, order is that of the top limb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions import words as W
from bitlake.functions.words import Let, inline, word


def limbs(x: Column, n: int) -> list[Column]:
    return [F.get(x, F.lit(i)) for i in range(n)]


def from_limbs(*parts: Column) -> Column:
    return F.array(*parts)


def and_(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseAND(b))


def or_(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseOR(b))


def xor(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))


def not_(x: Column) -> Column:
    return F.transform(x, F.bitwise_not)


def shl(x: Column, n: int, count: int) -> Column:
    W._within(n, 0, 64 * count - 1, "shift")
    part, q, r = limbs(x, count), n // 64, n % 64
    out = []
    for i in range(count):
        v = word(0)
        if i - q >= 0:
            v = F.shiftleft(part[i - q], r)
        if r and i - q - 1 >= 0:
            v = v.bitwiseOR(F.shiftrightunsigned(part[i - q - 1], 64 - r))
        out.append(v)
    return F.array(*out)


def shr(x: Column, n: int, count: int) -> Column:
    W._within(n, 0, 64 * count - 1, "shift")
    part, q, r = limbs(x, count), n // 64, n % 64
    out = []
    for i in range(count):
        v = word(0)
        if i + q < count:
            v = F.shiftrightunsigned(part[i + q], r)
        if r and i + q + 1 < count:
            v = v.bitwiseOR(F.shiftleft(part[i + q + 1], 64 - r))
        out.append(v)
    return F.array(*out)


def _below(a: Column, b: Column) -> Column:
    """a < b as unsigned numbers."""
    return a.bitwiseXOR(word(W.MIN)) < b.bitwiseXOR(word(W.MIN))


def wadd(x: Column, y: Column, count: int) -> Column:
    out, carry = [], F.lit(False)
    for a, b in zip(limbs(x, count), limbs(y, count), strict=True):
        s = W.wadd(a, b)
        t = W.wadd(s, carry.cast("long"))
        carry = _below(s, a) | (carry & (s == -1))
        out.append(t)
    return F.array(*out)


def wsub(x: Column, y: Column, count: int) -> Column:
    out, borrow = [], F.lit(False)
    for a, b in zip(limbs(x, count), limbs(y, count), strict=True):
        d = W.wsub(a, b)
        out.append(W.wsub(d, borrow.cast("long")))
        borrow = _below(a, b) | (borrow & (d == 0))
    return F.array(*out)


def wmul(x: Column, y: Column, count: int, let: Let = inline) -> Column:
    """x * y modulo the width of ``count`` limbs, by digits of 16 bits: sums of their products never overflow a BIGINT."""
    digits = lambda v: [let(F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF))) for a in limbs(v, count) for i in range(4)]
    a, b = digits(x), digits(y)
    out, carry = [], word(0)
    for k in range(4 * count):
        total = let(sum((a[i] * b[k - i] for i in range(k + 1)), carry))
        out.append(let(total.bitwiseAND(F.lit(0xFFFF))))
        carry = F.shiftrightunsigned(total, 16)
    join = lambda d: d[0].bitwiseOR(F.shiftleft(d[1], 16)).bitwiseOR(F.shiftleft(d[2], 32)).bitwiseOR(F.shiftleft(d[3], 48))
    return F.array(*[join(out[4 * i : 4 * i + 4]) for i in range(count)])


def count_ones(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, a: s + F.bit_count(a))


def trailing_zeros(x: Column, count: int) -> Column:
    out = F.lit(64 * count)
    for i, p in reversed(list(enumerate(limbs(x, count)))):
        out = F.when(p != 0, W.trailing_zeros(p) + 64 * i).otherwise(out)
    return F.when(x.isNotNull(), out)


def leading_zeros(x: Column, count: int) -> Column:
    out = F.lit(64 * count)
    for i, p in enumerate(limbs(x, count)):
        out = F.when(p != 0, W.leading_zeros(p) + 64 * (count - 1 - i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def clear_lowest_set(x: Column, count: int) -> Column:
    done, out = F.lit(False), []
    for p in limbs(x, count):
        out.append(F.when(done, p).otherwise(W.clear_lowest_set(p)))
        done = done | (p != 0)
    return F.array(*out)


def select_lowest(x: Column, k: Column, count: int, let: Let = inline) -> Column:
    """Place of the k-th set bit, the width where there is none: the limb first, then the place in it."""
    at, limb, left, found = F.lit(64 * count), word(0), k, F.lit(False)
    for i, p in enumerate(limbs(x, count)):
        here = let(~found & (left >= 0) & (left < F.bit_count(p)))
        at, limb = F.when(here, 64 * i).otherwise(at), F.when(here, p).otherwise(limb)
        found = let(found | here)
        left = let(F.when(found, left).otherwise(left - F.bit_count(p)))
    at, limb = let(at), let(limb)
    return F.when(found, at + W.select_lowest(limb, left, let)).otherwise(at)


def xor_scan(x: Column, count: int) -> Column:
    out, odd = [], F.lit(False)
    for p in limbs(x, count):
        s = W.xor_scan(p)
        out.append(F.when(odd, F.bitwise_not(s)).otherwise(s))
        odd = odd != W.parity(p)
    return F.array(*out)


def xor_scan_down(x: Column, count: int) -> Column:
    out, odd = [], F.lit(False)
    for p in reversed(limbs(x, count)):
        s = W.xor_scan_down(p)
        out.append(F.when(odd, F.bitwise_not(s)).otherwise(s))
        odd = odd != W.parity(p)
    return F.array(*out[::-1])


def low_ones(n: Column, count: int) -> Column:
    return F.array(*[W.low_ones(F.greatest(n - 64 * i, F.lit(0))) for i in range(count)])


def splat_byte(b: Column, count: int) -> Column:
    return F.array_repeat(W.splat_byte(b), count)


def low_byte(x: Column) -> Column:
    return W.low_byte(F.get(x, F.lit(0)))


def bit(x: Column, i: Column) -> Column:
    return W.bit(F.get(x, F.expr("0") + F.shiftright(i.cast("int"), 6)), i.bitwiseAND(F.lit(63)))


def compare(x: Column, y: Column, count: int) -> Column:
    """-1, 0 or 1 as x is below, equal to or above y."""
    out = F.lit(0)
    for a, b in zip(limbs(x, count), limbs(y, count), strict=True):
        out = F.when(_below(a, b), -1).when(_below(b, a), 1).otherwise(out)
    return out
