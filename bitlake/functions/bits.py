"""Combinators over words: runs, scans, fills, subsets, lanes of bytes, powers of two. See words for the conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions import words as W
from bitlake.functions.words import Let, inline, mask, ones, word

LOW_LANES = 0x0101010101010101
HIGH_LANES = 0x8080808080808080
SEVEN = 0x7F7F7F7F7F7F7F7F


def run_starts(x: Column, k: int, width: int = 64, let: Let = inline) -> Column:
    """Places p such that the k bits from p on are all set; every place for k = 0, none for k > width."""
    if k < 0:
        raise ValueError("a run has no negative length")
    if k == 0:
        return F.when(x.isNotNull(), word(ones(width)))
    if k > width:
        return F.when(x.isNotNull(), word(0))
    have = 1
    while have < k:
        step = min(have, k - have)
        x = let(x.bitwiseAND(F.shiftrightunsigned(x, step)))
        have += step
    return x


def has_run(x: Column, k: int, width: int = 64) -> Column:
    return run_starts(x, k, width) != 0


def longest_run(x: Column, width: int = 64) -> Column:
    return F.array_max(F.transform(F.split(F.bin(x), "0"), F.length))


def rank(x: Column, i: Column, width: int = 64) -> Column:
    """Set bits below place i."""
    return F.bit_count(x.bitwiseAND(W.low_ones(i, width)))


def select(x: Column, k: Column, let: Let = inline) -> Column:
    """The place of the k-th set bit, null where there is none."""
    return F.nullif(W.select_lowest(x, k, let), F.lit(64))


def first_set(x: Column) -> Column:
    return F.when(x != 0, W.trailing_zeros(x))


def last_set(x: Column, let: Let = inline) -> Column:
    return F.when(x != 0, F.bit_count(W.smear_down(x, let=let)) - 1)


def positions(x: Column, width: int = 64) -> Column:
    """Set places in ascending order, as an array to explode; reverse() gives them from the back."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(x, i) == 1)


def subsets(mask_: int) -> list[int]:
    """All subsets of a literal mask, ascending, as BIGINT patterns."""
    places = [i for i in range(64) if mask_ >> i & 1]
    if len(places) > 20:
        raise ValueError("a mask of more than 20 bits has too many subsets to list; use next_subset")
    out = [0]
    for p in places:
        out += [s | 1 << p for s in out]
    return [W.signed(s) for s in out]


def subsets_of(x: Column, width: int = 64) -> Column:
    """All subsets of each word, as an array to explode; null for words of more than 20 bits."""
    few = F.bit_count(x) <= 20
    grow = lambda out, p: F.concat(out, F.transform(out, lambda s: s.bitwiseOR(F.call_function("shiftleft", word(1), p))))
    return F.when(few, F.aggregate(positions(x, width), F.array(word(0)), grow))


def prefix_or(x: Column, width: int = 64, let: Let = inline) -> Column:
    return W.smear_up(x, width, "or", let)


def prefix_xor(x: Column, width: int = 64, let: Let = inline) -> Column:
    return W.smear_up(x, width, "xor", let)


def prefix_xor_carry(x: Column, carry: Column, let: Let = inline) -> tuple[Column, Column]:
    """Prefix parity of a word in a chain: (scan, carry out)."""
    scan = prefix_xor(x, let=let)
    out = F.when(carry, F.bitwise_not(scan)).otherwise(scan)
    return out, carry != W.parity(x)


def delta_xor(x: Column, width: int = 64) -> Column:
    return mask(x.bitwiseXOR(F.shiftleft(x, 1)), width)


def gray_encode(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 1))


def suffix_xor(x: Column, width: int = 64, let: Let = inline) -> Column:
    return W.smear_down(x, width, "xor", let)


gray_decode = suffix_xor


def find_escaped(x: Column, carry: Column, let: Let = inline) -> tuple[Column, Column]:
    """(clear places right after an odd run of set bits, carry out) of one word in a chain of words.

    carry: the word before ended in an odd run, so place 0 is spoken for. Within a run every second bit,
    from its first, acts on the place above it; those share the parity of the run's first place.
    """
    even = word(0x5555555555555555)
    first = F.when(carry, word(1)).otherwise(word(0))
    live = let(x.bitwiseAND(F.bitwise_not(first)))
    starts = live.bitwiseAND(F.bitwise_not(F.shiftleft(live, 1)))
    from_even = let(fill_up(starts.bitwiseAND(even), live, 1, let=let))
    acting = let(from_even.bitwiseAND(even).bitwiseOR(live.bitwiseAND(F.bitwise_not(from_even)).bitwiseAND(F.bitwise_not(even))))
    return F.shiftleft(acting, 1).bitwiseOR(first).bitwiseAND(F.bitwise_not(x)), F.shiftrightunsigned(acting, 63) != 0


def fill_up(x: Column, through: Column, stride: int, width: int = 64, let: Let = inline) -> Column:
    """x and all places reached from it by steps of stride to the left through set places of ``through``."""
    if stride <= 0 or stride >= width:
        return x
    s = stride
    while s < width:
        x = let(x.bitwiseOR(through.bitwiseAND(mask(F.shiftleft(x, s), width))))
        through = let(through.bitwiseAND(F.shiftleft(through, s)))
        s *= 2
    return x


def fill_down(x: Column, through: Column, stride: int, width: int = 64, let: Let = inline) -> Column:
    if stride <= 0 or stride >= width:
        return x
    s = stride
    while s < width:
        x = let(x.bitwiseOR(through.bitwiseAND(F.shiftrightunsigned(x, s))))
        through = let(through.bitwiseAND(F.shiftrightunsigned(through, s)))
        s *= 2
    return x


compact, expand = W.pext, W.pdep


def gather_factor_by(mask_: int, place: Callable[[int], int], width: int = 64) -> int | None:
    """A factor that sends the j-th bit of the mask to place(j), None where a bit would move down or out.

    That products of bits do not meet is not checked: compare gather() with compact() for that.
    """
    bits = [i for i in range(width) if mask_ >> i & 1]
    moves = [place(j) - i for j, i in enumerate(bits)]
    if any(m < 0 or i + m >= width for i, m in zip(bits, moves, strict=True)):
        return None
    return sum(1 << m for m in set(moves))


def gather_factor(mask_: int, target: int, width: int = 64) -> int | None:
    return gather_factor_by(mask_, lambda j: target + j, width)


def gather(x: Column, mask_: int, factor: int, target: int, width: int = 64) -> Column:
    """The bits under the mask, brought together by one multiplication; zero for target >= width."""
    n = bin(mask_).count("1")
    if target >= width:
        return F.when(x.isNotNull(), word(0))
    return F.shiftrightunsigned(W.wmul(x.bitwiseAND(word(mask_)), word(factor), width), target).bitwiseAND(word(ones(min(n, width - target))))


lowest_set_mask = W.lowest_set_mask


def below_lowest_set(x: Column, width: int = 64) -> Column:
    """Places under the lowest set bit; all for zero."""
    return mask(F.bitwise_not(x).bitwiseAND(F.coalesce(F.try_subtract(x, F.lit(1).cast("long")), word(W.MIN - 1))), width)


def up_to_lowest_set(x: Column, width: int = 64) -> Column:
    return mask(x.bitwiseXOR(F.coalesce(F.try_subtract(x, F.lit(1).cast("long")), word(W.MIN - 1))), width)


def set_lowest_zero(x: Column, width: int = 64) -> Column:
    return x.bitwiseOR(mask(lowest_set_mask(F.bitwise_not(x)), width))


def clear_lowest_run(x: Column, width: int = 64) -> Column:
    return W.wadd(x, lowest_set_mask(x), width).bitwiseAND(x)


def blend(x: Column, y: Column, m: Column) -> Column:
    """Bits of y where m is set, of x elsewhere."""
    return x.bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(m))


def truth_table(f: Callable[[int, int, int], int]) -> int:
    """The table of a function of three bits, from its value on the three patterns that list all cases."""
    return f(0xF0, 0xCC, 0xAA) & 0xFF


def ternary(a: Column, b: Column, c: Column, table: int, width: int = 64) -> Column:
    """Any boolean function of three words: bit 4a + 2b + c of the table is its value."""
    W._within(table, 0, 255, "table")
    by_c = {0: word(0), 1: F.bitwise_not(c), 2: c, 3: word(-1)}

    def pick(x: Column, low: Column, high: Column) -> Column:
        return low.bitwiseXOR(low.bitwiseXOR(high).bitwiseAND(x))

    quarter = [by_c[table >> 2 * i & 3] for i in range(4)]
    half = [quarter[2 * i] if table >> 4 * i & 3 == table >> 4 * i + 2 & 3 else pick(b, quarter[2 * i], quarter[2 * i + 1]) for i in range(2)]
    out = half[0] if table & 15 == table >> 4 else pick(a, half[0], half[1])
    return mask(F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), out), width)


def _sign_extended(x: Column, width: int) -> Column:
    return x if width == 64 else F.shiftright(F.shiftleft(x, 64 - width), 64 - width)


def signed_add_overflows(x: Column, y: Column, width: int = 64) -> Column:
    x, y = _sign_extended(x, width), _sign_extended(y, width)
    known = x.isNotNull() & y.isNotNull()
    if width == 64:
        return F.when(known, F.try_add(x, y).isNull())
    return ~(x + y).between(-(1 << width - 1), (1 << width - 1) - 1)


def signed_sub_overflows(x: Column, y: Column, width: int = 64) -> Column:
    x, y = _sign_extended(x, width), _sign_extended(y, width)
    known = x.isNotNull() & y.isNotNull()
    if width == 64:
        return F.when(known, F.try_subtract(x, y).isNull())
    return ~(x - y).between(-(1 << width - 1), (1 << width - 1) - 1)


def next_same_popcount(x: Column, width: int = 64, let: Let = inline) -> Column:
    """The next larger word with as many set bits, null where there is none."""
    low = let(lowest_set_mask(x))
    ripple = let(W.wadd(x, low, width))
    # The lowest run loses its top bit upwards; the others fall to the bottom.
    run = let(x.bitwiseAND(F.bitwise_not(ripple)))
    rest = F.when(F.bit_count(run) > 0, W.low_ones(F.bit_count(run) - 1, width)).otherwise(word(0))
    return F.when((x != 0) & (ripple != 0), ripple.bitwiseOR(rest))


def next_subset(x: Column, m: Column) -> Column:
    """The next larger subset of m after x & m, null after m itself."""
    x = x.bitwiseAND(m)
    return F.when(x != m, W.wsub(x, m).bitwiseAND(m))


def is_pow2(x: Column) -> Column:
    return F.bit_count(x) == 1


def round_down_pow2(x: Column, let: Let = inline) -> Column:
    s = let(W.smear_down(x, let=let))
    return F.when(x != 0, s.bitwiseXOR(F.shiftrightunsigned(s, 1)))


def log2_floor(x: Column, let: Let = inline) -> Column:
    return last_set(x, let)


def log2_ceil(x: Column, let: Let = inline) -> Column:
    below = W.smear_down(W.wsub(x, word(1)), let=let)
    return F.when(x == 1, 0).when(x != 0, F.bit_count(below))


def round_up_pow2(x: Column, width: int = 64, let: Let = inline) -> Column:
    n = let(log2_ceil(x, let))
    return F.when(x == 0, word(1)).when(n < width, F.call_function("shiftleft", word(1), n))


def lanes_lo() -> Column:
    return word(LOW_LANES)


def lanes_hi() -> Column:
    return word(HIGH_LANES)


def zero_bytes(x: Column) -> Column:
    """0x80 in each byte of x that is zero: no sum of a lane carries into the next."""
    return F.bitwise_not(W.wadd(x.bitwiseAND(word(SEVEN)), word(SEVEN)).bitwiseOR(x).bitwiseOR(word(SEVEN)))


def has_zero_byte(x: Column) -> Column:
    return zero_bytes(x) != 0


def first_zero_byte(x: Column) -> Column:
    z = zero_bytes(x)
    return F.when(z != 0, F.shiftrightunsigned(W.trailing_zeros(z).cast("long"), 3).cast("int"))


def bytes_eq(x: Column, b: int) -> Column:
    W._within(b, 0, 255, "byte")
    return zero_bytes(x.bitwiseXOR(word(b * LOW_LANES)))


def bytes_ge(x: Column, n: int) -> Column:
    W._within(n, 1, 128, "bound")
    return W.wadd(x.bitwiseAND(word(SEVEN)), word((128 - n) * LOW_LANES)).bitwiseOR(x).bitwiseAND(word(HIGH_LANES))


def bytes_lt(x: Column, n: int) -> Column:
    return bytes_ge(x, n).bitwiseXOR(word(HIGH_LANES))


def count_bytes_eq(x: Column, b: int) -> Column:
    return F.bit_count(bytes_eq(x, b))


def sum_bytes(x: Column) -> Column:
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(word(255)) for i in range(1, 8)), x.bitwiseAND(word(255)))


def delta_swap(x: Column, mask_: int, shift: int) -> Column:
    """Swap the bits under a literal mask with those ``shift`` places above."""
    if mask_ & mask_ << shift & ones(64):
        raise ValueError("the mask and its shifted copy overlap")
    t = F.shiftrightunsigned(x, shift).bitwiseXOR(x).bitwiseAND(word(mask_))
    return x.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, shift))
