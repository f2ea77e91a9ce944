"""Queries for the word-level operators over words mixed from the orders table, with bit-by-bit SQL definitions.

In the SQL, words are UBIGINT; ``b(w, j)`` tests bit j and ``v(cond)`` builds a word from a condition on
its bit number j, so that each oracle states what the operator means rather than how it is computed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bitlake.functions import affine as A
from bitlake.functions import bits as B
from bitlake.functions import boards as D
from bitlake.functions import wide as X
from bitlake.functions import words as W
from bitlake.operators import curves as C

K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
TWO64 = 1 << 64
MASKS = (0x00FF0F0F33335555, 0x8421)


def columns():
    return [F.col(c) for c in ("x", "y", "m", "k", "i")]


def words(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    a, c = F.col("o_orderkey"), F.col("o_custkey")
    mul = lambda v, n: W.wmul(v, W.word(K[n]))
    o = o.select(a.alias("id"), W.xor(mul(a, 0), F.shiftrightunsigned(mul(c, 1), 13)).alias("x0"), mul(a + 7, 2).alias("y"), W.and_(mul(c, 0), mul(a, 1)).alias("m"), (c % 70).cast("int").alias("k"), (a % 66).cast("int").alias("i"))
    # Some words with long runs, few bits, and none.
    x_ = F.when(F.col("id") % 7 == 0, F.col("x0").bitwiseOR(F.shiftrightunsigned(F.col("x0"), 1)).bitwiseOR(F.shiftrightunsigned(F.col("x0"), 2))).when(F.col("id") % 11 == 0, F.col("m").bitwiseAND(F.col("x0"))).when(F.col("id") % 13 == 0, F.shiftrightunsigned(F.col("x0"), 40)).when(F.col("id") % 17 == 0, W.word(0)).otherwise(F.col("x0"))
    return o.select("id", x_.alias("x"), "y", "m", F.col("x0").alias("z"), "k", "i")


WORDS = f"""w0 AS (SELECT o_orderkey AS id,
 xor((o_orderkey::UHUGEINT * {K[0]} % {TWO64})::UBIGINT, (o_custkey::UHUGEINT * {K[1]} % {TWO64})::UBIGINT >> 13) AS x0,
 ((o_orderkey + 7)::UHUGEINT * {K[2]} % {TWO64})::UBIGINT AS y,
 (o_custkey::UHUGEINT * {K[0]} % {TWO64})::UBIGINT & (o_orderkey::UHUGEINT * {K[1]} % {TWO64})::UBIGINT AS m,
 (o_custkey % 70)::INT AS k, (o_orderkey % 66)::INT AS i FROM orders),
w AS (SELECT id, CASE WHEN id % 7 = 0 THEN x0 | (x0 >> 1) | (x0 >> 2) WHEN id % 11 = 0 THEN m & x0 WHEN id % 13 = 0 THEN x0 >> 40
 WHEN id % 17 = 0 THEN 0::UBIGINT ELSE x0 END AS x, y, m, x0 AS z, k, i FROM w0)"""


def b(w: str, j: str) -> str:
    return f"((({w}) >> ({j})::UBIGINT) & 1) = 1"


def v(cond: str, n: int = 64) -> str:
    return f"list_sum(list_transform(range({n}), lambda j: CASE WHEN {cond} THEN 1::UBIGINT << j::UBIGINT ELSE 0::UBIGINT END))::UBIGINT"


def count(cond: str, low: str = "0", high: str = "64") -> str:
    return f"len(list_filter(range(({low})::BIGINT, ({high})::BIGINT), lambda j: {cond}))"


def least(cond: str, low: str = "0", high: str = "64") -> str:
    return f"list_min(list_filter(range(({low})::BIGINT, ({high})::BIGINT), lambda j: {cond}))"


def most(cond: str) -> str:
    return f"list_max(list_filter(range(64), lambda j: {cond}))"


def byte(w: str, j: str) -> str:
    return f"((({w}) >> (8 * ({j}))::UBIGINT) & 255)"


def bytes_(expr: str) -> str:
    """A word from an expression for byte j."""
    return f"list_sum(list_transform(range(8), lambda j: ({expr})::UBIGINT << (8 * j)::UBIGINT))::UBIGINT"


def board(row: str, col: str) -> str:
    """Board whose bit (j // 8, j % 8) is bit (row, col) of x."""
    return v(b("x", f"8 * ({row}) + ({col})"))


def under(mask: int) -> list[int]:
    return [p for p in range(64) if mask >> p & 1]


def wrap(e: str) -> str:
    return f"((({e}) % {TWO64} + {TWO64}) % {TWO64})::UBIGINT"


def _pext(w: str, mask: int) -> str:
    return "(" + " | ".join(f"((({w}) >> {p} & 1) << {j})" for j, p in enumerate(under(mask))) + ")"


def _pdep(w: str, mask: int) -> str:
    return "(" + " | ".join(f"((({w}) >> {j} & 1) << {p})" for j, p in enumerate(under(mask))) + ")"


def _table(table: int) -> str:
    cases = [f"({' AND '.join(('' if case >> s & 1 else 'NOT ') + '(' + b(w, 'j') + ')' for w, s in (('x', 2), ('y', 1), ('m', 0)))})" for case in range(8) if table >> case & 1]
    return v(" OR ".join(cases) or "false")


def _affine(a: A.Affine8, w: str = "x") -> str:
    return bytes_(f"list_extract({a.table()}, (1 + {byte(w, 'j')})::BIGINT)")


def _slide(to: D.Dir) -> str:
    """Places p reached: some piece on the ray back from p, with only empty places between."""
    dr, dc = {"NORTH": (1, 0), "SOUTH": (-1, 0), "EAST": (0, 1), "WEST": (0, -1), "NORTH_EAST": (1, 1), "NORTH_WEST": (1, -1), "SOUTH_EAST": (-1, 1), "SOUTH_WEST": (-1, -1)}[to.name]
    rays = []
    for n in range(1, 8):
        on = lambda t: f"(j // 8 - {t * dr}) BETWEEN 0 AND 7 AND (j % 8 - {t * dc}) BETWEEN 0 AND 7"  # noqa: E731, B023
        place = lambda t: f"greatest(0, least(63, 8 * (j // 8 - {t * dr}) + (j % 8 - {t * dc})))"
        rays.append("(" + " AND ".join([on(n), b("m", place(n)), *(b("y", place(t)) for t in range(1, n))]) + ")")
    return v(" OR ".join(rays))


_scan = "(bit_count({w} & (CASE WHEN j = 63 THEN 18446744073709551615::UBIGINT ELSE (1::UBIGINT << (j + 1)::UBIGINT) - 1 END)) % 2) = 1"
_down = "(bit_count({w} >> j::UBIGINT) % 2) = 1"
SIGNED = "(CASE WHEN {w} >= 9223372036854775808 THEN {w}::HUGEINT - 18446744073709551616 ELSE {w}::HUGEINT END)"
_sx, _sy = SIGNED.format(w="x"), SIGNED.format(w="y")
_mul = f"((x::UHUGEINT * (y & 4294967295)::UHUGEINT % {TWO64} + ((x::UHUGEINT * (y >> 32)::UHUGEINT) % 4294967296) * 4294967296) % {TWO64})::UBIGINT"
_low = lambda n: f"(CASE WHEN {n} >= 64 THEN 18446744073709551615::UBIGINT ELSE (1::UBIGINT << ({n})::UBIGINT) - 1 END)"
_odd_run = f"(NOT ({b('x', 'j')})) AND j > 0 AND (j - 1 - coalesce(list_max(list_filter(range(0, j), lambda q: NOT ({b('x', 'q')}))), -1)) % 2 = 1"
# g holds the lowest set place and the lowest empty one above it: the run between moves its top bit up one place, its others to the bottom.
_run = f"[{least(b('x', 'j'))}, {least(f'NOT ({b("x", "j")}) AND (x & {_low("j")}) > 0')}]"
_next_popcount = f"list_extract(list_transform([{_run}], lambda g: CASE WHEN g[2] IS NOT NULL THEN {v(f'j = g[2] OR (j > g[2] AND {b("x", "j")}) OR j < g[2] - g[1] - 1')} END), 1)"

#: name -> (column of one operator, SQL of its value, "word" | "int" | "bool"); built by layered().
OPS: dict = {
    # carrier primitives
    "word_and": (lambda let, x, y, m, k, i: W.and_(x, y), "x & y", "word"),
    "word_or": (lambda let, x, y, m, k, i: W.or_(x, y), "x | y", "word"),
    "word_xor": (lambda let, x, y, m, k, i: W.xor(x, y), "xor(x, y)", "word"),
    "word_not": (lambda let, x, y, m, k, i: W.not_(x), "~x", "word"),
    "word_shl": (lambda let, x, y, m, k, i: W.shl(x, 13), v(f"j >= 13 AND {b('x', 'greatest(j - 13, 0)')}"), "word"),
    "word_shl_by": (lambda let, x, y, m, k, i: W.shl(x, k), f"CASE WHEN k < 64 THEN {v('j >= k AND ' + b('x', 'greatest(j - k, 0)'))} END", "word"),
    "word_shr": (lambda let, x, y, m, k, i: W.shr(x, 13), "x >> 13", "word"),
    "word_shr_by": (lambda let, x, y, m, k, i: W.shr(x, k), "CASE WHEN k < 64 THEN x >> k::UBIGINT END", "word"),
    "word_wrapping_add": (lambda let, x, y, m, k, i: W.wadd(x, y), wrap("x::HUGEINT + y"), "word"),
    "word_wrapping_sub": (lambda let, x, y, m, k, i: W.wsub(x, y), wrap("x::HUGEINT - y"), "word"),
    "word_wrapping_mul": (lambda let, x, y, m, k, i: W.wmul(x, y), _mul, "word"),
    "word_splat_byte": (lambda let, x, y, m, k, i: W.splat_byte(x), bytes_("x & 255"), "word"),
    "word_low_byte": (lambda let, x, y, m, k, i: W.low_byte(x), "x & 255", "word"),
    "word_count_ones": (lambda let, x, y, m, k, i: W.count_ones(x), count(b("x", "j")), "int"),
    "word_trailing_zeros": (lambda let, x, y, m, k, i: W.trailing_zeros(x), f"coalesce({least(b('x', 'j'))}, 64)", "int"),
    "word_leading_zeros": (lambda let, x, y, m, k, i: W.leading_zeros(x, let=let), f"63 - coalesce({most(b('x', 'j'))}, -1)", "int"),
    "word_trailing_ones": (lambda let, x, y, m, k, i: W.trailing_ones(x), f"coalesce({least('NOT ' + b('x', 'j'))}, 64)", "int"),
    "word_leading_ones": (lambda let, x, y, m, k, i: W.leading_ones(x, let=let), f"63 - coalesce({most('NOT ' + b('x', 'j'))}, -1)", "int"),
    "word_clear_lowest_set": (lambda let, x, y, m, k, i: W.clear_lowest_set(x), v(f"{b('x', 'j')} AND (x & {_low('j')}) > 0"), "word"),
    "word_pext": (lambda let, x, y, m, k, i: W.pext(x, MASKS[0]), _pext("x", MASKS[0]), "word"),
    "word_pdep": (lambda let, x, y, m, k, i: W.pdep(x, MASKS[0]), _pdep("x", MASKS[0]), "word"),
    "word_pext_by_column": (lambda let, x, y, m, k, i: W.pext_by(x, m), f"list_sum(list_transform(range(64), lambda j: CASE WHEN {b('m', 'j')} AND {b('x', 'j')} THEN 1::UBIGINT << bit_count(m & {_low('j')})::UBIGINT ELSE 0::UBIGINT END))::UBIGINT", "word"),
    "word_pdep_by_column": (lambda let, x, y, m, k, i: W.pdep_by(x, m), v(f"{b('m', 'j')} AND {b('x', 'bit_count(m & ' + _low('j') + ')')}"), "word"),
    "word_unzip_even": (lambda let, x, y, m, k, i: W.unzip(x, let)[0], v(b("x", "2 * j"), 32), "word"),
    "word_unzip_odd": (lambda let, x, y, m, k, i: W.unzip(x, let)[1], v(b("x", "2 * j + 1"), 32), "word"),
    "word_zip": (lambda let, x, y, m, k, i: W.zip_(x, y, let), v(f"CASE WHEN j % 2 = 0 THEN {b('x', 'j // 2')} ELSE {b('y', 'j // 2')} END"), "word"),
    "word_select_lowest": (lambda let, x, y, m, k, i: W.select_lowest(x, k, let), f"coalesce(list_extract(list_filter(range(64), lambda j: {b('x', 'j')}), k + 1), 64)", "int"),
    "word_xor_scan": (lambda let, x, y, m, k, i: W.xor_scan(x, let=let), v(_scan.format(w="x")), "word"),
    "word_xor_scan_down": (lambda let, x, y, m, k, i: W.xor_scan_down(x, let=let), v(_down.format(w="x")), "word"),
    "word_low_ones": (lambda let, x, y, m, k, i: W.low_ones(k), _low("k"), "word"),
    "word_is_zero": (lambda let, x, y, m, k, i: W.is_zero(x), "x = 0", "bool"),
    "word_bit": (lambda let, x, y, m, k, i: W.bit(x, k), f"CASE WHEN k < 64 THEN {b('x', 'k')} END", "bool"),
    "word_parity": (lambda let, x, y, m, k, i: W.parity(x), "bit_count(x) % 2 = 1", "bool"),
    # combinators
    "bits_run_starts": (lambda let, x, y, m, k, i: B.run_starts(x, 3, let=let), v(f"j <= 61 AND {b('x', 'j')} AND {b('x', 'least(j + 1, 63)')} AND {b('x', 'least(j + 2, 63)')}"), "word"),
    "bits_has_run": (lambda let, x, y, m, k, i: B.has_run(x, 4), f"{least(' AND '.join(b('x', f'j + {n}') for n in range(4)), '0', '61')} IS NOT NULL", "bool"),
    "bits_longest_run": (lambda let, x, y, m, k, i: B.longest_run(x), "list_max(list_transform(string_split(x::BIT::VARCHAR, '0'), lambda s: length(s)))", "int"),
    "bits_rank": (lambda let, x, y, m, k, i: B.rank(x, k), f"bit_count(x & {_low('k')})", "int"),
    "bits_select": (lambda let, x, y, m, k, i: B.select(x, k, let), f"list_extract(list_filter(range(64), lambda j: {b('x', 'j')}), k + 1)", "int"),
    "bits_first_set": (lambda let, x, y, m, k, i: B.first_set(x), least(b("x", "j")), "int"),
    "bits_last_set": (lambda let, x, y, m, k, i: B.last_set(x, let), most(b("x", "j")), "int"),
    "bits_prefix_or": (lambda let, x, y, m, k, i: B.prefix_or(x, let=let), v(f"(x & {_low('(j + 1)')}) > 0"), "word"),
    "bits_prefix_xor": (lambda let, x, y, m, k, i: B.prefix_xor(x, let=let), v(_scan.format(w="x")), "word"),
    "bits_prefix_xor_carry": (lambda let, x, y, m, k, i: B.prefix_xor_carry(x, i % 2 == 1, let)[0], v(f"(({_scan.format(w='x')}) <> (i % 2 = 1))"), "word"),
    "bits_prefix_xor_carry_out": (lambda let, x, y, m, k, i: B.prefix_xor_carry(x, i % 2 == 1, let)[1], "(bit_count(x) + i) % 2 = 1", "bool"),
    "bits_delta_xor": (lambda let, x, y, m, k, i: B.delta_xor(x), v(f"({b('x', 'j')}) <> (j > 0 AND {b('x', 'greatest(j - 1, 0)')})"), "word"),
    "bits_gray_encode": (lambda let, x, y, m, k, i: B.gray_encode(x), "xor(x, x >> 1)", "word"),
    "bits_suffix_xor": (lambda let, x, y, m, k, i: B.suffix_xor(x, let=let), v(_down.format(w="x")), "word"),
    "bits_gray_decode": (lambda let, x, y, m, k, i: B.gray_decode(B.gray_encode(x), let=let), "x", "word"),
    "bits_find_escaped": (lambda let, x, y, m, k, i: B.find_escaped(x, F.lit(False), let)[0], v(_odd_run), "word"),
    "bits_find_escaped_carry": (lambda let, x, y, m, k, i: B.find_escaped(x, F.lit(False), let)[1], f"(63 - coalesce(list_max(list_filter(range(64), lambda q: NOT ({b('x', 'q')}))), -1)) % 2 = 1", "bool"),
    "bits_fill_up": (lambda let, x, y, m, k, i: B.fill_up(m, x, 1, let=let), v(f"list_bool_or(list_transform(range(0, j + 1), lambda q: {b('m', 'q')} AND bit_count(x & ({_low('(j + 1)')} & ~{_low('(q + 1)')})) = j - q))"), "word"),
    "bits_fill_down": (lambda let, x, y, m, k, i: B.fill_down(m, x, 1, let=let), v(f"list_bool_or(list_transform(range(j, 64), lambda q: {b('m', 'q')} AND bit_count(x & ({_low('q')} & ~{_low('j')})) = q - j))"), "word"),
    "bits_compact": (lambda let, x, y, m, k, i: B.compact(x, MASKS[1]), _pext("x", MASKS[1]), "word"),
    "bits_expand": (lambda let, x, y, m, k, i: B.expand(x, MASKS[1]), _pdep("x", MASKS[1]), "word"),
    "bits_gather": (lambda let, x, y, m, k, i: B.gather(x, B.LOW_LANES, B.gather_factor(B.LOW_LANES, 56), 56), _pext("x", B.LOW_LANES), "word"),
    "bits_gather_by": (lambda let, x, y, m, k, i: B.gather(x, 0x0000000000000811, B.gather_factor_by(0x811, lambda j: 40 + 2 * j), 40), f"(({' | '.join(f'((x >> {p} & 1) << {2 * j})' for j, p in enumerate((0, 4, 11)))}) & 7)", "word"),
    "bits_lowest_set_mask": (lambda let, x, y, m, k, i: B.lowest_set_mask(x), v(f"{b('x', 'j')} AND (x & {_low('j')}) = 0"), "word"),
    "bits_below_lowest_set": (lambda let, x, y, m, k, i: B.below_lowest_set(x), v(f"(x & {_low('(j + 1)')}) = 0"), "word"),
    "bits_up_to_lowest_set": (lambda let, x, y, m, k, i: B.up_to_lowest_set(x), v(f"(x & {_low('j')}) = 0"), "word"),
    "bits_set_lowest_zero": (lambda let, x, y, m, k, i: B.set_lowest_zero(x), v(f"{b('x', 'j')} OR (~x & {_low('j')}) = 0"), "word"),
    "bits_clear_lowest_run": (lambda let, x, y, m, k, i: B.clear_lowest_run(x), v(f"{b('x', 'j')} AND coalesce(list_bool_or(list_transform(range(0, j), lambda q: {b('x', 'q')} AND NOT {b('x', 'q + 1')})), false)"), "word"),
    "bits_blend": (lambda let, x, y, m, k, i: B.blend(x, y, m), "(x & ~m) | (y & m)", "word"),
    "bits_ternary_majority": (lambda let, x, y, m, k, i: B.ternary(x, y, m, B.truth_table(lambda a, b_, c: (a & b_) | (a & c) | (b_ & c))), "(x & y) | (x & m) | (y & m)", "word"),
    "bits_ternary": (lambda let, x, y, m, k, i: B.ternary(x, y, m, 0x6B), _table(0x6B), "word"),
    "bits_signed_add_overflows": (lambda let, x, y, m, k, i: B.signed_add_overflows(x, y), f"NOT ({_sx} + {_sy}) BETWEEN -9223372036854775808 AND 9223372036854775807", "bool"),
    "bits_signed_sub_overflows": (lambda let, x, y, m, k, i: B.signed_sub_overflows(x, y), f"NOT ({_sx} - {_sy}) BETWEEN -9223372036854775808 AND 9223372036854775807", "bool"),
    # 0 where there is none: nulls would make pandas turn whole words into floats.
    "bits_next_same_popcount": (lambda let, x, y, m, k, i: F.coalesce(B.next_same_popcount(x, let=let), W.word(0)), f"coalesce({_next_popcount}, 0)", "word"),
    "bits_next_subset": (lambda let, x, y, m, k, i: B.next_subset(x, W.word(0xF0B5)), f"(SELECT min(s) FROM (SELECT unnest([{', '.join(str(s) for s in B.subsets(0xF0B5))}]) AS s) WHERE s > x & {0xF0B5})", "word"),
    "bits_is_pow2": (lambda let, x, y, m, k, i: B.is_pow2(x), "bit_count(x) = 1", "bool"),
    "bits_round_down_pow2": (lambda let, x, y, m, k, i: B.round_down_pow2(x, let), f"CASE WHEN x > 0 THEN 1::UBIGINT << {most(b('x', 'j'))}::UBIGINT END", "word"),
    "bits_round_up_pow2": (lambda let, x, y, m, k, i: B.round_up_pow2(x, let=let), "CASE WHEN x = 0 THEN 1 ELSE list_min(list_filter(list_transform(range(64), lambda j: 1::UBIGINT << j::UBIGINT), lambda q: q >= x)) END", "word"),
    "bits_log2_floor": (lambda let, x, y, m, k, i: B.log2_floor(x, let), most(b("x", "j")), "int"),
    "bits_log2_ceil": (lambda let, x, y, m, k, i: B.log2_ceil(x, let), "CASE WHEN x > 0 THEN coalesce(list_min(list_filter(range(64), lambda j: (1::UBIGINT << j::UBIGINT) >= x)), 64) END", "int"),
    "bits_lanes": (lambda let, x, y, m, k, i: W.or_(B.lanes_lo(), B.lanes_hi()), str(B.LOW_LANES | B.HIGH_LANES) + "::UBIGINT", "word"),
    "bits_zero_bytes": (lambda let, x, y, m, k, i: B.zero_bytes(W.and_(x, m)), bytes_(f"CASE WHEN {byte('x & m', 'j')} = 0 THEN 128 ELSE 0 END"), "word"),
    "bits_has_zero_byte": (lambda let, x, y, m, k, i: B.has_zero_byte(W.and_(x, m)), least(byte("x & m", "j") + " = 0", "0", "8") + " IS NOT NULL", "bool"),
    "bits_first_zero_byte": (lambda let, x, y, m, k, i: B.first_zero_byte(W.and_(x, m)), least(byte("x & m", "j") + " = 0", "0", "8"), "int"),
    "bits_bytes_eq": (lambda let, x, y, m, k, i: B.bytes_eq(W.and_(x, W.word(0x0303030303030303)), 2), bytes_(f"CASE WHEN {byte('x', 'j')} & 3 = 2 THEN 128 ELSE 0 END"), "word"),
    "bits_bytes_ge": (lambda let, x, y, m, k, i: B.bytes_ge(x, 100), bytes_(f"CASE WHEN {byte('x', 'j')} >= 100 THEN 128 ELSE 0 END"), "word"),
    "bits_bytes_lt": (lambda let, x, y, m, k, i: B.bytes_lt(x, 100), bytes_(f"CASE WHEN {byte('x', 'j')} < 100 THEN 128 ELSE 0 END"), "word"),
    "bits_count_bytes_eq": (lambda let, x, y, m, k, i: B.count_bytes_eq(W.and_(x, W.word(0x0303030303030303)), 2), count(f"{byte('x', 'j')} & 3 = 2", "0", "8"), "int"),
    "bits_sum_bytes": (lambda let, x, y, m, k, i: B.sum_bytes(x), f"list_sum(list_transform(range(8), lambda j: {byte('x', 'j')}))::UBIGINT", "word"),
    "bits_delta_swap": (lambda let, x, y, m, k, i: B.delta_swap(x, 0x00FF, 24), v(b("x", "CASE WHEN j < 8 THEN j + 24 WHEN j BETWEEN 24 AND 31 THEN j - 24 ELSE j END")), "word"),
    # curves
    "dilated_from_int": (lambda let, x, y, m, k, i: C.dilate(x, 2, let), v(f"j % 2 = 0 AND {b('x', 'j // 2')}"), "word"),
    "dilated_to_int": (lambda let, x, y, m, k, i: C.undilate(x, 2, let), v(b("x", "2 * j"), 32), "word"),
    "dilated_from_int_by_3": (lambda let, x, y, m, k, i: C.dilate(x, 3, let), v(f"j % 3 = 0 AND j < 63 AND {b('x', 'j // 3')}"), "word"),
    "dilated_incr": (lambda let, x, y, m, k, i: C.dilated_incr(C.morton_x(x)), "(" + " | ".join(f"((((a + 1) >> {p}) & 1) << {2 * p})" for p in range(32)) + ")", "dilated"),
    "dilated_decr": (lambda let, x, y, m, k, i: C.dilated_decr(C.morton_x(x)), "(" + " | ".join(f"((((a + 4294967295) >> {p}) & 1) << {2 * p})" for p in range(32)) + ")", "dilated"),
    "dilated_wrapping_add": (lambda let, x, y, m, k, i: C.dilated_add(C.morton_x(x), C.morton_x(y)), "(" + " | ".join(f"((((a + b) >> {p}) & 1) << {2 * p})" for p in range(32)) + ")", "dilated"),
    "morton2_encode": (lambda let, x, y, m, k, i: C.morton2(x, y, let), v(f"CASE WHEN j % 2 = 0 THEN {b('x', 'j // 2')} ELSE {b('y', 'j // 2')} END"), "word"),
    "morton2_decode_x": (lambda let, x, y, m, k, i: C.morton2_xy(x, let)[0], v(b("x", "2 * j"), 32), "word"),
    "morton2_decode_y": (lambda let, x, y, m, k, i: C.morton2_xy(x, let)[1], v(b("x", "2 * j + 1"), 32), "word"),
    "morton2_step_x": (lambda let, x, y, m, k, i: C.step_x(x), f"(x & {0xAAAAAAAAAAAAAAAA}) | (" + " | ".join(f"((((a + 1) >> {p}) & 1) << {2 * p})" for p in range(32)) + ")", "dilated"),
    "morton2_step_y": (lambda let, x, y, m, k, i: C.step_y(x), f"(x & {0x5555555555555555}) | (" + " | ".join(f"((((c + 1) >> {p}) & 1) << {2 * p + 1})" for p in range(32)) + ")", "dilated"),
    "morton2_with_x": (lambda let, x, y, m, k, i: C.morton_with_x(x, C.morton_x(y)), v(f"CASE WHEN j % 2 = 0 THEN {b('y', 'j')} ELSE {b('x', 'j')} END"), "word"),
    "morton2_with_y": (lambda let, x, y, m, k, i: C.morton_with_y(x, C.morton_y(y)), v(f"CASE WHEN j % 2 = 1 THEN {b('y', 'j')} ELSE {b('x', 'j')} END"), "word"),
    "morton3_encode": (lambda let, x, y, m, k, i: C.morton3(x, y, m, let), v(f"j < 63 AND CASE j % 3 WHEN 0 THEN {b('x', 'j // 3')} WHEN 1 THEN {b('y', 'j // 3')} ELSE {b('m', 'j // 3')} END"), "word"),
    "morton3_decode_x": (lambda let, x, y, m, k, i: C.morton3_xyz(x, let)[0], v(b("x", "3 * j"), 21), "word"),
    "morton3_decode_y": (lambda let, x, y, m, k, i: C.morton3_xyz(x, let)[1], v(b("x", "3 * j + 1"), 21), "word"),
    "morton3_decode_z": (lambda let, x, y, m, k, i: C.morton3_xyz(x, let)[2], v(b("x", "3 * j + 2"), 21), "word"),
    # boards
    "board_transpose": (lambda let, x, y, m, k, i: D.transpose(x, let), board("j % 8", "j // 8"), "word"),
    "board_flip_vertical": (lambda let, x, y, m, k, i: D.flip_vertical(x, let), board("7 - j // 8", "j % 8"), "word"),
    "board_mirror_horizontal": (lambda let, x, y, m, k, i: D.mirror_horizontal(x, let), board("j // 8", "7 - j % 8"), "word"),
    "board_rotate_90_cw": (lambda let, x, y, m, k, i: D.rotate_90_cw(x, let), board("j % 8", "7 - j // 8"), "word"),
    "board_rotate_90_ccw": (lambda let, x, y, m, k, i: D.rotate_90_ccw(x, let), board("7 - j % 8", "j // 8"), "word"),
    "board_rotate_180": (lambda let, x, y, m, k, i: D.rotate_180(x, let), board("7 - j // 8", "7 - j % 8"), "word"),
    "board_shift": (lambda let, x, y, m, k, i: D.shift(x, D.Dir.NORTH_EAST), v(f"j // 8 > 0 AND j % 8 > 0 AND {b('x', 'greatest(j - 9, 0)')}"), "word"),
    **{f"board_slide_{d.name.lower()}": ((lambda let, x, y, m, k, i, d=d: D.slide(m, y, d, let)), _slide(d), "word") for d in D.Dir},
    # byte maps
    "affine_rotl": (lambda let, x, y, m, k, i: A.Affine8.rotl(3).apply8(x), bytes_(f"(({byte('x', 'j')} << 3) | ({byte('x', 'j')} >> 5)) & 255"), "word"),
    "affine_reverse_then_not": (lambda let, x, y, m, k, i: A.REVERSE.then(A.NOT).apply8(x), v(f"NOT {b('x', '8 * (j // 8) + 7 - j % 8')}"), "word"),
    "affine_parity": (lambda let, x, y, m, k, i: A.PARITY.apply8(x), bytes_(f"CASE WHEN bit_count({byte('x', 'j')}) % 2 = 1 THEN 255 ELSE 0 END"), "word"),
    "affine_sra": (lambda let, x, y, m, k, i: A.Affine8.sra(2).apply8(x), bytes_(f"({byte('x', 'j')} >> 2) | CASE WHEN {byte('x', 'j')} >= 128 THEN 192 ELSE 0 END"), "word"),
    "affine_compose": (lambda let, x, y, m, k, i: A.Affine8.shl(1).compose(A.Affine8.shr(3)).apply8(x), bytes_(f"(({byte('x', 'j')} >> 3) << 1) & 255"), "word"),
}

_bw = lambda j: f"(CASE WHEN ({j}) < 64 THEN {b('x', f'least({j}, 63)')} ELSE {b('y', f'greatest(({j}) - 64, 0)')} END)"


_borrow = "(CASE WHEN x < y THEN 1 ELSE 0 END)"
_carry = f"(CASE WHEN x::HUGEINT + y >= {TWO64} THEN 1 ELSE 0 END)"
def wide_columns():
    x, y, m, k, _ = columns()
    return F.array(x, y), F.array(y, m), x, k


#: Words of two limbs: name -> (array column, SQL of the low limb, of the high limb) or (column, SQL, kind).
WIDE: dict = {
    "wide_and": (lambda p, q, x, k: X.and_(p, q), "x & y", "y & m"),
    "wide_or": (lambda p, q, x, k: X.or_(p, q), "x | y", "y | m"),
    "wide_xor": (lambda p, q, x, k: X.xor(p, q), "xor(x, y)", "xor(y, m)"),
    "wide_not": (lambda p, q, x, k: X.not_(p), "~x", "~y"),
    "wide_shl": (lambda p, q, x, k: X.shl(p, 70, 2), "0::UBIGINT", v(f"j >= 6 AND {b('x', 'greatest(j - 6, 0)')}")),
    "wide_shr": (lambda p, q, x, k: X.shr(p, 9, 2), v(f"CASE WHEN j + 9 < 64 THEN {b('x', 'least(j + 9, 63)')} ELSE {b('y', 'greatest(j + 9 - 64, 0)')} END"), "y >> 9"),
    "wide_wrapping_add": (lambda p, q, x, k: X.wadd(p, q, 2), wrap("x::HUGEINT + y"), wrap(f"y::HUGEINT + m + {_carry}")),
    "wide_wrapping_sub": (lambda p, q, x, k: X.wsub(p, q, 2), wrap("x::HUGEINT - y"), wrap(f"y::HUGEINT - m - {_borrow}")),
    "wide_clear_lowest_set": (lambda p, q, x, k: X.clear_lowest_set(p, 2), v(f"{b('x', 'j')} AND (x & {_low('j')}) > 0"), f"CASE WHEN x > 0 THEN y ELSE {v(b('y', 'j') + ' AND (y & ' + _low('j') + ') > 0')} END"),
    "wide_xor_scan": (lambda p, q, x, k: X.xor_scan(p, 2), v(_scan.format(w="x")), v(f"({_scan.format(w='y')}) <> (bit_count(x) % 2 = 1)")),
    "wide_xor_scan_down": (lambda p, q, x, k: X.xor_scan_down(p, 2), v(f"({_down.format(w='x')}) <> (bit_count(y) % 2 = 1)"), v(_down.format(w="y"))),
    "wide_low_ones": (lambda p, q, x, k: X.low_ones(k + 20, 2), _low("(k + 20)"), _low("greatest(k + 20 - 64, 0)")),
    "wide_splat_byte": (lambda p, q, x, k: X.splat_byte(x, 2), bytes_("x & 255"), bytes_("x & 255")),
}
WIDE_SCALARS: dict = {  # built by layered()
    "wide_count_ones": (lambda let, p, q, x, k: X.count_ones(p), "bit_count(x) + bit_count(y)", "int"),
    "wide_trailing_zeros": (lambda let, p, q, x, k: X.trailing_zeros(p, 2), f"coalesce({least(b('x', 'j'))}, {least(b('y', 'j'))} + 64, 128)", "int"),
    "wide_leading_zeros": (lambda let, p, q, x, k: X.leading_zeros(p, 2), f"127 - coalesce({most(b('y', 'j'))} + 64, {most(b('x', 'j'))}, -1)", "int"),
    "wide_select_lowest": (lambda let, p, q, x, k: X.select_lowest(p, k, 2, let), f"coalesce(list_extract(list_concat(list_filter(range(64), lambda j: {b('x', 'j')}), list_transform(list_filter(range(64), lambda j: {b('y', 'j')}), lambda j: j + 64)), k + 1), 128)", "int"),
    "wide_low_byte": (lambda let, p, q, x, k: X.low_byte(p), "x & 255", "word"),
    "wide_bit": (lambda let, p, q, x, k: X.bit(p, k), _bw("k"), "bool"),
    "wide_cmp": (lambda let, p, q, x, k: X.compare(p, q, 2), "CASE WHEN y <> m THEN CASE WHEN y < m THEN -1 ELSE 1 END WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END", "int"),
}


def _cast(e: str, kind: str) -> str:
    if kind == "word":
        return f"CASE WHEN {e} > 9223372036854775807 THEN ({e}::HUGEINT - {TWO64})::BIGINT ELSE {e}::BIGINT END"
    return f"({e})::INT" if kind == "int" else e


def _sql(inner: str, kind: str, more: str = "") -> str:
    return f"WITH {WORDS}{more} SELECT id, {_cast('v', kind)} AS v FROM (SELECT id, {inner} AS v FROM {'d' if more else 'w'})"


_EVEN = ", d AS (SELECT *, " + ", ".join("(" + " | ".join(f"(({w} >> {2 * p + s} & 1) << {p})" for p in range(32)) + f") AS {n}" for w, s, n in (("x", 0, "a"), ("y", 0, "b"), ("x", 1, "c"))) + " FROM w)"
QUERIES: dict = {}
ORACLES: dict = {}
for _name, (_build, _value, _kind) in OPS.items():
    _out = "word" if _kind == "dilated" else _kind

    def _query(spark, sf_dir, build=_build, kind=_out):
        out = W.layered(words(spark, sf_dir), v=lambda let: build(let, *columns()))
        return out.select("id", F.col("v").cast({"word": "long", "int": "int", "bool": "boolean"}[kind]).alias("v"))

    QUERIES[_name] = _query
    ORACLES[_name] = _sql(_value, _out, _EVEN if _kind == "dilated" else "")
for _name, (_build, _a, _b) in WIDE.items():

    def _query(spark, sf_dir, build=_build):
        return words(spark, sf_dir).select("id", build(*wide_columns()).alias("a")).select("id", F.get("a", F.lit(0)).alias("low"), F.get("a", F.lit(1)).alias("high"))

    QUERIES[_name] = _query
    ORACLES[_name] = f"WITH {WORDS} SELECT id, {_cast('a', 'word')} AS low, {_cast('b', 'word')} AS high FROM (SELECT id, {_a} AS a, {_b} AS b FROM w)"
for _name, (_build, _value, _kind) in WIDE_SCALARS.items():

    def _query(spark, sf_dir, build=_build, kind=_kind):
        out = W.layered(words(spark, sf_dir), v=lambda let: build(let, *wide_columns()))
        return out.select("id", F.col("v").cast({"word": "long", "int": "int", "bool": "boolean"}[kind]).alias("v"))

    QUERIES[_name] = _query
    ORACLES[_name] = _sql(_value, _kind)


def wide_wrapping_mul(spark, sf_dir):
    p, q, _, _ = wide_columns()
    return W.layered(words(spark, sf_dir), a=lambda let: X.wmul(p, q, 2, let)).select("id", F.get("a", F.lit(0)).alias("low"), F.get("a", F.lit(1)).alias("high"))


def bits_positions(spark, sf_dir):
    return words(spark, sf_dir).select("id", F.explode(B.positions(F.col("x"))).alias("p"))


def bits_positions_back(spark, sf_dir):
    """The n-th set place from the top."""
    return words(spark, sf_dir).select("id", F.posexplode(F.reverse(B.positions(F.col("x")))).alias("n", "p"))


def bits_subsets(spark, sf_dir):
    low = words(spark, sf_dir).select("id", W.and_(F.col("x"), W.word(0x3F)).alias("s"))
    return low.select("id", F.explode(B.subsets_of(F.col("s"))).alias("subset"))


QUERIES |= {"wide_wrapping_mul": wide_wrapping_mul, "bits_positions": bits_positions, "bits_positions_back": bits_positions_back, "bits_subsets": bits_subsets}
_prod = lambda a, b: f"({a}::UHUGEINT * {b}::UHUGEINT)"
_high = f"({_prod('x', 'y')} // {TWO64} + {_prod('x', 'm')} % {TWO64} + {_prod('y', 'y')} % {TWO64}) % {TWO64}"
ORACLES |= {
    "wide_wrapping_mul": f"WITH {WORDS} SELECT id, {_cast('a', 'word')} AS low, {_cast('b', 'word')} AS high FROM (SELECT id, ({_prod('x', 'y')} % {TWO64})::UBIGINT AS a, ({_high})::UBIGINT AS b FROM w)",
    "bits_positions": f"WITH {WORDS} SELECT id, j::INT AS p FROM w, range(64) t(j) WHERE {b('x', 'j')}",
    "bits_positions_back": f"WITH {WORDS} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY j DESC) - 1)::INT AS n, j::INT AS p FROM w, range(64) t(j) WHERE {b('x', 'j')}",
    "bits_subsets": f"WITH {WORDS} SELECT id, s AS subset FROM w, range(64) t(s) WHERE s::UBIGINT & ~(x & 63) = 0",
}
