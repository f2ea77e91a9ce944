"""The word operators as functions of SQL.

register() gives a session temporary functions with SQL bodies, which the optimizer writes into the query: no UDF
runs. Words are BIGINT bit patterns. A function's arguments are computed once each, so that rounds may nest.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from bitlake.functions.words import LADDER2

#: name -> (parameters, type, body), each using those before it.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "word_add": ("x BIGINT, y BIGINT", "BIGINT", "coalesce(try_add(x, y), CASE WHEN x < 0 THEN (x + 9223372036854775807 + 1) + (y + 9223372036854775807 + 1) ELSE (x - 9223372036854775807 - 1) + (y - 9223372036854775807 - 1) END)"),
    "word_low_ones": ("n INT", "BIGINT", "CASE WHEN n >= 64 THEN -1L WHEN n <= 0 THEN 0L ELSE ~shiftleft(-1L, n) END"),
    "word_rank": ("x BIGINT, n INT", "INT", "bit_count(x & word_low_ones(n))"),
    "word_negate": ("x BIGINT", "BIGINT", "word_add(~x, 1L)"),
    "word_lowest_set_mask": ("x BIGINT", "BIGINT", "x & word_negate(x)"),
    "word_clear_lowest_set": ("x BIGINT", "BIGINT", "x ^ word_lowest_set_mask(x)"),
    "word_trailing_zeros": ("x BIGINT", "INT", "CASE WHEN x = 0 THEN 64 ELSE bit_count(word_add(word_lowest_set_mask(x), -1L)) END"),
    "word_parity": ("x BIGINT", "BOOLEAN", "bit_count(x) & 1 = 1"),
    "word_is_pow2": ("x BIGINT", "BOOLEAN", "bit_count(x) = 1"),
    "word_gray_encode": ("x BIGINT", "BIGINT", "x ^ shiftrightunsigned(x, 1)"),
    "word_bit": ("x BIGINT, n INT", "BOOLEAN", "n BETWEEN 0 AND 63 AND shiftrightunsigned(x, n) & 1 = 1"),
    "word_blend": ("x BIGINT, y BIGINT, mask BIGINT", "BIGINT", "x & ~mask | y & mask"),
    "byte_distance": ("x STRING, y STRING", "INT", "levenshtein(decode(encode(x, 'UTF-8'), 'ISO-8859-1'), decode(encode(y, 'UTF-8'), 'ISO-8859-1'))"),
}
_spread = "x"
for _i, (_shift, _mask) in enumerate(LADDER2):
    FUNCTIONS[f"morton_round_{_i}"] = ("x BIGINT", "BIGINT", f"(x | shiftleft(x, {_shift})) & {_mask}")
    _spread = f"morton_round_{_i}({_spread})"
FUNCTIONS["morton_spread"] = ("x BIGINT", "BIGINT", _spread.replace("(x)", "(x & 4294967295)"))
FUNCTIONS["morton2_key"] = ("x BIGINT, y BIGINT", "BIGINT", "morton_spread(x) | shiftleft(morton_spread(y), 1)")


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
