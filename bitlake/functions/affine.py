"""Affine maps of bytes over GF(2): x -> A x + b. Maps are built and fused on the driver, applied as table look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.words import word


@dataclass(frozen=True)
class Affine8:
    """Byte 7 - i of the matrix makes bit i of the result; then the constant is added (xor)."""

    matrix: int
    add: int = 0

    @classmethod
    def from_rows(cls, rows: list[int], add: int = 0) -> Affine8:
        """Rows in the order of the bits they make."""
        return cls(sum((r & 255) << 8 * (7 - i) for i, r in enumerate(rows)), add)

    @classmethod
    def of(cls, f, add: int = 0) -> Affine8:
        """The map of a linear function of bytes."""
        columns = [f(1 << j) for j in range(8)]
        return cls.from_rows([sum((columns[j] >> i & 1) << j for j in range(8)) for i in range(8)], add)

    @classmethod
    def shl(cls, n: int) -> Affine8:
        return cls.of(lambda x: x << n & 255)

    @classmethod
    def shr(cls, n: int) -> Affine8:
        return cls.of(lambda x: x >> n)

    @classmethod
    def sra(cls, n: int) -> Affine8:
        return cls.of(lambda x: (x - (x >> 7 << 8)) >> min(n, 7) & 255)

    @classmethod
    def rotl(cls, n: int) -> Affine8:
        return cls.of(lambda x: (x << n % 8 | x >> (8 - n % 8)) & 255)

    @classmethod
    def rotr(cls, n: int) -> Affine8:
        return cls.rotl(-n % 8)

    def row(self, i: int) -> int:
        return self.matrix >> 8 * (7 - i) & 255

    @property
    def is_linear(self) -> bool:
        return self.add == 0

    def apply(self, x: int) -> int:
        return sum((bin(self.row(i) & x).count("1") & 1) << i for i in range(8)) ^ self.add

    def table(self) -> list[int]:
        return [self.apply(x) for x in range(256)]

    def tables(self) -> tuple[list[int], list[int]]:
        """Tables of the low and the high nibble whose values are added; the constant is in the low one."""
        return [self.apply(x) for x in range(16)], [self.apply(x << 4) ^ self.add for x in range(16)]

    def then(self, after: Affine8) -> Affine8:
        """This map, then another, as one."""
        return Affine8.of(lambda x: after.apply(self.apply(x)) ^ after.apply(self.add), after.apply(self.add))

    def compose(self, first: Affine8) -> Affine8:
        return first.then(self)

    def column(self, b: Column) -> Column:
        """The map on a column of bytes (0..255)."""
        return F.element_at(F.lit(self.table()), b.cast("int") + 1)

    def apply8(self, x: Column) -> Column:
        """The map on all eight bytes of a word."""
        out = word(0)
        for i in range(8):
            out = out.bitwiseOR(F.shiftleft(self.column(F.shiftrightunsigned(x, 8 * i).bitwiseAND(word(255))).cast("long"), 8 * i))
        return out


IDENTITY = Affine8.of(lambda x: x)
NOT = Affine8.of(lambda x: x, 255)
REVERSE = Affine8.of(lambda x: int(f"{x:08b}"[::-1], 2))
PARITY = Affine8((1 << 64) - 1)
ZERO = Affine8(0)
