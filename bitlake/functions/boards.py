"""8x8 bit boards: bit 8 * row + column of a BIGINT word."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitlake.functions.bits import delta_swap, fill_down, fill_up
from bitlake.functions.words import Let, inline, word

FIRST_COLUMN = 0x0101010101010101
LAST_COLUMN = 0x8080808080808080


class Dir(Enum):
    """A sliding direction: (stride, upwards, places a step may land on)."""

    NORTH = (8, True, -1)
    SOUTH = (8, False, -1)
    EAST = (1, True, ~FIRST_COLUMN)
    WEST = (1, False, ~LAST_COLUMN)
    NORTH_EAST = (9, True, ~FIRST_COLUMN)
    NORTH_WEST = (7, True, ~LAST_COLUMN)
    SOUTH_EAST = (7, False, ~FIRST_COLUMN)
    SOUTH_WEST = (9, False, ~LAST_COLUMN)


def _swaps(x: Column, pairs, let: Let) -> Column:
    for m, s in pairs:
        x = let(delta_swap(x, m, s))
    return x


def transpose(x: Column, let: Let = inline) -> Column:
    return _swaps(x, ((0x00AA00AA00AA00AA, 7), (0x0000CCCC0000CCCC, 14), (0x00000000F0F0F0F0, 28)), let)


def flip_vertical(x: Column, let: Let = inline) -> Column:
    return _swaps(x, ((0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16), (0x00000000FFFFFFFF, 32)), let)


def mirror_horizontal(x: Column, let: Let = inline) -> Column:
    return _swaps(x, ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)), let)


def rotate_90_cw(x: Column, let: Let = inline) -> Column:
    return flip_vertical(transpose(x, let), let)


def rotate_90_ccw(x: Column, let: Let = inline) -> Column:
    return transpose(flip_vertical(x, let), let)


def rotate_180(x: Column, let: Let = inline) -> Column:
    return flip_vertical(mirror_horizontal(x, let), let)


def shift(x: Column, to: Dir) -> Column:
    """One step of every bit; those that leave the board vanish."""
    stride, up, land = to.value
    moved = F.shiftleft(x, stride) if up else F.shiftrightunsigned(x, stride)
    return moved.bitwiseAND(word(land))


def slide(pieces: Column, empty: Column, to: Dir, let: Let = inline) -> Column:
    """Places that sliding pieces reach through empty ones, with the first that is not empty."""
    stride, up, land = to.value
    through = let(empty.bitwiseAND(word(land)))
    return shift((fill_up if up else fill_down)(pieces, through, stride, let=let), to)
