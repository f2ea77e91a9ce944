"""Key ranges of rectangles on a curve, and whether a range of keys can meet a rectangle. Plain Python on the driver.

cover() gives at most ``budget`` inclusive ranges, sorted, disjoint and not touching, that hold every
cell of the rectangle. If the exact cover fits the budget it is that. Otherwise quadrants are refined to
the greatest depth whose cover has at most twice the budget, and the narrowest gaps are closed, the first
of equal ones first. Rectangles are inclusive; what lies past the grid is clipped, an empty one gives no
ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

Range = tuple[int, int]


def clip(bounds: tuple, order: int) -> Range | None:
    """(low, high), either None for unbounded, as inclusive and within the grid; None if empty."""
    low, high = bounds
    low, high = max(0, low or 0), min((1 << order) - 1, (1 << order) - 1 if high is None else high)
    return (low, high) if low <= high else None


def _quadrants(curve: str, swap: bool, flip: bool) -> list[tuple[int, int, bool, bool]]:
    """(x bit, y bit, frame) of the four quadrants of a node in key order."""
    if curve == "morton":
        return [(0, 0, False, False), (1, 0, False, False), (0, 1, False, False), (1, 1, False, False)]
    out = []
    for digit in range(4):
        a, b = digit >> 1, (digit >> 1) ^ (digit & 1)  # the frame's own coordinates
        x, y = (b, a) if swap else (a, b)
        turn = b == 0
        out.append((x ^ flip, y ^ flip, swap != turn, flip != (turn and a == 1)))
    return out


def _walk(curve: str, order: int, x: Range, y: Range, depth: int) -> Iterator[Range]:
    """Key ranges, in order, of the nodes inside the rectangle or at the depth and meeting it."""
    stack = [(0, 0, 0, 0, False, False)]  # key prefix, x and y prefix, level, frame
    while stack:
        key, cx, cy, level, swap, flip = stack.pop()
        left = order - level
        x0, x1, y0, y1 = cx << left, ((cx + 1) << left) - 1, cy << left, ((cy + 1) << left) - 1
        if x1 < x[0] or x0 > x[1] or y1 < y[0] or y0 > y[1]:
            continue
        if level == depth or (x[0] <= x0 and x1 <= x[1] and y[0] <= y0 and y1 <= y[1]):
            yield key << 2 * left, ((key + 1) << 2 * left) - 1
            continue
        for i, (bx, by, s, f) in reversed(list(enumerate(_quadrants(curve, swap, flip)))):
            stack.append((key << 2 | i, cx << 1 | bx, cy << 1 | by, level + 1, s, f))


def _joined(ranges: Iterator[Range], most: int | None = None) -> list[Range] | None:
    """Touching ranges joined; None as soon as there are more than most."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and out[-1][1] + 1 == a:
            out[-1][1] = b
        else:
            if most is not None and len(out) == most:
                return None
            out.append([a, b])
    return [tuple(r) for r in out]


def _multiples(low: int, high: int, rest: int, step: int) -> int:
    """How many numbers of low..high leave the rest after division by step."""
    return max(0, (high - rest) // step - (low - 1 - rest) // step) if low <= high else 0


def morton_runs(order: int, x: tuple, y: tuple) -> int:
    """The number of ranges of the exact Morton cover, without walking it.

    A run starts at a cell whose predecessor lies outside. Where a code's lowest set bit is bit t of x, its
    predecessor is one column back with y's lower t bits set; where it is bit t of y, one row back with x's
    lower t + 1 bits set. Cells of either kind, and those of them with a predecessor inside, are products of
    arithmetic progressions.
    """
    xs, ys = clip(x, order), clip(y, order)
    if xs is None or ys is None:
        return 0
    (x0, x1), (y0, y1) = xs, ys
    runs = int(x0 == 0 and y0 == 0)
    for t in range(order):
        half, whole = 1 << t, 2 << t
        runs += _multiples(x0, x1, half, whole) * _multiples(y0, y1, 0, half) - _multiples(x0 + 1, x1, half, whole) * _multiples(y0, y1 - half + 1, 0, half)
        runs += _multiples(x0, x1, 0, whole) * _multiples(y0, y1, half, whole) - _multiples(x0, x1 - whole + 1, 0, whole) * _multiples(y0 + 1, y1, half, whole)
    return runs


def cover(curve: str, order: int, x: tuple, y: tuple, budget: int = 16) -> list[Range]:
    xs, ys = clip(x, order), clip(y, order)
    if xs is None or ys is None:
        return []
    if budget < 1:
        raise ValueError("a rectangle that is not empty needs a budget of one range at least")
    best = None
    for depth in range(order + 1):
        found = _joined(_walk(curve, order, xs, ys, depth), 2 * budget)
        if found is None:
            break
        best = found
    gaps = sorted(range(1, len(best)), key=lambda i: (best[i][0] - best[i - 1][1], i))
    closed = set(gaps[: max(0, len(best) - budget)])
    out: list[Range] = []
    for i, (a, b) in enumerate(best):
        out = [*out[:-1], (out[-1][0], b)] if i in closed else [*out, (a, b)]
    return out


def intersects(curve: str, order: int, keys: Range, x: tuple, y: tuple) -> bool:
    """Whether a cell of the rectangle has its key in the inclusive range: one descent."""
    xs, ys = clip(x, order), clip(y, order)
    first, last = max(0, keys[0]), min((1 << 2 * order) - 1, keys[1])
    if xs is None or ys is None or first > last:
        return False
    stack = [(0, 0, 0, 0, False, False)]
    while stack:
        key, cx, cy, level, swap, flip = stack.pop()
        left = order - level
        k0, k1 = key << 2 * left, ((key + 1) << 2 * left) - 1
        x0, x1, y0, y1 = cx << left, ((cx + 1) << left) - 1, cy << left, ((cy + 1) << left) - 1
        if k1 < first or k0 > last or x1 < xs[0] or x0 > xs[1] or y1 < ys[0] or y0 > ys[1]:
            continue
        if (first <= k0 and k1 <= last) or (xs[0] <= x0 and x1 <= xs[1] and ys[0] <= y0 and y1 <= ys[1]):
            return True
        for i, (bx, by, s, f) in enumerate(_quadrants(curve, swap, flip)):
            stack.append((key << 2 | i, cx << 1 | bx, cy << 1 | by, level + 1, s, f))
    return False
