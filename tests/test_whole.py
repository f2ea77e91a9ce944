"""Queries over whole tables and texts, against plain Python."""

import pytest
from pyspark.sql import functions as F

from bitlake.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_lanes_of_whole_texts(spark, tmp_path):
    texts = [None, "", "short", "é" * 8, "x" * 47, "".join(chr(33 + i % 90) for i in range(1000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    load, add = [(0, None, None, None)], [(0, None, None, None)]
    for i, x in enumerate(t.encode() for t in texts[1:]):
        b = x + bytes(64)
        for j in range(max(1, -(-len(x) // 16))):
            v, w = b[16 * j : 16 * j + 16], b[16 * j + 16 : 16 * j + 32]
            size = min(16, len(x) - 16 * j)
            load.append((i + 1, j, size, ",".join(map(str, v))))
            add.append((i + 1, j, size, ",".join(str((p + q) & 255) for p, q in zip(v, w))))
    for name, want in (("lanes_load", load), ("lanes_add", add)):
        assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance_of_every_turn(spark, tmp_path):
    texts = [None, "", "naive uber search", "é" * 300, "naïve " * 200]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.d for r in QUERIES["edit_distance_conversations"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else levenshtein("naïve über search".encode(), t.encode()) for i, t in enumerate(texts)}


def next_same_popcount(x):
    if not x:
        return None
    low = x & -x
    up = x + low
    out = up | ((x ^ up) // low >> 2)
    return out if out < 1 << 64 else None


def test_words_whole(spark):
    from bitlake.plans import word_queries

    rows = [[v if v is None or k == "id" else v % (1 << 64) for k, v in r.asDict().items() if k in ("id", "x", "y", "m")] for r in word_queries.words(spark, SF).collect()]
    assert any((x | y << 64) * (y | m << 64) >= 1 << 128 for _, x, y, m in rows)
    got = {r.id: (r.low % (1 << 64), r.high % (1 << 64)) for r in QUERIES["wide_wrapping_mul"](spark, SF).collect()}
    product = {i: (x | y << 64) * (y | m << 64) % (1 << 128) for i, x, y, m in rows}
    assert got == {i: (p % (1 << 64), p >> 64) for i, p in product.items()}
    got = {r.id: r.v % (1 << 64) for r in QUERIES["bits_next_same_popcount"](spark, SF).collect()}
    assert got == {i: next_same_popcount(x) or 0 for i, x, _, _ in rows}
    assert {r.id: r.v for r in QUERIES["bits_is_pow2"](spark, SF).collect()} == {i: x.bit_count() == 1 for i, x, _, _ in rows}


def test_bitmaps_over_their_whole_range(spark, tmp_path):
    n = 40_000
    spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 33).alias("user_id"), F.lit("t").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    held, ids = {}, range(n)
    for i in ids:
        held.setdefault(i * 7 % 33 % 20, []).append(i)
    size = {b: (max(p) // 64 + 1) * 64 for b, p in held.items()}
    asked = {b: {i * 3 % size[b] for i in p} for b, p in held.items()}
    run = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    from bisect import bisect_left

    def words(sets):
        out = {}
        for b, ps in sets.items():
            for p in ps:
                out[b, p >> 6] = out.get((b, p >> 6), 0) | 1 << (p & 63)
        return {(*k, v - (1 << 64) if v >> 63 else v) for k, v in out.items()}

    s = {b: set(p) for b, p in held.items()}
    below = {(b, p): bisect_left(held[b], p) for b in asked for p in asked[b]}
    assert max(p for _, p in below) > 11_999
    assert run("bitmap_bit") == {(b, p, p in s[b]) for b, p in below}
    assert run("bitmap_rank") == {(b, p, r) for (b, p), r in below.items()}
    assert run("bitmap_rank0") == {(b, p, p - r) for (b, p), r in below.items()}
    assert run("bitmap_next_set") == {(b, p, held[b][r] if r < len(held[b]) else None) for (b, p), r in below.items()}
    found = run("bitmap_select")
    assert found == {(b, k, held[b][k]) for b in asked for k in {p % len(held[b]) for p in asked[b]}} and max(k for _, k, _ in found) > 699
    for name, sets in {
        "set_bits": {b: s[b] | asked[b] for b in s}, "clear_bits": {b: s[b] - asked[b] for b in s}, "and": {b: s[b] & asked[b] for b in s}, "or": {b: s[b] | asked[b] for b in s},
        "xor": {b: s[b] ^ asked[b] for b in s}, "andnot": {b: s[b] - asked[b] for b in s}, "filter_pack": {b: {k for k, p in enumerate(sorted(asked[b])) if p in s[b]} for b in s},
    }.items():
        assert run(f"bitmap_{name}") == words(sets), name


def test_look_ups_over_gaps_and_from_a_stored_directory(spark, tmp_path):
    from bisect import bisect_left

    from bitlake import sources
    from bitlake.operators import bitmaps

    held = {1: [3, 64 * 5 + 63, 64 * 4096 * 3 + 7, 64 * 4096 * 3 + 64, 64 * 4096 * 9], 2: [0]}
    asked = [(b, p) for b in (1, 2, 3) for q in held[1] for p in (q - 1, q, q + 1, q + 64, q + 64 * 4096)] + [(1, -70), (1, -1), (1, None), (1, 3)]
    df = spark.createDataFrame([(b, p) for b, ps in held.items() for p in ps], "b int, p long")
    words = bitmaps.from_positions(df, F.col("b"), F.col("p"))
    q = spark.createDataFrame(asked, "bitmap_id int, position long")
    sources.write_directory(words, str(tmp_path / "d"))
    stored = sources.read_directory(spark, str(tmp_path / "d"))
    below = lambda b, p: None if p is None else bisect_left(held.get(b, []), p)
    rows = lambda d: sorted(map(str, map(tuple, d.collect())))
    for table in (words, stored):
        assert rows(bitmaps.rank(table, q)) == sorted(str((b, p, below(b, p))) for b, p in asked)
        ks = [(b, k) for b in (1, 2, 3) for k in (-1, 0, 1, 4, 5)]
        found = bitmaps.select(table, spark.createDataFrame(ks, "bitmap_id int, k long"))
        assert rows(found) == sorted(str((b, k, held[b][k] if b in held and 0 <= k < len(held[b]) else None)) for b, k in ks)
        after = lambda b, p: None if p is None else next((x for x in held.get(b, []) if x >= p), None)
        assert rows(bitmaps.next_set_from(table, q)) == sorted(str((b, p, after(b, p))) for b, p in asked)


def test_runs_go_on_into_the_next_word(spark):
    from bitlake.operators import bitmaps

    held = {1: [60, 61, 62, 63, 64, 65], 2: [62, 63, 128, 129, 130], 3: list(range(10, 90))}
    words = bitmaps.from_positions(spark.createDataFrame([(b, p) for b, ps in held.items() for p in ps], "b int, p long"), F.col("b"), F.col("p"))
    for k in (1, 3, 6, 64):
        want = {(b, next(p for p in ps if all(p + i in ps for i in range(k)))) for b, ps in held.items() if any(all(p + i in ps for i in range(k)) for p in ps)}
        assert {tuple(r) for r in bitmaps.find_run(words, k).collect()} == want


def test_zone_map_of_a_frequent_key(spark):
    from bitlake.operators import spatial

    keys = sorted([7] * 50 + [i * i % 31 for i in range(40)])
    got = sorted(tuple(r) for r in spatial.zone_map(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 8).collect())
    assert got == [(i, min(b), max(b), len(b)) for i, b in enumerate(keys[j : j + 8] for j in range(0, len(keys), 8))]


def test_range_join_of_boxes_of_all_sizes(spark):
    import random

    from bitlake.operators import spatial

    rng = random.Random(4)
    points = [(i, rng.randrange(-50, 400), rng.randrange(0, 400)) for i in range(150)]
    boxes = [(i, x := rng.randrange(-60, 300), x + rng.choice([-1, 0, 3, 200]), y := rng.randrange(0, 300), y + rng.choice([0, 5, 90])) for i in range(40)]
    want = sorted((p, b) for p, x, y in points for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    got = spatial.range_join(spark.createDataFrame(points, "p int, x long, y long"), spark.createDataFrame(boxes, "b int, x0 long, x1 long, y0 long, y1 long"), "x", "y")
    assert sorted(map(tuple, got.select("p", "b").collect())) == want


def test_blocks_over_bands_of_rows(spark, monkeypatch):
    import random

    from bitlake.operators import grids

    monkeypatch.setattr(grids, "BAND", 4)
    rng = random.Random(5)
    rows = {(g, r): rng.getrandbits(6) | rng.getrandbits(6) for g in (1, 2) for r in range(-5, 30) if rng.random() < 0.95}
    df = spark.createDataFrame([(g, r, w) for (g, r), w in rows.items()], "grid_id int, row long, word long")
    for w, h in ((1, 1), (2, 3), (1, 6)):
        block = ((1 << w) - 1)
        want = {(g, r, sum(1 << c for c in range(64) if all(rows.get((g, r + i), 0) >> c & block == block for i in range(h)))) for g, r in rows}
        assert {(x.grid_id, x.row, x.starts) for x in grids.block_starts(df, w, h).collect()} == want
