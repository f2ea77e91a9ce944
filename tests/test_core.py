"""Operators of the library against models and against their SQL, on small inputs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bitlake.functions import affine, bits, words
from bitlake.operators import bytescan, curves, fuzzy
from bitlake.plans import catalogue, cover

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each family; the driver compares all of them.
NAMES = ["word_wrapping_mul", "bits_find_escaped", "bits_ternary", "bits_next_same_popcount", "wide_wrapping_add", "morton3_encode", "board_slide_north_east", "spatial_range_hilbert", "bitmap_rank", "bitmap_select", "bitmap_next_set", "fuzzy_join", "lanes_mul_add_pairs", "grid_find_block"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    mine = catalogue.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    want = db.sql(catalogue.ORACLES[name])
    assert columns == sorted(want.columns)
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in mine.collect())))
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted(str(tuple(r[c] for c in columns)) for r in rows)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def xy2d(x, y, order):
    d = 0
    for level in range(order - 1, -1, -1):
        rx, ry, below = x >> level & 1, y >> level & 1, (1 << level) - 1
        d, x, y = d << 2 | (3 * rx) ^ ry, x & below, y & below
        if not ry:
            x, y = (y ^ below, x ^ below) if rx else (y, x)
    return d


@pytest.mark.parametrize("order", [1, 2, 5, 16, 31, 32])
def test_hilbert2_is_the_textbook_curve(spark, order):
    rng = random.Random(order)
    df = spark.createDataFrame([(rng.getrandbits(order), rng.getrandbits(order)) for _ in range(100)], "x long, y long")
    df = curves.with_key(df, "h", F.col("x"), F.col("y"), "hilbert", order)
    for r in curves.with_xy(df, F.col("h"), "a", "b", "hilbert", order).collect():
        assert r.h == words.signed(xy2d(r.x, r.y, order)) and (r.a, r.b) == (r.x, r.y)


def walk3(code, order, table):
    frame = out = 0
    for level in range(order - 1, -1, -1):
        step = table[frame | (code >> 3 * level & 7)]
        frame, out = step & ~7, out << 3 | step & 7
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 16, 20, 21])
def test_hilbert3_is_the_published_curve(spark, order):
    from bitlake.plans.frame_queries import CELL_TO_INDEX3, INDEX_TO_CELL3

    rng = random.Random(order)
    cells = [(x, y, z) for x in range(1 << order) for y in range(1 << order) for z in range(1 << order)] if order < 4 else [tuple(rng.getrandbits(order) for _ in range(3)) for _ in range(300)]
    df = words.layered(spark.createDataFrame(cells, "x long, y long, z long"), h=lambda let: curves.hilbert3(F.col("x"), F.col("y"), F.col("z"), order, let))
    df = words.layered(df, m=lambda let: curves.morton3_from_hilbert(F.col("h"), order, let))
    for r in words.layered(df, back=lambda let: curves.hilbert3_from_morton(F.col("m"), order, let)).collect():
        code = sum((c >> i & 1) << 3 * i + j for j, c in enumerate((r.x, r.y, r.z)) for i in range(order))
        assert (r.h, r.m, r.back) == (walk3(code, order, CELL_TO_INDEX3), code, r.h) and walk3(r.h, order, INDEX_TO_CELL3) == code


def test_cover_and_intersects():
    rng = random.Random(2)
    for _ in range(60):
        o = rng.choice([2, 3, 4])
        x, y = (sorted(rng.randrange(1 << o) for _ in range(2)) for _ in range(2))
        cells = {xy2d(a, b, o) for a in range(x[0], x[1] + 1) for b in range(y[0], y[1] + 1)}
        for budget in (1, 2, 5, 2048):
            ranges = cover.cover("hilbert", o, x, y, budget)
            assert len(ranges) <= budget and all(any(a <= c <= b for a, b in ranges) for c in cells)
            assert budget < 2048 or sum(b - a + 1 for a, b in ranges) == len(cells)
        a = rng.randrange(1 << 2 * o)
        assert cover.intersects("hilbert", o, (a, a + 5), x, y) == any(a <= c <= a + 5 for c in cells)
    assert cover.cover("morton", 4, (3, 2), (0, 1), 0) == []
    with pytest.raises(ValueError):
        cover.cover("morton", 4, (0, 1), (0, 1), 0)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, diagonal + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_fuzzy_join_against_all_pairs(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
    left = [(i, None if i == 3 else word()) for i in range(60)]
    right = [(i, None if i == 5 else word()) for i in range(60)]
    want = sorted((i, j, d) for i, a in left for j, b in right if a is not None and b is not None and (d := levenshtein(a.encode(), b.encode())) <= k)
    l, r = spark.createDataFrame(left, "i long, s string"), spark.createDataFrame(right, "j long, t string")  # noqa: E741
    for variants in (1, 12, 2048):
        assert sorted(map(tuple, fuzzy.fuzzy_join(l, r, "s", "t", k, variants).select("i", "j", "distance").collect())) == want


def test_morton_runs_without_a_walk():
    rng = random.Random(3)
    for _ in range(300):
        o = rng.choice([1, 2, 4, 7])
        x, y = (tuple(sorted(rng.randrange((1 << o) + 2) for _ in range(2))) for _ in range(2))
        assert cover.morton_runs(o, x, y) == len(cover.cover("morton", o, x, y, 1 << 14))


def test_morton_cover_and_intersects():
    rng = random.Random(12)
    code = lambda a, b: sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(4))
    for _ in range(60):
        x, y = (sorted(rng.randrange(16) for _ in range(2)) for _ in range(2))
        cells = {code(a, b) for a in range(x[0], x[1] + 1) for b in range(y[0], y[1] + 1)}
        assert {k for a, b in cover.cover("morton", 4, x, y, 2048) for k in range(a, b + 1)} == cells
        a = rng.randrange(256)
        assert cover.intersects("morton", 4, (a, a + 5), x, y) == any(a <= c <= a + 5 for c in cells)


def test_approximate_search():
    rng = random.Random(7)
    for _ in range(40):
        needle, text = (bytes(rng.choice(b"abc") for _ in range(rng.randint(*n))) for n in ((1, 6), (0, 25)))
        k = rng.randint(0, 2)
        least = {e: min(levenshtein(needle, text[s:e]) for s in range(e + 1)) for e in range(1, len(text) + 1)}
        assert fuzzy.search(needle, text, k) == [(e, d) for e, d in least.items() if d <= k]
        found = fuzzy.occurrences(needle, text, k)
        assert all(levenshtein(needle, text[s:e]) == d == least[e] for s, e, d in found)
        runs = [e for e in least if least[e] <= k and least.get(e - 1, k + 1) > k]
        assert len(found) == len(runs) and fuzzy.substring_distance(needle, text) == min([len(needle), *least.values()])
    assert fuzzy.substring_distance(b"abc", b"") == 3 and fuzzy.substring_distance(b"", b"x") == 0


def test_json_structure_carries_over_chunks():
    text = rb'{"a [\" x": [1, "b\\", {"c": ":"}], "d": 2}'
    whole, _, _ = bytescan.structure(text)
    for cut in range(len(text)):
        first, escaped, inside = bytescan.structure(text[:cut])
        rest, _, _ = bytescan.structure(text[cut:], escaped, inside)
        assert first + [cut + p for p in rest] == whole


def test_affine_maps():
    assert affine.IDENTITY.matrix == 0x0102040810204080 and affine.REVERSE.matrix == 0x8040201008040201
    both = affine.REVERSE.then(affine.Affine8.shl(3))
    assert both == affine.Affine8.shr(3).then(affine.REVERSE)
    low, high = affine.Affine8.rotl(3).then(affine.NOT).tables()
    assert all(low[x & 15] ^ high[x >> 4] == affine.Affine8.rotl(3).then(affine.NOT).apply(x) for x in range(256))


def test_gather_factor():
    assert bits.gather_factor(0x0101010101010101, 56) == 0x0102040810204080
    assert bits.gather_factor(0b11, 63) is None


def test_streaming_scan_waits_for_earlier_chunks(spark, tmp_path):
    from bitlake.streaming import json_structure

    source, out, kinds = str(tmp_path / "in"), [], "stream_id string, chunk long, text string"
    for rows in ([("s", 2, "]}"), ("t", 0, "[")], [("s", 0, '{"a\\'), ("t", 0, "{{"), ("t", 1, None)], [("s", 1, '"[": [1'), ("s", 0, "[[[["), ("t", None, "[")]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(kinds).json(source)
        query = json_structure(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.stream_id, r.chunk, r.structure) for r in out) == [("s", 0, [0]), ("s", 1, [3, 5]), ("s", 2, [0, 1]), ("t", 0, [0]), ("t", 1, [])]
