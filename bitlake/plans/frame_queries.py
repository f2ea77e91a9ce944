"""Queries for the operators on tables: curves and rectangles, bitmaps, fuzzy text, lanes, grids, byte scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitlake import sources
from bitlake.functions import affine as A
from bitlake.functions import lanes as L
from bitlake.functions import words as W
from bitlake.operators import bitmaps, bytescan, curves, fuzzy, grids, spatial

ORDER = 31
BOX = ((50, 900), (3, 60))


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, sf_dir, *more):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), *more)


# --- curves -------------------------------------------------------------------


def hilbert2_encode(spark, sf_dir):
    p = _points(spark, sf_dir)
    return curves.with_key(p, "v", F.col("x"), F.col("y"), "hilbert", ORDER).select("o", "n", "x", "y", "v")


def hilbert2_decode(spark, sf_dir):
    p = curves.with_key(_points(spark, sf_dir), "v", F.col("x") * 1000003, F.col("y") * 777, "hilbert", ORDER)
    return curves.with_xy(p, F.col("v"), "dx", "dy", "hilbert", ORDER).select("o", "n", "dx", "dy")


def morton2_columns(spark, sf_dir):
    return curves.with_key(_points(spark, sf_dir), "v", F.col("x"), F.col("y"), "morton", ORDER).select("o", "n", "v")


def hilbert_from_morton(spark, sf_dir):
    p = curves.with_key(_points(spark, sf_dir), "m", F.col("x"), F.col("y"), "morton", ORDER)
    return W.layered(p, v=lambda let: curves.hilbert_from_morton(F.col("m"), ORDER, let)).select("o", "n", "v")


def morton_from_hilbert(spark, sf_dir):
    p = curves.with_key(_points(spark, sf_dir), "h", F.col("x"), F.col("y"), "hilbert", ORDER)
    return W.layered(p, v=lambda let: curves.morton_from_hilbert(F.col("h"), ORDER, let)).select("o", "n", "v")


def hilbert3_encode(spark, sf_dir):
    p = _points(spark, sf_dir)
    return W.layered(p, v=lambda let: curves.hilbert3(F.col("x"), F.col("y"), F.col("n").cast("long"), 16, let)).select("o", "n", "v")


def hilbert3_decode(spark, sf_dir):
    p = W.layered(_points(spark, sf_dir), h=lambda let: curves.hilbert3(F.col("x"), F.col("y"), F.col("n").cast("long"), 21, let))
    xyz: list = []
    p = W.layered(p, dx=lambda let: (xyz.extend(curves.hilbert3_xyz(F.col("h"), 21, let)), xyz[0])[1], dy=lambda let: xyz[1], dz=lambda let: xyz[2])
    return p.select("o", "n", "dx", "dy", "dz")


def hilbert3_from_morton(spark, sf_dir):
    p = W.layered(_points(spark, sf_dir), m=lambda let: curves.morton3(F.col("x"), F.col("y"), F.col("n").cast("long"), let))
    return W.layered(p, v=lambda let: curves.hilbert3_from_morton(F.col("m"), 17, let)).select("o", "n", "v")


def morton3_from_hilbert(spark, sf_dir):
    """The way back from indexes of order 20 that the line's own numbers make up: decoded cells, as Morton codes."""
    h = (F.col("x") * 1000003 + F.col("y") * 777).bitwiseAND(W.word((1 << 60) - 1))
    return W.layered(_points(spark, sf_dir), v=lambda let: curves.morton3_from_hilbert(h, 20, let)).select("o", "n", "v")


def morton2_decode_columns(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("m", F.col("x") * 1000003 + F.col("y") * 777)
    return curves.with_xy(p, F.col("m"), "dx", "dy", "morton", ORDER).select("o", "n", "dx", "dy")


def hilbert_path_adjacent(spark, sf_dir):
    """Steps of the curve that do not lead to a neighbouring cell: none."""
    h = spark.range(1 << 16).withColumnRenamed("id", "h")
    a = curves.with_xy(h, F.col("h"), "x0", "y0", "hilbert", ORDER)
    b = curves.with_xy(a, F.col("h") + 1, "x1", "y1", "hilbert", ORDER)
    return b.agg(F.count_if(F.abs(F.col("x0") - F.col("x1")) + F.abs(F.col("y0") - F.col("y1")) != 1).alias("breaks"))


def quantise(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", curves.quantise(F.col("c_acctbal"), -1000.0, 10000.0, 20).alias("cell"))


def _hilbert_sql(select: str, cells: str = "SELECT x, y FROM p") -> str:
    """The index digit by digit from the top: rotate and reflect what is left after each quadrant."""
    return f"""WITH RECURSIVE p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS x, l_suppkey AS y FROM lineitem),
s AS (SELECT x AS x0, y AS y0, x, y, 0::BIGINT AS d, {ORDER - 1}::BIGINT AS l FROM (SELECT DISTINCT x, y FROM ({cells}))
 UNION ALL SELECT x0, y0,
   CASE WHEN ry = 1 THEN x & b WHEN rx = 1 THEN b - (y & b) ELSE y & b END,
   CASE WHEN ry = 1 THEN y & b WHEN rx = 1 THEN b - (x & b) ELSE x & b END,
   d * 4 + xor(3 * rx, ry), l - 1
 FROM (SELECT *, (x >> l) & 1 AS rx, (y >> l) & 1 AS ry, (1::BIGINT << l) - 1 AS b FROM s WHERE l >= 0)),
h AS (SELECT x0 AS x, y0 AS y, d AS v FROM s WHERE l = -1)
{select}"""


#: A published state table of the 3D curve, frame | octant to frame | digit, with its own numbering of
#: frames (eight entries each), and its inverse.
CELL_TO_INDEX3 = [
    48, 33, 27, 34, 47, 78, 28, 77, 66, 29, 51, 52, 65, 30, 72, 63, 76, 95, 75, 24, 53, 54, 82, 81, 18, 3, 17, 80, 61, 4, 62, 15,
    0, 59, 71, 60, 49, 50, 86, 85, 84, 83, 5, 90, 79, 56, 6, 89, 32, 23, 1, 94, 11, 12, 2, 93, 42, 41, 13, 14, 35, 88, 36, 31,
    92, 37, 87, 38, 91, 74, 8, 73, 46, 45, 9, 10, 7, 20, 64, 19, 70, 25, 39, 16, 69, 26, 44, 43, 22, 55, 21, 68, 57, 40, 58, 67,
]
INDEX_TO_CELL3 = [
    48, 33, 35, 26, 30, 79, 77, 44, 78, 68, 64, 50, 51, 25, 29, 63, 27, 87, 86, 74, 72, 52, 53, 89, 83, 18, 16, 1, 5, 60, 62, 15,
    0, 52, 53, 57, 59, 87, 86, 66, 61, 95, 91, 81, 80, 2, 6, 76, 32, 2, 6, 12, 13, 95, 91, 17, 93, 41, 40, 36, 38, 10, 11, 31,
    14, 79, 77, 92, 88, 33, 35, 82, 70, 10, 11, 23, 21, 41, 40, 4, 19, 25, 29, 47, 46, 68, 64, 34, 45, 60, 62, 71, 67, 18, 16, 49,
]


def _hilbert3_sql(code: str, order: int, table: list[int]) -> str:
    """A code's digits of three bits through the table, from the top."""
    return f"""WITH RECURSIVE p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS x, l_suppkey AS y FROM lineitem),
c AS (SELECT o, n, {code} AS c FROM p),
s AS (SELECT c AS c0, c, 0::BIGINT AS v, 0 AS f, {order - 1} AS l FROM (SELECT DISTINCT c FROM c)
 UNION ALL SELECT c0, c, v * 8 + (e & 7), e & 120, l - 1 FROM (SELECT *, list_extract({table}, f + ((c >> (3 * l)) & 7) + 1) AS e FROM s WHERE l >= 0))
SELECT c.o, c.n, s.v FROM c JOIN s ON s.c0 = c.c WHERE s.l = -1"""


_MORTON3 = "list_sum(list_transform(range({n}), lambda j: (((x >> j) & 1) << (3 * j)) | (((y >> j) & 1) << (3 * j + 1)) | (((n::BIGINT >> j) & 1) << (3 * j + 2))))::BIGINT"
_MORTON = "list_sum(list_transform(range({n}), lambda j: ((({x} >> j) & 1) << (2 * j)) | ((({y} >> j) & 1) << (2 * j + 1))))::BIGINT"

# --- rectangles ---------------------------------------------------------------


def _indexed(df, curve="hilbert"):
    """df written as an index by key and read again, so that key ranges reach the scan."""
    path = sources.scratch_path(df.sparkSession, "points")
    sources.build_index(df, path, F.col("x"), F.col("y"), curve=curve, order=ORDER)
    return sources.read_points(df.sparkSession, path)


def _range(curve):
    def query(spark, sf_dir):
        p = _indexed(_points(spark, sf_dir, "l_returnflag", "l_quantity"), curve)
        found = spatial.range_query(p, "x", "y", *BOX, curve=curve, order=ORDER)
        return found.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))

    return query


def spatial_orders_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("x"), F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("y"))
    return spatial.range_query(_indexed(o), "x", "y", (50, 400), (300, 900), budget=8).select("o_orderkey", "x", "y")


def zone_map_prune(spark, sf_dir):
    """Points in the rectangle, counted over the blocks that may hold them and over all: the same."""
    keyed = _indexed(_points(spark, sf_dir))
    zones = spatial.prune(spatial.zone_map(keyed, "cell_key"), *BOX)
    inside = keyed.where(F.col("x").between(*BOX[0]) & F.col("y").between(*BOX[1])).select(F.col("cell_key").alias("key")).distinct()
    met = spatial.zones_of_keys(keyed, "cell_key").join(inside, "key", "left_semi").join(zones.select("block"), "block")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def zone_map_blocks(spark, sf_dir):
    """The blocks of 1024 rows in key order that may hold a point of the rectangle."""
    return spatial.prune(spatial.zone_map(_indexed(_points(spark, sf_dir)), "cell_key"), *BOX)


def quadtree_rollup(spark, sf_dir):
    p = curves.with_key(_points(spark, sf_dir), "cell_key", F.col("x"), F.col("y"), "morton", ORDER)
    return spatial.quadtree_rollup(p, "cell_key", 5)


def spatial_range_join(spark, sf_dir):
    points = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("x"), (F.col("o_orderkey") % 1000).alias("y"))
    boxes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") * 13 % 1200).alias("x0"), (F.col("s_suppkey") * 13 % 1200 + 40).alias("x1"), (F.col("s_suppkey") * 7 % 900).alias("y0"), (F.col("s_suppkey") * 7 % 900 + 25).alias("y1"))
    return spatial.range_join(points, boxes, "x", "y").select("o_orderkey", "box")


_BOX_SQL = f"l_partkey BETWEEN {BOX[0][0]} AND {BOX[0][1]} AND l_suppkey BETWEEN {BOX[1][0]} AND {BOX[1][1]}"

# --- bitmaps ------------------------------------------------------------------
# One bitmap per user of the ids of their events; queries are positions spread over each bitmap.


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id"), "event_type")


def _bitmap(spark, sf_dir, kind=None):
    e = _events(spark, sf_dir)
    e = e.where(F.col("event_type") == kind) if kind else e
    return bitmaps.from_positions(e, F.col("user_id") % 20, F.col("event_id"))


def _asked(spark, sf_dir):
    """Positions from all events, over the whole range of each bitmap."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("bitmap_id"), F.col("event_id"))
    size = e.groupBy("bitmap_id").agg(((F.shiftright(F.max("event_id"), 6) + 1) * 64).alias("size"))
    return e.join(size, "bitmap_id").select("bitmap_id", (F.col("event_id") * 3 % F.col("size")).alias("position")).distinct()


_E = """e AS (SELECT DISTINCT user_id % 20 AS bitmap_id, event_id AS position FROM events),
s AS (SELECT bitmap_id, (max(position) // 64 + 1) * 64 AS size, count(*) AS ones FROM e GROUP BY 1),
a AS (SELECT DISTINCT bitmap_id, position * 3 % size AS position FROM e JOIN s USING (bitmap_id)),
u AS (SELECT *, 1 AS one FROM e UNION ALL SELECT *, 0 AS one FROM a),
b AS (SELECT bitmap_id, position, one, (sum(one) OVER (PARTITION BY bitmap_id ORDER BY position, one))::BIGINT AS rank FROM u)"""
_WORDS = "list_sum(list_transform(list_distinct(list(position & 63)), lambda j: 1::UBIGINT << j::UBIGINT))"
_SIGNED = "CASE WHEN w >= 9223372036854775808 THEN (w::HUGEINT - 18446744073709551616)::BIGINT ELSE w::BIGINT END"


_PRIMES = "WITH primes AS (SELECT i AS p FROM range(2, 100000) r(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 317) f(j) WHERE j * j <= i AND i % j = 0))"


def _words_sql(positions: str) -> str:
    return f"WITH {_E} SELECT bitmap_id, word_idx, {_SIGNED} AS word FROM (SELECT bitmap_id, position >> 6 AS word_idx, {_WORDS} AS w FROM ({positions}) GROUP BY ALL)"


def bitmap_from_positions(spark, sf_dir):
    return _bitmap(spark, sf_dir)


def bitmap_positions(spark, sf_dir):
    return bitmaps.positions(_bitmap(spark, sf_dir))


def bitmap_count_ones(spark, sf_dir):
    return bitmaps.count_ones(_bitmap(spark, sf_dir))


def bitmap_bit(spark, sf_dir):
    return bitmaps.bit(_bitmap(spark, sf_dir), _asked(spark, sf_dir)).select("bitmap_id", "position", F.coalesce("bit", F.lit(False)).alias("bit"))


def bitmap_set_bits(spark, sf_dir):
    return bitmaps.set_bits(_bitmap(spark, sf_dir), _asked(spark, sf_dir))


def bitmap_clear_bits(spark, sf_dir):
    return bitmaps.clear_bits(_bitmap(spark, sf_dir), _asked(spark, sf_dir)).where("word != 0")


def _mask(spark, sf_dir):
    return bitmaps.from_positions(_asked(spark, sf_dir), F.col("bitmap_id"), F.col("position"))


def _combine(how):
    def query(spark, sf_dir):
        return bitmaps.combine(_bitmap(spark, sf_dir), _mask(spark, sf_dir), how)

    return query


def bitmap_rank(spark, sf_dir):
    return bitmaps.rank(_bitmap(spark, sf_dir), _asked(spark, sf_dir))


def bitmap_rank0(spark, sf_dir):
    return bitmaps.rank0(_bitmap(spark, sf_dir), _asked(spark, sf_dir))


def bitmap_select(spark, sf_dir):
    bitmap = _bitmap(spark, sf_dir)
    asked = _asked(spark, sf_dir).join(bitmaps.count_ones(bitmap), "bitmap_id").select("bitmap_id", (F.col("position") % F.col("ones")).alias("k")).distinct()
    return bitmaps.select(bitmap, asked)


def bitmap_next_set(spark, sf_dir):
    return bitmaps.next_set_from(_bitmap(spark, sf_dir), _asked(spark, sf_dir))


def bitmap_find_run(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return bitmaps.find_run(bitmaps.from_positions(e, F.col("user_id") % 2, F.floor(F.col("event_id") / 3)), 5)


def bitmap_directory(spark, sf_dir):
    return bitmaps.directory(_bitmap(spark, sf_dir), 4).select("bitmap_id", "word_idx", "before", "ones")


def bitmap_filter_pack(spark, sf_dir):
    return bitmaps.filter_pack(_bitmap(spark, sf_dir), _mask(spark, sf_dir)).where("word != 0")


def _primes(spark):
    n = 100_000
    factors = spark.range(2, 317).withColumnRenamed("id", "p")
    composite = factors.select(F.explode(F.sequence(F.col("p") * F.col("p"), F.lit(n - 1), F.col("p"))).alias("position"))
    full = bitmaps.from_positions(spark.range(2, n).withColumnRenamed("id", "position"), F.lit(0), F.col("position"))
    return bitmaps.combine(full, bitmaps.from_positions(composite, F.lit(0), F.col("position")), "andnot")


def bitmap_twin_primes(spark, sf_dir):
    """Primes under 10^5 whose next prime is two further."""
    return bitmaps.followed(_primes(spark), 2).select("position")


def bitmap_extent(spark, sf_dir):
    return bitmaps.extent(_bitmap(spark, sf_dir))


def sql_functions(spark, sf_dir):
    """The functions of SQL over keys of orders."""
    from bitlake.functions import sql

    sql.register(spark)
    read(spark, sf_dir, "orders").createOrReplaceTempView("bitlake_orders")
    return spark.sql(
        "SELECT o_orderkey, word_add(o_orderkey, 9223372036854775807) AS a, word_rank(o_orderkey * 77, 9) AS r, word_clear_lowest_set(o_orderkey) AS c, word_trailing_zeros(o_orderkey) AS t, "
        "word_gray_encode(o_orderkey) AS g, word_parity(o_custkey) AS p, morton2_key(o_orderkey, o_custkey) AS m, byte_distance(o_orderpriority, 'ségment') AS d FROM bitlake_orders"
    )


def bitmap_prime_sieve(spark, sf_dir):
    """Primes under 10^5 by a bitmap of composites: their number, and the last of them by select."""
    primes = _primes(spark)
    ones = bitmaps.count_ones(primes).select("bitmap_id", F.col("ones").alias("n"), (F.col("ones") - 1).alias("k"))
    return bitmaps.select(primes, ones).join(ones, "bitmap_id").select("n", F.col("position").alias("last"))


# --- fuzzy text ---------------------------------------------------------------


def edit_distance(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", fuzzy.distance(F.col("p_name"), F.col("p_type")).alias("d"))


def edit_distance_conversations(spark, sf_dir):
    """Every turn of any length; null where the text is null."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", fuzzy.distance(F.lit("naïve über search"), F.col("text")).alias("d"))


def fuzzy_topk(spark, sf_dir):
    return fuzzy.nearest(read(spark, sf_dir, "part").select("p_name").distinct(), F.col("p_name"), "part blue 7", 10).select("p_name", "distance")


def fuzzy_join(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "Supplier", "Customer").alias("s_name"))
    return fuzzy.fuzzy_join(p, s, "c_name", "s_name", 1).select("c_custkey", "s_suppkey", "distance")


def fuzzy_substring_distance(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fuzzy.with_substring_distance(p, "p_name", "prat", "d").select("p_partkey", "d")


def fuzzy_search(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fuzzy.find(p, "p_name", "prat", 2, "search").select("p_partkey", F.col("end").alias("at"), "distance")


def fuzzy_occurrences(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy.find(d, "text", "nntion there", 2).select("doc_id", "start", "end", "distance")


#: Sellers' table per pattern row: least distance of "prat" to a stretch ending at each byte, row by row of the table.
_SEMI = """WITH RECURSIVE t AS (SELECT p_partkey, p_name AS s FROM part),
c AS (SELECT p_partkey, s, 0 AS j, [0, 1, 2, 3, 4] AS col FROM t
 UNION ALL SELECT p_partkey, s, j + 1, [0, c1, c2, c3, least(col[5] + 1, c3 + 1, col[4] + (s[j + 1] <> 't')::INT)] FROM (
  SELECT *, least(col[4] + 1, c2 + 1, col[3] + (s[j + 1] <> 'a')::INT) AS c3 FROM (
   SELECT *, least(col[3] + 1, c1 + 1, col[2] + (s[j + 1] <> 'r')::INT) AS c2 FROM (
    SELECT *, least(col[2] + 1, 1, col[1] + (s[j + 1] <> 'p')::INT) AS c1 FROM c WHERE j < length(s)))))"""

# --- lanes --------------------------------------------------------------------


def _vectors(spark, sf_dir):
    """Every 16-byte vector of every text as a, the two after it as b and c, zeros past its end; an empty text has one, a null text a null one."""
    raw = F.col("text").cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(raw) - 1) / 16)).cast("int")
    parts = F.transform(F.array(raw), lambda t: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, 16 * i + 1, F.lit(48))))[0]
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.when(raw.isNotNull(), parts)).alias("vector", "part"))
    half = lambda k: F.conv(F.hex(F.rpad(F.substring("part", 8 * k + 1, 8), F.lit(8), F.lit(b"\0"))), 16, -10).cast("long")
    d = d.select("doc_id", "vector", F.when(F.col("part").isNotNull(), F.least(F.lit(16), F.octet_length("part"))).alias("length"), *[half(k).alias(f"w{k}") for k in range(6)])
    at = lambda k: F.when(F.col("vector").isNotNull(), F.array(*[F.shiftrightunsigned(f"w{w}", n).bitwiseAND(255).cast("int") for w in (k, k + 1) for n in range(56, -1, -8)]))
    return d.select("doc_id", "vector", "length", at(0).alias("a"), at(2).alias("b"), at(4).alias("c"))


_HEX = "'0123456789ABCDEF'"
_bytes = lambda at: f"list_transform(range(16), lambda j: 16 * (instr({_HEX}, substr(h, (2 * ({at} + j) + 1)::BIGINT, 1)) - 1) + instr({_HEX}, substr(h, (2 * ({at} + j) + 2)::BIGINT, 1)) - 1)"
_LANES = f"""WITH t AS (SELECT doc_id, text IS NULL AS absent, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(hex(encode(text)), '.{{1,32}}') END AS p FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN absent THEN [NULL] ELSE range(len(p)) END)::INT AS vector, unnest(CASE WHEN absent THEN [NULL] ELSE p END) AS x, unnest(p[2:]) AS y, unnest(p[3:]) AS z FROM t),
r AS (SELECT doc_id, vector, (length(x) // 2)::INT AS length, rpad(x || coalesce(y, '') || coalesce(z, ''), 96, '0') AS h FROM u),
l AS (SELECT doc_id, vector, length, {_bytes(0)} AS a, {_bytes(16)} AS b, {_bytes(32)} AS c FROM r)"""
_zip = lambda e: f"list_transform(range(1, 17), lambda j: ({e})::INT)"
_A, _B, _C = "a[j]", "b[j]", "c[j]"
_bits = lambda e: f"list_sum(list_transform(range(8), lambda q: CASE WHEN {e} THEN 1 << q ELSE 0 END))"
_TABLE = [(7 * t + 3) % 256 for t in range(16)]
_i16 = lambda p: f"(greatest(-32768, least(32767, {p})) & 65535)"
_w = lambda j: f"(CASE WHEN b[{j}] >= 128 THEN b[{j}] - 256 ELSE b[{j}] END)"
_pair = _i16(f"a[2 * ((j - 1) // 2) + 1] * {_w('2 * ((j - 1) // 2) + 1')} + a[2 * ((j - 1) // 2) + 2] * {_w('2 * ((j - 1) // 2) + 2')}")
#: name -> (column of lanes a, b, c; SQL of lane j, or of the whole value after "=").
LANES: dict = {
    "lanes_load": (lambda a, b, c: a, _A),
    "lanes_splat_xor": (lambda a, b, c: L.xor(a, L.splat(0x5A)), f"xor({_A}, 90)"),
    "lanes_zero": (lambda a, b, c: L.or_(L.zero(), b), _B),
    "lanes_lane": (lambda a, b, c: L.lane(a, 5), "=a[6]::INT"),
    "lanes_and": (lambda a, b, c: L.and_(a, b), f"{_A} & {_B}"),
    "lanes_or": (lambda a, b, c: L.or_(a, b), f"{_A} | {_B}"),
    "lanes_xor": (lambda a, b, c: L.xor(a, b), f"xor({_A}, {_B})"),
    "lanes_not": (lambda a, b, c: L.not_(a), f"255 - {_A}"),
    "lanes_add": (lambda a, b, c: L.add(a, b), f"({_A} + {_B}) & 255"),
    "lanes_sub": (lambda a, b, c: L.sub(a, b), f"({_A} - {_B} + 256) & 255"),
    "lanes_shl": (lambda a, b, c: L.shl(a, 3), f"({_A} << 3) & 255"),
    "lanes_shr": (lambda a, b, c: L.shr(a, 3), f"{_A} >> 3"),
    "lanes_cmp_eq": (lambda a, b, c: L.cmp_eq(a, b), f"CASE WHEN {_A} = {_B} THEN 255 ELSE 0 END"),
    "lanes_cmp_le": (lambda a, b, c: L.cmp_le(a, b), f"CASE WHEN {_A} <= {_B} THEN 255 ELSE 0 END"),
    "lanes_cmp_lt": (lambda a, b, c: L.cmp_lt(a, b), f"CASE WHEN {_A} < {_B} THEN 255 ELSE 0 END"),
    "lanes_cmp_ge": (lambda a, b, c: L.cmp_ge(a, b), f"CASE WHEN {_A} >= {_B} THEN 255 ELSE 0 END"),
    "lanes_cmp_gt": (lambda a, b, c: L.cmp_gt(a, b), f"CASE WHEN {_A} > {_B} THEN 255 ELSE 0 END"),
    "lanes_lut16": (lambda a, b, c: L.lut16(L.xor(a, L.splat(0x80)), F.lit(_TABLE)), f"CASE WHEN {_A} < 128 THEN 0 ELSE list_extract({_TABLE}, ({_A} & 15) + 1) END"),
    "lanes_lut16_nibbles": (lambda a, b, c: L.lut16_nibbles(a, _TABLE, _TABLE[::-1]), f"list_extract({_TABLE}, ({_A} & 15) + 1) & list_extract({_TABLE[::-1]}, ({_A} >> 4) + 1)"),
    "lanes_to_bitmask": (lambda a, b, c: L.to_bitmask(L.cmp_eq(L.and_(a, L.splat(1)), L.zero())), "=list_sum(list_transform(range(1, 17), lambda j: CASE WHEN a[j] & 1 = 0 THEN 1 << (j - 1) ELSE 0 END))::BIGINT"),
    "lanes_blend": (lambda a, b, c: L.blend(a, b, c), f"({_A} & (255 - {_C})) | ({_B} & {_C})"),
    "lanes_min": (lambda a, b, c: L.minimum(a, b), f"least({_A}, {_B})"),
    "lanes_max": (lambda a, b, c: L.maximum(a, b), f"greatest({_A}, {_B})"),
    "lanes_shuffle": (lambda a, b, c: L.shuffle(a, b), f"CASE WHEN {_B} >= 128 THEN 0 ELSE a[{_B} % 16 + 1] END"),
    "lanes_concat_shift": (lambda a, b, c: L.concat_shift(a, b, 5), "CASE WHEN j + 5 <= 16 THEN a[j + 5] ELSE b[j + 5 - 16] END"),
    "lanes_add_sat": (lambda a, b, c: L.add_sat(a, b), f"least({_A} + {_B}, 255)"),
    "lanes_sub_sat": (lambda a, b, c: L.sub_sat(a, b), f"greatest({_A} - {_B}, 0)"),
    "lanes_unpack_lo": (lambda a, b, c: L.unpack_lo(a, b), "CASE WHEN j % 2 = 1 THEN a[(j + 1) // 2] ELSE b[j // 2] END"),
    "lanes_unpack_hi": (lambda a, b, c: L.unpack_hi(a, b), "CASE WHEN j % 2 = 1 THEN a[8 + (j + 1) // 2] ELSE b[8 + j // 2] END"),
    "lanes_sum_abs_diff": (lambda a, b, c: L.sum_abs_diff(a, b), "=list_sum(list_transform(range(1, 17), lambda j: abs(a[j] - b[j])))::INT"),
    "lanes_mul_add_pairs": (lambda a, b, c: L.mul_add_pairs(a, b), f"CASE WHEN j % 2 = 1 THEN {_pair} & 255 ELSE {_pair} >> 8 END"),
    "lanes_affine": (lambda a, b, c: L.affine(a, A.Affine8.shl(2).then(A.NOT)), f"255 - (({_A} << 2) & 255)"),
    "lanes_reverse_bits": (lambda a, b, c: L.reverse_bits(a), _bits(f"({_A} >> (7 - q)) & 1 = 1")),
    "lanes_sra": (lambda a, b, c: L.sra(a, 3), f"({_A} >> 3) | CASE WHEN {_A} >= 128 THEN 224 ELSE 0 END"),
    "lanes_rotl": (lambda a, b, c: L.rotl(a, 3), f"(({_A} << 3) | ({_A} >> 5)) & 255"),
    "lanes_rotr": (lambda a, b, c: L.rotr(a, 3), f"(({_A} >> 3) | ({_A} << 5)) & 255"),
    "lanes_avg_round": (lambda a, b, c: L.avg_round(a, b), f"({_A} + {_B} + 1) // 2"),
    "lanes_avg_floor": (lambda a, b, c: L.avg_floor(a, b), f"({_A} + {_B}) // 2"),
    "lanes_ternary": (lambda a, b, c: L.ternary(a, b, c, 0xCA), f"({_A} & {_B}) | ((255 - {_A}) & {_C})"),
}

# --- grids --------------------------------------------------------------------


def _grid(spark, sf_dir):
    """One grid of 25 rows per supplier nation: bit c of row r says that the pair has a supplier or part in common."""
    e = read(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 8).alias("grid_id"), (F.col("event_id") % 40).alias("row")).agg(F.bit_or(F.call_function("shiftleft", W.word(1), (F.floor(F.col("event_id") / 40) % 48).cast("int"))).alias("word"))


_GRID = "WITH g AS (SELECT DISTINCT user_id % 8 AS grid_id, event_id % 40 AS row, (event_id // 40) % 48 AS col FROM events)"
_BLOCK = "SELECT a.grid_id, a.row, a.col FROM g a WHERE (SELECT count(*) FROM g b WHERE b.grid_id = a.grid_id AND b.row BETWEEN a.row AND a.row + 1 AND b.col BETWEEN a.col AND a.col + 2) = 6"


def grid_block_starts(spark, sf_dir):
    found = grids.block_starts(_grid(spark, sf_dir), 3, 2)
    from bitlake.functions.bits import positions

    return found.select("grid_id", "row", F.explode(positions(F.col("starts"))).alias("col"))


def grid_find_block(spark, sf_dir):
    return grids.find_block(_grid(spark, sf_dir), 3, 2)


def grid_fill_block(spark, sf_dir):
    return grids.fill_block(_grid(spark, sf_dir), 3, 10, 8, 5).select("grid_id", "row", F.bit_count("word").alias("n"))


def grid_clear_block(spark, sf_dir):
    return grids.clear_block(_grid(spark, sf_dir), 3, 10, 8, 5).select("grid_id", "row", F.bit_count("word").alias("n"))


# --- byte scans ---------------------------------------------------------------


def json_structure(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "props")
    return bytescan.json_structure(e, "props").select("event_id", F.concat_ws(",", F.col("structure").cast("array<string>")).alias("structure"))


def byte_class_counts(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", *[c.alias(n) for n, c in bytescan.class_counts(F.col("html"), {"digits": "0-9", "brackets": "<>", "high": "\x80-\xff"}).items()])


def byte_map(spark, sf_dir):
    swap = [b ^ 0x20 if chr(b).isascii() and chr(b).isalpha() else b for b in range(256)]
    return read(spark, sf_dir, "part").select("p_partkey", F.decode(bytescan.map_bytes(F.col("p_name"), swap), "UTF-8").alias("name"))


QUERIES: dict = {
    "spatial_range_hilbert": _range("hilbert"),
    "spatial_range_morton": _range("morton"),
    **{f"bitmap_{how}": _combine(how) for how in ("and", "or", "xor", "andnot")},
}
for _f in (
    hilbert2_encode, hilbert2_decode, morton2_columns, hilbert_from_morton, morton_from_hilbert, hilbert3_encode, hilbert3_decode, hilbert3_from_morton, morton3_from_hilbert, morton2_decode_columns, hilbert_path_adjacent, quantise,
    spatial_orders_days, zone_map_prune, zone_map_blocks, quadtree_rollup, spatial_range_join,
    bitmap_from_positions, bitmap_positions, bitmap_count_ones, bitmap_bit, bitmap_set_bits, bitmap_clear_bits, bitmap_rank, bitmap_rank0, bitmap_select, bitmap_next_set, bitmap_find_run, bitmap_directory, bitmap_filter_pack, bitmap_prime_sieve, bitmap_twin_primes, bitmap_extent, sql_functions,
    edit_distance, edit_distance_conversations, fuzzy_topk, fuzzy_join, fuzzy_substring_distance, fuzzy_search, fuzzy_occurrences,
    grid_block_starts, grid_find_block, grid_fill_block, grid_clear_block, json_structure, byte_class_counts, byte_map,
):
    QUERIES[_f.__name__] = _f

_P = "WITH p AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS x, l_suppkey AS y FROM lineitem)"
_FLAG = f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE {_BOX_SQL} GROUP BY 1"
ORACLES: dict = {
    "hilbert2_encode": _hilbert_sql("SELECT p.o, p.n, p.x, p.y, h.v FROM p JOIN h USING (x, y)"),
    "hilbert2_decode": _P + " SELECT o, n, x * 1000003 & 2147483647 AS dx, y * 777 & 2147483647 AS dy FROM p",
    "morton2_columns": _P + f" SELECT o, n, {_MORTON.format(x='x', y='y', n=31)} AS v FROM p",
    "hilbert_from_morton": _hilbert_sql("SELECT p.o, p.n, h.v FROM p JOIN h USING (x, y)"),
    "morton_from_hilbert": _P + f" SELECT o, n, {_MORTON.format(x='x', y='y', n=31)} AS v FROM p",
    "hilbert3_encode": _hilbert3_sql(_MORTON3.format(n=16), 16, CELL_TO_INDEX3),
    "hilbert3_from_morton": _hilbert3_sql(_MORTON3.format(n=17), 17, CELL_TO_INDEX3),
    "morton3_from_hilbert": _hilbert3_sql("((x * 1000003 + y * 777) & 1152921504606846975)", 20, INDEX_TO_CELL3),
    "morton2_decode_columns": _P + f" SELECT o, n, {'list_sum(list_transform(range(31), lambda j: (((x * 1000003 + y * 777) >> (2 * j)) & 1) << j))::BIGINT'} AS dx, {'list_sum(list_transform(range(31), lambda j: (((x * 1000003 + y * 777) >> (2 * j + 1)) & 1) << j))::BIGINT'} AS dy FROM p",
    "hilbert3_decode": _P + " SELECT o, n, x AS dx, y AS dy, n::BIGINT AS dz FROM p",
    # The cells of successive indexes, digit by digit from the lowest: what is there is turned, then moved to its quadrant.
    "hilbert_path_adjacent": f"""WITH RECURSIVE s AS (SELECT h, h AS t, 0::BIGINT AS x, 0::BIGINT AS y, 0 AS l FROM range({(1 << 16) + 1}) r(h)
 UNION ALL SELECT h, t >> 2, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN n - 1 - y ELSE y END + n * rx, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN n - 1 - x ELSE x END + n * ry, l + 1
 FROM (SELECT *, (t >> 1) & 1 AS rx, xor(t, t >> 1) & 1 AS ry, 1::BIGINT << l AS n FROM s WHERE l < {ORDER}))
SELECT count(*) FILTER (abs(x - u) + abs(y - v) <> 1) AS breaks FROM (SELECT x, y, lead(x) OVER (ORDER BY h) AS u, lead(y) OVER (ORDER BY h) AS v FROM s WHERE l = {ORDER}) WHERE u IS NOT NULL""",
    "quantise": "SELECT c_custkey, least(greatest(floor((c_acctbal - -1000.0) / (10000.0 - -1000.0) * 1048575), 0), 1048575)::BIGINT AS cell FROM customer",
    "spatial_range_hilbert": _FLAG,
    "spatial_range_morton": _FLAG,
    "spatial_orders_days": "SELECT * FROM (SELECT o_orderkey, o_custkey AS x, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS y FROM orders) WHERE x BETWEEN 50 AND 400 AND y BETWEEN 300 AND 900",
    "zone_map_prune": f"SELECT count(*) AS n FROM lineitem WHERE {_BOX_SQL}",
    # A block may hold a point of the rectangle where the rectangle has a cell between its first and last key.
    "zone_map_blocks": _hilbert_sql(
        """, k AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) // 1024 AS block FROM p JOIN h USING (x, y)),
z AS (SELECT block, min(v) AS first, max(v) AS last, count(*) AS rows FROM k GROUP BY block)
SELECT * FROM z WHERE EXISTS (SELECT 1 FROM h WHERE x BETWEEN %d AND %d AND y BETWEEN %d AND %d AND v BETWEEN first AND last)""" % (*BOX[0], *BOX[1]),
        "SELECT x, y FROM p UNION ALL SELECT i AS x, j AS y FROM range(%d, %d) a(i), range(%d, %d) b(j)" % (BOX[0][0], BOX[0][1] + 1, BOX[1][0], BOX[1][1] + 1),
    ),
    "quadtree_rollup": _P + f" SELECT {_MORTON.format(x='(x >> 5)', y='(y >> 5)', n=26)} AS cell, count(*) AS n FROM p GROUP BY 1",
    "spatial_range_join": "SELECT o_orderkey, s_suppkey AS box FROM orders, supplier WHERE o_custkey BETWEEN s_suppkey * 13 % 1200 AND s_suppkey * 13 % 1200 + 40 AND o_orderkey % 1000 BETWEEN s_suppkey * 7 % 900 AND s_suppkey * 7 % 900 + 25",
    "bitmap_from_positions": _words_sql("SELECT * FROM e"),
    "bitmap_positions": f"WITH {_E} SELECT * FROM e",
    "bitmap_count_ones": f"WITH {_E} SELECT bitmap_id, count(*) AS ones FROM e GROUP BY 1",
    "bitmap_bit": f"WITH {_E} SELECT a.*, e.position IS NOT NULL AS bit FROM a LEFT JOIN e USING (bitmap_id, position)",
    "bitmap_set_bits": _words_sql("SELECT * FROM e UNION SELECT * FROM a"),
    "bitmap_clear_bits": _words_sql("SELECT * FROM e EXCEPT SELECT * FROM a"),
    "bitmap_and": _words_sql("SELECT * FROM e INTERSECT SELECT * FROM a"),
    "bitmap_or": _words_sql("SELECT * FROM e UNION SELECT * FROM a"),
    "bitmap_xor": _words_sql("(SELECT * FROM e EXCEPT SELECT * FROM a) UNION (SELECT * FROM a EXCEPT SELECT * FROM e)"),
    "bitmap_andnot": _words_sql("SELECT * FROM e EXCEPT SELECT * FROM a"),
    "bitmap_rank": f"WITH {_E} SELECT bitmap_id, position, rank FROM b WHERE one = 0",
    "bitmap_rank0": f"WITH {_E} SELECT bitmap_id, position, position - rank AS rank0 FROM b WHERE one = 0",
    "bitmap_select": f"WITH {_E}, q AS (SELECT DISTINCT bitmap_id, position % ones AS k FROM a JOIN s USING (bitmap_id)) SELECT q.bitmap_id, q.k, b.position FROM q JOIN b ON q.bitmap_id = b.bitmap_id AND b.one = 1 AND b.rank = q.k + 1",
    "bitmap_next_set": f"WITH {_E} SELECT bitmap_id, position, next FROM (SELECT *, min(position) FILTER (one = 1) OVER (PARTITION BY bitmap_id ORDER BY position, one ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM u) WHERE one = 0",
    "bitmap_find_run": "WITH e AS (SELECT DISTINCT user_id % 2 AS bitmap_id, event_id // 3 AS p FROM events), r AS (SELECT *, lead(p, 4) OVER (PARTITION BY bitmap_id ORDER BY p) AS q FROM e) SELECT bitmap_id, min(p) AS start FROM r WHERE q = p + 4 GROUP BY 1",
    "bitmap_directory": f"WITH {_E}, w AS (SELECT bitmap_id, position >> 6 AS word_idx, count(*) AS ones FROM e GROUP BY ALL) SELECT bitmap_id, word_idx, (sum(ones) OVER (PARTITION BY bitmap_id ORDER BY word_idx) - ones)::BIGINT AS before, ones FROM w",
    "bitmap_filter_pack": f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY bitmap_id ORDER BY position) - 1 AS k FROM a), f AS (SELECT r.bitmap_id, r.k AS position FROM r JOIN e USING (bitmap_id, position)) SELECT bitmap_id, word_idx, {_SIGNED} AS word FROM (SELECT bitmap_id, position >> 6 AS word_idx, {_WORDS} AS w FROM f GROUP BY ALL)",
    "bitmap_prime_sieve": f"{_PRIMES} SELECT count(*) AS n, max(p) AS last FROM primes",
    "bitmap_twin_primes": f"{_PRIMES} SELECT p AS position FROM (SELECT p, lead(p) OVER (ORDER BY p) AS q FROM primes) WHERE q = p + 2",
    "bitmap_extent": f"WITH {_E} SELECT bitmap_id, max(position) // 64 + 1 AS words, (max(position) // 64 + 1) * 64 AS bits, false AS is_empty FROM e GROUP BY 1",
    "sql_functions": "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 9223372036854775807 ELSE (o_orderkey::HUGEINT + 9223372036854775807 - 18446744073709551616)::BIGINT END AS a, bit_count((o_orderkey * 77) & 511)::INT AS r, "
    "(CASE WHEN o_orderkey = 0 THEN 0 ELSE o_orderkey & (o_orderkey - 1) END)::BIGINT AS c, CASE WHEN o_orderkey = 0 THEN 64 ELSE list_position(list_transform(range(64), lambda j: (o_orderkey >> j) & 1), 1) - 1 END::INT AS t, "
    f"xor(o_orderkey, o_orderkey >> 1) AS g, bit_count(o_custkey) % 2 = 1 AS p, {_MORTON.format(x='o_orderkey', y='o_custkey', n=31)} AS m, levenshtein(o_orderpriority, 'ségment')::INT AS d FROM orders",
    "edit_distance": "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d FROM part",
    "edit_distance_conversations": "SELECT conv_id, turn, role, levenshtein('naïve über search', text)::INT AS d FROM conversations",
    "fuzzy_topk": "SELECT DISTINCT p_name, levenshtein('part blue 7', p_name)::INT AS distance FROM part ORDER BY distance, p_name LIMIT 10",
    "fuzzy_join": "SELECT c_custkey, s_suppkey, levenshtein(c_name, replace(s_name, 'Supplier', 'Customer'))::INT AS distance FROM customer, supplier WHERE abs(strlen(c_name) - strlen(s_name)) <= 1 AND levenshtein(c_name, replace(s_name, 'Supplier', 'Customer')) <= 1",
    "fuzzy_substring_distance": _SEMI + " SELECT p_partkey, min(col[5])::INT AS d FROM c GROUP BY 1",
    "fuzzy_search": _SEMI + " SELECT p_partkey, j::INT AS at, col[5]::INT AS distance FROM c WHERE j > 0 AND col[5] <= 2",
    "grid_block_starts": f"{_GRID} SELECT grid_id, row, col::INT AS col FROM ({_BLOCK})",
    "grid_find_block": f"{_GRID} SELECT grid_id, row, col::INT AS col FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY row, col) AS n FROM ({_BLOCK})) WHERE n = 1",
    "grid_fill_block": f"{_GRID} SELECT grid_id, row, (CASE WHEN row BETWEEN 3 AND 7 THEN 8 + count(*) FILTER (col NOT BETWEEN 10 AND 17) ELSE count(*) END)::INT AS n FROM g GROUP BY 1, 2",
    "grid_clear_block": f"{_GRID} SELECT grid_id, row, (count(*) FILTER (NOT (row BETWEEN 3 AND 7 AND col BETWEEN 10 AND 17)))::INT AS n FROM g GROUP BY 1, 2",
    # No string of this table holds a quote, backslash or structural character, so all of them count.
    "json_structure": "SELECT event_id, array_to_string(list_filter(range(length(props)), lambda i: contains('{}[]:,', substr(props, i + 1, 1))), ',') AS structure FROM events",
    "byte_class_counts": "SELECT page_id, length(regexp_replace(html, '[^0-9]', '', 'g'))::INT AS digits, length(regexp_replace(html, '[^<>]', '', 'g'))::INT AS brackets, strlen(regexp_replace(html, '[\\x00-\\x7f]', '', 'g'))::INT AS high FROM pages",
    "byte_map": "SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS name FROM part",
}
for _name, (_build, _value) in LANES.items():

    def _query(spark, sf_dir, build=_build, whole=_value[0] == "="):
        v = build(F.col("a"), F.col("b"), F.col("c"))
        return _vectors(spark, sf_dir).select("doc_id", "vector", "length", F.when(F.col("a").isNotNull(), v if whole else F.concat_ws(",", v.cast("array<string>"))).alias("v"))

    QUERIES[_name] = _query
    ORACLES[_name] = f"{_LANES} SELECT doc_id, vector, length, CASE WHEN vector IS NOT NULL THEN {_value[1:] if _value[0] == '=' else f"array_to_string({_zip(_value)}, ',')"} END AS v FROM l"
