"""The registered queries over point clouds, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import frame
from lattica.functions import morton as M
from lattica.operators import codec, frustum, lod, octree, region, schema, stats
from lattica.plans import clouds
from lattica.streaming import ledger

Query = Callable[[SparkSession, str], DataFrame]

LIMIT, DETAIL = 256, 5
BOX = region.Box((100.0, 1500.0, 500.0), (900.0, 2900.0, 3500.0))
BOX_SQL = "gx BETWEEN 100 AND 900 AND gy BETWEEN 1500 AND 2900 AND gz BETWEEN 500 AND 3500"
OVERLAP_SQL = "max_gx >= 100 AND min_gx <= 900 AND max_gy >= 1500 AND min_gy <= 2900 AND max_gz >= 500 AND min_gz <= 3500"
EYE, FOCAL, ERROR = (200.0, 1800.0, 900.0), 1000.0, 400.0
#: A wedge of half-spaces a*x + b*y + c*z + d >= 0. Fixed values of the registered queries.
PLANES = [(1.0, 0.0, 0.0, -50.0), (-1.0, 0.5, 0.0, 500.0), (0.0, 1.0, 0.0, -1300.0), (0.0, -1.0, 0.0, 3200.0), (0.0, 0.5, 1.0, -900.0), (0.0, 0.0, -1.0, 4200.0)]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _decode_sql(m: str) -> tuple[str, str, str]:
    one = lambda axis: " + ".join(f"((({m}) >> {3 * k + axis}) & 1) * {1 << k}" for k in range(20))
    return one(0), one(1), one(2)


def _msb_sql(x: str) -> str:
    return f"(length(bin({x})) - 1)"


P = clouds.ORDERS_SQL
ROOT = f"root AS (SELECT 5 * ({_msb_sql('xor(min(morton), max(morton))')} // 15) + 4 AS r FROM pts)"
LEVELS = f"""{P}, {ROOT},
lvl AS MATERIALIZED (SELECT CAST(l.l AS INTEGER) AS lod, morton >> CAST(3 * (l.l + 1) AS INTEGER) AS key, count(*) AS n, min(morton) AS low, max(morton) AS high, CAST(bit_or(1 << CAST((morton >> CAST(3 * l.l AS INTEGER)) & 7 AS INTEGER)) AS INTEGER) AS child_mask,
  min(gx) AS min_gx, max(gx) AS max_gx, min(gy) AS min_gy, max(gy) AS max_gy, min(gz) AS min_gz, max(gz) AS max_gz
  FROM pts, range(0, 20) AS l(l) WHERE l.l <= (SELECT r FROM root) GROUP BY 1, 2)"""
NODES = f"""{LEVELS},
split AS MATERIALIZED (SELECT lod - 1 AS lod, key AS up FROM lvl WHERE n > {LIMIT}),
held AS (SELECT * FROM lvl WHERE lod = (SELECT r FROM root) UNION ALL SELECT c.* FROM lvl c JOIN split p ON p.lod = c.lod AND p.up = c.key >> 3),
nodes AS MATERIALIZED (SELECT *, (n <= {LIMIT} OR lod = 0) AS is_leaf, lod // 5 AS page, 4 - lod % 5 AS level FROM held)"""
_AT = "(SELECT p.*, d.lod AS at_lod, p.morton >> (3 * (d.lod + 1)) AS at_key FROM pts p, (SELECT DISTINCT lod FROM nodes WHERE {}) d)"
LEAF = f"""{NODES},
leafed AS MATERIALIZED (SELECT a.* EXCLUDE (at_lod, at_key), a.at_lod AS leaf_lod, a.at_key AS leaf_key FROM {_AT.format('is_leaf')} a JOIN nodes n ON n.is_leaf AND n.lod = a.at_lod AND n.key = a.at_key)"""
SAMPLES = f"""{NODES},
sample AS MATERIALIZED (SELECT * FROM (SELECT n.lod, n.key, a.morton >> (3 * (greatest(n.lod - {DETAIL}, 0) + 1)) AS cell, a.* EXCLUDE (at_lod, at_key), row_number() OVER (PARTITION BY n.lod, a.morton >> (3 * (greatest(n.lod - {DETAIL}, 0) + 1)) ORDER BY a.morton, a.id) AS rn
  FROM {_AT.format('NOT is_leaf')} a JOIN nodes n ON NOT n.is_leaf AND n.lod = a.at_lod AND n.key = a.at_key) s WHERE rn = 1)"""
#: The unit of codecs and ranks: a leaf, which holds a bounded number of rows.
UNIT = ["leaf_lod", "leaf_key"]

_orders = clouds.orders


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    """The points, the root's level and the node table, which is made once: it is small, and plans read it repeatedly."""
    points = _orders(spark, sf_dir)
    top = octree.root(points)
    return points, top, clouds.settled(octree.nodes(points, LIMIT, top))


def _leafed(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, top, tree = _tree(spark, sf_dir)
    return octree.leaf_of_point(points, LIMIT, tree, top)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _orders(spark, sf_dir)
    return octree.nodes(points, LIMIT, octree.root(points))


# --- Morton algebra and the frame -------------------------------------------------------------------------------


@query(f"WITH {P} SELECT id, gx, gy, gz, morton FROM pts")
def morton_encode(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", "gx", "gy", "gz", "morton")


@query(f"WITH {P} SELECT id, gx AS dx, gy AS dy, gz AS dz FROM pts")
def morton_decode(spark, sf_dir):
    x, y, z = M.decode("morton")
    return _orders(spark, sf_dir).select("id", x.alias("dx"), y.alias("dy"), z.alias("dz"))


@query(f"WITH {clouds.EMBEDDINGS_SQL} SELECT id, gx, gy, gz, morton, label FROM pts")
def morton_encode_floats(spark, sf_dir):
    return clouds.embeddings(spark, sf_dir).select("id", "gx", "gy", "gz", "morton", "label")


@query(f"WITH {P} SELECT id, CAST({' + '.join(f'((((gx << 10) >> {21 + k}) & 1) + 2 * (((gy << 10) >> {21 + k}) & 1) + 4 * (((gz << 10) >> {21 + k}) & 1)) * {8**k}' for k in range(20))} AS BIGINT) AS hi, gx << 10 AS wx, gy << 10 AS wy, gz << 10 AS wz FROM pts")
def morton_wide(spark, sf_dir):
    wide = _orders(spark, sf_dir).select("id", M.encode_wide(F.shiftleft("gx", 10), F.shiftleft("gy", 10), F.shiftleft("gz", 10)).alias("m"))
    x, y, z = M.decode_wide("m")
    return wide.select("id", F.col("m.hi").alias("hi"), x.alias("wx"), y.alias("wy"), z.alias("wz"))


@query(f"WITH {LEAF} SELECT id, CAST({_msb_sql('xor(morton, before)')} // 3 AS INTEGER) AS lod FROM (SELECT id, morton, lag(morton) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY morton, id) AS before FROM leafed) x WHERE before IS NOT NULL")
def morton_lod_of_neighbours(spark, sf_dir):
    w = Window.partitionBy(*UNIT).orderBy("morton", "id")
    return _leafed(spark, sf_dir).withColumn("before", F.lag("morton").over(w)).filter("before is not null").select("id", M.lod_between("morton", "before").alias("lod"))


@query(f"WITH {P}, {ROOT} SELECT CAST(l.l AS INTEGER) AS lod, CAST((morton >> CAST(3 * l.l AS INTEGER)) & 7 AS INTEGER) AS child, count(*) AS n FROM pts, range(0, 20) AS l(l) WHERE l.l <= (SELECT r FROM root) GROUP BY 1, 2")
def morton_child_histogram(spark, sf_dir):
    points = _orders(spark, sf_dir)
    rows = points.select("morton", F.explode(F.sequence(F.lit(0), F.lit(octree.root(points)))).alias("lod"))  # collapses to eight rows a level in each task
    return rows.groupBy("lod", M.child("morton", F.col("lod")).alias("child")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT o_orderkey AS id, o_totalprice / 7.0::DOUBLE AS x FROM orders) SELECT id, CAST(trunc((x - -10000.0::DOUBLE) / 0.25::DOUBLE) AS BIGINT) AS g, CAST(trunc((x - -10000.0::DOUBLE) / 0.25::DOUBLE) AS BIGINT) * 0.25::DOUBLE + -10000.0::DOUBLE AS back FROM w")
def quantize_dequantize(spark, sf_dir):
    o = clouds.table(spark, sf_dir, "orders")
    w = o.select(F.col("o_orderkey").alias("id"), frame.quantize(F.col("o_totalprice") / F.lit(7.0), 0.25, -10000.0).alias("g"))
    return w.select("id", "g", frame.dequantize(F.col("g"), 0.25, -10000.0).alias("back"))


@query(f"WITH {LEAF} SELECT leaf_lod, leaf_key, id, row_number() OVER (PARTITION BY leaf_lod, leaf_key ORDER BY morton, id) - 1 AS rank FROM leafed")
def morton_sorted_rank(spark, sf_dir):
    return _leafed(spark, sf_dir).select(*UNIT, "id", (F.row_number().over(Window.partitionBy(*UNIT).orderBy("morton", "id")) - 1).cast("long").alias("rank"))


@query(f"WITH {P} SELECT id // 4096 AS chunk, id, row_number() OVER (PARTITION BY id // 4096 ORDER BY id) - 1 AS original_order FROM pts")
def original_order(spark, sf_dir):
    chunks = _orders(spark, sf_dir).select(F.floor(F.col("id") / 4096).alias("chunk"), "id")
    return chunks.withColumn("original_order", (F.row_number().over(Window.partitionBy("chunk").orderBy("id")) - 1).cast("long"))


# --- Octree -----------------------------------------------------------------------------------------------------


@query(f"WITH {LEVELS} SELECT lod, count(*) AS prefixes, CAST(sum(n) AS BIGINT) AS points, max(n) AS most FROM lvl GROUP BY lod")
def octree_level_counts(spark, sf_dir):
    return octree.levels(_orders(spark, sf_dir)).groupBy("lod").agg(F.count(F.lit(1)).alias("prefixes"), F.sum("n").alias("points"), F.max("n").alias("most"))


@query(f"WITH {NODES} SELECT lod, key, n, low, high, child_mask, is_leaf, page, level, min_gx, max_gx, min_gy, max_gy, min_gz, max_gz FROM nodes")
def octree_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("lod", "key", "n", "low", "high", F.col("child_mask").cast("int").alias("child_mask"), "is_leaf", "page", "level", *(f"{n}_{a}" for a in ("gx", "gy", "gz") for n in ("min", "max")))


@query(f"WITH {NODES} SELECT lod, key, n FROM nodes WHERE is_leaf")
def octree_leaves(spark, sf_dir):
    return _nodes(spark, sf_dir).filter("is_leaf").select("lod", "key", "n")


@query(f"""WITH {P}, {ROOT}, k AS (SELECT min(morton) >> CAST(3 * (max(r) + 1) AS INTEGER) AS root_key, max(r) AS r, count(*) AS point_count, min(gx) AS min_gx, max(gx) AS max_gx, min(gy) AS min_gy, max(gy) AS max_gy, min(gz) AS min_gz, max(gz) AS max_gz FROM pts, root)
SELECT CAST(r AS INTEGER) AS root_lod, root_key, point_count, {', '.join(f'CAST({d} AS BIGINT) AS cell_{a}' for a, d in zip('xyz', _decode_sql('root_key << CAST(3 * (r + 1) AS INTEGER)'), strict=True))}, CAST(1 AS BIGINT) << CAST(r + 1 AS INTEGER) AS side, min_gx, max_gx, min_gy, max_gy, min_gz, max_gz FROM k""")
def root_cell(spark, sf_dir):
    return octree.root_cell(_orders(spark, sf_dir))


@query(f"WITH {LEAF} SELECT id, leaf_lod, leaf_key FROM leafed")
def leaf_of_point(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    return octree.leaf_of_point(points, LIMIT, tree, top).select("id", "leaf_lod", "leaf_key")


@query(f"WITH {NODES} SELECT page, key >> (3 * (page * 5 + 4 - lod)) AS page_key, count(*) AS nodes, CAST(sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) AS BIGINT) AS leaves FROM nodes GROUP BY 1, 2")
def subtree_pages(spark, sf_dir):
    return stats.page_summary(_nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT lod, count(*) AS nodes, CAST(sum(CASE WHEN is_leaf THEN 0 ELSE 1 END) AS BIGINT) AS interior, CAST(sum(n) AS BIGINT) AS points FROM nodes GROUP BY lod")
def level_summary(spark, sf_dir):
    return stats.level_summary(_nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT lod, key, CAST(key & ((1 << CAST((4 - lod % 5) * 3 AS INTEGER)) - 1) AS INTEGER) AS name FROM nodes")
def node_names(spark, sf_dir):
    return _nodes(spark, sf_dir).select("lod", "key", M.node_name("key", F.col("lod")).alias("name"))


@query(f"WITH {NODES} SELECT p.lod AS parent_lod, p.key AS parent_key, c.lod, c.key FROM nodes c JOIN nodes p ON NOT p.is_leaf AND p.lod = c.lod + 1 AND p.key = c.key >> 3")
def node_edges(spark, sf_dir):
    return frustum.edges(_tree(spark, sf_dir)[2])


@query(f"WITH {LEAF} SELECT leaf_lod, leaf_key, count(*) AS n, min(morton) AS low, max(morton) AS high FROM leafed GROUP BY 1, 2")
def leaf_collapse(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    units = octree.leaf_of_point(points, LIMIT, tree, top).repartition("leaf_lod", "leaf_key").sortWithinPartitions("leaf_lod", "leaf_key", "morton", "id")
    return units.groupBy("leaf_lod", "leaf_key").agg(F.count(F.lit(1)).alias("n"), F.min("morton").alias("low"), F.max("morton").alias("high"))


@query(f"WITH {LEAF} SELECT leaf_lod, leaf_key, count(DISTINCT id // 4096) AS parts, count(DISTINCT id // 4096) = 1 AS collapsed FROM leafed GROUP BY 1, 2")
def collapsed_leaves(spark, sf_dir):
    return octree.collapsed(_leafed(spark, sf_dir).withColumn("part", F.floor(F.col("id") / 4096)), "part")


# --- Region queries ---------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT id, gx, gy, gz, morton, price FROM pts WHERE {BOX_SQL}")
def region_full_clip_point(spark, sf_dir):
    return region.project(_orders(spark, sf_dir).filter(region.inside(BOX)), ["price"])


@query(f"WITH {LEAF} SELECT l.id, l.leaf_lod AS lod, l.leaf_key AS key FROM leafed l JOIN nodes n ON n.is_leaf AND n.lod = l.leaf_lod AND n.key = l.leaf_key WHERE {OVERLAP_SQL}")
def region_full_clip_node(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    near = tree.filter("is_leaf").filter(region.overlaps(BOX)).select(F.col("lod").alias("leaf_lod"), F.col("key").alias("leaf_key"))
    return octree.leaf_of_point(points, LIMIT, tree, top).join(near, ["leaf_lod", "leaf_key"], "left_semi").select("id", F.col("leaf_lod").alias("lod"), F.col("leaf_key").alias("key"))


@query(f"WITH {P} SELECT count(*) AS n, CAST(sum(morton % 1000003) AS BIGINT) AS check_sum FROM pts")
def region_whole(spark, sf_dir):
    got = _orders(spark, sf_dir).filter(region.inside(region.Box((5.0, 5.0, 5.0), (5.0, 5.0, 5.0))))
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("morton") % 1000003).alias("check_sum"))


def _take(spark, sf_dir, frontier, box, clip):
    points, top, tree = _tree(spark, sf_dir)
    front = frontier(tree, top)
    return region.take(octree.leaf_of_point(points, LIMIT, tree, top), lod.pyramid(points, tree, DETAIL), front, box, clip)


def _taken_sql(front: str, where: str) -> str:
    return f"""WITH {LEAF}, {SAMPLES.removeprefix(NODES + ",")}, {front},
taken AS (SELECT l.leaf_lod AS lod, l.leaf_key AS key, FALSE AS is_lod, l.id, l.gx, l.gy, l.gz, l.morton FROM leafed l JOIN front f ON f.is_leaf AND f.lod = l.leaf_lod AND f.key = l.leaf_key
  UNION ALL SELECT s.lod, s.key, TRUE, s.id, s.gx, s.gy, s.gz, s.morton FROM sample s JOIN front f ON NOT f.is_leaf AND f.lod = s.lod AND f.key = s.key)
SELECT lod, key, is_lod, id, morton FROM taken WHERE {where}"""


LEVEL_FRONT = f"front AS (SELECT n.* FROM nodes n, root WHERE ((is_leaf AND lod >= 10) OR (NOT is_leaf AND lod = least(10, r))) AND {OVERLAP_SQL})"
BUDGET_FRONT = f"""run AS (SELECT *, coalesce(sum(CASE WHEN is_leaf THEN n ELSE 0 END) OVER (ORDER BY lod DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes WHERE {OVERLAP_SQL}),
front AS (SELECT * FROM run s WHERE (is_leaf OR before >= 700) AND NOT EXISTS (SELECT 1 FROM nodes a LEFT JOIN run u ON u.lod = a.lod AND u.key = a.key WHERE a.lod > s.lod AND a.key = s.key >> (3 * (a.lod - s.lod)) AND (u.lod IS NULL OR u.is_leaf OR u.before >= 700)))"""


@query(_taken_sql(LEVEL_FRONT, BOX_SQL))
def region_level(spark, sf_dir):
    return _take(spark, sf_dir, lambda t, r: region.frontier_level(t, 10, r), BOX, "point").select("lod", "key", "is_lod", "id", "morton")


@query(_taken_sql(BUDGET_FRONT, "TRUE"))
def region_budget(spark, sf_dir):
    return _take(spark, sf_dir, lambda t, r: region.frontier_budget(t, 700, BOX), BOX, "node").select("lod", "key", "is_lod", "id", "morton")


@query(f"WITH {NODES}, {BUDGET_FRONT} SELECT lod, key, n, is_leaf FROM front")
def region_frontier(spark, sf_dir):
    tree = _tree(spark, sf_dir)[2]
    return region.frontier_budget(tree, 700, BOX).select("lod", "key", "n", "is_leaf")


@query(f"WITH {P} SELECT id, gx * 0.25::DOUBLE + -10000.0::DOUBLE AS x, gy * 0.25::DOUBLE + -10000.0::DOUBLE AS y, gz * 0.25::DOUBLE + -10000.0::DOUBLE AS z FROM pts WHERE {BOX_SQL}")
def region_positions_r64(spark, sf_dir):
    return region.positions(_orders(spark, sf_dir).filter(region.inside(BOX)), "r64", 0.25, (-10000.0,) * 3).select("id", "x", "y", "z")


_CORNER = [f"CAST({d} AS BIGINT)" for d in _decode_sql("leaf_key << (3 * (leaf_lod + 1))")]


@query(f"WITH {LEAF} SELECT id, {', '.join(f'CAST((g{a} - {c}) * 0.25::DOUBLE AS FLOAT) AS {a}' for a, c in zip('xyz', _CORNER, strict=True))} FROM leafed WHERE {BOX_SQL}")
def region_positions_r32(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    got = octree.leaf_of_point(points.filter(region.inside(BOX)), LIMIT, tree, top)
    return region.positions(got, "r32", 0.25, (-10000.0,) * 3, ("leaf_lod", "leaf_key")).select("id", "x", "y", "z")


@query(f"WITH {LEAF} SELECT id, {', '.join(f'CAST(g{a} - {c} AS INTEGER) AS {a}' for a, c in zip('xyz', _CORNER, strict=True))} FROM leafed WHERE {BOX_SQL}")
def region_positions_i32(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    got = octree.leaf_of_point(points.filter(region.inside(BOX)), LIMIT, tree, top)
    return region.positions(got, "i32", 0.25, (-10000.0,) * 3, ("leaf_lod", "leaf_key")).select("id", "x", "y", "z")


@query(_taken_sql(LEVEL_FRONT, BOX_SQL).replace("SELECT lod, key, is_lod, id, morton FROM taken WHERE", "SELECT lod, key, is_lod, count(*) AS point_count, CAST(coalesce(sum(count(*)) OVER (ORDER BY lod DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_point FROM taken WHERE") + " GROUP BY lod, key, is_lod")
def region_segments(spark, sf_dir):
    return region.segments(_take(spark, sf_dir, lambda t, r: region.frontier_level(t, 10, r), BOX, "point"))


@query(f"WITH {P} SELECT id, gx, gy, gz, morton, price, 0 AS intensity FROM pts WHERE {BOX_SQL}")
def region_missing_attribute(spark, sf_dir):
    return region.project(_orders(spark, sf_dir).filter(region.inside(BOX)), ["price", "intensity"])


@query(f"WITH {P} SELECT id, gx, gy, gz, morton, 200 AS red, status FROM pts WHERE {BOX_SQL}")
def region_missing_colour(spark, sf_dir):
    return region.project(_orders(spark, sf_dir).filter(region.inside(BOX)), ["red", "status"])


@query(f"WITH {P} SELECT id, price FROM pts WHERE {BOX_SQL} AND price > 200000 AND status = 'F'")
def region_attribute_filter(spark, sf_dir):
    return _orders(spark, sf_dir).filter(region.inside(BOX) & (F.col("price") > 200000) & (F.col("status") == "F")).select("id", "price")


# --- Level of detail --------------------------------------------------------------------------------------------


@query(f"WITH {P}, {ROOT} SELECT CAST(l.l AS INTEGER) AS lod, count(DISTINCT morton >> CAST(3 * (greatest(l.l - {DETAIL}, 0) + 1) AS INTEGER)) AS cells FROM pts, range(0, 20) AS l(l) WHERE l.l <= (SELECT r FROM root) GROUP BY 1")
def lod_cells(spark, sf_dir):
    points = _orders(spark, sf_dir)
    top = octree.root(points)
    of = spark.range(top + 1).select(F.col("id").cast("int").alias("lod")).withColumn("width", lod.mask_width(F.col("lod"), DETAIL))
    return of.join(octree.occupied(points, list(range(max(top - DETAIL, 0) + 1))), "width").select("lod", "cells")


@query(f"WITH {SAMPLES} SELECT lod, key, cell, id, morton FROM sample")
def lod_pyramid(spark, sf_dir):
    points, _, tree = _tree(spark, sf_dir)
    return lod.pyramid(lod.slim(points), tree, DETAIL).select("lod", "key", "cell", "id", "morton")


@query(f"WITH {SAMPLES} SELECT lod, key, count(*) AS n FROM sample GROUP BY lod, key")
def lod_pyramid_counts(spark, sf_dir):
    points, _, tree = _tree(spark, sf_dir)
    return lod.pyramid(lod.slim(points), tree, DETAIL).groupBy("lod", "key").agg(F.count(F.lit(1)).alias("n"))


def _median_sql() -> str:
    """Level by level, each from the one below."""
    steps = []
    for k in range(1, 20):
        below = f" UNION ALL SELECT id, morton FROM s{k - 1}" if k > 1 else ""
        cell = f"morton >> {3 * (max(k - DETAIL, 0) + 1)}"
        ranked = f"SELECT id, morton, count(*) OVER (PARTITION BY {cell}) AS n, row_number() OVER (PARTITION BY {cell} ORDER BY morton, id) - 1 AS rank FROM (SELECT id, morton FROM leafed WHERE leaf_lod = {k - 1}{below}) u"
        steps.append(f"s{k} AS MATERIALIZED (SELECT id, morton FROM ({ranked}) x WHERE rank = n // 2 AND {k} <= (SELECT r FROM root))")
    return f"WITH {LEAF}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {k} AS lod, morton >> {3 * (k + 1)} AS key, id, morton FROM s{k}" for k in range(1, 20))


@query(_median_sql())
def lod_median_pyramid(spark, sf_dir):
    points, _, tree = _tree(spark, sf_dir)
    return lod.median_pyramid(points.select("id", "morton"), tree, DETAIL).select("lod", "key", "id", "morton")


@query(f"WITH {P} SELECT cell, n, id, morton FROM (SELECT *, morton >> {3 * 7} AS cell, count(*) OVER (PARTITION BY morton >> {3 * 7}) AS n, row_number() OVER (PARTITION BY morton >> {3 * 7} ORDER BY morton, id) - 1 AS rank FROM pts) x WHERE rank = n // 2")
def lod_representatives(spark, sf_dir):
    return lod.cell_median(_orders(spark, sf_dir), 11, DETAIL).select("cell", "n", "id", "morton")


@query(f"WITH {P}, c AS (SELECT w.w, count(DISTINCT morton >> CAST(3 * (w.w + 1) AS INTEGER)) AS cells, count(*) AS n FROM pts, range(6, 14) AS w(w) GROUP BY 1) SELECT CAST(coalesce(min(CASE WHEN cells * 4 <= n THEN w END), 14) AS INTEGER) AS width FROM c")
def lod_adaptive_width(spark, sf_dir):
    return spark.range(1).select(F.lit(lod.adaptive_width(_orders(spark, sf_dir), 11, DETAIL)).alias("width"))


_REP = f"rep AS (SELECT *, CASE WHEN before IS NULL THEN 63 ELSE CAST({_msb_sql('xor(before, morton)')} // 3 AS INTEGER) END AS rep_level FROM (SELECT *, lag(morton) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY morton, id) AS before FROM leafed) x)"


@query(f"WITH {LEAF}, {_REP} SELECT id, rep_level FROM rep")
def rep_level(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    return lod.rep_level(octree.leaf_of_point(points, LIMIT, tree, top), ["leaf_lod", "leaf_key"]).select("id", "rep_level")


@query(f"WITH {LEAF}, {_REP}, h AS (SELECT leaf_lod, leaf_key, rep_level AS k, count(*) AS n FROM rep GROUP BY 1, 2, 3) SELECT leaf_lod, leaf_key, k, CAST(sum(n) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY k DESC) AS BIGINT) AS points FROM h")
def rep_level_prefix_counts(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    unit = ["leaf_lod", "leaf_key"]
    return lod.prefix_counts(lod.rep_level(octree.leaf_of_point(points, LIMIT, tree, top), unit), unit)


@query(f"WITH {LEAF} SELECT leaf_lod, leaf_key, leaf_lod - 1 AS lod, morton >> (3 * leaf_lod) AS key, count(*) AS n, min(morton) AS low, max(morton) AS high FROM leafed WHERE leaf_lod >= 1 GROUP BY 1, 2, 3, 4")
def virtual_octants(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    return lod.virtual_octants(octree.leaf_of_point(points, LIMIT, tree, top))


@query(f"""WITH {LEAF}, {_REP}, u AS (SELECT leaf_lod, leaf_key, count(*) AS total, CAST(floor(log2(greatest(4.0::DOUBLE / (540.0::DOUBLE / (100.0::DOUBLE * leaf_lod)) / 0.25::DOUBLE, 1e-9::DOUBLE))) AS INTEGER) AS need FROM rep GROUP BY 1, 2)
SELECT u.leaf_lod, u.leaf_key, CASE WHEN need < 0 THEN total ELSE least(greatest((SELECT count(*) FROM rep r WHERE r.leaf_lod = u.leaf_lod AND r.leaf_key = u.leaf_key AND r.rep_level >= least(u.need, 63)), 1), total) END AS draw FROM u""")
def lod_draw_size(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    unit = ["leaf_lod", "leaf_key"]
    counts = lod.prefix_counts(lod.rep_level(octree.leaf_of_point(points, LIMIT, tree, top), unit), unit)
    held = tree.filter("is_leaf").select(F.col("lod").alias("leaf_lod"), F.col("key").alias("leaf_key"), F.col("n").alias("total"), (F.col("lod") * 100.0).alias("distance"))
    return lod.draw_size(counts.join(held, unit), unit, "total", "distance", 1.0, 1080, 0.25, 4.0)


# --- Camera selection -------------------------------------------------------------------------------------------


def _plane_sql(near: bool) -> str:
    term = lambda k, a: f"{k!r}::DOUBLE * {('min' if k >= 0 else 'max') if near else ('max' if k >= 0 else 'min')}_{a}"
    each = [" + ".join([f"{d!r}::DOUBLE", *(term(k, a) for k, a in zip((a_, b_, c_), ("gx", "gy", "gz"), strict=True))]) for a_, b_, c_, d in PLANES]
    return " AND ".join(f"({e}) >= 0" for e in each) if near else " OR ".join(f"({e}) < 0" for e in each)


_VIEW = f"CASE WHEN {_plane_sql(False)} THEN 'outside' WHEN {_plane_sql(True)} THEN 'inside' ELSE 'intersects' END"
_D2 = " + ".join(f"power(greatest(min_{a} - {e!r}::DOUBLE, {e!r}::DOUBLE - max_{a}, 0.0::DOUBLE), 2)" for a, e in zip(("gx", "gy", "gz"), EYE, strict=True))
_HALF = "sqrt(power(CAST(max_gx - min_gx AS DOUBLE), 2) + power(CAST(max_gy - min_gy AS DOUBLE), 2) + power(CAST(max_gz - min_gz AS DOUBLE), 2)) / 2"
_CENTRE = "sqrt(" + " + ".join(f"power(CAST(min_{a} + max_{a} AS DOUBLE) / 2 - {e!r}::DOUBLE, 2)" for a, e in zip(("gx", "gy", "gz"), EYE, strict=True)) + ")"
_REFINE = f"({_CENTRE} < {_HALF} OR {FOCAL * 0.5!r}::DOUBLE * {_HALF} / {_CENTRE} > {ERROR!r}::DOUBLE)"


@query(f"WITH {NODES} SELECT lod, key, {_VIEW} AS view FROM nodes")
def frustum_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("lod", "key", frustum.classify(PLANES).alias("view"))


@query(f"WITH {NODES} SELECT lod, key, {_REFINE} AS refines FROM nodes")
def screen_error_refine(spark, sf_dir):
    return _nodes(spark, sf_dir).select("lod", "key", frustum.refines(EYE, FOCAL, ERROR).alias("refines"))


@query(f"WITH {NODES} SELECT lod, key, {_CENTRE} < {_HALF} OR {FOCAL * 0.5!r}::DOUBLE * {_HALF} / {_CENTRE} > {ERROR!r}::DOUBLE * CASE WHEN lod >= 10 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS refines FROM nodes")
def screen_error_hysteresis(spark, sf_dir):
    """Nodes from level 10 up count as refined before."""
    return _nodes(spark, sf_dir).select("lod", "key", frustum.refines(EYE, FOCAL, ERROR, 0.25, F.col("lod") >= 10).alias("refines"))


@query(f"WITH {NODES}, v AS (SELECT *, ({_VIEW}) <> 'outside' AS visible, ({_VIEW}) <> 'outside' AND NOT is_leaf AND {_REFINE} AS refined FROM nodes) SELECT lod, key, visible, refined FROM v s WHERE NOT EXISTS (SELECT 1 FROM v a WHERE a.lod > s.lod AND a.key = s.key >> (3 * (a.lod - s.lod)) AND NOT a.refined)")
def frustum_walk(spark, sf_dir):
    return frustum.walk(_tree(spark, sf_dir)[2], PLANES, EYE, FOCAL, ERROR).select("lod", "key", "visible", "refined")


@query(f"WITH {NODES}, d AS (SELECT lod, key, n, coalesce(sum(n) OVER (ORDER BY {_D2}, lod, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nodes WHERE is_leaf) SELECT lod, key, n FROM d WHERE before < 3000")
def nearest_nodes_budget(spark, sf_dir):
    return frustum.nearest(_nodes(spark, sf_dir), EYE, 3000).select("lod", "key", "n")


@query(f"WITH {NODES}, d AS (SELECT lod, key, n, n * 24 AS bytes, coalesce(sum(n) OVER w, 0) AS before, coalesce(sum(n * 24) OVER w, 0) AS bytes_before, row_number() OVER (ORDER BY {_D2}, lod, key) - 1 AS reads_before FROM nodes WHERE is_leaf WINDOW w AS (ORDER BY {_D2}, lod, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT lod, key, n, bytes FROM d WHERE before < 3000 AND bytes_before < 40000 AND reads_before < 25")
def nearest_nodes_budgets(spark, sf_dir):
    tree = _nodes(spark, sf_dir).withColumn("bytes", F.col("n") * 24).withColumn("reads", F.lit(1))
    return frustum.nearest(tree, EYE, {"n": 3000, "bytes": 40_000, "reads": 25}).select("lod", "key", "n", "bytes")


@query(f"WITH {NODES}, a AS (SELECT lod, key FROM nodes WHERE is_leaf AND {OVERLAP_SQL}), b AS (SELECT lod, key FROM nodes WHERE is_leaf AND ({_VIEW}) <> 'outside') SELECT coalesce(a.lod, b.lod) AS lod, coalesce(a.key, b.key) AS key, CASE WHEN a.lod IS NULL THEN 'in' WHEN b.lod IS NULL THEN 'out' ELSE 'stay' END AS status FROM a FULL JOIN b ON a.lod = b.lod AND a.key = b.key")
def node_diff(spark, sf_dir):
    tree = _tree(spark, sf_dir)[2].filter("is_leaf")
    return frustum.diff(tree.filter(region.overlaps(BOX)), tree.filter(frustum.classify(PLANES) != "outside"), ["lod", "key"])


@query(f"WITH {P} SELECT id, least(greatest((price - 5000.0::DOUBLE) / (300000.0::DOUBLE - 5000.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS contrast FROM pts")
def normalize_attribute(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", stats.contrast("price", 5000.0, 300000.0).alias("contrast"))


# --- Metadata and statistics ------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT min(gx) AS min_gx, max(gx) AS max_gx, min(gy) AS min_gy, max(gy) AS max_gy, min(gz) AS min_gz, max(gz) AS max_gz FROM pts")
def extent_exact(spark, sf_dir):
    return stats.extent_exact(_orders(spark, sf_dir))


@query(f"WITH {P}, e AS (SELECT min(morton) AS lo, max(morton) AS hi FROM pts) SELECT {', '.join(f'CAST({d} AS BIGINT) AS {n}_{a}' for n, m in (('low', 'lo'), ('high', 'hi')) for a, d in zip(('gx', 'gy', 'gz'), _decode_sql(m), strict=True))} FROM e")
def extent_morton(spark, sf_dir):
    return stats.extent_morton(_orders(spark, sf_dir))


_STAT = " UNION ALL ".join(f"SELECT status, '{a}' AS attribute, CAST({a} AS DOUBLE) AS v FROM pts" for a in ("price", "gx", "gy"))


@query(f"WITH {P}, s AS ({_STAT}) SELECT attribute, count(*) AS n, count(*) * 8 AS raw_bytes, min(v) AS min_value, max(v) AS max_value FROM s GROUP BY attribute")
def attribute_stats(spark, sf_dir):
    return stats.attribute_stats(_orders(spark, sf_dir), ["price", "gx", "gy"])


@query(f"WITH {P}, s AS ({_STAT}) SELECT attribute, status, count(*) AS n, count(*) * 8 AS raw_bytes, min(v) AS min_value, max(v) AS max_value FROM s GROUP BY ROLLUP (attribute, status)")
def attribute_stats_rollup(spark, sf_dir):
    return stats.stats_rollup(_orders(spark, sf_dir), ["price", "gx", "gy"], "status")


@query(f"WITH {P} SELECT id, morton, price FROM pts ORDER BY morton, id LIMIT 100 OFFSET 500")
def extract_range(spark, sf_dir):
    return stats.extract_range(_orders(spark, sf_dir), 500, 100).select("id", "morton", "price")


@query("SELECT 0 AS place, 'id' AS name UNION ALL SELECT 1, 'price' UNION ALL SELECT 2, 'status' UNION ALL SELECT 3, 'label'")
def attribute_registry(spark, sf_dir):
    names = stats.attribute_registry(["id", "price"], ["id", "status", "price"], ["label", "id"])
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@query(f"WITH {P} SELECT id, gx, price AS value, '' AS type, 0 AS label FROM pts UNION ALL SELECT event_id, user_id, value, event_type, 0 FROM events")
def schema_union(spark, sf_dir):
    a = _orders(spark, sf_dir).select("id", "gx", F.col("price").alias("value"))
    b = clouds.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("gx"), "value", F.col("event_type").alias("type"), F.lit(0).alias("label"))
    return schema.union(a, b)


@query(f"WITH {SAMPLES}, a AS (SELECT sum(8) AS p, sum(8) AS g FROM pts), b AS (SELECT sum(8) AS p, sum(8) AS g FROM sample) SELECT 'price' AS attribute, CAST(a.p AS BIGINT) AS source_bytes, CAST(b.p AS BIGINT) AS lod_bytes, 100.0::DOUBLE * b.p / a.p AS overhead_percent FROM a, b UNION ALL SELECT 'gx', CAST(a.g AS BIGINT), CAST(b.g AS BIGINT), 100.0::DOUBLE * b.g / a.g FROM a, b")
def storage_overhead(spark, sf_dir):
    points, _, tree = _tree(spark, sf_dir)
    return stats.storage(points, lod.pyramid(points, tree, DETAIL), ["price", "gx"])


@query("SELECT l_linenumber & 7 AS return_number, count(*) AS n FROM lineitem GROUP BY 1")
def points_per_return(spark, sf_dir):
    return stats.points_per_return(las_composite_pack(spark, sf_dir).withColumnRenamed("packed", "las_composite_0"))


@query(f"WITH {NODES} SELECT l.lod, l.key, l.n FROM lvl l ANTI JOIN nodes n ON n.lod = l.lod AND n.key = l.key")
def unreferenced_units(spark, sf_dir):
    points, top, tree = _tree(spark, sf_dir)
    return stats.unreferenced(octree.levels(points, top), tree, ["lod", "key"]).select("lod", "key", "n")


# --- Codecs -----------------------------------------------------------------------------------------------------


@query(f"WITH {LEAF} SELECT id, morton - coalesce(lag(morton) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY morton, id), 0) AS delta FROM leafed")
def codec_delta(spark, sf_dir):
    return codec.delta(_leafed(spark, sf_dir), "morton", UNIT, ["morton", "id"]).select("id", "delta")


@query(f"WITH {P} SELECT id, morton AS value FROM pts")
def codec_delta_inverse(spark, sf_dir):
    coded = codec.delta(_leafed(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy(*UNIT).orderBy("morton", "id"))), "morton", UNIT, ["place"])
    return codec.undelta(coded, "delta", UNIT, ["place"]).select("id", "value")


@query(f"WITH {LEAF} SELECT id, price - min(price) OVER (PARTITION BY leaf_lod, leaf_key) AS rest, min(price) OVER (PARTITION BY leaf_lod, leaf_key) AS base FROM leafed")
def codec_offset_f64(spark, sf_dir):
    return codec.offset(_leafed(spark, sf_dir), "price", UNIT).select("id", "rest", "base")


@query(f"WITH {LEAF} SELECT id, CAST(row_number() OVER (PARTITION BY leaf_lod, leaf_key ORDER BY price, id) - 1 AS INTEGER) AS rank FROM leafed")
def codec_sort_permutation(spark, sf_dir):
    return codec.sort_permutation(_leafed(spark, sf_dir), "price", UNIT, ["id"]).select("id", "rank")


_RGB = "c AS (SELECT id, (gx * 37) % 65536 AS r, (gy * 91) % 65536 AS g, (gz * 53) % 65536 AS b FROM pts)"


def _colours(spark, sf_dir):
    return _orders(spark, sf_dir).select("id", *((F.col(a) * k % 65536).alias(n) for a, k, n in (("gx", 37, "r"), ("gy", 91, "g"), ("gz", 53, "b"))))


@query(f"WITH {P}, {_RGB} SELECT id, g, (r - g + 65536) % 65536 AS rg, (b - g + 65536) % 65536 AS bg FROM c")
def codec_rgb_decorrelate(spark, sf_dir):
    g, rg, bg = codec.decorrelate(*(F.col(n) for n in "rgb"))
    return _colours(spark, sf_dir).select("id", g.alias("g"), rg.alias("rg"), bg.alias("bg"))


@query(f"WITH {P}, {_RGB} SELECT id, r, g, b FROM c")
def codec_rgb_inverse(spark, sf_dir):
    g, rg, bg = codec.decorrelate(*(F.col(n) for n in "rgb"))
    coded = _colours(spark, sf_dir).select("id", g.alias("g"), rg.alias("rg"), bg.alias("bg"))
    return coded.select("id", *(c.alias(n) for c, n in zip(codec.correlate(F.col("g"), F.col("rg"), F.col("bg")), "rgb", strict=True)))


@query(f"WITH {LEAF} SELECT id, (gx * 37 % 65536 - coalesce(lag(gx * 37 % 65536) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY id), 0) + 65536) % 65536 AS dr FROM leafed")
def codec_component_delta(spark, sf_dir):
    return codec.delta(_leafed(spark, sf_dir).withColumn("r", F.col("gx") * 37 % 65536), "r", UNIT, ["id"], "dr", 65536).select("id", "dr")


@query(f"WITH {LEAF}, b AS (SELECT leaf_lod, leaf_key, CAST(k.k AS INTEGER) AS band, (gx >> CAST(8 * k.k AS INTEGER)) & 255 AS byte FROM leafed, range(0, 8) AS k(k)) SELECT leaf_lod, leaf_key, band, min(byte) = max(byte) AS constant, min(byte) AS value FROM b GROUP BY 1, 2, 3")
def codec_constant_bands(spark, sf_dir):
    return codec.constant_bands(_leafed(spark, sf_dir), "gx", UNIT)


@query(f"""WITH {LEAF}, d AS (SELECT leaf_lod, leaf_key, gy, gy - min(gy) OVER (PARTITION BY leaf_lod, leaf_key) AS rest, gy - coalesce(lag(gy) OVER (PARTITION BY leaf_lod, leaf_key ORDER BY gy, id), 0) AS delta FROM leafed),
c AS (SELECT leaf_lod, leaf_key, count(*) * max(length(bin(gy))) AS a, count(*) * max(length(bin(rest))) + 64 AS b, count(*) * (max(length(bin(abs(delta)))) + 1) AS d, CASE WHEN min(gy) = max(gy) THEN 64 END AS e FROM d GROUP BY 1, 2)
SELECT leaf_lod, leaf_key, path, bits FROM (SELECT leaf_lod, leaf_key, path, bits, row_number() OVER (PARTITION BY leaf_lod, leaf_key ORDER BY bits, path) AS rn FROM (SELECT leaf_lod, leaf_key, 'plain' AS path, a AS bits FROM c UNION ALL SELECT leaf_lod, leaf_key, 'offset', b FROM c UNION ALL SELECT leaf_lod, leaf_key, 'delta', d FROM c UNION ALL SELECT leaf_lod, leaf_key, 'constant', e FROM c WHERE e IS NOT NULL) u) r WHERE rn = 1""")
def codec_best_path(spark, sf_dir):
    return codec.best_path(_leafed(spark, sf_dir), "gy", UNIT, ["gy", "id"])


@query(f"WITH {LEAF} SELECT leaf_lod, leaf_key, id, morton, gy AS value FROM leafed")
def codec_round_trip(spark, sf_dir):
    """Encoded by the shortest of all paths, and decoded."""
    points = _leafed(spark, sf_dir).select(*UNIT, "id", "morton", "gy")
    back = codec.decoded(codec.encoded(points, ["id", "morton", "gy"], UNIT, ["morton", "id"]), ["id", "morton", "gy"], UNIT)
    return back.withColumnRenamed("gy", "value")


# --- LAS fields -------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST((l_linenumber & 7) | ((l_partkey & 7) << 3) | ((l_suppkey & 1) << 6) | ((l_orderkey & 1) << 7) AS INTEGER) AS packed FROM lineitem")
def las_composite_pack(spark, sf_dir):
    fields = {"return_number": F.col("l_linenumber"), "number_of_returns": F.col("l_partkey"), "scan_direction": F.col("l_suppkey"), "edge_of_flight_line": F.col("l_orderkey")}
    return clouds.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", schema.pack("las_composite_0", fields).alias("packed"))


@query("SELECT event_id, CAST(event_id & 15 AS INTEGER) AS classification_flags, CAST((event_id >> 4) & 3 AS INTEGER) AS scanner_channel, CAST((event_id >> 6) & 1 AS INTEGER) AS scan_direction, CAST((event_id >> 7) & 1 AS INTEGER) AS edge_of_flight_line FROM events")
def las_composite_unpack(spark, sf_dir):
    return clouds.table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in schema.unpack("las_composite_2", F.col("event_id").bitwiseAND(F.lit(255))).items()))


# --- Incremental ingestion --------------------------------------------------------------------------------------


def _ledger(spark, sf_dir):
    """Inputs made from the orders: one a priority and status, finished for all but two."""
    by = _orders(spark, sf_dir).groupBy(F.concat_ws("/", "priority", "status").alias("name")).agg(F.min("morton").alias("morton_min"), F.min("gx").alias("x"), F.min("gy").alias("y"), F.min("gz").alias("z"), F.count(F.lit(1)).cast("int").alias("sub_count"))
    held = F.col("name").startswith("5") & F.col("name").endswith("P")
    return by.select("name", M.encode("x", "y", "z").alias("input_order"), "morton_min", (~F.col("name").startswith("4")).alias("read_started"), (~held & ~F.col("name").startswith("4")).alias("read_finished"), "sub_count", F.when(held, 0).otherwise(F.col("sub_count")).alias("inserted"))


_LEDGER = f"""{P}, b AS (SELECT priority || '/' || status AS name, min(morton) AS morton_min, min(gx) AS gx, min(gy) AS gy, min(gz) AS gz, count(*) AS sub_count FROM pts GROUP BY 1),
led AS (SELECT name, CAST({clouds._interleave()} AS BIGINT) AS input_order, morton_min, name NOT LIKE '4%' AS started, name NOT LIKE '4%' AND NOT (name LIKE '5%' AND name LIKE '%P') AS done FROM b),
mark AS (SELECT CASE WHEN (SELECT done FROM led WHERE started ORDER BY input_order, name LIMIT 1) AND bound > 0 THEN bound END AS done_morton FROM (SELECT least(coalesce((SELECT least(morton_min, input_order) FROM led WHERE started AND NOT done ORDER BY input_order, name LIMIT 1), 9223372036854775807), coalesce((SELECT min(input_order) FROM led WHERE NOT started), 9223372036854775807)) AS bound) q)"""


@query(f"WITH {_LEDGER}, c AS (SELECT l.*, b.sub_count FROM led l JOIN b USING (name)) SELECT CASE WHEN done THEN 'done' WHEN started THEN 'reading' ELSE 'waiting' END AS state, count(*) AS inputs, CAST(sum(sub_count) AS BIGINT) AS parts, CAST(sum(CASE WHEN started AND NOT done THEN 0 ELSE sub_count END) AS BIGINT) AS inserted FROM c GROUP BY 1")
def ledger_states(spark, sf_dir):
    return ledger.states(_ledger(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT done_morton FROM mark")
def done_morton_watermark(spark, sf_dir):
    return ledger.done_morton(_ledger(spark, sf_dir))


FINAL = 1 << 36


@query(f"WITH {NODES} SELECT lod, key, CASE WHEN ((key + 1) << (3 * (lod + 1))) - 1 < {FINAL} THEN 'final' ELSE 'building' END AS state FROM nodes")
def final_nodes(spark, sf_dir):
    return ledger.final_nodes(_nodes(spark, sf_dir), FINAL).select("lod", "key", "state")


@query(f"WITH {P} SELECT id, morton FROM pts WHERE morton < {FINAL >> 1}")
def late_points(spark, sf_dir):
    return ledger.late(_orders(spark, sf_dir), FINAL >> 1).select("id", "morton")


@query(f"WITH {NODES} SELECT lod, key, CASE WHEN ((key + 1) << (3 * (lod + 1))) - 1 < {FINAL >> 2} THEN 0 WHEN ((key + 1) << (3 * (lod + 1))) - 1 < {FINAL} THEN 1 END AS band FROM nodes")
def bands(spark, sf_dir):
    return ledger.bands(_nodes(spark, sf_dir), [FINAL >> 2, FINAL]).select("lod", "key", "band")


@query(f"WITH {_LEDGER} SELECT name FROM led WHERE NOT done")
def skip_done_inputs(spark, sf_dir):
    led = _ledger(spark, sf_dir)
    return ledger.skip_done(led.select("name"), led)


@query(f"WITH {_LEDGER} SELECT name, input_order, CAST(row_number() OVER (ORDER BY input_order, name) - 1 AS INTEGER) AS place FROM led")
def dispatch_order(spark, sf_dir):
    by = _orders(spark, sf_dir).groupBy(F.concat_ws("/", "priority", "status").alias("name")).agg(*(F.min(a).alias(f"min_{a}") for a in ("gx", "gy", "gz")))
    return ledger.dispatch_order(by).select("name", "input_order", "place")
