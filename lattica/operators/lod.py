"""Level-of-detail samples: one point of each cell, per interior node, and point order within nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import morton as M
from lattica.operators import octree, running

SLIM = ("rgb", "intensity", "classification")


def mask_width(lod: Column | int, full_detail: int = 9) -> Column:
    return F.greatest((lod if isinstance(lod, Column) else F.lit(lod)) - full_detail, F.lit(0))


def slim(points: DataFrame, all_attributes: bool = False, keep: tuple[str, ...] = SLIM) -> DataFrame:
    """Positions and visual attributes only."""
    return points if all_attributes else points.select(*(c for c in points.columns if c in ("id", "gx", "gy", "gz", "morton", *keep)))


def pyramid(points: DataFrame, tree: DataFrame, full_detail: int = 9) -> DataFrame:
    """(lod, key, cell, points' columns): of each interior node, the least (morton, id) of every occupied cell.

    The choice is associative, so points collapse to their smallest cells once and all levels come from those: each as
    often as its leaf has ancestors, which are the interior nodes. Codes, ids and positions are aggregated, all numbers of
    one size; other columns are fetched once for the rows that are in some sample."""
    place = [a for a in ("gx", "gy", "gz") if a in points.columns]
    codes = points.groupBy("morton").agg(F.min("id").alias("id"), *(F.min(a).alias(a) for a in place))  # a code has one position
    least = [F.min("morton").alias("morton"), *(F.min_by(c, "morton").alias(c) for c in ("id", *place))]
    smallest = codes.groupBy(M.prefix("morton", 0).alias("c0")).agg(*least).drop("c0")
    top = tree.agg(F.max("lod")).first()[0] or 0
    above = octree.leaf_of_point(smallest, 0, tree, top).filter(F.col("leaf_lod") < top)
    at = above.select("morton", "id", *place, F.explode(F.sequence(F.col("leaf_lod") + 1, F.lit(top))).alias("lod"))
    fine = at.filter(F.col("lod") <= full_detail).withColumn("cell", M.prefix("morton", 0))  # here a cell is a smallest one
    coarse = at.filter(F.col("lod") > full_detail).groupBy("lod", M.prefix("morton", mask_width(F.col("lod"), full_detail)).alias("cell")).agg(*least)
    out = fine.unionByName(coarse).withColumn("key", M.prefix("morton", F.col("lod")))
    others = [c for c in points.columns if c not in ("morton", "id", *place)]
    if others:
        rows = points.select("morton", "id", *others).join(smallest.select("morton", "id"), ["morton", "id"], "left_semi").dropDuplicates(["morton", "id"])
        out = out.join(rows, ["morton", "id"])
    return out.select("lod", "key", "cell", "morton", "id", *(c for c in points.columns if c not in ("morton", "id")))


def cell_median(points: DataFrame, lod: int, full_detail: int = 9) -> DataFrame:
    """(cell, n, points' columns): of each cell of a level's sample, the row at rank n div 2 by (morton, id)."""
    cells = points.withColumn("cell", M.prefix("morton", mask_width(lod, full_detail)))
    w = Window.partitionBy("cell")
    ranked = cells.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("morton", "id")) - 1)
    return ranked.filter(F.col("rank") == F.floor(F.col("n") / 2)).drop("rank")


def median_pyramid(points: DataFrame, tree: DataFrame, full_detail: int = 9) -> DataFrame:
    """(lod, key, points' columns), bottom-up: each interior node merges its children's samples, or their points if they
    are leaves, and keeps of every cell the row at rank n div 2 by (morton, id).

    A level needs the one below, so each is a checkpoint of its own; a cell holds what eight children left of it."""
    top = tree.agg(F.max("lod")).first()[0] or 0
    placed = octree.leaf_of_point(points, 0, tree, top)
    lods = sorted(r[0] for r in tree.filter("not is_leaf").select("lod").distinct().collect())  # at most the tree's depth
    below, out = None, None
    for lod in lods:
        raw = placed.filter(F.col("leaf_lod") == lod - 1).select(*points.columns)
        source = raw if below is None else raw.unionByName(below)
        cells = source.withColumn("cell", M.prefix("morton", mask_width(lod, full_detail)))
        w = Window.partitionBy("cell")
        ranked = cells.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("morton", "id")) - 1)
        below = running.settled(ranked.filter(F.col("rank") == F.floor(F.col("n") / 2)).select(*points.columns))
        layer = below.select(F.lit(lod).alias("lod"), M.prefix("morton", lod).alias("key"), "*")
        out = layer if out is None else out.unionByName(layer)
    return points.limit(0).select(F.lit(0).alias("lod"), F.lit(0).cast("long").alias("key"), "*") if out is None else out


def adaptive_width(points: DataFrame, lod: int, full_detail: int = 9, share: int = 4, most: int = 21) -> int:
    """The least mask width whose cells are at most a `share`-th of the points."""
    start = max(lod - full_detail, 0)
    widths = list(range(start, min(start + 8, most)))
    cells = {r["width"]: r["cells"] for r in octree.occupied(points, widths).collect()}  # at most eight rows
    n = points.count()
    return next((w for w in widths if cells.get(w, 0) * share <= n), min(start + 8, most))


def rep_level(points: DataFrame, node: list[str]) -> DataFrame:
    """points with rep_level: the level at which each first differs from its predecessor in the node; 63 for the first."""
    before = F.lag("morton").over(Window.partitionBy(*node).orderBy("morton", "id"))
    return points.withColumn("before", before).withColumn("rep_level", F.when(F.col("before").isNull(), 63).otherwise(M.lod_between("before", "morton"))).drop("before")


def prefix_counts(levelled: DataFrame, node: list[str]) -> DataFrame:
    """(node, k, points): how many points have rep_level >= k, for each k that occurs; points in descending order of it
    are a coarse-to-fine order whose prefixes are these."""
    by = levelled.groupBy(*node, "rep_level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*node).orderBy(F.desc("rep_level")).rowsBetween(Window.unboundedPreceding, 0)
    return by.select(*node, F.col("rep_level").alias("k"), F.sum("n").over(w).alias("points"))


def draw_size(counts: DataFrame, node: list[str], total: str, distance: str, focal: float, height: int, scale: float, spacing_px: float) -> DataFrame:
    """(node, draw): how long a prefix of each node's coarse-to-fine order gives points `spacing_px` apart on screen.

    counts: prefix_counts() with the node's number of points and distance. At distance 0, or where cells are finer than
    the grid, all points are drawn; otherwise at least one."""
    pixels = F.lit(focal * 0.5 * height) / F.nullif(F.col(distance).cast("double"), F.lit(0.0))
    step = F.floor(F.log2(F.greatest(F.lit(spacing_px) / pixels / F.lit(scale), F.lit(1e-9)))).cast("int")
    need = F.least(step, F.lit(63))
    by = counts.withColumn("need", need).groupBy(*node, total, "need").agg(F.max(F.when(F.col("k") >= F.col("need"), F.col("points"))).alias("prefix"))
    return by.select(*node, F.when(F.col("need").isNull() | (F.col("need") < 0), F.col(total)).otherwise(F.least(F.greatest(F.coalesce("prefix", F.lit(0)), F.lit(1)), F.col(total))).alias("draw"))


def virtual_octants(points_with_leaf: DataFrame, levels: int = 1) -> DataFrame:
    """(leaf_lod, leaf_key, lod, key, n, low, high): the non-empty octants `levels` below each leaf, made on demand."""
    at = points_with_leaf.filter(F.col("leaf_lod") >= levels).withColumn("lod", F.col("leaf_lod") - levels)
    return at.withColumn("key", M.prefix("morton", F.col("lod"))).groupBy("leaf_lod", "leaf_key", "lod", "key").agg(F.count(F.lit(1)).alias("n"), F.min("morton").alias("low"), F.max("morton").alias("high"))
