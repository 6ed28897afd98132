"""Region queries: box, level of detail, attribute projection, clip mode and position encoding.

Full detail is a scan with a box filter: three closed intervals on the grid, which Parquet's statistics prune in files
sorted by Morton code. The other modes select a frontier of nodes (never a node and its ancestor) and take leaves from
the points and interior nodes from the samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import morton as M
from lattica.operators import running

AXES = ("gx", "gy", "gz")


@dataclass(frozen=True)
class Box:
    """Closed on all sides. One with min >= max on all three axes stands for everything."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def everything(self) -> bool:
        return all(a >= b for a, b in zip(self.low, self.high, strict=True))


def _whole(low: float, high: float) -> tuple[Column, Column]:
    """Bounds of grid values as integers, so that filters on the integer columns reach the scan."""
    most = 1 << 62
    return F.lit(math.ceil(max(low, -most))).cast("long"), F.lit(math.floor(min(high, most))).cast("long")


def inside(box: Box | None) -> Column:
    if box is None or box.everything:
        return F.lit(True)
    out = F.lit(True)
    for axis, a, b in zip(AXES, box.low, box.high, strict=True):
        out = out & F.col(axis).between(*_whole(a, b))
    return out


def overlaps(box: Box | None) -> Column:
    """Of nodes with true extents: some point may be inside."""
    if box is None or box.everything:
        return F.lit(True)
    out = F.lit(True)
    for axis, a, b in zip(AXES, box.low, box.high, strict=True):
        least, most = _whole(a, b)
        out = out & (F.col(f"max_{axis}") >= least) & (F.col(f"min_{axis}") <= most)
    return out


#: What an attribute is where nothing else says so: colours are a light grey, one value a component. Fixed values.
MISSING = {"rgb": 200, "red": 200, "green": 200, "blue": 200}


def filled(df: DataFrame, attribute: str) -> Column:
    """The attribute; what the rows lack of it is its value in `MISSING`, or zero."""
    kind, value = dict(df.dtypes).get(attribute), MISSING.get(attribute, 0)
    if kind is None:
        return F.array_repeat(F.lit(value), 3) if attribute == "rgb" else F.lit(value)
    none = F.array_repeat(F.lit(value), 3) if kind.startswith("array") else F.lit("" if kind == "string" else value)
    return F.coalesce(F.col(attribute), none.cast(kind))


def project(df: DataFrame, attributes: list[str]) -> DataFrame:
    """id, position and the named attributes, filled where the rows lack them."""
    return df.select("id", *AXES, "morton", *(filled(df, a).alias(a) for a in attributes))


def frontier_level(tree: DataFrame, k: int, root_lod: int) -> DataFrame:
    """Leaves not below level k, and interior nodes at it."""
    return tree.filter((F.col("is_leaf") & (F.col("lod") >= k)) | (~F.col("is_leaf") & (F.col("lod") == min(k, root_lod))))


def frontier_budget(tree: DataFrame, budget: int, box: Box | None = None) -> DataFrame:
    """Breadth first until the leaves emitted so far reach the budget: the running count of leaves before an interior
    node decides whether it is descended; nodes with a node among their ancestors that isn't are no candidates.

    The running count is over nodes, not points, in the walk's order: coarse levels first, by key within a level."""
    near = tree.filter(overlaps(box)).withColumn("held", F.when(F.col("is_leaf"), F.col("n")).otherwise(0))
    run = running.before(near, [F.desc("lod"), F.col("key")], {"before": "held"}).drop("held")
    down = run.filter(~F.col("is_leaf") & (F.col("before") < budget)).select(F.col("lod").alias("up_lod"), F.col("key").alias("up_key"))
    stays = run.filter(F.col("is_leaf") | (F.col("before") >= budget))
    top = tree.agg(F.max("lod").alias("top"))
    reached = stays.join(F.broadcast(top), F.lit(True)).select("*", F.explode(F.when(F.col("lod") < F.col("top"), F.sequence(F.col("lod") + 1, F.col("top"))).otherwise(F.array(F.lit(-1)))).alias("up_lod"))
    reached = reached.withColumn("up_key", F.when(F.col("up_lod") >= 0, F.call_function("shiftright", F.col("key"), ((F.col("up_lod") - F.col("lod")) * 3).cast("int"))))
    ok = reached.join(down, ["up_lod", "up_key"], "left_semi").groupBy("lod", "key").agg(F.count(F.lit(1)).alias("descended"))
    out = stays.join(F.broadcast(top), F.lit(True)).join(ok, ["lod", "key"], "left").filter(F.coalesce("descended", F.lit(0)) == F.col("top") - F.col("lod"))
    return out.drop("top", "descended", "before")


def take(points_with_leaf: DataFrame, samples: DataFrame, frontier: DataFrame, box: Box | None, clip: str = "point") -> DataFrame:
    """The frontier's rows: (lod, key, is_lod, points' columns)."""
    if clip not in ("point", "node"):
        raise ValueError(f"clip is 'point' or 'node', not {clip!r}")
    near = frontier.filter(overlaps(box))
    leaves = near.filter("is_leaf").select(F.col("lod").alias("leaf_lod"), F.col("key").alias("leaf_key"))
    raw = points_with_leaf.join(leaves, ["leaf_lod", "leaf_key"], "left_semi").withColumnRenamed("leaf_lod", "lod").withColumnRenamed("leaf_key", "key").withColumn("is_lod", F.lit(False))
    inner = near.filter("not is_leaf").select("lod", "key")
    out = raw.unionByName(samples.drop("cell").join(inner, ["lod", "key"], "left_semi").withColumn("is_lod", F.lit(True)), allowMissingColumns=True)
    return out.filter(inside(box)) if clip == "point" else out


def positions(df: DataFrame, kind: str, scale: float, offset: tuple[float, float, float], node: tuple[str, str] = ("lod", "key")) -> DataFrame:
    """df with x, y, z: 'r64' absolute doubles, 'r32' floats and 'i32' grid steps relative to the node's corner."""
    corner = M.decode(M.cell_min(node[1], F.col(node[0]))) if kind != "r64" else (None,) * 3
    for axis, name, g0, o in zip(AXES, "xyz", corner, offset, strict=True):
        if kind == "r64":
            c = F.col(axis) * F.lit(scale) + F.lit(o)
        elif kind == "r32":
            c = ((F.col(axis) - g0) * F.lit(scale)).cast("float")
        elif kind == "i32":
            c = (F.col(axis) - g0).cast("int")
        else:
            raise ValueError(f"position format is 'r64', 'r32' or 'i32', not {kind!r}")
        df = df.withColumn(name, c)
    return df


def segments(result: DataFrame) -> DataFrame:
    """(lod, key, is_lod, first_point, point_count): each node's stretch of the result in walk order."""
    by = result.groupBy("lod", "key", "is_lod").agg(F.count(F.lit(1)).alias("point_count"))
    return running.before(by, [F.desc("lod"), F.col("key")], {"first_point": "point_count"})


def ordered(result: DataFrame) -> DataFrame:
    return result.orderBy(F.desc("lod"), "key", "morton", "id")
