"""Camera selection over the node table: frustum planes, screen-space error, nearest nodes within a budget, list diff."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import running

AXES = ("gx", "gy", "gz")


def planes(view_projection: np.ndarray) -> np.ndarray:
    """Six normalised planes (a, b, c, d), a point inside where all are >= 0."""
    m = np.asarray(view_projection, float)
    rows = np.stack([m[3] + m[0], m[3] - m[0], m[3] + m[1], m[3] - m[1], m[3] + m[2], m[3] - m[2]])
    return rows / np.linalg.norm(rows[:, :3], axis=1, keepdims=True)


def classify(frustum: np.ndarray) -> Column:
    """'outside', 'intersects' or 'inside', of a node with min_/max_ extents."""
    outside, inside = F.lit(False), F.lit(True)
    for a, b, c, d in np.asarray(frustum, float).tolist():
        far = sum((F.lit(k) * F.col(f"{'max' if k >= 0 else 'min'}_{axis}") for k, axis in zip((a, b, c), AXES, strict=True)), F.lit(d))
        near = sum((F.lit(k) * F.col(f"{'min' if k >= 0 else 'max'}_{axis}") for k, axis in zip((a, b, c), AXES, strict=True)), F.lit(d))
        outside, inside = outside | (far < 0), inside & (near >= 0)
    return F.when(outside, "outside").when(inside, "inside").otherwise("intersects")


def squared_distance(eye: tuple[float, float, float]) -> Column:
    """From the eye to the nearest point of the node's extent; 0 inside."""
    out = F.lit(0.0)
    for axis, e in zip(AXES, eye, strict=True):
        gap = F.greatest(F.col(f"min_{axis}") - F.lit(float(e)), F.lit(float(e)) - F.col(f"max_{axis}"), F.lit(0.0))
        out = out + gap * gap
    return out


def refines(eye: tuple[float, float, float], focal: float, threshold: float, hysteresis: float = 0.0, before: Column | None = None) -> Column:
    """Whether half the node's diagonal, seen from the eye to the node's centre, covers more than `threshold` of the screen.

    A camera nearer to the centre than that always refines. Nodes that were refined `before` stay so down to a threshold
    lower by the share `hysteresis`, so that a camera at the boundary doesn't flicker."""
    square = lambda columns: F.sqrt(sum((F.pow(c, F.lit(2.0)) for c in columns), F.lit(0.0)))
    half = square((F.col(f"max_{a}") - F.col(f"min_{a}")).cast("double") for a in AXES) / 2
    distance = square((F.col(f"max_{a}") + F.col(f"min_{a}")).cast("double") / 2 - F.lit(float(e)) for a, e in zip(AXES, eye, strict=True))
    least = F.lit(float(threshold))
    if before is not None:
        least = F.when(before, least * F.lit(1.0 - hysteresis)).otherwise(least)
    return (distance < half) | (F.lit(focal * 0.5) * half > least * distance)


def walk(tree: DataFrame, frustum: np.ndarray, eye: tuple[float, float, float], focal: float, threshold: float, hysteresis: float = 0.0, last: DataFrame | None = None) -> DataFrame:
    """tree's nodes that a walk visits, with visible and refined: every ancestor is visible, interior and refined.
    last: (lod, key) of the nodes that the walk before refined."""
    before = None
    if last is not None:
        tree = tree.join(last.select("lod", "key").distinct().withColumn("before", F.lit(True)), ["lod", "key"], "left")
        before = F.coalesce("before", F.lit(False))
    flagged = tree.withColumn("visible", classify(frustum) != "outside").withColumn("refined", F.col("visible") & ~F.col("is_leaf") & refines(eye, focal, threshold, hysteresis, before))
    top = flagged.agg(F.max("lod").alias("top"))
    ups = flagged.join(F.broadcast(top), F.lit(True)).filter(F.col("lod") < F.col("top")).select("lod", "key", F.explode(F.sequence(F.col("lod") + 1, F.col("top"))).alias("up_lod"))
    ups = ups.withColumn("up_key", F.call_function("shiftright", F.col("key"), ((F.col("up_lod") - F.col("lod")) * 3).cast("int")))
    stops = flagged.filter("not refined").select(F.col("lod").alias("up_lod"), F.col("key").alias("up_key"))
    hidden = ups.join(stops, ["up_lod", "up_key"], "left_semi").select("lod", "key").distinct()
    return flagged.join(hidden, ["lod", "key"], "left_anti")


def edges(tree: DataFrame) -> DataFrame:
    """(parent_lod, parent_key, lod, key)."""
    up = tree.filter("not is_leaf").select(F.col("lod").alias("parent_lod"), F.col("key").alias("parent_key"))
    down = tree.select("lod", "key").withColumn("parent_lod", F.col("lod") + 1).withColumn("parent_key", F.call_function("shiftright", F.col("key"), F.lit(3)))
    return down.join(up, ["parent_lod", "parent_key"]).select("parent_lod", "parent_key", "lod", "key")


def nearest(tree: DataFrame, eye: tuple[float, float, float], budget: int | dict[str, int]) -> DataFrame:
    """Leaves, nearest first, while those before are under the budget: of points, or of several columns (points, bytes,
    reads, ...), each of which may end the list."""
    budgets = {"n": budget} if isinstance(budget, int) else budget
    leaves = tree.filter("is_leaf").withColumn("d2", squared_distance(eye))
    spent = {f"{c}_before": c for c in budgets}
    out = running.before(leaves, [F.col("d2"), F.col("lod"), F.col("key")], spent)
    for c, most in budgets.items():
        out = out.filter(F.col(f"{c}_before") < most)
    return out


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): 'in', 'out' or 'stay', of two render lists."""
    a, b = old.select(*key).distinct().withColumn("was", F.lit(True)), new.select(*key).distinct().withColumn("is", F.lit(True))
    return a.join(b, key, "full_outer").select(*key, F.when(F.col("was").isNull(), "in").when(F.col("is").isNull(), "out").otherwise("stay").alias("status"))
