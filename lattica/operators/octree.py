"""The octree as grouping by Morton prefix.

A node at level L is the set of points with one `morton >> 3 * (L + 1)`. Counts start from the smallest cells, one
pre-aggregated shuffle of the points, so a dense cell is one row. The tree takes those cells in the order of their codes,
in stretches of at most `STRETCH`, however long a task's range of codes is: a stretch gives the nodes below parents that
it holds whole and that exceed the limit, and its parts of those that may go on in the next stretch, whatever their size;
the parts, a few for each level, are added up. No row is repeated by level.
Points find their leaf by the order of codes, without a shuffle, as long as the tree has at most `SMALL_TREE` leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import morton as M


#: A tree of so many leaves goes to the tasks as two sorted arrays, 9 bytes a leaf; a larger one is joined.
SMALL_TREE = 4_000_000
#: So many smallest cells, of 88 bytes each, a task's Python holds at once.
STRETCH = 65_536

_EXTENTS = [f"{n}_{a}" for a in ("gx", "gy", "gz") for n in ("min", "max")]


def root(points: DataFrame) -> int:
    """The root's level: the one scalar that is taken to the driver."""
    low, high = points.agg(F.min("morton"), F.max("morton")).first()
    return M.root_lod(low, high) if low is not None else 4


def root_cell(points: DataFrame) -> DataFrame:
    """One row: root level, key, point count, the cell's grid corners, and the exact extent."""
    got = points.agg(F.count(F.lit(1)).alias("point_count"), F.min("morton").alias("low"), F.max("morton").alias("high"), *(f(a).alias(f"{n}_{a}") for a in ("gx", "gy", "gz") for n, f in (("min", F.min), ("max", F.max))))
    lod = (F.floor(M.msb(F.col("low").bitwiseXOR(F.col("high"))) / 15) * 5 + 4).cast("int")
    cell = got.withColumn("root_lod", lod).withColumn("root_key", M.prefix("low", F.col("root_lod")))
    x, y, z = M.decode(M.cell_min("root_key", F.col("root_lod")))
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("root_lod") + 1)
    corner = [c.alias(n) for c, n in zip((x, y, z), ("cell_x", "cell_y", "cell_z"), strict=True)]
    return cell.select("root_lod", "root_key", "point_count", *corner, side.alias("side"), *(f"{n}_{a}" for a in ("gx", "gy", "gz") for n in ("min", "max")))


def smallest_cells(points: DataFrame) -> DataFrame:
    """Level 0: (key, n, low, high, mask, extents)."""
    extents = [f(a).alias(f"{n}_{a}") for a in ("gx", "gy", "gz") for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(M.prefix("morton", 0).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("morton").alias("low"), F.max("morton").alias("high"), F.bit_or(F.call_function("shiftleft", F.lit(1), M.child("morton", 0))).alias("mask"), *extents
    )


def _coarser(cells: DataFrame, lod: Column) -> DataFrame:
    """The cells' prefixes at the level or levels of `lod`, above theirs."""
    mask = F.when(F.col("lod") == 0, F.col("mask")).otherwise(F.call_function("shiftleft", F.lit(1), M.child("low", F.col("lod"))))
    at = cells.withColumn("lod", lod).withColumn("child", mask).withColumn("key", M.prefix("low", F.col("lod")))
    return at.groupBy("lod", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("child").alias("child_mask"), *((F.min if e[:3] == "min" else F.max)(e).alias(e) for e in _EXTENTS))


def levels(points: DataFrame, root_lod: int | None = None) -> DataFrame:
    """Every prefix at every level up to the root: (lod, key, n, low, high, child_mask, extents).

    Five levels (a page) are made at a time, from the cells of the last page's top."""
    top = root(points) if root_lod is None else root_lod
    cells, out = smallest_cells(points), None
    for first in range(0, top + 1, 5):
        last = min(first + 4, top)
        page = _coarser(cells, F.explode(F.sequence(F.lit(first), F.lit(last))))
        out = page if out is None else out.unionByName(page)
        cells = page.filter(F.col("lod") == last).withColumn("mask", F.col("child_mask"))
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict[str, np.ndarray]]:
    """The batches' rows in stretches of `most`, whatever the batches' length; the last may be shorter."""
    got, rows = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            got.append(b.slice(at, most - rows))
            at, rows = at + got[-1].num_rows, rows + got[-1].num_rows
            if rows == most:
                yield _columns(got)
                got, rows = [], 0
    if rows:
        yield _columns(got)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return {n: t.column(n).to_numpy() for n in t.column_names}


def _range_tree(limit: int, top: int, most: int = STRETCH) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of smallest cells in the order of their keys: the nodes that may be in the tree, as far as they lie in one stretch."""

    def nodes_of(col: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = col.pop("key")
        for lod in range(top + 1):
            here = key >> 3 * lod
            begin = _starts(here)
            n = np.add.reduceat(col["n"], begin)
            want = np.ones(len(begin), bool)
            if lod < top:
                up = here[begin] >> 3
                first = _starts(up)
                held = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(up))))
                want = (held > limit) | (up == up[0]) | (up == up[-1])  # the stretch's first and last parents may go on outside
            if not want.any():
                continue
            mask = col["mask"] if lod == 0 else 1 << (key >> 3 * (lod - 1) & 7)
            end = np.append(begin[1:], len(key)) - 1
            out = {"lod": np.full(len(begin), lod, np.int32), "key": here[begin], "n": n, "low": col["low"][begin], "high": col["high"][end], "child_mask": np.bitwise_or.reduceat(mask, begin).astype(np.int32)}
            out |= {e: (np.minimum if e[:3] == "min" else np.maximum).reduceat(col[e], begin) for e in _EXTENTS}
            yield pa.RecordBatch.from_arrays([pa.array(v[want]) for v in out.values()], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for col in _stretches(batches, most):
            yield from nodes_of(col)

    return run


def nodes(points: DataFrame, limit: int, root_lod: int | None = None) -> DataFrame:
    """The tree: prefixes all of whose ancestors hold more than `limit` points. Adds is_leaf, page and page level."""
    top = root(points) if root_lod is None else root_lod
    cells = smallest_cells(points).select("key", "n", "low", "high", F.col("mask").cast("long").alias("mask"), *(F.col(e).cast("long").alias(e) for e in _EXTENTS))
    parts = cells.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_range_tree(limit, top, STRETCH), "lod int, key long, n long, low long, high long, child_mask int, " + ", ".join(f"{e} long" for e in _EXTENTS))
    every = parts.groupBy("lod", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("child_mask").alias("child_mask"), *((F.min if e[:3] == "min" else F.max)(e).alias(e) for e in _EXTENTS))
    split = every.filter((F.col("n") > limit) & (F.col("lod") > 0)).select(F.col("lod").alias("up_lod"), F.col("key").alias("up_key"))
    under = every.join(split, (F.col("lod") + 1 == F.col("up_lod")) & (F.call_function("shiftright", F.col("key"), F.lit(3)) == F.col("up_key")), "left_semi")
    tree = every.filter(F.col("lod") == top).unionByName(under)
    return tree.withColumn("is_leaf", (F.col("n") <= limit) | (F.col("lod") == 0)).withColumn("page", M.magnitude(F.col("lod"))).withColumn("level", F.lit(4) - F.col("lod") % 5)


def occupied(points: DataFrame, widths: list[int]) -> DataFrame:
    """(width, cells): how many cells of each width, ascending, hold a point. Cells are counted in ranges of codes; one
    that two ranges share counts once."""
    base = widths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if got:
            at = [np.unique(np.concatenate(got) >> 3 * (w - base)) for w in widths]
            yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), *(pa.array([f(k) for k in at], pa.int64()) for f in (len, lambda k: k[0], lambda k: k[-1]))], names=["width", "cells", "first", "last"])

    cells = points.select(M.prefix("morton", base).alias("cell")).distinct().repartitionByRange("cell")
    w = Window.partitionBy("width").orderBy("first", "last")  # a row a range
    parts = cells.mapInArrow(run, "width int, cells long, first long, last long").withColumn("again", F.coalesce((F.lag("last").over(w) == F.col("first")).cast("long"), F.lit(0)))
    return parts.groupBy("width").agg((F.sum("cells") - F.sum("again")).alias("cells"))


def _leaf_lod(leaves: DataFrame) -> Column | None:
    """Column of the leaf level of each code; None if there are too many leaves to send them to the tasks."""
    if leaves.limit(SMALL_TREE + 1).count() > SMALL_TREE:
        return None
    held = leaves.select(M.cell_min("key", F.col("lod")).alias("low"), F.col("lod").cast("byte").alias("lod")).toArrow()
    low, lod = held.column("low").to_numpy(), held.column("lod").to_numpy()
    order = np.argsort(low)
    shared = leaves.sparkSession.sparkContext.broadcast((low[order], lod[order]))

    @F.arrow_udf("int")
    def find(morton: pa.Array) -> pa.Array:
        low, lod = shared.value
        return pa.array(lod[np.searchsorted(low, morton.to_numpy(zero_copy_only=False), "right") - 1].astype(np.int32))

    return find("morton")


def leaf_of_point(points: DataFrame, limit: int, tree: DataFrame | None = None, root_lod: int | None = None) -> DataFrame:
    """points with leaf_lod and leaf_key: by the place of their code among the leaves' least codes. Of a large tree, cells of
    the finest leaf level find their leaf first, then points join cells."""
    top = root(points) if root_lod is None else root_lod
    leaves = (tree if tree is not None else nodes(points, limit, top)).filter("is_leaf").select("lod", "key")
    if leaves.isEmpty():
        return points.withColumn("leaf_lod", F.lit(top)).withColumn("leaf_key", M.prefix("morton", top))
    if (found := _leaf_lod(leaves)) is not None:
        return points.withColumn("leaf_lod", found).withColumn("leaf_key", M.prefix("morton", F.col("leaf_lod")))
    lods = sorted(r[0] for r in leaves.select("lod").distinct().collect())  # at most the tree's depth
    fine = lods[0]
    cells = points.select(M.prefix("morton", fine).alias("fine")).distinct()
    ups = cells.select("fine", F.explode(F.array(*(F.struct(F.lit(k).alias("lod"), F.call_function("shiftright", F.col("fine"), F.lit(3 * (k - fine))).alias("key")) for k in lods))).alias("at"))
    placed = ups.select("fine", F.col("at.lod").alias("lod"), F.col("at.key").alias("key")).join(leaves, ["lod", "key"]).select("fine", F.col("lod").alias("leaf_lod"), F.col("key").alias("leaf_key"))
    return points.withColumn("fine", M.prefix("morton", fine)).join(placed, "fine").drop("fine")


def collapsed(points_with_leaf: DataFrame, part: str) -> DataFrame:
    """(leaf_lod, leaf_key, parts, collapsed): in how many stored parts each leaf's points lie; one part needs no rewrite."""
    by = points_with_leaf.groupBy("leaf_lod", "leaf_key").agg(F.count_distinct(part).alias("parts"))
    return by.withColumn("collapsed", F.col("parts") == 1)
