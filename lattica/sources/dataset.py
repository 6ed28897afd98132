"""Datasets: a folder of Parquet tables, points in Morton order, and the query surface over them.

    points/            every point with its leaf, range-partitioned and sorted by Morton code: box queries prune by
                       Parquet statistics
    nodes/, samples/   the octree and its level-of-detail samples
    config.json        written last: a folder without it is no dataset
"""

from __future__ import annotations

import asyncio
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import morton as M
from lattica.functions.frame import CloudConfig, on_grid
from lattica.operators import lod, octree, region, stats

MODES, FORMATS = ("full", "level", "budget"), ("r64", "r32", "i32")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise RuntimeError(f"no dataset: {path} is missing")
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def build(points: DataFrame, path: str, config: CloudConfig | None = None, mode: str = "errorifexists") -> Dataset:
    """Build a dataset from points with x, y, z (world), or gx, gy, gz (grid), and attributes. `id` is made if missing."""
    config, spark = config or CloudConfig(), points.sparkSession
    if "gx" not in points.columns:
        points = on_grid(points, config).drop("x", "y", "z")
    if "id" not in points.columns:
        points = points.withColumn("id", F.monotonically_increasing_id())
    if config.store_original_order:
        points = points.withColumn("original_order", F.monotonically_increasing_id())
    coded = points.withColumn("morton", M.encode("gx", "gy", "gz"))
    coded.write.mode(mode).parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    top = octree.root(raw)
    octree.nodes(raw, config.node_point_limit, top).write.mode(mode).parquet(f"{path}/nodes")
    tree = spark.read.parquet(f"{path}/nodes")
    placed = octree.leaf_of_point(raw, config.node_point_limit, tree, top)
    placed.repartitionByRange("morton").sortWithinPartitions("morton", "id").write.mode(mode).option("compression", "zstd").parquet(f"{path}/points")
    lod.pyramid(lod.slim(raw.drop("original_order"), config.lod_all_attributes), tree, config.full_detail_level).write.mode(mode).option("compression", "zstd").parquet(f"{path}/samples")
    fs, p = _fs(spark, f"{path}/raw")
    fs.delete(p, True)
    _write_text(spark, f"{path}/config.json", json.dumps(config.as_dict() | {"uuid": uuid.uuid4().hex, "root_lod": top}))
    return open_dataset(spark, path)


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    return Dataset(spark, path, json.loads(_read_text(spark, f"{path}/config.json")))


def copy(source: Dataset, path: str) -> Dataset:
    """The tables under another path, each node and sample once, with an id of its own."""
    for name in ("points", "nodes", "samples"):
        df = source.table(name)
        (df.dropDuplicates(["lod", "key", *(["cell"] if name == "samples" else [])]) if name != "points" else df).write.mode("errorifexists").parquet(f"{path}/{name}")
    _write_text(source.spark, f"{path}/config.json", json.dumps(source.config | {"uuid": uuid.uuid4().hex}))
    return open_dataset(source.spark, path)


class Dataset:
    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path, self.config = spark, path, config

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.table("points").columns if c not in ("leaf_lod", "leaf_key", "morton", "gx", "gy", "gz", "id")]

    def info(self) -> DataFrame:
        return octree.root_cell(self.table("points")).withColumn("scale", F.lit(self.config["scale"])).withColumn("node_point_limit", F.lit(self.config["node_point_limit"])).withColumn("attribute_count", F.lit(len(self.attributes)))

    def statistics(self) -> DataFrame:
        kinds = dict(self.table("points").dtypes)
        return stats.attribute_stats(self.table("points"), [a for a in self.attributes if kinds[a] in stats.WIDTHS])

    def _grid(self, corner) -> tuple[float, ...]:
        """World to grid; a corner that is a grid value but for rounding errors is that value."""
        exact = [(float(c) - o) / self.config["scale"] for c, o in zip(corner, self.config["offset"], strict=True)]
        return tuple(float(round(v)) if abs(v) < 1e15 and abs(v - round(v)) < 1e-6 else v for v in exact)

    def query(self, low=None, high=None, attributes: list[str] | None = None, lod_mode: str = "full", level: int = 0, max_points: int = 0, clip: str = "point", position_format: str = "r64") -> DataFrame:
        """Rows (lod, key, is_lod, id, x, y, z, attributes). The box is in world coordinates and closed."""
        if lod_mode not in MODES or position_format not in FORMATS:
            raise ValueError(f"the mode is one of {MODES}, the position format one of {FORMATS}")
        if (low is None) != (high is None) or any(b is not None and len(b) != 3 for b in (low, high)):
            raise ValueError("a box has a low and a high corner of three coordinates")
        box = None if low is None else region.Box(self._grid(low), self._grid(high))
        points, tree = self.table("points"), self.table("nodes")
        if lod_mode == "full" and clip == "point":
            got = points.filter(region.inside(box)).withColumnsRenamed({"leaf_lod": "lod", "leaf_key": "key"}).withColumn("is_lod", F.lit(False))
        else:
            front = tree.filter("is_leaf") if lod_mode == "full" else region.frontier_level(tree, level, self.config["root_lod"]) if lod_mode == "level" else region.frontier_budget(tree, max_points, box)
            got = region.take(points, self.table("samples"), front, box, clip)
        names = self.attributes if attributes is None else attributes
        got = region.positions(got, position_format, self.config["scale"], tuple(self.config["offset"]))
        return got.select("lod", "key", "is_lod", "morton", "id", "x", "y", "z", *(region.filled(got, a).alias(a) for a in names))

    def query_box(self, aabb_min=None, aabb_max=None, attributes: list[str] | None = None, lod: str = "full", level: int = 0, max_points: int = 0, clip_points: bool = True, position_format: str = "r64") -> dict:
        """The result as numpy arrays: xyz (N, 3), each attribute, point_count, node_count. For results that fit a client."""
        rows = region.ordered(self.query(aabb_min, aabb_max, attributes, lod, level, max_points, "point" if clip_points else "node", position_format)).toArrow()
        out = {a: rows.column(a).to_numpy() for a in rows.column_names if a not in ("lod", "key", "is_lod", "morton", "id", "x", "y", "z")}
        nodes = np.column_stack([rows.column(c).to_numpy() for c in ("lod", "key")]) if rows.num_rows else np.zeros((0, 2))
        return out | {"xyz": np.column_stack([rows.column(c).to_numpy() for c in "xyz"]), "point_count": rows.num_rows, "node_count": len(np.unique(nodes, axis=0))}

    async def query_box_async(self, *args, **kwargs) -> dict:
        return await asyncio.to_thread(self.query_box, *args, **kwargs)
