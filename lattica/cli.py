"""Command line: convert, info, extract, copy, laz, query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.functions.frame import CloudConfig, adopt_scale, fitted
from lattica.operators import stats
from lattica.sources import dataset, las, sinks


def lod_mode(text: str) -> tuple[str, int, int]:
    """'full', a level, or 'budget:n'."""
    if text == "full":
        return "full", 0, 0
    if text.startswith("budget:"):
        return "budget", 0, int(text[7:])
    return "level", int(text), 0


def byte_size(text: str) -> int:
    """'64', '64K', '2M', '1G'."""
    units = {"k": 10, "m": 20, "g": 30}
    return int(text[:-1]) << units[text[-1].lower()] if text[-1].lower() in units else int(text)


def box(text: str) -> tuple[list[float], list[float]]:
    values = [float(v) for v in text.split(",")]
    if len(values) != 6:
        raise argparse.ArgumentTypeError("a box is six numbers: x0,y0,z0,x1,y1,z1")
    return values[:3], values[3:]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="LAS or Parquet points to a dataset")
    c.add_argument("inputs", nargs="+"), c.add_argument("-o", "--output", required=True)
    c.add_argument("--node-limit", type=int, default=200_000), c.add_argument("--scale", type=float), c.add_argument("--all-attributes", action="store_true")
    for name in ("info", "extract"):
        c = sub.add_parser(name)
        c.add_argument("path")
    c.add_argument("--offset", type=int, default=0), c.add_argument("--count", type=int, default=20), c.add_argument("--random", type=int), c.add_argument("--nodes", action="store_true"), c.add_argument("--node", help="level:key, everything about one node"), c.add_argument("--hex", help="a column's bytes")
    c = sub.add_parser("copy")
    c.add_argument("path"), c.add_argument("output")
    c = sub.add_parser("laz", help="headers and points of LAS files")
    c.add_argument("path"), c.add_argument("--points", type=int, default=0), c.add_argument("--offset", type=int, default=0)
    c = sub.add_parser("query")
    c.add_argument("path"), c.add_argument("--aabb", type=box), c.add_argument("--attributes"), c.add_argument("--lod", type=lod_mode, default=("full", 0, 0))
    c.add_argument("--clip", choices=("point", "node"), default="point"), c.add_argument("--position", choices=dataset.FORMATS, default="r64"), c.add_argument("--stats", action="store_true"), c.add_argument("--csv"), c.add_argument("-o", "--output", help="raw column buffers, in a folder"), c.add_argument("--per-node", action="store_true")
    c.add_argument("--memory", type=byte_size, help="bytes that a scan task reads at most, as 64M")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    if a.command == "convert":
        files = all(p.lower().endswith(".las") for p in a.inputs)
        raw = las.read(spark, *a.inputs) if files else spark.read.parquet(*a.inputs)
        scale = a.scale or (adopt_scale(las.headers(spark, *a.inputs)) if files else CloudConfig.scale)
        config = CloudConfig(node_point_limit=a.node_limit, scale=scale, lod_all_attributes=a.all_attributes)
        made = dataset.build(raw, a.output, fitted(raw, config) if "x" in raw.columns else config)
        made.info().show(truncate=False)
    elif a.command == "info":
        ds = dataset.open_dataset(spark, a.path)
        ds.info().show(truncate=False), ds.statistics().show(100, truncate=False), stats.level_summary(ds.table("nodes")).orderBy(F.desc("lod")).show(100)
    elif a.command == "extract":
        ds = dataset.open_dataset(spark, a.path)
        if a.node:
            lod, key = map(int, a.node.split(":"))
            at = (F.col("lod") == lod) & (F.col("key") == key)
            ds.table("nodes").filter(at).show(1, truncate=False, vertical=True)
            held = ds.table("points").filter((F.col("leaf_lod") == lod) & (F.col("leaf_key") == key)).unionByName(ds.table("samples").filter(at), allowMissingColumns=True)
            kinds = dict(held.dtypes)
            stats.attribute_stats(held, ["gx", "gy", "gz", *(n for n in ds.attributes if kinds[n] in stats.WIDTHS)]).show(100, truncate=False)
            return 0
        rows = ds.table("nodes") if a.nodes else stats.extract_random(ds.table("points"), a.random, 42) if a.random else stats.extract_range(ds.table("points"), a.offset, a.count)
        if a.hex:
            for data in sinks.raw_buffers(rows, [a.hex]).orderBy("batch").toLocalIterator():
                for k in range(0, len(data["bytes"]), 16):
                    print(f"{k:08x}  {data['bytes'][k : k + 16].hex(' ')}")
        else:
            rows.show(1000, truncate=False)
    elif a.command == "copy":
        dataset.copy(dataset.open_dataset(spark, a.path), a.output)
    elif a.command == "laz":
        las.headers(spark, a.path).show(truncate=False)
        if a.points:
            las.read(spark, a.path).filter(F.col("record") >= a.offset).orderBy("record").limit(a.points).show(a.points, truncate=False)
    else:
        mode, level, most = a.lod
        if a.memory:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(a.memory))
        low, high = a.aabb or (None, None)
        got = dataset.open_dataset(spark, a.path).query(low, high, a.attributes.split(",") if a.attributes else None, mode, level, most, a.clip, a.position)
        if a.csv:
            sinks.write_csv(got, a.csv)
        if a.output:
            numbers = [n for n, k in got.dtypes if k != "string" and n not in ("lod", "key", "is_lod", "morton", "id")]
            sinks.write_raw(got, a.output, numbers, a.per_node)
        if a.stats or not (a.csv or a.output):
            got.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("lod", "key").alias("nodes")).show()
        if a.stats:
            got.groupBy("lod", "is_lod").agg(F.count_distinct("key").alias("nodes"), F.count(F.lit(1)).alias("points")).orderBy(F.desc("lod"), "is_lod").show(100)
            kinds = dict(got.dtypes)
            stats.attribute_stats(got, [n for n in got.columns if kinds[n] in stats.WIDTHS and n not in ("lod", "key", "morton", "id")]).show(100, truncate=False)
    return 0
