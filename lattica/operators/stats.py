"""Metadata and statistics of clouds: extents, attribute statistics, level summaries, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import morton as M

WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def extent_exact(points: DataFrame) -> DataFrame:
    return points.agg(*(f(a).alias(f"{n}_{a}") for a in ("gx", "gy", "gz") for n, f in (("min", F.min), ("max", F.max))))


def extent_morton(points: DataFrame) -> DataFrame:
    """Decoded least and greatest codes: cheap, and not a bounding box."""
    got = points.agg(F.min("morton").alias("low"), F.max("morton").alias("high"))
    return got.select(*(c.alias(f"{n}_{a}") for n in ("low", "high") for a, c in zip(("gx", "gy", "gz"), M.decode(n), strict=True)))


def attribute_stats(points: DataFrame, attributes: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, attribute, n, raw_bytes, min_value, max_value): one pass over the points, first components of arrays."""
    kinds = dict(points.dtypes)
    pairs = []
    for a in attributes:
        c = F.col(a)[0] if kinds[a].startswith("array") else F.col(a)
        width = WIDTHS.get(kinds[a].removeprefix("array<").removesuffix(">"), 8)
        size = F.size(a) * width if kinds[a].startswith("array") else F.lit(width)
        pairs.append(F.struct(F.lit(a).alias("attribute"), c.cast("double").alias("value"), size.cast("long").alias("bytes")))
    rows = points.select(*(by or []), F.explode(F.array(*pairs)).alias("a")).select(*(by or []), "a.*").filter("value is not null")
    return rows.groupBy(*(by or []), "attribute").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("raw_bytes"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def stats_rollup(points: DataFrame, attributes: list[str], by: str) -> DataFrame:
    """attribute_stats per value of `by`, with totals per attribute and over all (null keys)."""
    base = attribute_stats(points, attributes, [by])
    return base.rollup("attribute", by).agg(F.sum("n").alias("n"), F.sum("raw_bytes").alias("raw_bytes"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def level_summary(tree: DataFrame) -> DataFrame:
    return tree.groupBy("lod").agg(F.count(F.lit(1)).alias("nodes"), F.sum((~F.col("is_leaf")).cast("int")).alias("interior"), F.sum("n").alias("points"))


def page_summary(tree: DataFrame) -> DataFrame:
    """(page, page_key, nodes, leaves): five-level sub-trees."""
    top = F.col("page") * 5 + 4
    keyed = tree.withColumn("page_key", F.call_function("shiftright", F.col("key"), ((top - F.col("lod")) * 3).cast("int")))
    return keyed.groupBy("page", "page_key").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_leaf").cast("int")).alias("leaves"))


def attribute_registry(*schemas: list[str]) -> list[str]:
    """All attribute names, in the order in which they are first seen."""
    return list(dict.fromkeys(a for s in schemas for a in s))


def extract_range(points: DataFrame, offset: int, count: int) -> DataFrame:
    """Rows [offset, offset + count) in Morton order."""
    return points.orderBy("morton", "id").offset(offset).limit(count)


def extract_random(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows chosen by a seeded hash of the id: a sampling operator."""
    return points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


def contrast(c: str, low: float, high: float):
    """A value's place between the dataset's least and greatest, in 0..1."""
    width = F.lit(float(high) - float(low))
    return F.when(width == 0, F.lit(0.0)).otherwise(F.least(F.greatest((F.col(c).cast("double") - F.lit(float(low))) / F.nullif(width, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def unreferenced(stored: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Stored units that no node refers to: what a clean-up may delete."""
    return stored.join(nodes.select(*key).distinct(), key, "left_anti")


def points_per_return(points: DataFrame) -> DataFrame:
    """(return_number, n) of points with las_composite_0 or _1."""
    from lattica.operators.schema import unpack

    name = next(c for c in ("las_composite_0", "las_composite_1") if c in points.columns)
    return points.groupBy(unpack(name, F.col(name))["return_number"].alias("return_number")).agg(F.count(F.lit(1)).alias("n"))


def storage(source: DataFrame, samples: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute_stats of the points and of the samples, with each attribute's overhead of the samples in percent."""
    both = attribute_stats(source, attributes).withColumn("part", F.lit("source")).unionByName(attribute_stats(samples, [a for a in attributes if a in samples.columns]).withColumn("part", F.lit("lod")))
    by = both.groupBy("attribute").pivot("part", ["source", "lod"]).agg(F.sum("raw_bytes"))
    return by.select("attribute", F.coalesce("source", F.lit(0)).alias("source_bytes"), F.coalesce("lod", F.lit(0)).alias("lod_bytes"), (F.lit(100.0) * F.coalesce("lod", F.lit(0)) / F.nullif(F.col("source"), F.lit(0))).alias("overhead_percent"))
