"""The grid frame: scale and offset per axis, and the conversion between world and grid coordinates."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CloudConfig:
    """Of a dataset. node_point_limit: points a leaf may hold; full_detail_level: below it, a level's sample keeps one
    point of each smallest cell."""

    scale: float = 0.00025
    offset: tuple[float, float, float] = (-10000.0, -10000.0, -10000.0)
    node_point_limit: int = 200_000
    full_detail_level: int = 9
    lod_all_attributes: bool = False
    store_original_order: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


def quantize(c: Column, scale: float, offset: float) -> Column:
    """World to grid, truncating toward zero."""
    return ((c.cast("double") - F.lit(offset)) / F.lit(scale)).cast("long")


def round_to_grid(c: Column, scale: float, offset: float) -> Column:
    """World to grid for bounds, to the nearest."""
    return F.round((c.cast("double") - F.lit(offset)) / F.lit(scale)).cast("long")


def dequantize(g: Column, scale: float, offset: float) -> Column:
    return g * F.lit(scale) + F.lit(offset)


def on_grid(df: DataFrame, config: CloudConfig, axes: tuple[str, str, str] = ("x", "y", "z"), bits: int = 20) -> DataFrame:
    """df with gx, gy, gz; a point outside the range of the grid is an error, as in any strict ingest."""
    for k, (axis, name) in enumerate(zip(axes, ("gx", "gy", "gz"), strict=True)):
        world = F.col(axis).cast("double")
        inside = (world >= config.offset[k]) & (world < config.offset[k] + config.scale * (1 << bits))
        df = df.withColumn(name, F.when(inside, quantize(world, config.scale, config.offset[k])).otherwise(F.raise_error(F.lit("a point lies outside the dataset range")).cast("long")))
    return df


def adopt_scale(headers: DataFrame) -> float:
    """The finest native scale of the inputs' headers (one row each)."""
    return headers.agg(F.min("scale")).first()[0]


def fitted(points: DataFrame, config: CloudConfig, axes: tuple[str, str, str] = ("x", "y", "z")) -> CloudConfig:
    """The config with its offset at the points' least coordinates: one aggregate row."""
    low = points.agg(*(F.min(a).cast("double") for a in axes)).first()
    return replace(config, offset=tuple(0.0 if v is None else float(v) for v in low))
