"""LAS point files (uncompressed, formats 0 to 10) as a Spark data source.

`spark.read.format("las").load(paths)` splits each file into ranges of records, so a large file is read by many tasks.
Compressed LAZ needs a codec that isn't part of this library and is refused. Paths are URIs for pyarrow.fs, or local.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RECORDS_PER_SPLIT = 1_000_000

#: Fields of the record formats: name, numpy type. Fixed values of the LAS 1.4 specification.
_BASE = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("las_composite_0", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_EXTENDED = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("las_composite_1", "u1"), ("las_composite_2", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_TIME = [("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_WAVE = [("wave_index", "u1"), ("wave_offset", "<u8"), ("wave_size", "<u4"), ("wave_return", "<f4"), ("wave_dx", "<f4"), ("wave_dy", "<f4"), ("wave_dz", "<f4")]
FORMATS = {
    0: _BASE,
    1: _BASE + _TIME,
    2: _BASE + _RGB,
    3: _BASE + _TIME + _RGB,
    4: _BASE + _TIME + _WAVE,
    5: _BASE + _TIME + _RGB + _WAVE,
    6: _EXTENDED,
    7: _EXTENDED + _RGB,
    8: _EXTENDED + _RGB + [("near_infrared", "<u2")],
    9: _EXTENDED + _WAVE,
    10: _EXTENDED + _RGB + [("near_infrared", "<u2")] + _WAVE,
}
_SPARK = {"u1": "smallint", "i1": "tinyint", "u2": "int", "i2": "smallint", "u4": "bigint", "i4": "int", "u8": "decimal(20,0)", "f4": "float", "f8": "double"}


def schema_of(point_format: int) -> str:
    """World coordinates as doubles, the other fields in the least Spark type that holds them."""
    return "file string, record bigint, x double, y double, z double, " + ", ".join(f"{n} {_SPARK[t.lstrip('<')]}" for n, t in FORMATS[point_format][3:])


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


def read_header(path: str) -> dict:
    """Version, counts, record layout, scale, offset, bounds and variable records' names of a file."""
    with _open(path) as f:
        head = f.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        major, minor, size, data, vlrs, kind, length, legacy = head[24], head[25], *struct.unpack_from("<HIIBHI", head, 94)
        scale, offset, box = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155), struct.unpack_from("<6d", head, 179)
        count = struct.unpack_from("<Q", head, 247)[0] if minor >= 4 and size >= 375 else legacy
        if kind & 0xC0 or kind not in FORMATS:
            raise ValueError(f"{path}: compressed or unknown point format {kind}")
        f.seek(size)
        names = []
        for _ in range(vlrs):
            v = f.read(54)
            user, record, extra = v[2:18].rstrip(b"\0").decode("latin-1"), *struct.unpack_from("<HH", v, 18)
            names.append({"user": user, "record": record, "bytes": extra})
            f.seek(extra, 1)
    return {"path": path, "version": f"{major}.{minor}", "point_format": kind, "record_bytes": length, "points": count, "data_offset": data, "scale": scale, "offset": offset, "min": box[1::2], "max": box[::2], "vlrs": names}


def write(path: str, point_format: int, fields: dict[str, np.ndarray], scale: float = 0.001, offset: float = 0.0) -> None:
    """A small LAS 1.4 file from grid coordinates and fields: for exports and tests."""
    kind = np.dtype(FORMATS[point_format])
    n = len(fields["x"])
    rows = np.zeros(n, kind)
    for name, values in fields.items():
        rows[name] = values
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HIIBHI", head, 94, 375, 375, 0, point_format, kind.itemsize, n if point_format < 6 else 0)
    struct.pack_into("<6d", head, 131, *(scale,) * 3, *(offset,) * 3)
    box = [f(rows[a]) * scale + offset if n else 0.0 for a in "xyz" for f in (np.max, np.min)]
    struct.pack_into("<6d", head, 179, *box)
    struct.pack_into("<Q", head, 247, n)
    with open(path, "wb") as f:
        f.write(bytes(head) + rows.tobytes())


class _Range(InputPartition):
    def __init__(self, header: dict, first: int, count: int):
        self.header, self.first, self.count = header, first, count


class LasReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], schema: StructType):
        self.headers, self.schema = [read_header(p) for p in paths], schema

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(h, at, min(RECORDS_PER_SPLIT, h["points"] - at)) for h in self.headers for at in range(0, h["points"], RECORDS_PER_SPLIT)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        h = part.header
        kind = np.dtype({"names": [n for n, _ in FORMATS[h["point_format"]]], "formats": [t for _, t in FORMATS[h["point_format"]]], "offsets": np.cumsum([0, *(np.dtype(t).itemsize for _, t in FORMATS[h["point_format"]][:-1])]).tolist(), "itemsize": h["record_bytes"]})
        with _open(h["path"]) as f:
            f.seek(h["data_offset"] + part.first * h["record_bytes"])
            for at in range(0, part.count, 65536):
                n = min(65536, part.count - at)
                rows = np.frombuffer(f.read(n * h["record_bytes"]), kind)
                cols = {"file": pa.array([h["path"]] * n), "record": pa.array(np.arange(part.first + at, part.first + at + n))}
                cols |= {a: pa.array(rows[a] * h["scale"][k] + h["offset"][k]) for k, a in enumerate("xyz")}
                for name, t in FORMATS[h["point_format"]][3:]:
                    values = pa.array(np.ascontiguousarray(rows[name]))
                    cols[name] = values.cast({"smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64()}[_SPARK[t.lstrip("<")]])
                wanted = self.schema.names
                yield pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n)) for c in wanted], names=wanted)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def _paths(self) -> list[str]:
        return [p for p in self.options["path"].split(",") if p]

    def schema(self) -> str:
        kinds = {read_header(p)["point_format"] for p in self._paths()}
        if len(kinds) != 1:
            raise ValueError("files of one read have one point format; union reads of different ones")
        return schema_of(kinds.pop())

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(self._paths(), schema)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").load(",".join(paths))


def headers(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a file: the probe that ingestion makes before it reads points."""
    rows = [(h["path"], h["version"], h["point_format"], h["points"], float(min(h["scale"])), *map(float, h["min"]), *map(float, h["max"])) for h in map(read_header, paths)]
    return spark.createDataFrame(rows, "file string, version string, point_format int, points long, scale double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
