"""Lossless column transforms, each with its inverse, per unit: a bounded stretch of rows such as a leaf.

As window expressions over rows, whose windows a unit partitions; and as `encoded`, which turns a unit's columns into
bytes by the shortest of all paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(unit: list[str], by: list[str]):
    return Window.partitionBy(*unit).orderBy(*by)


def delta(df: DataFrame, c: str, unit: list[str], by: list[str], out: str = "delta", modulus: int | None = None) -> DataFrame:
    d = F.col(c) - F.coalesce(F.lag(c).over(_order(unit, by)), F.lit(0))
    return df.withColumn(out, F.pmod(d, F.lit(modulus)) if modulus else d)


def undelta(df: DataFrame, c: str, unit: list[str], by: list[str], out: str = "value", modulus: int | None = None) -> DataFrame:
    s = F.sum(c).over(_order(unit, by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.pmod(s, F.lit(modulus)) if modulus else s)


def monotonic(df: DataFrame, c: str, unit: list[str], by: list[str]) -> DataFrame:
    """(unit, ascending): whether the delta form applies."""
    step = df.withColumn("step", F.col(c) - F.lag(c).over(_order(unit, by)))
    return step.groupBy(*unit).agg(F.coalesce(F.min("step") >= 0, F.lit(True)).alias("ascending"))


def offset(df: DataFrame, c: str, unit: list[str], out: str = "rest", base: str = "base") -> DataFrame:
    return df.withColumn(base, F.min(c).over(Window.partitionBy(*unit))).withColumn(out, F.col(c) - F.col(base))


def sort_permutation(df: DataFrame, c: str, unit: list[str], by: list[str], out: str = "rank") -> DataFrame:
    """Each row's place in the unit's sorted column; sorting by it and reading `by` order inverts."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*unit).orderBy(c, *by)) - 1)


def decorrelate(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return g, F.pmod(r - g, F.lit(65536)), F.pmod(b - g, F.lit(65536))


def correlate(g: Column, rg: Column, bg: Column) -> tuple[Column, Column, Column]:
    return F.pmod(rg + g, F.lit(65536)), g, F.pmod(bg + g, F.lit(65536))


def constant_bands(df: DataFrame, c: str, unit: list[str], width: int = 8) -> DataFrame:
    """(unit, band, constant, value): of each byte of an integer column, whether the unit needs to store it."""
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftright(F.col(c).cast("long"), 8 * k).bitwiseAND(F.lit(255)).alias("byte")) for k in range(width)))
    rows = df.select(*unit, F.explode(bands).alias("b")).select(*unit, "b.*")
    return rows.groupBy(*unit, "band").agg((F.min("byte") == F.max("byte")).alias("constant"), F.min("byte").alias("value"))


def bits(c: Column) -> Column:
    return F.length(F.bin(F.abs(c)))


def best_path(df: DataFrame, c: str, unit: list[str], by: list[str]) -> DataFrame:
    """(unit, path, bits): the cheapest of plain, offset, delta and constant, by the bits their widest value needs."""
    both = delta(offset(df, c, unit), c, unit, by)
    n = F.count(F.lit(1))
    cost = both.groupBy(*unit).agg(
        (n * F.max(bits(F.col(c)))).alias("plain"), (n * F.max(bits(F.col("rest"))) + 64).alias("offset"), (n * (F.max(bits(F.col("delta"))) + 1)).alias("delta"),
        F.when(F.min(c) == F.max(c), F.lit(64)).alias("constant"),
    )
    paths = F.array(*(F.struct(F.coalesce(F.col(p).cast("long"), F.lit(1 << 62)).alias("bits"), F.lit(p).alias("path")) for p in ("plain", "offset", "delta", "constant")))
    return cost.select(*unit, F.array_min(paths).alias("best")).select(*unit, "best.path", "best.bits")


def shuffled(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on: bytes of one significance lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unshuffled(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _differences(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[1:] = values[1:] - values[:-1]
    return out


def _paths(values: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """Every encoding that the column allows. Floats are transformed as the whole numbers of their bits, so all are exact."""
    if len(values) and (values == values[0]).all():
        yield "constant", values[:1].tobytes()
        return
    yield "plain", zlib.compress(values.tobytes(), 6)
    yield "shuffle", zlib.compress(shuffled(values), 6)
    yield "delta", zlib.compress(shuffled(_differences(values)), 6)
    least = values.min()
    yield "offset", least.tobytes() + zlib.compress(shuffled(values - least), 6)


def encode(column: np.ndarray) -> tuple[str, bytes]:
    """The name and the bytes of the shortest path."""
    kind = np.dtype(f"i{column.dtype.itemsize}")
    return min(_paths(np.ascontiguousarray(column).view(kind)), key=lambda p: (len(p[1]), p[0]))


def decode(path: str, data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    whole = np.dtype(f"i{kind.itemsize}")
    if path == "constant":
        out = np.repeat(np.frombuffer(data, whole), n)
    elif path == "plain":
        out = np.frombuffer(zlib.decompress(data), whole)
    elif path == "offset":
        out = unshuffled(zlib.decompress(data[whole.itemsize :]), whole) + np.frombuffer(data[: whole.itemsize], whole)
    else:
        out = unshuffled(zlib.decompress(data), whole)
        if path == "delta":
            out = np.cumsum(out, dtype=whole)
    return out.view(kind)


def encoded(df: DataFrame, columns: list[str], unit: list[str], by: list[str]) -> DataFrame:
    """(unit, column, n, path, data): each number column of each unit, its rows ordered by `by`. Units fit a task: they
    are as long as whoever cuts them makes them. Nulls are refused."""
    of = {n: k for n, k in df.dtypes}
    names = list(dict.fromkeys([*columns, *by]))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(b, "ascending") for b in by])
        rows = [(n, len(table), *encode(table.column(n).combine_chunks().to_numpy(zero_copy_only=True))) for n in columns]
        head = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.Table.from_arrays(head + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*unit, "column", "n", "path", "data"])

    schema = ", ".join(f"{u} {of[u]}" for u in unit) + ", column string, n long, path string, data binary"
    kinds = ", ".join(f"{n}={of[n]}" for n in columns)
    return df.select(*unit, *(n for n in names if n not in unit)).groupBy(*unit).applyInArrow(run, schema).withMetadata("column", {"kinds": kinds})


def decoded(units: DataFrame, columns: list[str], unit: list[str]) -> DataFrame:
    """The rows of encoded(): (unit, columns), in each unit's order."""
    of = dict(units.dtypes)
    kinds = dict(k.split("=") for k in units.schema["column"].metadata["kinds"].split(", "))
    types = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = {r["column"]: r for r in table.to_pylist()}
        n = held[columns[0]]["n"]
        cols = [pa.array(decode(held[c]["path"], held[c]["data"], n, np.dtype(types[kinds[c]]))) for c in columns]
        return pa.Table.from_arrays([pa.array([k.as_py()] * n, k.type) for k in key] + cols, names=[*unit, *columns])

    schema = ", ".join(f"{u} {of[u]}" for u in unit) + ", " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    return units.groupBy(*unit).applyInArrow(run, schema)
