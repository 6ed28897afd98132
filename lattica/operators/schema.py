"""Attribute schemas: union of differing point sets, type conversion of components, composite bit fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit layouts of the packed attributes: name -> (field, first bit, bits). Fixed values of the LAS formats.
COMPOSITES = {
    "las_composite_0": [("return_number", 0, 3), ("number_of_returns", 3, 3), ("scan_direction", 6, 1), ("edge_of_flight_line", 7, 1)],
    "las_composite_1": [("return_number", 0, 4), ("number_of_returns", 4, 4)],
    "las_composite_2": [("classification_flags", 0, 4), ("scanner_channel", 4, 2), ("scan_direction", 6, 1), ("edge_of_flight_line", 7, 1)],
    "classification": [("class", 0, 5), ("synthetic", 5, 1), ("key_point", 6, 1), ("withheld", 7, 1)],
}


def pack(name: str, fields: dict[str, Column]) -> Column:
    out = F.lit(0)
    for field, first, size in COMPOSITES[name]:
        out = out.bitwiseOR(F.shiftleft(fields[field].cast("int").bitwiseAND(F.lit((1 << size) - 1)), first))
    return out


def unpack(name: str, packed: Column) -> dict[str, Column]:
    return {field: F.shiftright(packed.cast("int"), first).bitwiseAND(F.lit((1 << size) - 1)) for field, first, size in COMPOSITES[name]}


def union(*parts: DataFrame) -> DataFrame:
    """The first part's columns, then the others' new ones; what a part lacks is zero, and one name is of one widest type."""
    kinds: dict[str, str] = {}
    rank = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    for p in parts:
        for n, k in p.dtypes:
            if n not in kinds or (k in rank and kinds[n] in rank and rank.index(k) > rank.index(kinds[n])):
                kinds[n] = k
    zero = {n: F.lit("" if k == "string" else 0).cast(k) if not k.startswith("array") else F.array().cast(k) for n, k in kinds.items()}
    return reduce(DataFrame.unionByName, [p.select(*(F.coalesce(F.col(n).cast(k), zero[n]).alias(n) if n in p.columns else zero[n].alias(n) for n, k in kinds.items())) for p in parts])


_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def components(c: Column, size: int, kind: str, source: str = "bigint") -> Column:
    """An array attribute as `size` components of another type: cut, or padded with zeros.

    Whole numbers keep their low bits, as a narrowing conversion does; fractions lose what is after the point first.
    What has no whole number (NaN, or beyond 64 bits) is zero."""
    padded = F.slice(F.concat(c, F.array_repeat(F.lit(0).cast(source), size)), 1, size)
    if kind not in _BITS:
        return F.transform(padded, lambda x: x.try_cast(kind))

    def low(x: Column) -> Column:
        whole = F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
        unused = 64 - _BITS[kind]
        return F.shiftright(F.shiftleft(whole, unused), unused).cast(kind)

    return F.transform(padded, low)
