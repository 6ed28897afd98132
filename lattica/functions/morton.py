"""Morton (Z-order) codes as Spark columns: x has the lowest bit of each triple. No UDFs.

Codes of up to 20 bits an axis fit one non-negative BIGINT. Wider grids use struct<hi,lo>, which Spark orders field by
field, with 21 bits an axis in `lo` and the next 21 in `hi`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20

#: Steps of the bit spread: shift and mask. Fixed values of the interleave by three.
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spread(c: Column | str) -> Column:
    """Put two zero bits before each of the low 21 bits."""
    out = _col(c).cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def squeeze(c: Column | str) -> Column:
    """Inverse of spread()."""
    out = _col(c).bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(_SPREAD[::-1], [*(m for _, m in _SPREAD[-2::-1]), 0x1FFFFF], strict=True):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask))
    return out


def encode(x: Column | str, y: Column | str, z: Column | str) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def decode(m: Column | str) -> tuple[Column, Column, Column]:
    m = _col(m)
    return squeeze(m), squeeze(F.shiftright(m, 1)), squeeze(F.shiftright(m, 2))


def encode_wide(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """struct<hi,lo> of up to 42 bits an axis."""
    high = [F.shiftright(_col(c).cast("long"), 21) for c in (x, y, z)]
    return F.struct(encode(*high).alias("hi"), encode(x, y, z).alias("lo"))


def decode_wide(m: Column | str) -> tuple[Column, ...]:
    m = _col(m)
    return tuple(F.shiftleft(h, 21).bitwiseOR(low) for h, low in zip(decode(m["hi"]), decode(m["lo"]), strict=True))


def _shift(lod: Column | int, extra: int = 1) -> Column:
    return (lod if isinstance(lod, Column) else F.lit(lod)).cast("int") * 3 + 3 * extra


def prefix(m: Column | str, lod: Column | int) -> Column:
    """The key of the node at `lod` that holds the code."""
    return F.call_function("shiftright", _col(m), _shift(lod))


def child(m: Column | str, lod: Column | int) -> Column:
    """Which of the eight children of its node at `lod` holds the code."""
    return F.call_function("shiftright", _col(m), _shift(lod, 0)).bitwiseAND(F.lit(7)).cast("int")


def cell_min(key: Column | str, lod: Column | int) -> Column:
    return F.call_function("shiftleft", _col(key), _shift(lod))


def cell_max(key: Column | str, lod: Column | int) -> Column:
    return cell_min(key, lod) + F.call_function("shiftleft", F.lit(1).cast("long"), _shift(lod)) - 1


def msb(m: Column | str) -> Column:
    """Place of the highest set bit; 0 for 0."""
    return F.length(F.bin(_col(m))) - 1


def lod_between(a: Column | str, b: Column | str) -> Column:
    """The lowest level at which two codes share a node."""
    return F.floor(msb(_col(a).bitwiseXOR(_col(b))) / 3).cast("int")


def magnitude(lod: Column | int) -> Column:
    return F.floor((lod if isinstance(lod, Column) else F.lit(lod)) / 5).cast("int")


def node_name(key: Column | str, lod: Column) -> Column:
    """The path inside a page of five levels: three bits a level, from the page's top."""
    depth = F.lit(4) - lod % 5
    return _col(key).bitwiseAND(F.call_function("shiftleft", F.lit(1), (depth * 3).cast("int")).cast("long") - 1).cast("int")


def root_lod(low: int, high: int) -> int:
    """Level of the canonical root over codes from `low` to `high`: the top of a five-level page."""
    spread_ = max((low ^ high).bit_length() - 1, 0)
    return 5 * (spread_ // 15) + 4
