"""Results as CSV and as raw column buffers, whole or by node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(result: DataFrame, path: str) -> None:
    """Coordinates with six decimals; arrays as columns name_0, name_1, ..."""
    cols = []
    for name, kind in result.dtypes:
        if kind.startswith("array"):
            width = result.select(F.max(F.size(name))).first()[0] or 0
            cols += [F.col(name)[k].alias(f"{name}_{k}") for k in range(width)]
        elif kind == "double":
            cols.append(F.format_string("%.6f", name).alias(name))
        else:
            cols.append(F.col(name))
    result.select(*cols).write.option("header", True).csv(path)


def raw_buffers(result: DataFrame, columns: list[str]) -> DataFrame:
    """(batch, column, bytes): little-endian values, buffers of a batch one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            data = [b.column(c).to_numpy(zero_copy_only=False).tobytes() for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(columns), pa.int32()), pa.array(columns), pa.array(data, pa.binary())], names=["batch", "column", "bytes"])

    return result.select(*columns).mapInArrow(run, "batch int, column string, bytes binary")


def write_raw(result: DataFrame, folder: str, columns: list[str], by_node: bool = False) -> None:
    """Little-endian values of each column as files <column>-<part>-<batch>.bin, in a folder for each node if wanted.

    Tasks write their own files, rows in the result's order; a part's files of all columns hold the same rows. A task
    that runs again writes the same names."""
    kinds = dict(result.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        part, n = TaskContext.get().partitionId(), 0
        for k, batch in enumerate(batches):
            table = pa.Table.from_batches([batch])
            pieces = {"": table}
            if by_node:
                nodes = table.select(["lod", "key"]).group_by(["lod", "key"]).aggregate([]).to_pylist()
                pieces = {f"/{x['lod']}-{x['key']}": table.filter((pc.field("lod") == x["lod"]) & (pc.field("key") == x["key"])) for x in nodes}
            for name, rows in pieces.items():
                fs.create_dir(root + name, recursive=True)
                for c in columns:
                    values = rows.column(c).combine_chunks()
                    flat = values.flatten() if kinds[c].startswith("array") else values
                    with fs.open_output_stream(f"{root}{name}/{c}-{part:05d}-{k:05d}.bin") as out:
                        out.write(np.ascontiguousarray(flat.to_numpy(zero_copy_only=False)).tobytes())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    named = list(dict.fromkeys([*(("lod", "key") if by_node else ()), *columns]))
    result.select(*named).mapInArrow(run, "files long").agg(F.sum("files")).first()
