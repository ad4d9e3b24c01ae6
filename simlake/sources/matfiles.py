"""Numeric arrays of MAT files, level 5: what label and split files of image corpora come as. Read by the published format; other contents are skipped."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from simlake.operators.runtime import ship

# Fixed values of the format: types of data elements, and classes of arrays that hold numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, NUMERIC = 14, 15, range(6, 16)


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, data) of a run of data elements; short ones hold type and size in four bytes."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(f"{order}II", raw, at)
        if kind >> 16:
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, raw[at + 4 : at + 4 + size]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def arrays(raw: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a file, by name, in their shapes."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order, out = "<" if raw[126:128] == b"IM" else ">", {}
    whole = [e for kind, data in _elements(raw[128:], order) for e in (_elements(zlib.decompress(data), order) if kind == COMPRESSED else [(kind, data)])]
    for kind, data in whole:
        if kind != MATRIX:
            continue
        parts = list(_elements(data, order))
        if len(parts) < 4 or struct.unpack_from(f"{order}I", parts[0][1])[0] & 0xFF not in NUMERIC or parts[3][0] not in NUMBERS:
            continue
        shape = np.frombuffer(parts[1][1], f"{order}i4")
        values = np.frombuffer(parts[3][1], order + NUMBERS[parts[3][0]])
        out[parts[2][1].decode("ascii")] = values.reshape(shape, order="F")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, i, value): the values of every numeric array of the files under ``path``, in column order, read where Spark reads them. A file is read whole by one task."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, a in arrays(raw).items():
                    flat = a.ravel(order="F").astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([where] * len(flat)), pa.array([name] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["path", "name", "i", "value"])

    return files.mapInArrow(each, "path string, name string, i long, value double")


def labels(spark: SparkSession, path: str, name: str = "labels") -> DataFrame:
    """(image_id, label): place i of the array belongs to image i + 1."""
    found = read(spark, path).where(f"name = '{name}'")
    return found.selectExpr("cast(i + 1 as int) AS image_id", "cast(value as int) AS label")


def split_ids(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """(split, image_id) as the file calls its splits; ``names`` maps array names to splits. Use datasets.split_ids for the swap."""
    cases = " ".join(f"WHEN '{array}' THEN '{split}'" for array, split in names.items())
    return read(spark, path).selectExpr(f"CASE name {cases} END AS split", "cast(value as int) AS image_id").where("split is not null")
