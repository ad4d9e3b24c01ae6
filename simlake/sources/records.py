"""Nested records and JSON documents, written and read as tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def type_of(value: object) -> T.DataType:
    """The column type of a value: numbers, strings, bytes, arrays of numbers, and mappings of those; a TypeError for others."""
    if isinstance(value, bool | int | np.integer):
        return T.LongType()
    if isinstance(value, float | np.floating):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, bytes):
        return T.BinaryType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in value.items()])
    if isinstance(value, np.ndarray):
        inner: T.DataType = T.StringType() if value.dtype.kind in "US" else T.LongType() if value.dtype.kind in "iub" else T.DoubleType()
        if value.dtype.kind not in "USiubf":
            raise TypeError(f"arrays of {value.dtype} can't be stored")
        for _ in range(value.ndim):
            inner = T.ArrayType(inner)
        return inner
    if isinstance(value, list | tuple):
        return type_of(np.array(value))
    raise TypeError(f"values of type {type(value).__name__} can't be stored")


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, np.ndarray | np.generic):
        value = value.tolist()
    return int(value) if isinstance(value, bool) else list(value) if isinstance(value, tuple) else value


def save_record(spark: SparkSession, record: dict, path: str) -> None:
    """A nested mapping as one row of nested structs in Parquet."""
    spark.createDataFrame([_plain(record)], type_of(record)).coalesce(1).write.mode("overwrite").parquet(path)


def load_record(spark: SparkSession, path: str) -> dict:
    """The mapping that save_record wrote; strings come back as strings."""
    return spark.read.parquet(path).first().asDict(recursive=True)


def save_json(spark: SparkSession, document: dict, path: str) -> None:
    """A document, indented by four, as one text file in a folder."""
    spark.createDataFrame([(json.dumps(document, indent=4),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_table(df: DataFrame, path: str, buckets: int | None = None, by: str | None = None) -> None:
    """An encoding map or any table, as Parquet; with ``buckets`` as a bucketed table, so that later joins by ``by`` don't shuffle."""
    if buckets:
        df.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(path)
    else:
        df.write.mode("overwrite").parquet(path)


def transfer(spark: SparkSession, paths: Iterable[str], folder: str, mode: str = "copy") -> int:
    """Copies ('copy') or moves ('cut') files into a folder, in any file system that Spark reads; the number of files."""
    if mode not in ("copy", "cut"):
        raise ValueError("mode must be 'copy' or 'cut'")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, n = jvm.org.apache.hadoop.fs.Path(folder), 0
    fs = to.getFileSystem(conf)
    fs.mkdirs(to)
    for p in paths:
        source = jvm.org.apache.hadoop.fs.Path(p)
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, to, mode == "cut", conf)
        n += 1
    return n
