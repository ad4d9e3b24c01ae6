"""A labelled image folder with splits, as tables: paths, labels, splits, and their join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.operators import order

PURPOSES = ("train", "validation", "test")
# Sizes of the flower corpus, after the swap of its train and test ids.
EXPECTED = {"labels": 8189, "images": 8189, "train": 6149, "validation": 1020, "test": 1020}


def image_paths(spark: SparkSession, folder: str, suffix: str = ".jpg") -> DataFrame:
    """(image_id, path) in order of the file name; ids start at 1. The suffix is compared without case; empty files are no images and are left out."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return order.numbered(files, ["path"], "image_id").select("image_id", "path")


def numbered(labels: DataFrame) -> DataFrame:
    """(image_id, label) of an array column ``labels``: position i belongs to image i + 1."""
    return labels.select(F.posexplode("labels").alias("i", "label")).select((F.col("i") + 1).alias("image_id"), "label")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of two tables joined by their place in an order each; what the longer one has more is left out. For tables without a common key."""
    a = order.numbered(left, left_order, "~place")
    return a.join(order.numbered(right, right_order, "~place"), "~place").drop("~place")


def split_ids(ids: DataFrame, swap_splits: bool = True) -> DataFrame:
    """(split, image_id); with ``swap_splits`` what the files call test trains, and what they call train tests."""
    if not swap_splits:
        return ids.select("split", "image_id")
    name = F.when(F.col("split") == "train", "test").when(F.col("split") == "test", "train").otherwise(F.col("split"))
    return ids.select(name.alias("split"), "image_id")


def checked_purposes(purpose: str | list[str]) -> list[str]:
    wanted = [purpose] if isinstance(purpose, str) else list(purpose)
    if len(set(wanted)) != len(wanted):
        raise ValueError("a purpose is named twice")
    if unknown := set(wanted) - set(PURPOSES):
        raise ValueError(f"unknown purposes: {sorted(unknown)}")
    return wanted


def labelled_images(paths: DataFrame, labels: DataFrame, splits: DataFrame, purpose: str | list[str] = "train") -> DataFrame:
    """(image_id, path, label) of the union of the chosen splits, each image once."""
    wanted = checked_purposes(purpose)
    ids = splits.where(F.col("split").isin(wanted)).select("image_id").distinct()
    return paths.join(ids, "image_id").join(labels, "image_id")


def decoded(spark: SparkSession, folder: str, suffix: str = ".jpg") -> DataFrame:
    """(path, image struct) by Spark's own decoder; files that are no images are dropped."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select(F.col("image.origin").alias("path"), "image")


def integrity(paths: DataFrame, labels: DataFrame, splits: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """(part, n, expected, ok): whether labels, images and splits have the sizes they should; a part that is expected and absent has none."""
    want = expected or EXPECTED
    counts = labels.agg(F.count("*").alias("n")).select(F.lit("labels").alias("part"), "n").unionAll(paths.agg(F.count("*").alias("n")).select(F.lit("images").alias("part"), "n"))
    counts = counts.unionAll(splits.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n")))
    rule = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(v).cast("long").alias("expected")) for k, v in want.items()))
    wanted = labels.sparkSession.range(1).select(F.inline(rule))
    return wanted.join(counts, "part", "full").select("part", F.coalesce("n", F.lit(0)).alias("n"), "expected", F.coalesce(F.coalesce("n", F.lit(0)) == F.col("expected"), F.lit(False)).alias("ok"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))
