"""What the operators share: shipping the package, checkpoints in the shared folder, broadcast bounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of query vectors that go to every worker at once; more queries are scored in blocks of this size.
BLOCK_BYTES = 64 << 20

#: Estimated bytes up to which an input is dealt out anew before a costly pass.
SPREAD_BYTES = 16 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their Python path already has it."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or any(k and Path(k).resolve() == root for k in known):
        return
    to = Path(tempfile.mkdtemp(prefix="simlake-code-")) / "simlake.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in (root / "simlake").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """A small input, which often is one row group and so one task, dealt out evenly over the cores; a large one as it comes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if size <= SPREAD_BYTES and n > 1 else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where that is unset a local session makes one; a cluster is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="simlake-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder. For narrow rows; texts are written as tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, pruned by column, independent of lost executors. It goes when the driver ends, or by ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
