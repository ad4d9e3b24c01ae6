"""Structured Streaming over incoming vectors: nearest centre with windowed counts, and top k against a fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.functions.vectors import doubles, euclidean
from simlake.operators.codebook import Codebook
from simlake.operators.scoring import top_k


def assigned(stream: DataFrame, codebook: Codebook) -> DataFrame:
    """``stream(.., v)`` with ``k``, the nearest centre; stateless, the codebook is a literal of the plan."""
    centres = F.array(*(F.struct(F.lit(i).alias("k"), F.array(*map(F.lit, c.tolist())).alias("c")) for i, c in enumerate(codebook.means)))
    best = F.array_min(F.transform(centres, lambda s: F.struct(F.round(euclidean(doubles("v"), s["c"]), 9).alias("d"), s["k"].alias("k"))))
    return stream.withColumn("k", best["k"])


def counts(stream: DataFrame, codebook: Codebook, time: str = "ts", every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, k, n): how many vectors of each window fall to each centre; later than ``late`` is dropped."""
    return assigned(stream, codebook).withWatermark(time, late).groupBy(F.window(time, every).alias("window"), "k").agg(F.count("*").alias("n"))


def start_top_k(stream: DataFrame, database: DataFrame, path: str, checkpoint: str, k: int = 5):  # noqa: ANN201
    """Starts a query that appends each micro-batch's (q, id, sim, rank, batch) to a Parquet folder. A batch that is repeated writes the same rows under the same number."""

    def write(batch: DataFrame, number: int) -> None:
        top_k(batch.select("q", "v"), database, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
