"""Results of a stream that are given out once they are final: the best rows of each key and time window, and the sessions of each key.

The top k is kept by key and window, no more than k rows of each, and a timer clears it; so state grows with the windows that are
open, not with the stream. Rows that come late but within the watermark count, repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from simlake.operators.runtime import ship

#: What a query is started with: a state store that keeps state of any kind out of the heap, and sessions merged in each task first.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

#: How that store works, which is unset otherwise: no look-up before each write only to count rows, and a batch writes its changes instead of a copy of the state.
STORE = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def best_of(rows: pd.DataFrame, by: list[str], k: int) -> pd.DataFrame:
    """The k best of each group, each id once with its best score, ties to the lowest id."""
    ordered = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").drop_duplicates([*by, "id"])
    return ordered.groupby(by, sort=False, dropna=False).head(k) if by else ordered.head(k)


class TopK(StatefulProcessor):
    """Holds the k best (id, score) of a key and window; emits them, ranked, when the window's timer expires."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "ids array<bigint>, scores array<double>")

    def _frame(self) -> pd.DataFrame:
        ids, scores = self.held.get() if self.held.exists() else ([], [])
        return pd.DataFrame({"id": pd.Series(list(ids), dtype="int64"), "score": pd.Series(list(scores), dtype="float64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = not self.held.exists()
        best = self._frame()
        for frame in rows:
            best = best_of(pd.concat([best, frame[["id", "score"]]]), [], self.k)
        self.held.update((best["id"].tolist(), best["score"].tolist()))
        if new:
            self.handle.registerTimer(int(key[1]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        best = self._frame()
        self.held.clear()
        yield pd.DataFrame({"key": key[0], "until": int(key[1]), "rank": range(1, len(best) + 1), "id": best["id"], "score": best["score"]})

    def close(self) -> None:
        pass


def running_top(stream: DataFrame, k: int = 5, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(key, start, rank, id, score) of ``stream(key, id, score, ts)``: the k best of each key in each window of ``every``, once the watermark has passed its end.

    The key is null or of any type; rows without an id, a time or a score (null or NaN) do not count. Each task first keeps the k
    best of its rows for a key and window, so a hot key sends k rows a task to the state, and the latest of all its rows, which
    the watermark needs. Append mode. Needs ``started``, which gives the query a state store that can hold this state.
    """
    ship(stream.sparkSession)
    known = stream.where("id is not null and ts is not null and score is not null and not isnan(score)").withColumn("ts", F.col("ts").cast("timestamp"))
    own = known.select("key", F.unix_millis(F.window("ts", every)["end"]).alias("until"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.unix_micros("ts").alias("at"))

    def trimmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                best = best_of(frame, ["key", "until"], k)
                latest = frame["at"].idxmax()
                yield best if latest in best.index else pd.concat([best, frame.loc[[latest]]])

    kind = own.schema["key"].dataType.simpleString()
    first = own.mapInPandas(trimmed, own.schema).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    out = first.groupBy("key", "until").transformWithStateInPandas(TopK(k), f"key {kind}, until long, rank int, id long, score double", "Append", "EventTime")
    return out.select("key", (F.timestamp_millis("until") - F.expr(f"INTERVAL {every}")).alias("start"), "rank", "id", "score")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, last, n, total) of ``stream(key, id, score, ts)``: each key's sessions, which end ``gap`` after their last row, once the watermark has passed that end.

    An id that comes again within the watermark counts once; rows without an id or a time do not count, nor does a null score in
    the total. Append mode; the state holds open sessions and the ids of the last ``late``. With ``started`` each task merges its
    sessions before they are shuffled, so a hot key sends sessions, not rows.
    """
    known = stream.where("id is not null and ts is not null").select("key", "id", F.col("score").cast("double").alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    once = known.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    found = once.groupBy("key", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    return found.select("key", F.col("s.start").alias("start"), (F.col("s.end") - F.expr(f"INTERVAL {gap}")).alias("last"), "n", "total")


def started(result: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """A query that appends ``result`` to a Parquet folder for all that is there now, each row once, and ends. Called again it goes on from its checkpoint."""
    spark = result.sparkSession
    before = {name: spark.conf.get(name, None) for name in SETTINGS | STORE}
    for name, value in (SETTINGS | STORE).items():
        spark.conf.set(name, value)
    try:
        return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def replayed(spark: SparkSession, pieces: list[DataFrame], folder: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream's result ``of`` it gives for tables that arrive one after the other; the query ends after each and starts again from its checkpoint."""
    for piece in pieces:
        piece.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(piece.schema).parquet(f"{folder}/in")
        started(of(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
