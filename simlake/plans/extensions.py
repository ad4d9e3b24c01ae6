"""Queries of what goes beyond the reference: SQL functions and table functions, as-of joins, the index. SQL text only where the query says so."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions import sql
from simlake.operators import index
from simlake.operators.asof import asof_join
from simlake.operators.runtime import shared_folder, table
from simlake.operators.stages import BagEncoder
from simlake.plans.common import BOOK, DESCRIBED, EVERY, RANKED, RESIDUALS, TO_CENTRES, UNIT, bagged, codebook, database, lloyd, query_set, six, vectors
from simlake.plans.encoding import STEPS
from simlake.streaming import running

#: A user of ``events`` stands for the customers whose key has that remainder, so that a key has many orders.
USERS = 150


def _views(spark: SparkSession, sf_dir: str) -> None:
    sql.register(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("vectors_of_embeddings")


def sql1_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines, norms and powers by SQL functions of the session. What is of one vector is computed once a row, before the pairs; the pairs are spread over all tasks, whatever their label."""
    _views(spark, sf_dir)
    return spark.sql(f"""
        WITH a AS (SELECT vec_id, label, unit_vector(v) AS u FROM vectors_of_embeddings WHERE vec_id % {EVERY} = 0),
             b AS (SELECT /*+ REPARTITION({2 * spark.sparkContext.defaultParallelism}) */ vec_id, label, unit_vector(v) AS u, p_normalised(v, 2D) AS p, round(vector_norm(signed_power(v, 0.5D), 1D), 5) + 0D AS mass FROM vectors_of_embeddings)
        SELECT /*+ BROADCAST(a) */ a.vec_id AS q, b.vec_id AS id, round(vector_dot(a.u, b.u), 6) + 0D AS sim, mass, round(vector_dot(a.u, b.p), 6) + 0D AS near
        FROM b JOIN a ON a.label = b.label""")


def descriptors_of(v: list[float]) -> np.ndarray:
    """A user's extractor: a vector of 64 as eight descriptors of eight."""
    return np.reshape(v, (8, 8))


def sql2_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors by a table function in a LATERAL join, their RootSIFT form by a SQL function, grouped by image: SQL text only."""
    _views(spark, sf_dir)
    sql.register_extractor(spark, "descriptors_of", descriptors_of, 8)
    return spark.sql("""
        SELECT e.vec_id AS image, count(*) AS n, round(sum(d.x[0]), 6) + 0D AS first, round(sum(vector_dot(hellinger(transform(d.x, c -> abs(c))), d.x)), 5) + 0D AS rooted
        FROM vectors_of_embeddings e, LATERAL descriptors_of(e.v) d WHERE d.desc < 7 GROUP BY e.vec_id""")


def asof1_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last order of its user before it, -1 where there is none; orders are moved 27 years on, into the time of the events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % USERS).alias("user_id"), "o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 27 YEARS")).alias("ordered"), "o_totalprice")
    return asof_join(events, orders, ["user_id"], "ts", "ordered", ["o_orderkey"]).select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), six(F.coalesce("o_totalprice", F.lit(0.0))).alias("price"))


def asof2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of its user in the hour before it."""
    events = table(spark, sf_dir, "events")
    late = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    return asof_join(late, views, ["user_id"], "ts", "seen", ["view_id"], within=3600.0).select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


def idx1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the index, probed in six cells of ten: these vectors are noise, which takes many probes."""
    d = database(spark, sf_dir)
    model = index.fit(d)
    found = index.search(index.build(d, model), model, query_set(spark, sf_dir), 10, probes=-(-6 * len(model.cells) // 10), rerank=200)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id", six("sim").alias("sim"))


def idx2_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index probed in all cells with all rows ranked again, which is exact."""
    d = database(spark, sf_dir)
    model = index.fit(d, cells=12)
    found = index.search(index.build(d, model), model, query_set(spark, sf_dir), 10, probes=12, rerank=d.count())
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id", six("sim").alias("sim"))


def ml1_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of an encoder and Spark's own Normalizer: fitted in steps from a saved codebook, saved, loaded, applied."""
    to = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    codebook(spark, sf_dir).save(spark, f"{to}/start")
    own = bagged(spark, sf_dir)
    stages = [BagEncoder(kind="vlad", nClusters=4, maxIter=STEPS, start=f"{to}/start"), Normalizer(p=1.0, inputCol="encoding", outputCol="share")]
    Pipeline(stages=stages).fit(own).write().overwrite().save(f"{to}/fitted")
    out = PipelineModel.load(f"{to}/fitted").transform(own).select("image", F.posexplode(F.arrays_zip(vector_to_array("encoding").alias("v"), vector_to_array("share").alias("s"))).alias("pos", "c"))
    return out.select("image", "pos", (F.round("c.v", 5) + F.lit(0.0)).alias("v"), (F.round("c.s", 5) + F.lit(0.0)).alias("share"))


def _pieces(spark: SparkSession, sf_dir: str, key: str) -> list[DataFrame]:
    """The events in three parts, up to an hour late; every seventh also comes again, in its part and in the next. A part is one pass over the table."""
    seen = table(spark, sf_dir, "events").withColumn("ts", F.expr("make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), extract(SECOND FROM ts), 'UTC')"))
    events = seen.select(F.col(key).alias("key"), F.col("event_id").alias("id"), F.col("value").alias("score"), "ts", (F.unix_seconds("ts") + F.crc32(F.col("event_id").cast("string")) % 3600).alias("came"))
    least, most = events.agg(F.coalesce(F.min("came"), F.lit(0)), F.coalesce(F.max("came"), F.lit(0))).first()
    part = F.floor((F.col("came") - least) * 3 / (most - least + 1))
    often = lambda i: F.when(part == i, 1).otherwise(0) + F.when((F.col("id") % 7 == 0) & part.isin(i, i - 1), 1).otherwise(0)
    return [events.select("key", "id", "score", "ts", F.explode(F.array_repeat(F.lit(0), often(i))).alias("~again")).drop("~again") for i in range(3)]


def _replay(spark: SparkSession, sf_dir: str, key: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``of`` a stream of the events, which come in pieces."""
    return running.replayed(spark, _pieces(spark, sf_dir, key), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", of)


def str1_running_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best events of each type and day, by state and timers; days that are not over yet have no result."""
    out = _replay(spark, sf_dir, "event_type", lambda s: running.running_top(s, k=3, every="1 day", late="2 hours"))
    return out.select("key", F.unix_millis("start").alias("start"), "rank", "id", "score")


def str2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of each user, which half a day without an event ends; open ones have no result."""
    out = _replay(spark, sf_dir, "user_id", lambda s: running.sessions(s, gap="12 hours", late="2 hours"))
    return out.select("key", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n", (F.round("total", 2) + F.lit(0.0)).alias("total"))


QUERIES = {f.__name__: f for f in (sql1_functions, sql2_lateral, asof1_orders, asof2_within, idx1_search, idx2_exhaustive, ml1_pipeline, str1_running_top, str2_sessions)}
ORACLE_SQL = {
    "sql1_functions": f"""WITH {UNIT} SELECT a.vec_id AS q, b.vec_id AS id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS sim, round(list_sum(list_transform(e.v, lambda x: sqrt(abs(x)))), 5) + 0.0 AS mass,
 round(list_dot_product(a.v, list_transform(e.v, lambda x: x / (sqrt(list_dot_product(e.v, e.v)) + 1e-9))), 6) + 0.0 AS near FROM u a JOIN u b ON a.label = b.label JOIN e ON e.vec_id = b.vec_id WHERE a.vec_id % {EVERY} = 0""",
    "sql2_lateral": f"""WITH {DESCRIBED} SELECT image, count(*) AS n, round(sum(x[1]), 6) + 0.0 AS first, round(sum(list_sum(list_transform(range(1, 9), lambda i: x[i] * sqrt(abs(x[i]) / (list_sum(list_transform(x, lambda c: abs(c))) + 1e-7))))), 5) + 0.0 AS rooted FROM d WHERE descr < 7 GROUP BY image""",
    "asof1_orders": f"""WITH o AS (SELECT o_custkey % {USERS} AS user_id, o_orderdate + INTERVAL 27 YEARS AS ordered, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL)
SELECT event_id, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(round(price, 6), 0) + 0.0 AS price FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.ordered""",
    "asof2_within": """WITH v AS (SELECT user_id, ts AS seen, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL), m AS (SELECT event_id, ts, seen, view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.seen)
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(seen) <= 3600000000 THEN view_id ELSE -1 END AS view_id FROM m""",
    "idx2_exhaustive": f"WITH {RANKED} SELECT q, rank, id, round(sim, 6) + 0.0 AS sim FROM r WHERE rank <= 10",
    "str1_running_top": """WITH e AS (SELECT event_type AS key, epoch_ms(date_trunc('day', ts)) AS start, event_id AS id, value AS score, ts FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_id IS NOT NULL AND ts IS NOT NULL)
SELECT key, start, CAST(row_number() OVER (PARTITION BY key, start ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM e WHERE start + 86400000 <= (SELECT max(epoch_ms(ts)) FROM e) - 7200000 QUALIFY rank <= 3""",
    "str2_sessions": """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pause FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL), n AS (SELECT *, sum(CASE WHEN pause <= INTERVAL 12 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id AS key, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM n GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS""",
    "ml1_pipeline": f"WITH {DESCRIBED}{BOOK.format('c0')}, p AS (SELECT image * 8 + descr AS pid, x FROM d), {lloyd('p', 'c0', 8, STEPS)}{TO_CENTRES}{RESIDUALS} SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 5) + 0.0 AS v, round(v / sum(abs(v)) OVER (PARTITION BY image), 5) + 0.0 AS share FROM vl",
}
