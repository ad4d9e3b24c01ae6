"""Stand-ins built from the test tables, and the same as SQL.

Queries are the vectors whose id 50 divides, the database holds all. A vector of 64 components is a bag of eight descriptors
of eight components; the codebook is the first descriptor of vectors 0 to 3, with equal weights and variances of 0.02.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions.vectors import doubles
from simlake.operators.codebook import Codebook, Projection
from simlake.operators.runtime import table

EVERY, DESCRIPTORS, WIDTH, CENTRES, VARIANCE = 50, 8, 8, 4, 0.02


def six(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), "label", "v")


def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "v")


def bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, bag): each vector's descriptors whole, as an extractor gives them."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(DESCRIPTORS - 1)), lambda j: F.slice("v", j * WIDTH + 1, F.lit(WIDTH)))
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), parts.alias("bag"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.sequence(F.lit(0), F.lit(DESCRIPTORS - 1)), lambda j: F.struct(j.alias("desc"), F.slice("v", j * WIDTH + 1, F.lit(WIDTH)).alias("x")))
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.inline(parts))


def codebook(spark: SparkSession, sf_dir: str) -> Codebook:
    rows = descriptors(spark, sf_dir).where((F.col("image") < CENTRES) & (F.col("desc") == 0)).orderBy("image").collect()
    means = np.array([r["x"] for r in rows])
    return Codebook(means, np.full(CENTRES, 1 / CENTRES), np.full(means.shape, VARIANCE))


def pair_projection() -> Projection:
    """8 to 4 components: (x[2i] + x[2i+1]) / sqrt(2), around a mean of 0.01."""
    c = np.zeros((4, 8))
    for i in range(4):
        c[i, 2 * i : 2 * i + 2] = 0.5**0.5
    return Projection(np.full(8, 0.01), c)


def in_long_form(encodings: DataFrame, digits: int = 6) -> DataFrame:
    """(image, pos, v) of encodings."""
    return encodings.select("image", F.posexplode("encoding").alias("pos", "v")).select("image", "pos", (F.round("v", digits) + F.lit(0.0)).alias("v"))


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
UNIT = E + ", n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / norm) AS v FROM n)"
PAIRS = UNIT + f", s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS q_label, b.label AS d_label, list_dot_product(a.v, b.v) AS sim FROM u a, u b WHERE a.vec_id % {EVERY} = 0)"
RANKED = PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS rank, CAST(q_label = d_label AS INTEGER) AS rel FROM s)"
DESCRIBED = E + ", d AS (SELECT vec_id AS image, CAST(j AS INTEGER) AS descr, v[j * 8 + 1 : j * 8 + 8] AS x FROM e, range(8) t(j))"
BOOK = ", {} AS (SELECT vec_id AS k, v[1:8] AS m FROM e WHERE vec_id < 4)"
D = DESCRIBED + BOOK.format("c")
TO_CENTRES = ", dk AS (SELECT image, descr, k, x, m, list_sum(list_transform(range(1, 9), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d2 FROM d, c), a AS (SELECT * FROM dk QUALIFY row_number() OVER (PARTITION BY image, descr ORDER BY round(d2, 9), k) = 1)"
ASSIGNED = D + TO_CENTRES
RESIDUALS = """, g AS (SELECT vec_id AS image, k, i FROM e, c, range(1, 9) t(i)),
 res AS (SELECT image, k, i, sum(x[i] - m[i]) AS s FROM a, range(1, 9) t(i) GROUP BY ALL),
 full_ AS (SELECT g.image, g.k, g.i, coalesce(s, 0) AS s FROM g LEFT JOIN res ON g.image = res.image AND g.k = res.k AND g.i = res.i),
 vl AS (SELECT image, k * 8 + i - 1 AS pos, s / (sqrt(sum(s * s) OVER (PARTITION BY image, k)) + 1e-9) AS v FROM full_)"""
VLAD = ASSIGNED + RESIDUALS
POSTERIOR = ", ld AS (SELECT image, descr, k, x, m, ln(0.25) - 0.5 * 8 * ln(2 * pi() * 0.02) - 0.5 * d2 / 0.02 AS l FROM (SELECT image, descr, k, x, m, list_sum(list_transform(range(1, 9), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d2 FROM d, c)), lm AS (SELECT *, exp(l - max(l) OVER (PARTITION BY image, descr)) AS w FROM ld), p AS (SELECT image, descr, k, x, m, w / sum(w) OVER (PARTITION BY image, descr) AS p FROM lm)"
FISHER_PARTS = """, s0 AS (SELECT image, k, any_value(m) AS m, avg(p) AS s0 FROM p GROUP BY ALL),
 s12 AS (SELECT image, k, i, avg(p * x[i]) AS s1, avg(p * x[i] * x[i]) AS s2 FROM p, range(1, 9) t(i) GROUP BY image, k, i),
 parts AS (
  SELECT image, k AS pos, (s0 - 0.25) / sqrt(0.25) AS f FROM s0
  UNION ALL SELECT s12.image, 4 + s12.k * 8 + i - 1, (s1 - s0 * m[i]) / (sqrt(0.25) * sqrt(0.02)) FROM s12 JOIN s0 ON s12.image = s0.image AND s12.k = s0.k
  UNION ALL SELECT s12.image, 36 + s12.k * 8 + i - 1, (-s2 - s0 * m[i] * m[i] + s0 * 0.02 + 2 * s1 * m[i]) / (sqrt(2) * sqrt(0.25) * 0.02) FROM s12 JOIN s0 ON s12.image = s0.image AND s12.k = s0.k),
 pw AS (SELECT image, pos, sign(f) * sqrt(abs(f)) AS f FROM parts),
 fv AS (SELECT image, pos, f / (sqrt(sum(f * f) OVER (PARTITION BY image)) + 1e-9) AS v FROM pw)"""
FISHER = D + POSTERIOR + FISHER_PARTS


def lloyd(points: str, start: str, dim: int, steps: int, name: str = "c") -> str:
    """CTEs of k-means steps over ``points(pid, x)`` from ``start(k, m)``; the last centres are ``name(k, m)``."""
    out, before = [], start
    for i in range(1, steps + 1):
        now = name if i == steps else f"{name}_{i}"
        d2 = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i])))"
        out.append(f"{name}_at_{i} AS MATERIALIZED (SELECT pid, x, k FROM {points}, {before} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round({d2}, 9), k) = 1)")
        out.append(f"{now} AS MATERIALIZED (SELECT b.k, coalesce(n.m, b.m) AS m FROM {before} b LEFT JOIN (SELECT k, list(y ORDER BY i) AS m FROM (SELECT k, i, avg(x[i]) AS y FROM {name}_at_{i}, range(1, {dim + 1}) t(i) GROUP BY k, i) GROUP BY k) n ON n.k = b.k)")
        before = now
    return ", ".join(out)


def expectation(points: str, start: str, dim: int, steps: int, name: str = "mix") -> str:
    """CTEs of steps of expectation maximisation over ``points(pid, x)`` from ``start(k, w, m, s)``, weight, mean and variances; the last mixture is ``name``."""
    out, before, over = [], start, f"range(1, {dim + 1})"
    for j in range(1, steps + 1):
        now = name if j == steps else f"{name}_{j}"
        out.append(f"{name}_l_{j} AS (SELECT pid, x, k, ln(w) - 0.5 * list_sum(list_transform({over}, lambda i: ln(2 * pi() * s[i]) + (x[i] - m[i]) * (x[i] - m[i]) / s[i])) AS l FROM {points}, {before})")
        out.append(f"{name}_e_{j} AS (SELECT pid, x, k, exp(l - max(l) OVER (PARTITION BY pid)) AS r FROM {name}_l_{j})")
        out.append(f"{name}_r_{j} AS MATERIALIZED (SELECT pid, x, k, r / sum(r) OVER (PARTITION BY pid) AS r FROM {name}_e_{j})")
        out.append(f"{name}_m_{j} AS (SELECT k, i, sum(r) AS mass, sum(r * x[i]) / sum(r) AS mean, sum(r * x[i] * x[i]) / sum(r) AS square FROM {name}_r_{j}, {over} t(i) GROUP BY k, i)")
        out.append(f"{now} AS MATERIALIZED (SELECT k, any_value(mass) / (SELECT sum(mass) FROM {name}_m_{j} WHERE i = 1) AS w, list(mean ORDER BY i) AS m, list(greatest(square - mean * mean, 0) + 1e-6 ORDER BY i) AS s FROM {name}_m_{j} GROUP BY k)")
        before = now
    return ", ".join(out)
