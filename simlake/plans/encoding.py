"""Projection, encoding and training queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions import vectors as V
from simlake.operators import encode, images, stats, train
from simlake.operators.runtime import table
from simlake.plans.common import ASSIGNED, BOOK, DESCRIBED, D, E, FISHER, FISHER_PARTS, POSTERIOR, RESIDUALS, TO_CENTRES, VLAD, bagged, codebook, descriptors, expectation, in_long_form, lloyd, pair_projection, six, vectors


def _spread(spark: SparkSession, sf_dir: str, vector) -> DataFrame:  # noqa: ANN001
    return in_long_form(vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), vector.alias("encoding")))


def prj1_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, V.hellinger(F.transform("v", F.abs)))


def prj2_signed_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, V.signed_power(F.col("v"), 0.5))


def prj3_p_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), V.normalised(F.col("v"), 1).alias("a"), V.normalised(F.col("v"), 2).alias("b"), V.normalised(F.col("v"), 3).alias("c"))
    return own.select("image", F.concat("a", "b", "c").alias("encoding")).transform(in_long_form)


def prj4_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.bags(descriptors(spark, sf_dir)).select("image", images.flat(F.col("bag")).alias("encoding"))
    return in_long_form(rows)


def prj5_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, F.concat("v", F.transform("v", lambda x: x * x), "v"))


def prj7_feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("v", c * 8 + 1, F.lit(8))).alias("v"))
    cells = images.feature_cells(maps, 2, 4)
    return cells.select("image", "desc", F.posexplode("x").alias("pos", "v")).select("image", "desc", "pos", six("v").alias("v"))


def prj8_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode("v").alias("pos", "v"))
    columns = stats.value_standardised(rows, ["pos"]).select(F.lit(0).alias("axis"), "image", "pos", six("v").alias("v"))
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), V.standardised(F.col("v")).alias("encoding"))
    return columns.unionByName(in_long_form(own).withColumn("axis", F.lit(1)).select("axis", "image", "pos", "v"))


def prj9_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, rows = pair_projection().columns()
    own = descriptors(spark, sf_dir).select("image", "desc", F.posexplode(V.projected(F.col("x"), mean, rows)).alias("pos", "v"))
    return own.select("image", "desc", "pos", six("v").alias("v"))


def prj10_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode(V.truncated(F.transform("v", lambda x: x * 100))).alias("pos", "v"))
    return own.select("image", "pos", "v")


def prj11_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = vectors(spark, sf_dir).select(F.col("vec_id").alias("image"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, F.lit(8))).alias("v"))
    done = images.blur(pictures, None, 1.0)
    return in_long_form(done.select("image", images.flat(F.col("v")).alias("encoding")))


def line_features(text: str | None) -> np.ndarray | None:
    """A user's extractor: a descriptor for each line of a text."""
    if not text:
        return None
    return np.array([[len(s), s.count(" "), s.count("e"), s.count(".")] for s in text.split("\n")], float)


def fx3_user_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.Extractor(line_features, 4).of_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("image").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(4)))


def enc1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.assign(descriptors(spark, sf_dir), codebook(spark, sf_dir))


def enc2_vlad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_long_form(encode.Vlad(codebook(spark, sf_dir)).encode(descriptors(spark, sf_dir)))


def enc3_empty_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, book = descriptors(spark, sf_dir), codebook(spark, sf_dir)
    found = encode.Vlad(book).encode(own.where(F.col("image") % 3 != 0), own.select("image"))
    return found.select("image", (F.size("encoding")).alias("length"), (F.size(F.filter("encoding", lambda x: x != 0)) == 0).alias("zero"))


def enc4_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode.posterior_table(descriptors(spark, sf_dir), codebook(spark, sf_dir))
    return found.select("image", "desc", F.posexplode("p").alias("k", "p")).select("image", "desc", "k", six("p").alias("p"))


def enc5_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_long_form(encode.Fisher(codebook(spark, sf_dir)).encode_bags(bagged(spark, sf_dir)), 5)


def enc6_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = codebook(spark, sf_dir)
    return in_long_form(encode.Pipeline([encode.Vlad(book), encode.Fisher(book)]).encode_bags(bagged(spark, sf_dir)), 5)


def sim3_encoder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = descriptors(spark, sf_dir)
    found = encode.Vlad(codebook(spark, sf_dir)).similarity_scores(own.where("image % 50 = 0"), own, single=False)
    return found.select("q", "id", six("sim").alias("sim"))


def sim4_pipeline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, book = descriptors(spark, sf_dir), codebook(spark, sf_dir)
    found = encode.Pipeline([encode.Vlad(book), encode.Fisher(book)]).similarity_scores(own.where("image % 50 = 0"), own, single=False)
    return found.select("q", "id", F.round("sim", 5).alias("sim"))


def enc11_encoding_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode.Vlad(codebook(spark, sf_dir)).encode(descriptors(spark, sf_dir))
    found = encode.retrieve(encoded, encoded.where("image % 50 = 0"), 5)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id", six("sim").alias("sim"))


#: Steps of the training queries, which SQL repeats.
STEPS = 10


def enc7_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VLAD with a codebook learned in steps from the fixed one, then applied."""
    own = descriptors(spark, sf_dir)
    learned = train.learn(encode.Vlad, own, 4, start=codebook(spark, sf_dir), iterations=STEPS)
    return in_long_form(learned.encode(own), 5)


def enc7_learn_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norms, which no rotation changes, of descriptors behind a projection that keeps all components but is learned."""
    own = descriptors(spark, sf_dir)
    learned = train.learn(encode.Vlad, own, 4, reduction=1, iterations=2)
    mean, rows = learned.projection.columns()
    moved = own.select("image", "desc", V.projected(F.col("x"), mean, rows).alias("y"))
    return moved.select("image", "desc", six(F.aggregate("y", F.lit(0.0), lambda a, y: a + y * y)).alias("square"))


def enc8_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = train.fit_kmeans(descriptors(spark, sf_dir), 4, iterations=STEPS, start=codebook(spark, sf_dir).means).to_df(spark)
    return found.select("k", F.posexplode("mean").alias("pos", "mean")).select("k", "pos", six("mean").alias("mean"))


def enc9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of expectation maximisation from the fixed mixture, however little the last ones gain."""
    found = train.fit_mixture(descriptors(spark, sf_dir), 4, iterations=STEPS, tolerance=-1.0, start=codebook(spark, sf_dir)).to_df(spark)
    parts = found.select("k", F.round("weight", 5).alias("weight"), F.posexplode(F.arrays_zip("mean", "var")).alias("pos", "p"))
    return parts.select("k", "pos", "weight", (F.round("p.mean", 5) + F.lit(0.0)).alias("mean"), F.round("p.var", 5).alias("var"))


def enc10_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance matrix, put together again from the components and the variances along them: right only if they are its eigenvectors."""
    own = descriptors(spark, sf_dir)
    fit = train.fit_pca(own, 8)
    mean, rows = fit.columns()
    moved = own.select(F.posexplode(V.projected(F.col("x"), mean, rows)).alias("k", "y"))
    variance = {r["k"]: r["v"] for r in moved.groupBy("k").agg(F.var_pop("y").alias("v")).collect()}
    whole = fit.components.T @ np.diag([variance[k] for k in range(8)]) @ fit.components
    cells = [(i, j, float(whole[i, j]), float(fit.mean[i])) for i in range(8) for j in range(8)]
    return spark.createDataFrame(cells, "i int, j int, covariance double, mean double").select("i", "j", six("covariance").alias("covariance"), six("mean").alias("mean"))


QUERIES = {f.__name__: f for f in (prj1_hellinger, prj2_signed_power, prj3_p_norm, prj4_flatten, prj5_concat, prj7_feature_cells, prj8_standardise, prj9_project, prj10_integers, prj11_blur, fx3_user_extractor, enc1_assign, enc2_vlad, enc3_empty_images, enc4_posteriors, enc5_fisher, enc6_pipeline, sim3_encoder_scores, sim4_pipeline_scores, enc11_encoding_map, enc7_learn, enc7_learn_reduced, enc8_kmeans, enc9_mixture, enc10_pca)}
_POS = "CAST(i - 1 AS INTEGER) AS pos"
_L = "WITH " + E + ", x AS (SELECT vec_id AS image, {}, {} AS v FROM e, range(1, {}) t(i)) SELECT image, pos, round(v, 6) + 0.0 AS v FROM x"
_PN = "list_sum(list_transform(v, lambda y: abs(y) ** {0})) ** (1.0 / {0}) + 1e-9"
_PIPE = VLAD + POSTERIOR + FISHER_PARTS + ", pipe AS (SELECT image, pos, v FROM vl UNION ALL SELECT image, pos + 32, v FROM fv)"
_COS = ", nn AS (SELECT image, sqrt(sum(v * v)) AS norm FROM {0} GROUP BY image), sc AS (SELECT a.image AS q, b.image AS id, sum(a.v * b.v) AS dp FROM {0} a JOIN {0} b ON a.pos = b.pos WHERE a.image % 50 = 0 GROUP BY ALL), co AS (SELECT q, id, CASE WHEN x.norm * y.norm > 0 THEN dp / (x.norm * y.norm) ELSE 0 END AS sim FROM sc JOIN nn x ON x.image = q JOIN nn y ON y.image = id)"
_POINTS = "p AS (SELECT image * 8 + descr AS pid, x FROM d)"
ORACLE_SQL = {
    "prj1_hellinger": _L.format(_POS, "sqrt(abs(v[i]) / (list_sum(list_transform(v, lambda y: abs(y))) + 1e-7))", 65),
    "prj2_signed_power": _L.format(_POS, "sign(v[i]) * sqrt(abs(v[i]))", 65),
    "prj3_p_norm": _L.format(_POS, f"CASE WHEN i <= 64 THEN v[i] / ({_PN.format(1)}) WHEN i <= 128 THEN v[i - 64] / ({_PN.format(2)}) ELSE v[i - 128] / ({_PN.format(3)}) END", 193),
    "prj4_flatten": _L.format(_POS, "v[i]", 65),
    "prj5_concat": _L.format(_POS, "list_concat(list_concat(v, list_transform(v, lambda y: y * y)), v)[i]", 193),
    "prj7_feature_cells": f"""WITH {E}, x AS (SELECT vec_id AS image, CAST(p AS INTEGER) AS "desc", CAST(i AS INTEGER) AS pos, CASE WHEN i < 8 THEN v[i * 8 + p + 1] WHEN i = 8 THEN (p % 4) / 4.0 ELSE (p // 4) / 2.0 END AS v FROM e, range(8) a(p), range(10) b(i)) SELECT image, "desc", pos, round(v, 6) + 0.0 AS v FROM x""",
    "prj8_standardise": f"WITH {E}, x AS (SELECT vec_id AS image, {_POS}, v[i] AS v FROM e, range(1, 65) t(i)) SELECT 0 AS axis, image, pos, round((v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos), 6) + 0.0 AS v FROM x UNION ALL SELECT 1, image, pos, round((v - avg(v) OVER (PARTITION BY image)) / stddev_pop(v) OVER (PARTITION BY image), 6) + 0.0 FROM x",
    "prj9_project": f'WITH {D} SELECT image, descr AS "desc", {_POS}, round((x[2 * i - 1] - 0.01) * sqrt(0.5) + (x[2 * i] - 0.01) * sqrt(0.5), 6) + 0.0 AS v FROM d, range(1, 5) t(i)',
    "prj10_integers": f"WITH {E} SELECT vec_id AS image, {_POS}, CAST(trunc(v[i] * 100) AS INTEGER) AS v FROM e, range(1, 65) t(i)",
    "prj11_blur": f"""WITH {E}, w AS (SELECT o, exp(-o * o / 2.0) / sum(exp(-o * o / 2.0)) OVER () AS w FROM range(-3, 4) t(o)),
 px AS (SELECT vec_id, v, r, c FROM e, range(8) a(r), range(8) b(c)),
 x AS (SELECT vec_id AS image, r * 8 + c AS pos, sum(y.w * z.w * v[(7 - abs(7 - abs(r + y.o))) * 8 + (7 - abs(7 - abs(c + z.o))) + 1]) AS v FROM px, w y, w z GROUP BY ALL)
 SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS v FROM x""",
    "fx3_user_extractor": "WITH l AS (SELECT doc_id AS image, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text <> '') SELECT image, count(*) AS n, CAST(sum(length(s)) AS DOUBLE) AS x0, CAST(sum(length(s) - length(replace(s, ' ', ''))) AS DOUBLE) AS x1, CAST(sum(length(s) - length(replace(s, 'e', ''))) AS DOUBLE) AS x2, CAST(sum(length(s) - length(replace(s, '.', ''))) AS DOUBLE) AS x3 FROM l GROUP BY image",
    "enc1_assign": f'WITH {ASSIGNED} SELECT image, descr AS "desc", CAST(k AS INTEGER) AS k FROM a',
    "enc2_vlad": f"WITH {VLAD} SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 6) + 0.0 AS v FROM vl",
    "enc3_empty_images": f"WITH {VLAD} SELECT image, 32 AS length, image % 3 = 0 OR bool_and(v = 0) AS zero FROM vl GROUP BY image",
    "enc4_posteriors": f'WITH {D}{POSTERIOR} SELECT image, descr AS "desc", CAST(k AS INTEGER) AS k, round(p, 6) + 0.0 AS p FROM p',
    "enc5_fisher": f"WITH {FISHER} SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 5) + 0.0 AS v FROM fv",
    "enc6_pipeline": f"WITH {_PIPE} SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 5) + 0.0 AS v FROM pipe",
    "sim3_encoder_scores": f"WITH {VLAD}{_COS.format('vl')} SELECT q, id, round(sim, 6) + 0.0 AS sim FROM co",
    "sim4_pipeline_scores": f"WITH {_PIPE}{_COS.format('pipe')} SELECT q, id, round(sim, 5) AS sim FROM co",
    "enc11_encoding_map": f"WITH {VLAD}{_COS.format('vl')}, rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) AS rank FROM co) SELECT q, rank, id, round(sim, 6) + 0.0 AS sim FROM rk WHERE rank <= 5",
    "enc7_learn": f"WITH {DESCRIBED}{BOOK.format('c0')}, {_POINTS}, {lloyd('p', 'c0', 8, STEPS)}{TO_CENTRES}{RESIDUALS} SELECT image, CAST(pos AS INTEGER) AS pos, round(v, 5) + 0.0 AS v FROM vl",
    "enc7_learn_reduced": f"""WITH {DESCRIBED}, m AS (SELECT i, avg(x[i]) AS m FROM d, range(1, 9) t(i) GROUP BY i) SELECT image, descr AS "desc", round(sum((x[i] - m) * (x[i] - m)), 6) + 0.0 AS square FROM d, m GROUP BY image, descr""",
    "enc8_kmeans": f"WITH {DESCRIBED}{BOOK.format('c0')}, {_POINTS}, {lloyd('p', 'c0', 8, STEPS)} SELECT CAST(k AS INTEGER) AS k, CAST(i - 1 AS INTEGER) AS pos, round(m[i], 6) + 0.0 AS mean FROM c, range(1, 9) t(i)",
    "enc9_mixture": f"WITH {DESCRIBED}{BOOK.format('b')}, {_POINTS}, c0 AS (SELECT k, 0.25 AS w, m, list_transform(m, lambda y: 0.02) AS s FROM b), {expectation('p', 'c0', 8, STEPS)} SELECT CAST(k AS INTEGER) AS k, CAST(i - 1 AS INTEGER) AS pos, round(w, 5) AS weight, round(m[i], 5) + 0.0 AS mean, round(s[i], 5) AS var FROM mix, range(1, 9) t(i)",
    "enc10_pca": f"WITH {DESCRIBED} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(covar_pop(x[i], x[j]), 6) + 0.0 AS covariance, round(avg(x[i]), 6) + 0.0 AS mean FROM d, range(1, 9) a(i), range(1, 9) b(j) GROUP BY i, j",
}
