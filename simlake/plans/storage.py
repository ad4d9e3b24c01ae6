"""Queries through the sinks and sources: what is written to the shared folder is read back and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions import vectors as V
from simlake.operators import images, stats
from simlake.operators.codebook import Catalogue, Codebook
from simlake.operators.runtime import shared_folder, table
from simlake.plans.common import E, codebook, pair_projection, six, vectors
from simlake.sources import datasets, records


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/storage-{uuid.uuid4().hex}"


def snk1_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of every region, as one JSON document and back."""
    place = _place(spark)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).collect()
    records.save_json(spark, {r["r_name"]: {"nations": r["names"]} for r in rows}, place)
    read = records.load_json(spark, place)
    return spark.createDataFrame([(k, len(v["nations"]), v["nations"][0]) for k, v in read.items()], "region string, n long, first string")


def snk2_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, as one nested record and back."""
    place = _place(spark)
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")).collect()
    records.save_record(spark, {"by_status": {r["o_orderstatus"]: {"n": r["n"], "mean": r["mean"], "tags": [r["o_orderstatus"], "x"]} for r in rows}}, place)
    read = records.load_record(spark, place)["by_status"]
    return spark.createDataFrame([(k, v["n"], v["mean"], ",".join(v["tags"])) for k, v in read.items()], "status string, n long, mean double, tags string")


def snk3_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture and a projection, saved, named in a catalogue and loaded by name."""
    place = _place(spark)
    codebook(spark, sf_dir).save(spark, f"{place}/book")
    pair_projection().save(spark, f"{place}/projection")
    names = Catalogue(spark, f"{place}/names")
    names.register("mixture", f"{place}/book", f"{place}/projection")
    book, projection = names.load("mixture")
    found = Codebook(book.means @ projection.components.T, book.weights, book.variances[:, :4]).to_df(spark)
    return found.select("k", "weight", F.posexplode(F.arrays_zip("mean", "var")).alias("pos", "p")).select("k", "pos", "weight", six("p.mean").alias("mean"), six("p.var").alias("var"))


def src3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, copied to a folder; the paths of those with the suffix, in order of their names."""
    place, jvm = _place(spark), spark._jvm
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    made = [f"{place}/from/{n.replace(' ', '_')}.{'JPG' if i % 2 else 'jpg'}" for i, n in enumerate(names)] + [f"{place}/from/notes.txt"]
    for f in made:
        at = jvm.org.apache.hadoop.fs.Path(f)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(1)  # Spark lists no empty files
        out.close()
    records.transfer(spark, made, f"{place}/to")
    found = datasets.image_paths(spark, f"{place}/to")
    return found.select(F.col("image_id").cast("long").alias("image_id"), F.lower(F.regexp_extract("path", "([^/]+)$", 1)).alias("name"))


def prd1_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pictures of one row: whether their bytes are as many as their size says."""
    data = F.col("text").cast("binary")
    size = F.octet_length(data)
    image = F.struct(F.lit(1).alias("height"), F.floor(size / 3).cast("int").alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return table(spark, sf_dir, "documents").select("doc_id", V.is_image(image).alias("good"))


def prd2_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels of four by five values, and whether they lie in 0 to 1; a matrix of whole numbers is a mask."""
    cut = lambda at, n: F.transform(F.slice("v", at, n), lambda x: F.abs(x) * 3)
    channels = F.array(*(F.array(*(cut(20 * c + 5 * r + 1, 5) for r in range(4))) for c in range(3)))
    mask = F.array(*(F.transform(F.slice("v", 4 * r + 1, 4), lambda x: F.round(x * 3)) for r in range(4)))
    return vectors(spark, sf_dir).select("vec_id", V.is_channels_first(channels).alias("channels"), V.is_mask(mask).alias("mask"), six(V.total(F.flatten(F.flatten(V.channels_last(channels))))).alias("total"))


def prd4_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", six(V.total(V.checked_width(F.col("v"), 64))).alias("total"))


def snk9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.when(F.col("p_partkey") % 50 == 0, F.col("p_retailprice") * 9).otherwise(F.col("p_retailprice")).alias("y"))
    return stats.outliers(own, 10, 0.0, 60.0).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("y"))


def fx0_whole_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as pictures, checked, and a bag of row means of each."""
    raw = F.substring("html", 1, 1 << 30).cast("binary")
    rows = F.floor(F.octet_length(raw) / 30).cast("int")
    image = F.struct(F.col("url").alias("origin"), rows.alias("height"), F.lit(10).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.substring(raw, 1, rows * 30).alias("data"))
    own = images.checked_images(table(spark, sf_dir, "pages").where(F.octet_length(raw) >= 30).select("page_id", image.alias("image")))
    found = images.Extractor(lambda a: a.reshape(len(a), -1).sum(1, keepdims=True).astype(float), 1).bags(own, "page_id")
    return found.select(F.col("image").alias("page_id"), F.size("bag").alias("n"), F.aggregate("bag", F.lit(0.0), lambda s, x: s + x[0]).alias("total"))


QUERIES = {f.__name__: f for f in (snk1_json, snk2_record, snk3_codebook, src3_paths, prd1_images, prd2_channels, prd4_widths, snk9_outliers, fx0_whole_bags)}
_CH = "list_transform(v[1:60], lambda x: abs(x) * 3)"
ORACLE_SQL = {
    "snk1_json": "SELECT r_name AS region, count(*) AS n, min(n_name) AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "snk2_record": "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean, o_orderstatus || ',x' AS tags FROM orders GROUP BY o_orderstatus",
    "snk3_codebook": f"WITH {E} SELECT CAST(vec_id AS INTEGER) AS k, CAST(i AS INTEGER) AS pos, 0.25::DOUBLE AS weight, round((v[2 * i + 1] + v[2 * i + 2]) * sqrt(0.5), 6) + 0.0 AS mean, 0.02::DOUBLE AS var FROM e, range(4) t(i) WHERE vec_id < 4",
    "src3_paths": "SELECT row_number() OVER (ORDER BY f) AS image_id, lower(f) AS name FROM (SELECT replace(n_name, ' ', '_') || CASE WHEN n % 2 = 1 THEN '.JPG' ELSE '.jpg' END AS f FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation))",
    "prd1_images": "SELECT doc_id, coalesce(octet_length(encode(text)) > 0 AND octet_length(encode(text)) % 3 = 0, false) AS good FROM documents",
    "prd2_channels": f"WITH {E} SELECT vec_id, list_max({_CH}) <= 1.00001 AS channels, true AS mask, round(list_sum({_CH}), 6) + 0.0 AS total FROM e",
    "prd4_widths": f"WITH {E} SELECT vec_id, round(list_sum(v), 6) + 0.0 AS total FROM e",
    "snk9_outliers": """WITH b AS (SELECT CAST(floor(p_size / 6) AS INTEGER) AS bin, CASE WHEN p_partkey % 50 = 0 THEN p_retailprice * 9 ELSE p_retailprice END AS y FROM part WHERE p_size < 60), q AS (SELECT bin, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM b GROUP BY bin)
SELECT bin, count(*) AS n, round(sum(y), 2) AS y FROM b JOIN q USING (bin) WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) GROUP BY bin""",
    "fx0_whole_bags": "WITH p AS (SELECT page_id, encode(html) AS raw FROM pages WHERE octet_length(encode(html)) >= 30), h AS (SELECT page_id, hex(raw) AS h, octet_length(raw) // 30 AS n FROM p) SELECT page_id, CAST(n AS INTEGER) AS n, CAST(list_sum(list_transform(regexp_extract_all(h[1 : n * 60], '..'), lambda x: ('0x' || x)::INTEGER)) AS DOUBLE) AS total FROM h",
}
