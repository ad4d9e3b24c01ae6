from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from simlake.operators import encode
from simlake.operators.stages import BagEncoder, BagEncoderModel
from simlake.plans.common import bagged, codebook


def arrays(df, name="encoding"):
    return {r["image"]: np.array(r["v"]) for r in df.select("image", vector_to_array(name).alias("v")).collect()}


@pytest.mark.parametrize(("kind", "reduction"), [("vlad", 0), ("fisher", 2)])
def test_a_saved_stage_encodes_as_the_learned_encoder(spark, sf, tmp_path, kind, reduction):
    own = bagged(spark, sf).limit(60).cache()
    estimator = BagEncoder(kind=kind, nClusters=3, reduction=reduction, order=1.0)
    estimator.write().overwrite().save(f"{tmp_path}/estimator")
    estimator = BagEncoder.load(f"{tmp_path}/estimator")
    assert estimator.getOrDefault("nClusters") == 3 and estimator.getOrDefault("kind") == kind
    model = Pipeline(stages=[estimator]).fit(own)
    model.write().overwrite().save(f"{tmp_path}/fitted")
    loaded = PipelineModel.load(f"{tmp_path}/fitted")
    stage = loaded.stages[0]
    assert isinstance(stage, BagEncoderModel) and stage.uid == model.stages[0].uid and (stage.projection is not None) == bool(reduction)
    got, before = arrays(loaded.transform(own)), arrays(model.transform(own))
    want = {r["image"]: np.array(r["encoding"]) for r in stage.encoder.encode_bags(own).collect()}
    assert len(got) == 60 and all(np.allclose(got[i], want[i], atol=1e-12) and np.allclose(got[i], before[i], atol=1e-12) for i in want)
    assert len(next(iter(got.values()))) == stage.encoder.length


def test_other_columns_pass_and_empty_bags_are_zero(spark, sf):
    book = codebook(spark, sf)
    model = BagEncoderModel(book)
    rows = [(1, None, "a"), (2, [], "b"), (3, [book.means[0].tolist()], "c")]
    df = spark.createDataFrame(rows, "image long, bag array<array<double>>, source string")
    out = model.transform(df.withColumn("encoding", F.lit("old")))
    got = arrays(out)
    assert out.columns == ["image", "bag", "source", "encoding"] and not got[1].any() and not got[2].any()
    assert np.allclose(got[3], encode.Vlad(book).of_bag(book.means[:1]))
    assert model.transform(df.where("image > 9")).collect() == []


def test_refusals(spark):
    df = spark.createDataFrame([(1, [1.0])], "image long, bag array<double>")
    with pytest.raises(ValueError, match="bags"):
        BagEncoderModel().transform(df)
    with pytest.raises(ValueError, match="bags"):
        BagEncoder(nClusters=1).fit(df)
    with pytest.raises(ValueError, match="unknown kind"):
        BagEncoder(kind="other").fit(df)
