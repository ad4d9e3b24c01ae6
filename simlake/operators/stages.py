"""Encoders as stages of ``pyspark.ml`` pipelines: an estimator learns the model from a column of bags, its model encodes such a column.

Both are saved and loaded as any stage, alone or inside a ``Pipeline``: parameters as metadata, the codebook and the projection
as Parquet. The encoding is an ML vector, so that built-in stages can follow; all other columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasMaxIter, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from simlake.operators.codebook import Codebook, Projection
from simlake.operators.encode import Encoder, Fisher, Vlad, encoded
from simlake.operators.runtime import ship
from simlake.operators.train import learn

KINDS: dict[str, type[Encoder]] = {"vlad": Vlad, "fisher": Fisher}
BAG = ArrayType(ArrayType(DoubleType()))


class _BagParams(HasInputCol, HasOutputCol, HasSeed, HasMaxIter):
    kind = Param(Params._dummy(), "kind", "'vlad' or 'fisher'", TypeConverters.toString)
    nClusters = Param(Params._dummy(), "nClusters", "centres of the codebook, at least 1", TypeConverters.toInt)
    reduction = Param(Params._dummy(), "reduction", "components of a descriptor for each one kept by a learned projection; 0 for none", TypeConverters.toInt)
    power = Param(Params._dummy(), "power", "exponent of the signed power", TypeConverters.toFloat)
    order = Param(Params._dummy(), "order", "order of the norm", TypeConverters.toFloat)
    start = Param(Params._dummy(), "start", "path of a saved codebook that training begins with; empty for none", TypeConverters.toString)

    def __init__(self, **given: object) -> None:
        super().__init__()
        self._setDefault(inputCol="bag", outputCol="encoding", kind="vlad", nClusters=256, reduction=0, order=2.0, start="", seed=42)
        self._set(**given)

    def _bags(self, df: DataFrame) -> F.Column:
        name = self.getOrDefault("inputCol")
        if not isinstance(kind := df.schema[name].dataType, ArrayType) or not isinstance(kind.elementType, ArrayType):
            raise ValueError(f"{name} must hold bags, arrays of arrays of numbers")
        return F.col(name).cast(BAG)


class BagEncoder(Estimator, _BagParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a codebook, and a projection in front of it where ``reduction`` is given, from a column of bags; null and empty bags teach nothing."""

    def _fit(self, dataset: DataFrame) -> BagEncoderModel:
        kind = self.getOrDefault("kind")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        path = self.getOrDefault("start")
        learned = learn(
            KINDS[kind],
            dataset.select(F.explode(self._bags(dataset)).alias("x")),
            self.getOrDefault("nClusters"),
            self.getOrDefault("reduction") or None,
            self.getOrDefault("seed"),
            Codebook.load(dataset.sparkSession, path) if path else None,
            self.getOrDefault("maxIter") if self.isSet("maxIter") else None,
        )
        return self._copyValues(BagEncoderModel(learned.codebook, learned.projection))


class BagEncoderModel(Model, _BagParams, MLReadable, MLWritable):
    """Adds the encoding of each bag, a zero vector where a bag is null or empty. No shuffle, and only the bags go to Python."""

    def __init__(self, codebook: Codebook | None = None, projection: Projection | None = None) -> None:
        super().__init__()
        self.codebook, self.projection = codebook, projection

    @property
    def encoder(self) -> Encoder:
        settings = {"power": self.getOrDefault("power")} if self.isSet("power") else {}
        return KINDS[self.getOrDefault("kind")](self.codebook, projection=self.projection, order=self.getOrDefault("order"), **settings)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        encoder = self.encoder

        def of_bags(bags: pa.Array) -> pa.Array:
            return encoded(bags, encoder.of_descriptors, encoder.width)

        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.arrow_udf(of_bags, "array<double>")(self._bags(dataset))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: BagEncoderModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"projected": self.model.projection is not None})
        self.model.codebook.save(self.sparkSession, f"{path}/codebook")
        if self.model.projection is not None:
            self.model.projection.save(self.sparkSession, f"{path}/projection")


class _Reader(MLReader):
    def load(self, path: str) -> BagEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        projection = Projection.load(self.sparkSession, f"{path}/projection") if metadata["projected"] else None
        model = BagEncoderModel(Codebook.load(self.sparkSession, f"{path}/codebook"), projection)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
