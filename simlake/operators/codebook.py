"""Codebooks and projections: small models that go to the workers with the function, and their tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codebook:
    """K centres of D components; a mixture also has weights (K) and diagonal variances (K, D)."""

    means: np.ndarray
    weights: np.ndarray | None = None
    variances: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.means.ndim != 2:
            raise ValueError("centres must form a matrix")
        if (self.weights is None) != (self.variances is None):
            raise ValueError("a mixture needs weights and variances")
        if self.variances is not None and self.variances.shape != self.means.shape:
            raise ValueError("only diagonal covariances, one variance a component, are supported")

    @property
    def k(self) -> int:
        return self.means.shape[0]

    @property
    def dim(self) -> int:
        return self.means.shape[1]

    @property
    def is_mixture(self) -> bool:
        return self.weights is not None

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, None if self.weights is None else float(self.weights[i]), self.means[i].tolist(), None if self.variances is None else self.variances[i].tolist()) for i in range(self.k)]
        return spark.createDataFrame(rows, "k int, weight double, mean array<double>, var array<double>")

    @staticmethod
    def from_df(df: DataFrame) -> Codebook:
        rows = df.orderBy("k").collect()
        mixture = rows[0]["weight"] is not None
        return Codebook(np.array([r["mean"] for r in rows], float), np.array([r["weight"] for r in rows], float) if mixture else None, np.array([r["var"] for r in rows], float) if mixture else None)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codebook:
        return Codebook.from_df(spark.read.parquet(path))


@dataclass(frozen=True)
class Projection:
    """(x - mean) times the rows of ``components``."""

    mean: np.ndarray
    components: np.ndarray

    @property
    def dim_in(self) -> int:
        return self.components.shape[1]

    @property
    def dim_out(self) -> int:
        return self.components.shape[0]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.mean.tolist(), self.components.tolist())], "mean array<double>, components array<array<double>>")

    @staticmethod
    def from_df(df: DataFrame) -> Projection:
        r = df.first()
        return Projection(np.array(r["mean"], float), np.array(r["components"], float))

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Projection:
        return Projection.from_df(spark.read.parquet(path))

    def columns(self) -> tuple:
        """Mean and components as literal columns, for expressions."""
        return F.array(*map(F.lit, self.mean.tolist())), F.array(*(F.array(*map(F.lit, r)) for r in self.components.tolist()))


class Catalogue:
    """Named codebooks with the projection each was trained behind: a table of name, codebook path, projection path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def register(self, name: str, codebook: str, projection: str | None = None) -> None:
        self.spark.createDataFrame([(name, codebook, projection)], "name string, codebook string, projection string").write.mode("append").parquet(self.path)

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.spark.read.parquet(self.path).select("name").distinct().collect())

    def load(self, name: str) -> tuple[Codebook, Projection | None]:
        row = self.spark.read.parquet(self.path).where(F.col("name") == name).first()
        if row is None:
            raise KeyError(f"no codebook named {name!r}")
        return Codebook.load(self.spark, row["codebook"]), Projection.load(self.spark, row["projection"]) if row["projection"] else None
