"""Encodings of descriptor bags: VLAD, Fisher vectors, and pipelines of encoders.

Descriptors come in long form (image, desc, x). One shuffle by image gathers each image's bag, which is bounded by the image;
an Arrow pass then encodes bags with matrix products against the codebook. Bags that an extractor already gives whole need
no shuffle. An image without descriptors gets a zero vector, and its neighbours are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.functions.vectors import SIMILARITIES, doubles
from simlake.operators.codebook import Codebook, Projection
from simlake.operators.runtime import ship
from simlake.operators.scoring import checked, ranked, scores


def bags(descriptors: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image, bag array<array<double>>): an image's descriptors in order. ``images(image)`` adds those without any."""
    own = descriptors.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("desc", doubles("x").alias("x")))).alias("d")).select("image", F.col("d.x").alias("bag"))
    if images is not None:
        own = images.select("image").distinct().join(own, "image", "left").withColumn("bag", F.coalesce("bag", F.array().cast("array<array<double>>")))
    return own


def encoded(column: pa.Array, fn: Callable[[np.ndarray], np.ndarray], width: int) -> pa.Array:
    """``fn`` of every bag of an Arrow column, as an (n, width) matrix; a null bag has no rows."""
    out = []
    for bag in column:
        flat = bag.values
        n = 0 if flat is None else len(flat)
        x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, width))
        if n and x.shape[1] != width:
            raise ValueError(f"descriptors have {x.shape[1]} components, the model expects {width}")
        out.append(fn(x))
    return pa.array(out, pa.list_(pa.float64()))


def per_bag(bagged: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(image, encoding) with ``fn`` applied to every bag as an (n, width) matrix."""
    ship(bagged.sparkSession)
    bagged = bagged.select("image", "bag")
    schema = f"image {bagged.schema['image'].dataType.simpleString()}, encoding array<double>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoded(batch.column(1), fn, width)], names=["image", "encoding"])

    return bagged.mapInArrow(each, schema)


#: Numbers of the largest array that a product of descriptors and a model makes at once.
SLICE = 1 << 20


def slices(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``x`` by rows, so many that rows times ``width`` stay within SLICE."""
    step = max(1, SLICE // max(1, width))
    return (x[a : a + step] for a in range(0, len(x), step))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By differences, in slices of bounded memory: exact for equal vectors."""
    parts = [((part[:, None, :] - c[None]) ** 2).sum(-1) for part in slices(x, c.size)]
    return np.concatenate(parts) if parts else np.zeros((0, len(c)))


def nearest(x: np.ndarray, codebook: Codebook, decimals: int = 9) -> np.ndarray:
    """The nearest centre; ties, at ``decimals`` of the squared distance, go to the lowest.

    Distances come from a product around the centres' mean; rows whose two nearest centres are closer than its rounding can
    tell are decided by differences.
    """
    c, out = codebook.means, []
    shift = c.mean(0)
    c0 = c - shift
    own = (c0**2).sum(1)
    for part in slices(x, len(c) + codebook.dim):
        y = part - shift
        size = (y**2).sum(1)
        d2 = own - 2 * y @ c0.T
        at, least = d2.argmin(1), d2.min(1)
        close = 2 * 10.0**-decimals + 1e-14 * codebook.dim * (size + own.max())
        doubtful = (d2 <= (least + close)[:, None]).sum(1) > 1
        if doubtful.any():
            at[doubtful] = np.round(squared_distances(part[doubtful], c), decimals).argmin(1)
        out.append(at)
    return np.concatenate(out) if out else np.zeros(0, int)


def log_joint(x: np.ndarray, codebook: Codebook) -> np.ndarray:
    """(n, K): log of weight times density of a diagonal mixture. Two products of n x K, around the mixture's mean, so nothing of n x K x D is made."""
    shift = codebook.weights @ codebook.means / codebook.weights.sum()
    y, m, inverse = x - shift, codebook.means - shift, 1 / codebook.variances
    squares = y**2 @ inverse.T - 2 * y @ (m * inverse).T + (m**2 * inverse).sum(1)
    return np.log(codebook.weights) - 0.5 * np.log(2 * np.pi * codebook.variances).sum(1) - 0.5 * np.maximum(squares, 0)


def responsibilities(x: np.ndarray, codebook: Codebook) -> tuple[np.ndarray, float]:
    """(n, K) posteriors by log-sum-exp, and the log-likelihood of all rows."""
    log = log_joint(x, codebook)
    top = log.max(1, keepdims=True)
    p = np.exp(log - top)
    total = p.sum(1, keepdims=True)
    return p / total, float((top + np.log(total)).sum())


def posteriors(x: np.ndarray, codebook: Codebook) -> np.ndarray:
    """(n, K) of a diagonal mixture."""
    parts = [responsibilities(part, codebook)[0] for part in slices(x, codebook.k + codebook.dim)]
    return np.concatenate(parts) if parts else np.zeros((0, codebook.k))


def moments(x: np.ndarray, codebook: Codebook, shift: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Over the rows, by centre: the sums of posteriors, of posteriors times x - shift, and times its square; and the log-likelihood. Memory of a slice of rows and of the model."""
    mass, first, second, likelihood = np.zeros(codebook.k), np.zeros(codebook.means.shape), np.zeros(codebook.means.shape), 0.0
    for part in slices(x, codebook.k + codebook.dim):
        p, gained = responsibilities(part, codebook)
        y = part - shift
        mass += p.sum(0)
        first += p.T @ y
        second += p.T @ y**2
        likelihood += gained
    return mass, first, second, likelihood


def assign(descriptors: DataFrame, codebook: Codebook) -> DataFrame:
    """(image, desc, k): the nearest centre of every descriptor. No shuffle."""
    ship(descriptors.sparkSession)
    own = descriptors.select("image", "desc", doubles("x").alias("x"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, codebook.dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(x, codebook).astype(np.int32))], names=["image", "desc", "k"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("image", "desc")}
    return own.mapInArrow(each, f"image {kinds['image']}, desc {kinds['desc']}, k int")


def posterior_table(descriptors: DataFrame, codebook: Codebook) -> DataFrame:
    """(image, desc, p): a mixture's posteriors of every descriptor. No shuffle."""
    if not codebook.is_mixture:
        raise ValueError("posteriors need a mixture")
    ship(descriptors.sparkSession)
    own = descriptors.select("image", "desc", doubles("x").alias("x"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, codebook.dim)
            step = max(1, SLICE // codebook.k)
            for at in range(0, len(x), step):
                p = posteriors(x[at : at + step], codebook)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), codebook.k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), batch.column(1).slice(at, step), rows], names=["image", "desc", "p"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("image", "desc")}
    return own.mapInArrow(each, f"image {kinds['image']}, desc {kinds['desc']}, p array<double>")


def _power(v: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(v) * np.abs(v) ** alpha


def _norm(v: np.ndarray, order: float, axis: int | None = None) -> np.ndarray:
    return (np.abs(v) ** order).sum(axis=axis, keepdims=axis is not None) ** (1 / order)


def check_similarity(similarity: str | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """A name that is registered, or a function of two matrices or of two vectors, which is probed."""
    if callable(similarity):
        checked(similarity)
    elif similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}; known: {', '.join(SIMILARITIES)}")


def _named(similarity: str | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> str:
    return similarity if isinstance(similarity, str) else getattr(similarity, "__name__", "function")


@dataclass(frozen=True)
class Encoder:
    """What encoders share: a model, a projection in front of it, power and norm; a similarity by name or a user's function. ``validate`` runs before any plan is built."""

    codebook: Codebook
    projection: Projection | None = None
    power: float = 1.0
    order: float = 2.0
    epsilon: float = 1e-9
    similarity: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cosine"

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        if self.projection is not None and self.projection.dim_out != self.codebook.dim:
            raise ValueError(f"the projection gives {self.projection.dim_out} components, the codebook has {self.codebook.dim}")
        check_similarity(self.similarity)

    @property
    def width(self) -> int:
        return self.projection.dim_in if self.projection else self.codebook.dim

    @property
    def length(self) -> int:
        raise NotImplementedError

    def of_bag(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def of_descriptors(self, x: np.ndarray) -> np.ndarray:
        """The vector of an (n, width) bag as an extractor gives it; zero where it has no rows."""
        if not len(x):
            return np.zeros(self.length)
        return self.of_bag(self.projection.apply(x) if self.projection else x)

    def encode_bags(self, bagged: DataFrame) -> DataFrame:
        """(image, encoding) of ``bagged(image, bag)``."""
        return per_bag(bagged, self.of_descriptors, self.width)

    def encode(self, descriptors: DataFrame, images: DataFrame | None = None) -> DataFrame:
        """(image, encoding) of descriptors in long form: the encoding map."""
        return self.encode_bags(bags(descriptors, images))

    def similarity_scores(self, first: DataFrame, second: DataFrame, single: bool = True) -> DataFrame:
        """(q, id, sim) of all pairs of two sets of descriptors, by this encoder's similarity; in single precision unless asked otherwise."""
        left = self.encode(first).select(F.col("image").alias("q"), F.col("encoding").alias("v"))
        right = self.encode(second).select(F.col("image").alias("id"), F.col("encoding").alias("v"))
        out = scores(left, right, self.similarity)
        return out.withColumn("sim", F.col("sim").cast("float")) if single else out

    def describe(self) -> str:
        behind = f", projection {self.projection.dim_in} to {self.projection.dim_out}" if self.projection else ""
        return f"{type(self).__name__}(K={self.codebook.k}, D={self.codebook.dim}{behind}, power={self.power:g}, order={self.order:g}, similarity={_named(self.similarity)})"


@dataclass(frozen=True)
class Vlad(Encoder):
    """Sums of residuals to the nearest centre, normalised centre by centre; K * D components, those of an empty centre zero."""

    @property
    def length(self) -> int:
        return self.codebook.k * self.codebook.dim

    def of_bag(self, x: np.ndarray) -> np.ndarray:
        at, v = nearest(x, self.codebook), np.zeros((self.codebook.k, self.codebook.dim))
        np.add.at(v, at, x - self.codebook.means[at])
        v = _power(v, self.power)
        return (v / (_norm(v, self.order, 1) + self.epsilon)).ravel()


@dataclass(frozen=True)
class Fisher(Encoder):
    """Gradients of a diagonal mixture's log-likelihood by weights, means and deviations, normalised together; K + 2 K D components."""

    power: float = 0.5

    def validate(self) -> None:
        super().validate()
        if not self.codebook.is_mixture:
            raise ValueError("Fisher vectors need a mixture")

    @property
    def length(self) -> int:
        return self.codebook.k * (1 + 2 * self.codebook.dim)

    def of_bag(self, x: np.ndarray) -> np.ndarray:
        c = self.codebook
        mass, first, second, _ = (m / len(x) for m in moments(x, c))
        mass = mass[:, None]
        root = np.sqrt(c.weights)[:, None]
        by_weight = (mass - c.weights[:, None]) / root
        by_mean = (first - mass * c.means) / (root * np.sqrt(c.variances))
        by_deviation = (mass * (c.variances - c.means**2) + 2 * first * c.means - second) / (np.sqrt(2) * root * c.variances)
        v = _power(np.concatenate([by_weight.ravel(), by_mean.ravel(), by_deviation.ravel()]), self.power)
        return v / (_norm(v, self.order) + self.epsilon)


@dataclass(frozen=True)
class Pipeline:
    """Encoders over the same images; their vectors are concatenated in order. Bags are gathered once for encoders that share descriptors."""

    encoders: list[Encoder] = field(default_factory=list)
    similarity: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cosine"

    def __post_init__(self) -> None:
        if not self.encoders or not all(isinstance(e, Encoder) for e in self.encoders):
            raise ValueError("a pipeline needs encoders")
        check_similarity(self.similarity)
        if len({e.width for e in self.encoders}) > 1:
            raise ValueError("encoders of one pipeline read descriptors of one width; use encode_each for several")

    @property
    def length(self) -> int:
        return sum(e.length for e in self.encoders)

    def encode(self, descriptors: DataFrame, images: DataFrame | None = None) -> DataFrame:
        return self.encode_bags(bags(descriptors, images))

    def encode_bags(self, bagged: DataFrame) -> DataFrame:
        """(image, encoding) of ``bagged(image, bag)``: no shuffle."""
        own = self.encoders

        def one(x: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros(e.length) if not len(x) else e.of_bag(e.projection.apply(x) if e.projection else x) for e in own])

        return per_bag(bagged, one, own[0].width)

    def encode_each(self, descriptors: list[DataFrame]) -> DataFrame:
        """One table of descriptors for each encoder; the encodings are joined by image."""
        out = None
        for i, (e, d) in enumerate(zip(self.encoders, descriptors, strict=True)):
            part = e.encode(d).withColumnRenamed("encoding", f"e{i}")
            out = part if out is None else out.join(part, "image")
        return out.select("image", F.concat(*(f"e{i}" for i in range(len(self.encoders)))).alias("encoding"))

    def similarity_scores(self, first: DataFrame, second: DataFrame, single: bool = True) -> DataFrame:
        left = self.encode(first).select(F.col("image").alias("q"), F.col("encoding").alias("v"))
        right = self.encode(second).select(F.col("image").alias("id"), F.col("encoding").alias("v"))
        out = scores(left, right, self.similarity)
        return out.withColumn("sim", F.col("sim").cast("float")) if single else out

    def describe(self) -> str:
        return "Pipeline(" + ", ".join(e.describe() for e in self.encoders) + ")"


def retrieve(encodings: DataFrame, encoded_queries: DataFrame, k: int = 5) -> DataFrame:
    """Top k of every encoded query by cosine, whatever similarity the encoder has: (q, id, sim, rank)."""
    q = encoded_queries.select(F.col("image").alias("q"), F.col("encoding").alias("v"))
    d = encodings.select(F.col("image").alias("id"), F.col("encoding").alias("v"))
    return ranked(scores(q, d, "cosine", k), k)


def with_model(encoder: Encoder, codebook: Codebook, projection: Projection | None = None) -> Encoder:
    """The encoder with a newly learned model; a projection that is not given is dropped, not kept by accident."""
    return replace(encoder, codebook=codebook, projection=projection)
