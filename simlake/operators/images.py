"""Images: decoding, blurring, feature maps, and feature extraction through user functions.

An image is the struct of Spark's image source: origin, height, width, nChannels, mode, data (rows of blue, green, red).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlake.functions.vectors import is_image
from simlake.operators.runtime import ship, spread


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """(H, W, 3) in red, green, blue; one channel is repeated."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3][:, :, ::-1]


def checked_images(images: DataFrame, column: str = "image") -> DataFrame:
    """``images`` with an error, when it runs, for a row whose image struct holds no picture."""
    what = F.concat(F.lit("not an image: "), F.coalesce(F.col(column)["origin"], F.lit("of unknown origin")))
    return images.withColumn(column, F.when(is_image(F.col(column)), F.col(column)).otherwise(F.raise_error(what).cast(images.schema[column].dataType)))


def takes_images(*positions: int, names: tuple[str, ...] = (), column: str = "image") -> Callable[[Callable], Callable]:
    """A contract on a function of DataFrames: its arguments at ``positions`` (the first by default) and under ``names`` must hold images. A missing column is refused at once, a bad row when the plan runs."""
    wanted = positions or (() if names else (0,))

    def checked(df: DataFrame) -> DataFrame:
        if not isinstance(df, DataFrame) or column not in df.columns:
            raise ValueError(f"expected a DataFrame with a column {column!r}")
        return checked_images(df, column)

    def around(function: Callable) -> Callable:
        @wraps(function)
        def call(*args: object, **kwargs: object) -> object:
            if wanted and max(wanted) >= len(args):
                raise ValueError(f"expected images at position {max(wanted)}")
            return function(*(checked(a) if i in wanted else a for i, a in enumerate(args)), **{k: checked(v) if k in names else v for k, v in kwargs.items()})

        return call

    return around


def gaussian_kernel(size: int | None = None, sigma: float = 1.0) -> np.ndarray:
    """Weights that sum to 1; the size defaults to 2 * int(3 sigma) + 1 and must lie between that and 2 * int(5 sigma) + 1."""
    least, most = 2 * int(3 * sigma) + 1, 2 * int(5 * sigma) + 1
    size = least if size is None else size
    if not least <= size <= most:
        raise ValueError(f"kernel size must be in {least}..{most}")
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma * sigma))
    return w / w.sum()


def blurred(image: np.ndarray, size: int | None = None, sigma: float = 1.0) -> np.ndarray:
    """Separable convolution; the border mirrors without repeating its own pixel."""
    k = gaussian_kernel(size, sigma)
    out = image.astype(float)
    for axis in (0, 1):
        r = len(k) // 2
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, len(k) - 1 - r)
        p = np.pad(out, pad, mode="reflect")
        n = out.shape[axis]
        out = sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def blur(images: DataFrame, size: int | None = None, sigma: float = 1.0) -> DataFrame:
    """``images(image, v)`` of matrices as array<array<double>>, blurred."""
    gaussian_kernel(size, sigma)
    ship(images.sparkSession)
    own = images.select("image", F.col("v").cast("array<array<double>>").alias("v"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [blurred(np.array(m, float), size, sigma).tolist() for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["image", "v"])

    return spread(own).mapInArrow(each, f"image {own.schema['image'].dataType.simpleString()}, v array<array<double>>")


def feature_cells(maps: DataFrame, height: int, width: int, spatial: bool = True) -> DataFrame:
    """Descriptors (image, desc, x) of ``maps(image, v)``, v an array of channels of height * width values in row order: a cell's channel values, then its column / width and row / height. Stays in the JVM."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: F.struct(p.alias("desc"), F.transform("v", lambda ch: ch[p].cast("double")).alias("x")))
    out = maps.select("image", F.inline(cells))
    if spatial:
        place = F.array((F.col("desc") % width) / float(width), F.floor(F.col("desc") / width) / float(height))
        out = out.withColumn("x", F.concat("x", place))
    return out.select("image", "desc", "x")


def flat(rows: Column) -> Column:
    """A matrix as one vector, row by row."""
    return F.flatten(rows)


class Extractor:
    """A function from an (H, W, 3) image to an (n, width) matrix of descriptors, run on the executors."""

    def __init__(self, function: Callable[[np.ndarray], np.ndarray | None], width: int):
        if not callable(function):
            raise ValueError("an extractor needs a function")
        self.function, self.width = function, width

    def checked(self, image: np.ndarray) -> np.ndarray:
        found = self.function(image)
        if found is None:
            return np.zeros((0, self.width))
        found = np.asarray(found, float)
        if found.ndim != 2 or found.shape[1] != self.width:
            raise ValueError(f"an extractor of width {self.width} gave shape {found.shape}")
        return found

    def descriptors(self, images: DataFrame, key: str = "path") -> DataFrame:
        """(image, desc, x) of ``images(key, image struct)``; an image without descriptors gives no row."""
        ship(images.sparkSession)
        own = images.select(F.col(key).alias("key"), "image.height", "image.width", "image.nChannels", "image.data")
        one = self.checked

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at, xs = [], [], []
                for r in batch.to_pylist():
                    for i, x in enumerate(one(pixels(r["height"], r["width"], r["nChannels"], r["data"]))):
                        keys.append(r["key"])
                        at.append(i)
                        xs.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(at, pa.int32()), pa.array(xs, pa.list_(pa.float64()))], names=["image", "desc", "x"])

        return spread(own).mapInArrow(each, f"image {own.schema['key'].dataType.simpleString()}, desc int, x array<double>")

    def bags(self, images: DataFrame, key: str = "path") -> DataFrame:
        """(image, bag) of ``images(key, image struct)``: each image's descriptors whole, as encoders read them, without a shuffle; an image without descriptors has an empty bag."""
        ship(images.sparkSession)
        own, one = images.select(F.col(key).alias("key"), "image.height", "image.width", "image.nChannels", "image.data"), self.checked

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [one(pixels(r["height"], r["width"], r["nChannels"], r["data"])).tolist() for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["image", "bag"])

        return spread(own).mapInArrow(each, f"image {own.schema['key'].dataType.simpleString()}, bag array<array<double>>")

    def of_rows(self, rows: DataFrame, key: str, value: str) -> DataFrame:
        """(image, desc, x) of any column, for functions that read something other than images."""
        ship(rows.sparkSession)
        own, one = rows.select(F.col(key).alias("image"), F.col(value).alias("value")), self.checked

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [one(v) for v in batch.column(1).to_pylist()]
                n = [len(f) for f in found]
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                xs = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([np.arange(k) for k in n] or [[]]).astype(np.int32)), pa.array(xs, pa.list_(pa.float64()))], names=["image", "desc", "x"])

        return spread(own).mapInArrow(each, f"image {own.schema['image'].dataType.simpleString()}, desc int, x array<double>")


def sift() -> Extractor:
    """SIFT descriptors of width 128; needs cv2 on the workers, which is only imported there."""

    def run(image: np.ndarray) -> np.ndarray | None:
        import cv2

        return cv2.SIFT_create().detectAndCompute(image, None)[1]

    return Extractor(run, 128)


def root_sift() -> Extractor:
    """SIFT, then the square root of each descriptor over its sum."""
    plain = sift()

    def run(image: np.ndarray) -> np.ndarray | None:
        x = plain.function(image)
        return None if x is None else np.sqrt(x / (x.sum(1, keepdims=True) + 1e-7))

    return Extractor(run, 128)


def convolutional(make_model: Callable[[], object], layer: Callable[[object], object] | str | int, width: int, spatial: bool = True, prepare: Callable[[np.ndarray], object] | None = None) -> Extractor:
    """Activations of one layer of a torch model, a descriptor a cell; the model is made once a worker, by ``make_model``. The layer is a function of the model, a module's name, or a convolution's place in ``convolution_layers`` (from the end if negative). Needs torch on the workers."""
    held: list = []

    def chosen(model: object) -> object:
        if callable(layer):
            return layer(model)
        if isinstance(layer, str):
            return submodule(model, layer)
        return convolution_layers(model)[layer][2]

    def run(image: np.ndarray) -> np.ndarray:
        import torch

        if not held:
            model = make_model()
            seen: dict = {}
            chosen(model).register_forward_hook(lambda _m, _i, out: seen.update(out=out))
            held.extend((model.eval(), seen))
        x = prepare(image) if prepare else torch.from_numpy(np.ascontiguousarray(image.transpose(2, 0, 1))).float()[None] / 255
        with torch.no_grad():
            held[0](x)
        a = held[1]["out"][0].numpy()
        cells = a.reshape(a.shape[0], -1).T
        if spatial:
            h, w = a.shape[1:]
            p = np.arange(h * w)
            cells = np.c_[cells, (p % w) / w, (p // w) / h]
        return cells

    return Extractor(run, width + 2 * spatial)


def submodule(model: object, name: str) -> object:
    """A module by its dotted name; a ValueError names those that there are."""
    known = dict(model.named_modules())
    if name not in known:
        raise ValueError(f"no module named {name!r}; known: {', '.join(n for n in known if n)}")
    return known[name]


def convolution_layers(model: object) -> list[tuple[int, str, object]]:
    """(index, name, module) of a torch model's two-dimensional convolutions."""
    import torch

    return [(i, name, m) for i, (name, m) in enumerate((n, m) for n, m in model.named_modules() if isinstance(m, torch.nn.Conv2d))]
