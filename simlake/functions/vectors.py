"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    """The vector in double precision; cast once, before any arithmetic."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row; inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def p_norm(v: Column, order: float = 2.0) -> Column:
    if order == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    if order == 1:
        return total(F.transform(v, F.abs))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(order))))), F.lit(1.0 / order))


def scaled(v: Column, by: Column) -> Column:
    """Each component divided by ``by``."""
    return let(by, lambda d: F.transform(v, lambda x: x / d))


def normalised(v: Column, order: float = 2.0, epsilon: float = 1e-9) -> Column:
    """v / (its p-norm + epsilon)."""
    return scaled(v, p_norm(v, order) + F.lit(epsilon))


def unit(v: Column) -> Column:
    """v / its norm; a zero vector stays zero, so its cosine with anything is 0."""
    return let(p_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def signed_power(v: Column, alpha: float) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(float(alpha))))


def hellinger(v: Column, epsilon: float = 1e-7) -> Column:
    """Square root of the vector after division by its sum: RootSIFT of a SIFT descriptor."""
    return let(total(v) + F.lit(epsilon), lambda s: F.transform(v, lambda x: F.sqrt(x / s)))


def standardised(v: Column) -> Column:
    """(x - mean) / population deviation within the vector; NULL components where the deviation is 0."""
    n = F.size(v).cast("double")

    def by_mean(mean: Column) -> Column:
        deviation = F.sqrt(F.try_divide(total(F.transform(v, lambda x: (x - mean) * (x - mean))), n))
        return let(deviation, lambda d: F.transform(v, lambda x: F.try_divide(x - mean, d)))

    return let(F.try_divide(total(v), n), by_mean)


def projected(v: Column, mean: Column, components: Column) -> Column:
    """(v - mean) times each row of ``components``."""
    return let(F.zip_with(v, mean, lambda x, m: x - m), lambda c: F.transform(components, lambda row: dot(c, row)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


#: Similarities by name, as expressions of two vectors.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": lambda a, b: dot(unit(a), unit(b)),
    "dot": dot,
    "euclidean": euclidean,
    "neg_euclidean": lambda a, b: -euclidean(a, b),
    "manhattan": manhattan,
}


def similarity(name: str) -> Callable[[Column, Column], Column]:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(SIMILARITIES)}")
    return SIMILARITIES[name]


def truncated(v: Column) -> Column:
    """Components as integers, truncated toward zero."""
    return F.transform(v, lambda x: x.cast("int"))


def is_subset(small: Column, large: Column) -> Column:
    """Whether every element of ``small`` is in ``large``; an error where ``small`` has more elements, repeats included."""
    return F.when(F.size(small) > F.size(large), F.raise_error(F.lit("the first list is longer than the second")).cast("boolean")).otherwise(F.size(F.array_except(small, large)) == 0)


def all_different(v: Column) -> Column:
    return F.size(F.array_distinct(v)) == F.size(v)


def both_numbers(x: Column, y: Column) -> Column:
    """Whether neither value of a pair is NULL or NaN."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def is_image(image: Column) -> Column:
    """Whether an image struct holds height * width * channels bytes, of 1 or 3 channels."""
    size = image["height"] * image["width"] * image["nChannels"]
    return F.coalesce((image["height"] > 0) & (image["width"] > 0) & image["nChannels"].isin(1, 3) & (F.octet_length(image["data"]) == size), F.lit(False))


def is_channels_first(v: Column, tolerance: float = 1e-5) -> Column:
    """Whether an array of three equal matrices holds values in [0, 1], give or take the tolerance."""
    flat = F.flatten(F.flatten(v))
    sizes = F.array_distinct(F.flatten(F.transform(v, lambda m: F.transform(m, F.size))))
    within = F.forall(flat, lambda x: x.isNotNull() & (x >= -tolerance) & (x <= 1 + tolerance))
    return F.coalesce((F.size(v) == 3) & (F.size(F.array_distinct(F.transform(v, F.size))) == 1) & (F.size(sizes) == 1) & within, F.lit(False))


def channels_last(v: Column) -> Column:
    """An array of channel matrices as rows of pixels, each pixel its channels: what extractors read."""
    rows = F.sequence(F.lit(0), F.size(v[0]) - 1)
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.size(v[0][r]) - 1), lambda c: F.transform(v, lambda m: m[r][c])))


def is_mask(v: Column) -> Column:
    """Whether a matrix holds whole numbers in rows of one length."""
    return F.coalesce((F.size(F.array_distinct(F.transform(v, F.size))) == 1) & F.forall(F.flatten(v), lambda x: x == F.floor(x)), F.lit(False))


def checked_width(v: Column, width: int) -> Column:
    """The vector itself; an error if its length is not ``width``."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} components, got "), F.size(v).cast("string"))).cast("array<double>"))
