"""Statistics, regression and binning of paired samples ``(x, y)``. Pairs with a NULL or NaN are dropped first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlake.functions.vectors import both_numbers
from simlake.operators.quantiles import quantiles, rank_correlation, ranks, with_rank
from simlake.operators.runtime import checkpoint


def valid_pairs(pairs: DataFrame) -> DataFrame:
    own = pairs.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own.where(both_numbers(F.col("x"), F.col("y")))


def correlation(x: str = "x", y: str = "y") -> Column:
    """Pearson's coefficient; NULL where a side is constant or there are fewer than two pairs."""
    return F.when((F.count("*") > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / (F.nullif(F.stddev_pop(x), F.lit(0.0)) * F.nullif(F.stddev_pop(y), F.lit(0.0))))


def average_ranks(pairs: DataFrame) -> DataFrame:
    """``pairs`` with x and y replaced by ranks, ties sharing their mean."""
    out, middle = pairs, (pairs.count() + 1) / 2
    for c in ("x", "y"):
        counts = checkpoint(pairs.groupBy(c).agg(F.count("*").alias("n")))
        out = with_rank(out, checkpoint(ranks(counts, [], c)), [], c, f"r{c}")
    return out.select((F.col("rx") + middle).alias("x"), (F.col("ry") + middle).alias("y"))


def statistics(pairs: DataFrame) -> DataFrame:
    """One row: pearson, spearman, and of y: std (population), mean, median, n_points."""
    own = valid_pairs(pairs)
    first = own.agg(correlation().alias("pearson"), F.stddev_pop("y").alias("std"), F.avg("y").alias("mean"), F.count("*").alias("n_points"))
    median = quantiles(own, [], "y", [0.5]).select(F.col("q")[0].alias("median"))
    for more in (rank_correlation(own, []), median):
        first = first.join(F.broadcast(more), F.lit(True), "left")
    return first.select("pearson", "spearman", "std", "mean", "median", "n_points")


def linear_fit(pairs: DataFrame) -> DataFrame:
    """One row: slope, intercept and mean squared error of the least squares line; needs two pairs with different x."""
    own = valid_pairs(pairs)
    line = own.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    error = F.pow(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")), 2)
    return own.crossJoin(F.broadcast(line)).groupBy("slope", "intercept").agg(F.avg(error).alias("mse"))


def polynomial_fit(pairs: DataFrame, degree: int = 1) -> tuple[list[float], float]:
    """(coefficients, intercept) of least squares: coefficients[0] belongs to the constant column and is 0. Sums of powers are gathered in one pass."""
    if degree < 1:
        raise ValueError("degree must be 1 or more")
    own = valid_pairs(pairs)
    scale = own.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).first()
    if not scale["n"]:
        raise ValueError("no valid pairs")
    m, s = scale["m"], scale["s"] or 1.0
    z = (F.col("x") - m) / s
    powers = [F.sum(F.pow(z, F.lit(float(p)))).alias(f"p{p}") for p in range(2 * degree + 1)]
    moments = [F.sum(F.pow(z, F.lit(float(p))) * F.col("y")).alias(f"q{p}") for p in range(degree + 1)]
    r = own.agg(*powers, *moments).first()
    a = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    b = np.array([r[f"q{i}"] for i in range(degree + 1)])
    in_z = np.polynomial.Polynomial(np.linalg.lstsq(a, b, rcond=None)[0])
    in_x = in_z(np.polynomial.Polynomial([-m / s, 1 / s])).coef
    in_x = np.r_[in_x, np.zeros(degree + 1 - len(in_x))]
    return [0.0, *in_x[1:].tolist()], float(in_x[0])


def polynomial_predictions(pairs: DataFrame, degree: int = 1) -> DataFrame:
    """(x, y, predicted, error) of the fitted polynomial."""
    coefficients, intercept = polynomial_fit(pairs, degree)
    value = F.lit(0.0)
    for c in reversed(coefficients):
        value = value * F.col("x") + F.lit(c)
    own = valid_pairs(pairs).withColumn("predicted", value + F.lit(intercept))
    return own.withColumn("error", F.pow(F.col("y") - F.col("predicted"), 2))


def bins(pairs: DataFrame, n: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, x, y) with right-open bins of equal width; x at or past ``high`` and below ``low`` is dropped."""
    at = F.width_bucket(F.col("x"), F.lit(float(low)), F.lit(float(high)), F.lit(n)) - 1
    return valid_pairs(pairs).withColumn("bin", at.cast("int")).where(F.col("bin").between(0, n - 1)).select("bin", "x", "y")


def bin_statistics(pairs: DataFrame, n: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Statistics, line and mean squared error of each bin that is open on the left and closed on the right, where it has more than one point."""
    width = (high - low) / n
    own = valid_pairs(pairs).withColumn("bin", (F.ceil((F.col("x") - low) / width) - 1).cast("int")).where(F.col("bin").between(0, n - 1))
    out = own.groupBy("bin").agg(correlation().alias("pearson"), F.stddev_pop("y").alias("std"), F.avg("y").alias("mean"), F.count("*").alias("n_points"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    out = checkpoint(out.where(F.col("n_points") > 1))
    off = F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept"))
    errors = own.join(F.broadcast(out.select("bin", "slope", "intercept")), "bin").groupBy("bin").agg(F.avg(off * off).alias("mse"))
    medians = quantiles(own, ["bin"], "y", [0.5]).select("bin", F.col("q")[0].alias("median"))
    for more in (rank_correlation(own, ["bin"]), errors, medians):
        out = out.join(F.broadcast(more), "bin", "left")
    return out.select("bin", "pearson", "spearman", "std", "mean", "median", "n_points", "slope", "intercept", "mse")


def boxes(pairs: DataFrame, n: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and the number of outliers of every right-open bin; an empty bin has NULLs and no outliers."""
    own = bins(pairs, n, low, high)
    quart = checkpoint(quantiles(own, ["bin"], "y", [0.25, 0.5, 0.75]))
    quart = quart.select("bin", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = F.col("q3") - F.col("q1")
    within = F.col("y").between(F.col("q1") - 1.5 * reach, F.col("q3") + 1.5 * reach)
    found = own.join(F.broadcast(quart), "bin").groupBy("bin", "q1", "median", "q3").agg(F.min(F.when(within, F.col("y"))).alias("low_whisker"), F.max(F.when(within, F.col("y"))).alias("high_whisker"), F.sum((~within).cast("long")).alias("n_outliers"))
    grid = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0).cast("long")))


def outliers(pairs: DataFrame, n: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, x, y) of the points past the whiskers' reach of their bin."""
    ends = boxes(pairs, n, low, high).select("bin", "low_whisker", "high_whisker")
    return bins(pairs, n, low, high).join(F.broadcast(ends), "bin").where((F.col("y") < F.col("low_whisker")) | (F.col("y") > F.col("high_whisker"))).select("bin", "x", "y")


def histogram(values: DataFrame, n: int = 10) -> DataFrame:
    """(bin, n) of ``values(x)`` between its least and greatest value; the last bin is closed. Empty bins count 0."""
    own = values.select(F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = own.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * n), F.lit(n - 1))).otherwise(F.lit(n // 2))
    counted = own.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def line_points(pairs: DataFrame, points: int = 100) -> DataFrame:
    """(i, x, y): the fitted line sampled evenly between the least and greatest x."""
    own = valid_pairs(pairs)
    line = own.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / float(max(points - 1, 1))
    return at.select("i", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y"))


def value_standardised(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Each value less its group's mean, over its population deviation; NULL where that is 0. Grouped by position for columns, by row for rows."""
    group = rows.groupBy(*by).agg(F.avg(value).alias("~m"), F.stddev_pop(value).alias("~s"))
    return rows.join(group, by).withColumn(value, F.try_divide(F.col(value) - F.col("~m"), F.nullif(F.col("~s"), F.lit(0.0)))).drop("~m", "~s")
