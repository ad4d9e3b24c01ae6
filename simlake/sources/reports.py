"""The tables behind charts: heat maps, bars, lines. Drawing is left to whatever reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.operators.order import numbered


def heatmap(matrix: DataFrame, row: str = "q", column: str = "id", value: str = "sim") -> DataFrame:
    """A long matrix with one row a line: (row, cells) with the cells in order of the column."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col(value).alias("v"))))
    return matrix.groupBy(F.col(row).alias("row")).agg(cells.alias("s")).select("row", F.col("s.v").alias("cells"))


def bars(rows: DataFrame, category: str, series: str, value: str, names: list | None = None) -> DataFrame:
    """A bar a category and series: sums of ``value``, a column a series."""
    return rows.groupBy(category).pivot(series, names).agg(F.sum(value))


def line(points: DataFrame, x: str = "x", y: str = "y", sort_y: bool = False) -> DataFrame:
    """(i, x, y) in order of x. ``sort_y`` orders the values of y by themselves, apart from x."""
    rows = numbered(points, [x, y], "i", 0)
    if not sort_y:
        return rows.select("i", F.col(x).alias("x"), F.col(y).alias("y"))
    values = numbered(points.select(F.col(y).alias("y")), ["y"], "i", 0)
    return rows.select("i", F.col(x).alias("x")).join(values, "i")


def ticks(line_rows: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` rows of a line, evenly spread, both ends included."""
    n = line_rows.agg(F.count("*").alias("n"))
    place = n.where("n > 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most)) - 1), lambda j: F.floor(j * (F.col("n") - 1) / F.greatest(F.least(F.col("n"), F.lit(most)) - 1, F.lit(1))).cast("long"))).alias("i")).distinct()
    return line_rows.join(F.broadcast(place), "i")
