"""Charts from the small tables of reports and statistics. matplotlib is imported when a chart is drawn, and only then."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

#: Rows that a chart may read; a larger table is an error, not a longer wait.
MOST_ROWS = 200_000


def _rows(df: DataFrame, *order: str) -> list:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; aggregate first")
    return rows


def _drawn(path: str, draw: Callable, title: str, x: str = "", y: str = "") -> None:
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise ImportError("drawing needs matplotlib; the tables in reports and stats do not") from e
    figure = Figure(figsize=(8, 5))
    axes = figure.add_subplot()
    draw(axes)
    axes.set(title=title, xlabel=x, ylabel=y)
    figure.savefig(path, bbox_inches="tight")


def picture(pixels: np.ndarray, path: str, title: str = "") -> None:
    """An (H, W, 3) image or an (H, W) mask, without axes."""
    if pixels.ndim not in (2, 3) or pixels.ndim == 3 and pixels.shape[2] != 3:
        raise ValueError(f"an image is (H, W, 3) or (H, W), not {pixels.shape}")

    def draw(a) -> None:  # noqa: ANN001
        a.imshow(pixels)
        a.axis("off")

    _drawn(path, draw, title)


def heatmap(df: DataFrame, path: str, title: str = "") -> None:
    """Of reports.heatmap."""
    cells = [r["cells"] for r in _rows(df, "row")]
    _drawn(path, lambda a: a.figure.colorbar(a.imshow(cells)), title)


def barplot(categories: list, values: list, path: str, title: str = "") -> None:
    if len(categories) != len(values):
        raise ValueError("a bar needs a category and a value each")
    _drawn(path, lambda a: a.bar([str(c) for c in categories], values), title)


def lineplot(df: DataFrame, path: str, title: str = "") -> None:
    """Of reports.line."""
    rows = _rows(df, "i")
    _drawn(path, lambda a: a.plot([r["x"] for r in rows], [r["y"] for r in rows]), title, "x", "y")


def histogram(df: DataFrame, path: str, title: str = "", x_limits: tuple[float, float] | None = None) -> None:
    """Of stats.histogram; limits clip the axis, not the data."""
    rows = _rows(df, "bin")

    def draw(a) -> None:  # noqa: ANN001
        a.bar([r["bin"] for r in rows], [r["n"] for r in rows], width=1)
        if x_limits:
            a.set_xlim(*x_limits)

    _drawn(path, draw, title, "bin", "n")


def boxplot(boxes: DataFrame, path: str, line: DataFrame | None = None, title: str = "", outliers: DataFrame | None = None) -> None:
    """Of stats.boxes, with the line of stats.line_points over it and the points of stats.outliers beside the boxes."""
    rows = [r for r in _rows(boxes, "bin") if r["median"] is not None]
    beyond: dict[int, list[float]] = {}
    for r in _rows(outliers, "bin", "y") if outliers is not None else []:
        beyond.setdefault(r["bin"], []).append(r["y"])
    stats = [{"med": r["median"], "q1": r["q1"], "q3": r["q3"], "whislo": r["low_whisker"], "whishi": r["high_whisker"], "fliers": beyond.get(r["bin"], [])} for r in rows]
    points = _rows(line, "i") if line is not None else []

    def draw(a) -> None:  # noqa: ANN001
        a.bxp(stats, positions=[r["bin"] for r in rows], showfliers=bool(beyond))
        if points:
            twin = a.twiny()
            twin.plot([p["x"] for p in points], [p["y"] for p in points])

    _drawn(path, draw, title, "bin", "y")


def scatter(pairs: DataFrame, path: str, line: DataFrame | None = None, title: str = "") -> None:
    """Of pairs (x, y), with the line of stats.line_points."""
    rows, points = _rows(pairs, "x", "y"), _rows(line, "i") if line is not None else []

    def draw(a) -> None:  # noqa: ANN001
        a.scatter([r["x"] for r in rows], [r["y"] for r in rows], s=4)
        if points:
            a.plot([p["x"] for p in points], [p["y"] for p in points])

    _drawn(path, draw, title, "x", "y")
