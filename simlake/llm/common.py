"""Shared plumbing of the corpus operators: Arrow passes over texts, checkpoints, size checks."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from simlake.operators.runtime import checkpoint, dropped, ship, spread, table, written

__all__ = ["arrow_pass", "as_bytes", "changed", "checkpoint", "dropped", "fits", "fold", "fold_of", "least", "ship", "spread", "table", "unused", "with_lengths", "written"]

#: Rows that a pass over texts hands to its function at once; bounds what the function's arrays take.
BATCH_ROWS = 1000


def least(df: DataFrame, by: str, sizes: dict, mark: str, ties: list[str], n: int, spare: int = 8) -> list[Row]:
    """The ``n`` rows of each group with the least ``mark``, a 64-bit hash, then the least ``ties``; sorted by group and mark. ``sizes`` has the groups that count and their rows.

    A large group first drops the rows whose mark lies past what ``spare`` * n of its rows need, so no task meets more
    than about that many rows of a group. Groups whose marks are so uneven that fewer than n stay are read whole.
    """
    least_mark, span = -(1 << 63), 1 << 64

    def taken(groups: dict, cut: bool) -> list[Row]:
        if not groups:
            return []
        bounds = [(g, least_mark + (span * spare * n // size if cut and size > spare * n else span - 1)) for g, size in groups.items()]
        bound = F.create_map(*(F.lit(x) for pair in bounds for x in pair))
        near = df.where(F.col(by).isin(list(groups)) & (F.col(mark) <= bound[F.col(by)]))
        place = F.row_number().over(Window.partitionBy(by).orderBy(mark, *ties))
        return near.withColumn("~place", place).where(F.col("~place") <= n).drop("~place").collect()

    rows = taken(sizes, True)
    met = Counter(r[by] for r in rows)
    short = {g: size for g, size in sizes.items() if size > spare * n and met[g] < n}
    if short:
        rows = [r for r in rows if r[by] not in short] + taken(short, False)
    return sorted(rows, key=lambda r: (r[by], r[mark], *(r[t] for t in ties)))


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Run ``fn`` on slices of up to ``rows`` rows of ``df``: no shuffle. Slices are cut in the worker, whatever batches the session sends (Spark bounds those in rows and bytes)."""
    ship(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from fn(batch.slice(at, rows))

    return spread(df).mapInArrow(over, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def fold_of(doc_id: object) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 4


def fits(df: DataFrame, size: Column, bound: int) -> bool:
    """Whether the sum of ``size`` over ``df`` stays within ``bound``: the check before a broadcast."""
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) <= bound


def changed(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with some of its columns replaced, cast to their types."""
    names = batch.schema.names
    made = [columns[n].cast(batch.column(i).type) if n in columns else batch.column(i) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(made, names=names)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "~"
    return name


def with_lengths(docs: DataFrame, text_col: str, length_col: str) -> DataFrame:
    """The length column anew after texts have changed, where there is one."""
    return docs.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else docs
