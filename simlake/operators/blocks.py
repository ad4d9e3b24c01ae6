"""All pairs of the rows of a table, in blocks: what is shuffled is a row a pair of blocks, what comes out is up to the function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.operators.runtime import ship

#: Rows of a block; a task holds two blocks and the products between them.
BLOCK_ROWS = 2048


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column; all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def within(rows: DataFrame, fn: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fn`` of every two blocks of ``rows(id, ..)``, each with itself too (the second is None then). Rows of one id share a block."""
    ship(rows.sparkSession)
    n = -(-rows.count() // block_rows) or 1
    columns = rows.columns
    own = rows.withColumn("~b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("~o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = own.select(F.least("~b", "~o").alias("~i"), F.greatest("~b", "~o").alias("~j"), "~b", *columns)

    def each(t: pa.Table) -> pa.Table:
        i, j = t.column("~i")[0].as_py(), t.column("~j")[0].as_py()
        side = lambda b: t.filter(pa.array(t.column("~b").to_numpy() == b)).select(columns)
        return fn(side(i), None if i == j else side(j))

    return dealt.groupBy("~i", "~j").applyInArrow(each, schema)


def between(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, left_rows: int, right_rows: int) -> DataFrame:
    """``fn`` of every block of ``left(q, ..)`` with every block of ``right(id, ..)``."""
    ship(left.sparkSession)
    n, m = -(-left.count() // left_rows) or 1, -(-right.count() // right_rows) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.withColumn("~i", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int")).withColumn("~j", every(m))
    b = right.withColumn("~j", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("~i", every(n))
    names = left.columns, right.columns
    each = lambda x, y: fn(x.select(names[0]), y.select(names[1]))
    return a.groupBy("~i", "~j").cogroup(b.groupBy("~i", "~j")).applyInArrow(each, schema)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of the graph of a symmetric boolean matrix."""
    left, tree = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            i = queue.pop()
            hit = np.flatnonzero(near[i] & left)
            left[hit] = False
            tree += [(i, k) for k in hit]
            queue += hit.tolist()
    a = np.array(tree, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]
