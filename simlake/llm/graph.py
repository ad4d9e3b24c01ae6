"""Connected components and bucket comparison for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Members of a bucket that one task compares at once; larger buckets are cut into blocks, and pairs of blocks are dealt out.
BLOCK = 2048

#: Rows of buckets that one task walks, about.
TASK_ROWS = 4_000_000

#: Nodes whose edges share a file of a round, where the number of nodes is told.
NODES = 100_000


def components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges(a, b)``.

    Alternates large-star and small-star steps: each round's groups only need the minimum of a node's neighbours, which
    is combined before the shuffle, and a hub's edges are spread over its neighbours. Rounds grow with the logarithm of
    the longest path. Nulls and self-loops are dropped; an empty input gives an empty result.

    Rounds are checkpointed in a file a shuffle partition. If the number of ``nodes`` is told, in a file for each NODES of
    them, at least one a core: on local disks Hadoop starts processes for every file, each for a moment as large as the executor.
    """
    files = None if nodes is None else max(edges.sparkSession.sparkContext.defaultParallelism, -(-nodes // NODES))
    kept = lambda df: checkpoint(df if files is None else df.coalesce(files))
    now = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = kept(small.where("u <> v").distinct())
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        now, before = after, mark
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: compare(left rows, right rows or None for the rows among themselves) -> Arrow arrays of what is found, linear in the rows.
Compare = Callable[[dict[str, np.ndarray], dict[str, np.ndarray] | None], dict[str, np.ndarray]]


def in_buckets(rows: DataFrame, columns: list[str], runs: Callable[[dict[str, np.ndarray], np.ndarray], list[dict[str, np.ndarray]]], pair: Compare, found_schema: str, read: Callable[[pa.RecordBatch], dict[str, np.ndarray]], block: int = BLOCK, size: int = 0) -> DataFrame:
    """Compare the rows that share ``key``, without a join and without a row for each pair.

    ``rows`` has ``key long`` and ``columns``. One shuffle brings equal keys together, sorted; each task walks its
    buckets as a stream. Buckets of up to ``block`` rows go to ``runs(rows, run starts)`` at once. A larger bucket is
    handed on in numbered blocks; each pair of its blocks becomes a task of its own, with ``pair``. ``size`` is about how many
    rows there are: a task gets TASK_ROWS of them, or fewer as the session has more shuffle partitions.
    """
    names = ["key", *columns]
    schema = rows.select(*names).schema
    found_names = [x.split()[0] for x in found_schema.split(", ")]

    def out(hot: pa.RecordBatch | None, numbers: np.ndarray | None, found: dict[str, np.ndarray] | None) -> pa.RecordBatch:
        n = hot.num_rows if hot is not None else len(found[found_names[0]])
        made = [pa.array(numbers, pa.int32()) if hot is not None else pa.nulls(n, pa.int32())]
        made += [hot.column(i) if hot is not None else pa.nulls(n, arrow_types[i]) for i in range(len(names))]
        made += [pa.nulls(n, t) if found is None else pa.array(found[c], t) for c, t in zip(found_names, found_types)]
        return pa.RecordBatch.from_arrays(made, names=["block", *names, *found_names])

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_types = list(to_arrow_schema(schema).types)
    found_types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(found_schema).fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the last key so far, up to a block
        kept_rows, hot_key, hot_at = 0, None, 0

        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=1 << 30)
            if t:
                key = t[0].column(0).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                for found in runs(read(t[0]), starts):
                    if len(found[found_names[0]]):
                        yield out(None, None, found)

        for batch in batches:
            while batch.num_rows:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                if hot_key is not None:
                    n = int(np.searchsorted(key, hot_key, "right"))
                    if n:
                        yield out(batch.slice(0, n), (hot_at + np.arange(n)) // block, None)
                    hot_at += n
                    batch = batch.slice(n)
                    if batch.num_rows:
                        hot_key, hot_at = None, 0
                    continue
                last = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
                if last:
                    yield from whole([*kept, batch.slice(0, last)])
                    kept, kept_rows = [], 0
                    batch = batch.slice(last)
                elif kept and kept[-1].column(0)[-1].as_py() != key[0]:
                    yield from whole(kept)
                    kept, kept_rows = [], 0
                else:
                    kept.append(batch)
                    kept_rows += batch.num_rows
                    if kept_rows > block:
                        hot_key, hot_at = key[0], 0
                        for b in kept:
                            yield out(b, (hot_at + np.arange(b.num_rows)) // block, None)
                            hot_at += b.num_rows
                        kept, kept_rows = [], 0
                    break
        if kept:
            yield from whole(kept)

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_ROWS)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    walked = checkpoint(rows.select(*names).repartition(n, "key").sortWithinPartitions("key").mapInArrow(walk, f"block int, {shape}, {found_schema}"))
    found = walked.where("block is null").select(*found_names)
    hot = walked.where("block is not null").select("block", *names)
    if hot.isEmpty():
        return found
    blocks = hot.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *names)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = t.column("block").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        side = lambda n: read(t.filter(pa.array(at == n)).select(names).combine_chunks().to_batches()[0])
        got = pair(side(i), None if i == j else side(j))
        return pa.table([pa.array(got[c], ty) for c, ty in zip(found_names, found_types)], names=found_names)

    return found.unionAll(dealt.groupBy("key", "i", "j").applyInArrow(compare, found_schema))


def forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of n nodes in which near(i, others) says which others i links with; O(n) memory."""
    left, tree = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                got = left[hit]
                tree += [(i, k) for k in got]
                queue += list(got)
                left = left[~hit]
    a = np.array(tree, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]
