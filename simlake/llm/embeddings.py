"""Embedding near-dedup by cross-polytope hashing.

Several tables have several hash functions each. A function rotates a vector by three rounds of random signs and a fast
Hadamard transform, and takes the nearest of the signed unit vectors. Multiprobe: a vector also enters the buckets in
which one function takes its second choice. Rows of a bucket and label are compared in double precision; only pairs at
the threshold or above count.

How many functions and tables there are follows from the data, for each power of two that bounds a vector's length: enough
functions that unrelated vectors of the most frequent label would leave CROWD in a bucket, then enough tables that a pair
at the threshold itself meets with a chance of RECALL; that chance is measured on random pairs. So buckets stay small as
the table grows, and no pair is less likely to be found.

Equal vectors of a label form one class that is indexed once. A pair of classes can meet in several buckets; it counts in
the first of them, which both rows' hash codes tell; those of linked rows are made again in the bucket. So each bucket reports the number of
links of its rows and a spanning forest, and no row is made for a pair. Buckets past graph.BLOCK are dealt out in
pairs of blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing and are their own component; vectors of different lengths do not link, and a long one does not widen the others;
repeated rows are vectors of their own and link with each other; of ids that tie in a component the smallest names it; a
null vec_id keeps its row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, checkpoint, table
from .graph import components, forest, in_buckets

THRESHOLD = 0.98
#: Unrelated vectors that a bucket may be expected to hold; least chance of a pair at the threshold to meet.
CROWD, RECALL = 64, 0.999
FUNCTIONS_MOST, TABLES_MOST = 6, 64
#: Random pairs that the chance is measured on, at most.
TRIALS = 512
SEED = 20_240_501
#: Numbers that are rotated at once.
AT_ONCE = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, of a power of two, without scaling."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def codes(v: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """Bucket codes (n, tables, 1 + functions): the vector's own, then with one function's second choice."""
    d = 1 << max(v.shape[1] - 1, 1).bit_length()
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (3, tables * functions, d))
    step = max(1, AT_ONCE // (tables * functions * d))
    return np.concatenate([_codes(v[a : a + step], signs, tables, functions) for a in range(0, max(len(v), 1), step)])


def _codes(v: np.ndarray, signs: np.ndarray, tables: int, functions: int) -> np.ndarray:
    (n, width), d = v.shape, signs.shape[2]
    x = np.zeros((n, 1, d), np.float32)
    x[:, 0, :width] = v
    x = x * signs[0]
    for s in (signs[1], signs[2]):
        x = hadamard(x) * s
    x = hadamard(x)
    size = np.abs(x)
    first = size.argmax(-1)
    take = lambda a, i: np.take_along_axis(a, i[..., None], -1)[..., 0]
    top = 2 * first + (take(x, first) < 0)
    np.put_along_axis(size, first[..., None], -1, -1)
    second = size.argmax(-1)
    next_ = 2 * second + (take(x, second) < 0)
    top, next_ = top.reshape(n, tables, functions).astype(np.int64), next_.reshape(n, tables, functions).astype(np.int64)
    place = (2 * d) ** np.arange(functions, dtype=np.int64)
    own = (top * place).sum(-1)
    return np.concatenate([own[..., None], own[..., None] + (next_ - top) * place], -1)


@cache
def meeting(d: int, functions: int, threshold: float) -> float:
    """The chance that two vectors of ``d`` components at the threshold share a bucket of a table, measured on random pairs."""
    n, rng = max(64, min(TRIALS, AT_ONCE // d)), np.random.default_rng(SEED + 1)
    a, b = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (codes(v, 4, functions) for v in (a, threshold * a + (1 - threshold**2) ** 0.5 * b))
    return float((x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean())


def plan(d: int, classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(tables, functions) for ``classes`` vectors of one label and up to ``d`` components, by which a pair at the threshold meets with a chance of RECALL.

    As many functions as keep buckets small; where that takes more than TABLES_MOST tables, fewer, and so larger buckets,
    which ``in_buckets`` cuts into blocks. An error where no number of functions reaches RECALL.
    """
    functions = 1
    while functions < FUNCTIONS_MOST and classes > CROWD * (2 * d) ** functions:
        functions += 1
    while functions:
        missed, tables = max(1 - meeting(d, functions, threshold), 1e-4), 1
        while tables < TABLES_MOST and missed**tables > 1 - RECALL:
            tables += 1
        if missed**tables <= 1 - RECALL:
            return tables, functions
        functions -= 1
    raise ValueError(f"{TABLES_MOST} tables do not find a share of {RECALL} of the pairs at a cosine of {threshold}: raise TABLES_MOST or the threshold")


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit key of integers; rows that meet by a collision fail the later comparison."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return h.astype(np.int64)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, plans: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``. ``plans`` fixes (tables, functions) of some padded lengths."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    usable = F.coalesce(F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"), F.lit(False))
    digest = F.unhex(F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0).cast("tinyint")).cast("string"))), 256))  # x + 0 makes the zeros equal
    good = own.where(usable).withColumn("digest", digest)
    classes = checkpoint(good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()))
    n_classes = classes.count()
    padded = F.pow(2, F.ceil(F.log2(F.greatest(F.size("v"), F.lit(2))))).cast("long")
    crowds = classes.groupBy(padded.alias("d"), "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # a row for each power of two
    of = {r["d"]: plan(r["d"], r["n"], threshold) for r in crowds} | (plans or {})
    stored = np.dtype("<f4") if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.dtype("<f8")
    shape_of = lambda width: of[1 << max(width - 1, 1).bit_length()]

    def hash_all(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths = batch.column(2).value_lengths().to_numpy()
        for width in np.unique(lengths):
            yield from hashed_of(batch.filter(pa.array(lengths == width)), int(width))

    def hashed_of(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
        tables, functions = shape_of(width)
        v = batch.column(2).flatten().to_numpy().reshape(-1, width).astype(np.float64)
        unit = v / np.abs(v).max(1, keepdims=True)  # against overflow
        c = codes(unit / np.linalg.norm(unit, axis=1, keepdims=True), tables, functions)
        n, t, p = c.shape
        where = np.broadcast_to(np.arange(t)[None, :, None], c.shape)
        key = _mix(batch.column(1).to_numpy()[:, None, None], np.int64(width), where, c)
        keep = np.ones(c.shape, bool)  # a probe that repeats an earlier one is left out
        for k in range(1, p):
            keep[:, :, k] = (c[:, :, k : k + 1] != c[:, :, :k]).all(-1)
        keep = keep.ravel()
        at = pa.array(np.repeat(np.arange(n), t * p)[keep])
        packed = pa.array([x.tobytes() for x in v.astype(stored)], pa.binary())
        size = pa.array(np.full(n, width, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[keep]), batch.column(0).take(at), batch.column(1).take(at), size.take(at), batch.column(3).take(at), packed.take(at), pa.array(where.ravel()[keep]), pa.array(c.ravel()[keep])], names=["key", "cid", "label", "size", "m", "v", "t", "code"])

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(c).to_numpy() for c in ("key", "cid", "label", "size", "m", "t", "code")}
        out["v"] = np.array([*batch.column("v").to_pylist(), None], object)[:-1]
        return out

    def whole(r: dict[str, np.ndarray], at: np.ndarray | slice) -> dict[str, np.ndarray]:
        """Those rows, all of one length, with their unit vectors."""
        r = {c: x[at] for c, x in r.items()}
        width = int(r["size"][0])
        v = np.frombuffer(b"".join(r["v"]), stored).reshape(-1, width).astype(np.float64)
        v = v / np.abs(v).max(1, keepdims=True)
        r["unit"] = v / np.linalg.norm(v, axis=1, keepdims=True)
        return r

    def first_meeting(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pair's first common bucket is this one: no common code in earlier tables, no smaller one in this. The codes of linked rows are made again, which is less than to send them along."""
        out = np.zeros(len(i), bool)
        if not len(i):
            return out
        linked, at = np.unique(np.r_[i, j], return_inverse=True)
        own, x_at, y_at = codes(r["unit"][linked], *shape_of(int(r["size"][0]))), at[: len(i)], at[len(i) :]
        for a in range(0, len(i), 50_000):
            x, y = x_at[a : a + 50_000], y_at[a : a + 50_000]
            same = own[x][:, :, :, None] == own[y][:, :, None, :]
            t = same.any((2, 3)).argmax(1)
            k = np.arange(len(x))
            least = np.where(same[k, t].any(-1), own[x][k, t], np.iinfo(np.int64).max).min(-1)
            here = i[a : a + 50_000]
            out[a : a + 50_000] = (t == r["t"][here]) & (least == r["code"][here])
        return out

    def report(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        counted = first_meeting(r, i, j)
        i, j = i[counted], j[counted]
        n = np.bincount(i, r["m"][j], len(r["cid"])) + np.bincount(j, r["m"][i], len(r["cid"]))
        some = np.flatnonzero(n)
        a, b = tree
        return {"a": np.r_[r["cid"][some], r["cid"][a]], "b": np.r_[np.full(len(some), -1), r["cid"][b]], "n": np.r_[n[some].astype(np.int64), np.zeros(len(a), np.int64)]}

    def one_bucket(r: dict[str, np.ndarray], side: np.ndarray | None = None) -> dict[str, np.ndarray]:
        hit = r["unit"] @ r["unit"].T >= threshold
        for c in ("label", "t", "code"):
            hit &= r[c][:, None] == r[c][None, :]
        if side is not None:
            hit &= side[:, None] != side[None, :]
        np.fill_diagonal(hit, False)
        i, j = np.nonzero(np.triu(hit))
        return report(r, i, j, forest(lambda k, others: hit[k, others], len(hit)))

    def lengths(r: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """The places of the rows of each length, in order."""
        for width in np.unique(r["size"]):
            yield np.flatnonzero(r["size"] == width)

    def pair(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        r = left if right is None else {c: np.concatenate([left[c], right[c]]) for c in left}
        side = None if right is None else np.arange(len(r["cid"])) < len(left["cid"])
        found = [one_bucket(whole(r, at), None if side is None else side[at]) for at in lengths(r)]
        return {c: np.concatenate([f[c] for f in found]) for c in ("a", "b", "n")}

    def runs(rows: dict[str, np.ndarray], starts: np.ndarray) -> list[dict[str, np.ndarray]]:
        found = []
        for at in lengths(rows):
            key = rows["key"][at]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            for s, n in zip(begin[size > 16], size[size > 16]):
                found.append(one_bucket(whole(rows, at[s : s + n])))
            short = at[np.repeat((size <= 16) & (size > 1), size)]
            if not len(short):
                continue
            r, key = whole(rows, short), rows["key"][short]
            for gap in range(1, 16):
                i = np.flatnonzero(key[gap:] == key[:-gap])
                if not len(i):
                    break
                j = i + gap
                ok = np.einsum("ij,ij->i", r["unit"][i], r["unit"][j]) >= threshold
                for c in ("label", "t", "code"):
                    ok &= r[c][i] == r[c][j]
                found.append(report(r, i[ok], j[ok], (i[ok], j[ok])))
        return found

    hashed = arrow_pass(classes.select("cid", "label", "v", "m"), hash_all, "key long, cid long, label long, size long, m long, v binary, t long, code long")
    found = checkpoint(in_buckets(hashed, ["cid", "label", "size", "m", "v", "t", "code"], runs, pair, "a long, b long, n long", read, size=n_classes * max((t * (1 + f) for t, f in of.values()), default=0)))
    degree = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b >= 0").select("a", "b"), n_classes).withColumnRenamed("node", "cid")
    full = classes.drop("v").join(degree, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = full.groupBy("component").agg(F.min("rep").alias("component_id"))
    full = full.join(least, "component").select("label", "digest", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "label", "digest").join(full, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
 p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
 reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b),
 c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
