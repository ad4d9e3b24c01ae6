"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has 64 bits, by majority over the XXH64 values of all 4-word shingles. Fingerprints link when they differ in at
most DISTANCE bits. The 64 bits are cut into DISTANCE // 2 + 1 segments, so that two linked fingerprints have a segment
that differs in one bit at most. Each distinct fingerprint is indexed under every segment as it is, and under every segment
with one bit left out; equal keys meet in a shuffle, and each meeting is verified over all 64 bits. The variants without bit
b only compare fingerprints that differ in b, so a pair meets once a segment.

Fingerprints are made distinct before anything is compared: a group of equal texts is one row in the index, however large.
A bucket's links are reported as a spanning forest, which keeps every component and grows with the bucket, not with its
pairs; buckets past graph.BLOCK are dealt out in pairs of blocks.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; a text with fewer than SHINGLE
words is one shingle; texts of any length are read whole, their shingles in slices; a bit that is set in exactly half of the
shingles is 0; repeated rows stay and share a component; a null doc_id keeps its row, and its component is the smallest id
it reaches, null if there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_pass, as_bytes, checkpoint, fits, table, unused, written
from .graph import components, forest, in_buckets

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Rows that stay, up to which their numbers are broadcast to the texts.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []  # ASCII case and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = [digest(view[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the values; counted in slices of bounded memory."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_pass(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), each, "doc_id long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the distance // 2 + 1 segments."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _variants(fp: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    """Keys (fingerprints x variants): number of the variant in the high bits, the segment without the left-out bit below."""
    u, keys, number = fp.view(np.uint64), [], 0
    for first, bits in cut:
        seg = (u >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for left_out in [0, *(1 << b for b in range(bits))]:
            keys.append((np.uint64(number) << np.uint64(40)) | (seg & ~np.uint64(left_out)))
            number += 1
    return np.stack(keys, 1).astype(np.int64)


def links(distinct: DataFrame, distance: int = DISTANCE, size: int = 0) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp``, about ``size`` of them: they connect exactly what links at ``distance`` bits connect."""
    cut = segments(distance)
    if max(b for _, b in cut) > 39:
        raise ValueError("segments of more than 39 bits: distance must be 2 or more")
    masks = np.array([m for first, bits in cut for m in [0, *(1 << (first + b) for b in range(bits))]], np.uint64)

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = batch.column(0).to_numpy()
        keys = _variants(fp, cut)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, keys.shape[1]))], names=["key", "fp"])

    def near(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Within the distance; the variant without a bit is for pairs that differ in it."""
        x = a ^ b
        return (np.bitwise_count(x) <= distance) & ((mask == 0) | (x & mask != 0))

    def mask_of(key: np.ndarray) -> np.ndarray:
        return masks[key >> 40]

    def pair(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        fp = left["fp"] if right is None else np.concatenate([left["fp"], right["fp"]])
        mask, split = mask_of(left["key"][0]), len(left["fp"])
        across = (lambda i, o: near(mask, fp[i], fp[o])) if right is None else (lambda i, o: near(mask, fp[i], fp[o]) & ((o < split) != (i < split)))
        a, b = forest(across, len(fp))
        return {"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)}

    def runs(rows: dict[str, np.ndarray], starts: np.ndarray) -> list[dict[str, np.ndarray]]:
        key, fp, found = rows["key"], rows["fp"], []
        size = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[size > 24], size[size > 24]):
            found.append(pair({"key": key[s : s + n], "fp": fp[s : s + n]}, None))
        short = np.repeat(size <= 24, size)
        k, f = key[short], fp[short]
        for gap in range(1, 24):
            same = np.flatnonzero(k[gap:] == k[:-gap])
            if not len(same):
                break
            hit = same[near(mask_of(k[same]), f[same], f[same + gap])]
            found.append({"a": f[hit].view(np.int64), "b": f[hit + gap].view(np.int64)})
        return found

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"key": batch.column(0).to_numpy(), "fp": batch.column(1).to_numpy().view(np.uint64)}

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows become many, so they are dealt out first
    keyed = arrow_pass(distinct.select("fp").repartition(n, "fp"), spread, "key long, fp long")
    return in_buckets(keyed, ["fp"], runs, pair, "a long, b long", read, size=size * len(masks))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    own = checkpoint(fingerprints(docs, id_col, text_col))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    n = distinct.count()
    of = components(links(distinct, distance, n), n).withColumnRenamed("node", "fp")
    named = distinct.join(of, "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest id, a null id only if there is no other."""
    at, names = docs.columns.index(text_col), docs.columns
    row, own_fp = unused(docs, "~row"), unused(docs, "~fp")
    schema = StructType([StructField(row, LongType()), StructField(own_fp, LongType()), *docs.schema.fields])

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t) for t in as_bytes(batch.column(at))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(fp), pa.int64()), pa.array(fp), *batch.columns], names=[row, own_fp, *names])

    marked = written(arrow_pass(docs, each, schema).withColumn(row, F.monotonically_increasing_id()))
    own = marked.select(F.col(f"`{row}`").alias("row"), F.col(f"`{own_fp}`").alias("fp"), F.col(id_col).alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    distinct = own.groupBy("fp").agg(first)
    n = distinct.count()
    of = components(links(distinct, distance, n), n).withColumnRenamed("node", "fp")
    best = distinct.join(of, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    stay = checkpoint(best.select(F.col("first.row").alias(row)))
    return marked.join(F.broadcast(stay) if fits(stay, F.lit(1), BROADCAST_ROWS) else stay, row, "left_semi").select(*(f"`{c}`" for c in names))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
