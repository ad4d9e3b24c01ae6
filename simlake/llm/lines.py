"""Line dedup: lines found in many documents go, or stay only where they come first.

A line's key is the line without white space at its ends, A-Z lower-cased. Four passes over the texts, none of which shuffles them:

1. Hashes of each task's keys, packed by slice of the hash range, go to the task of their slice (8 bytes a line). It streams
   them through two Bloom filters: a hash already in the filter of keys seen once enters the filter of those seen twice.
2. The filters of keys seen twice, folded to what they hold, go to every worker. A key in none of them is in a single
   document and is left alone. The others are suspects: they alone are shuffled, as key and number of documents.
3. The exact count of each suspect says which keys go. Keys of more than 32 bytes are compared by their SHA-256.
4. Lines with such keys are taken out of their texts. The HELD most frequent keys are sent to the workers; where there are
   more, the rest are joined with the texts that hold them by the text's digest, so that no key of that join is a hot one.

Slices grow in number with the lines, so each task's filters stay below 2 x 16 MB. The filters that are sent take up to
FILTER_BYTES; past that they are folded further, which makes more keys suspects and changes no result.

Edge cases: a null or empty text is one empty line, a null stays null unless that line goes; keys shorter than ``min_chars``
code points always stay; each row counts as a document, also where its id is null or repeats; ``keep="first"`` leaves the
first line with the key in the documents of the least id (rows that share that id all keep it; where every id is null, each
document keeps its first); texts of any length are split whole; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructType

from .common import as_bytes, checkpoint, ship, spread, table, unused

#: White space that a key sheds at its ends.
WHITE = b" \t\n\v\f\r"

#: Lines of a slice of the hash range, and bits of a filter for each of them.
SLICE_LINES, LINE_BITS = 1 << 21, 8

#: Positions of a hash in a filter.
POSITIONS = 4

#: Bytes of filters that go to every worker.
FILTER_BYTES = 64 << 20

#: Frequent keys that go to every worker.
HELD = 500_000

#: Different keys that a worker gathers before it hands them on.
GATHERED = 1 << 18


def keys_of(raw: bytes | None) -> list[bytes]:
    """The key of each line of a text."""
    return [line.strip(WHITE) for line in (raw or b"").lower().split(b"\n")]  # bytes.lower() touches A-Z only


def token_of(key: bytes) -> bytes:
    """What stands for a key: itself, or 33 bytes that are no UTF-8 text."""
    return key if len(key) <= 32 else b"\xff" + hashlib.sha256(key).digest()


def counted(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def own_keys(raw: bytes | None, min_chars: int) -> list[bytes]:
    """The different keys of a text that count."""
    return [k for k in dict.fromkeys(keys_of(raw)) if counted(k, min_chars)]


def _positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    mask, step = np.uint64(bits - 1), (hashes >> np.uint64(24)) | np.uint64(1)
    for i in range(POSITIONS):
        yield (hashes + np.uint64(i) * step) & mask


def folded(bits: np.ndarray, times: int) -> np.ndarray:
    """A filter of half the size, ``times`` over: a hash has its positions modulo the size, so none is lost."""
    for _ in range(times):
        if len(bits) > 8:
            half = len(bits) // 2
            bits = bits[:half] | bits[half:]
    return bits


def _hashes(docs: DataFrame, text_col: str, slices: int, min_chars: int) -> DataFrame:
    """(slice, hashes): sorted hashes of keys, one for each that a worker met, two for each that it met in several documents."""

    def chunks(met: Counter) -> Iterator[pa.RecordBatch]:
        h = np.fromiter(met.keys(), np.uint64, len(met))
        h = np.sort(np.r_[h, h[np.fromiter(met.values(), np.int64, len(met)) > 1]])
        of = (h >> np.uint64(44)) % np.uint64(slices)
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(h) else []
        parts = [x.tobytes() for x in np.split(h, starts[1:])] if len(h) else []
        yield pa.RecordBatch.from_arrays([pa.array([int(of[s]) for s in starts], pa.int32()), pa.array(parts, pa.binary())], names=["slice", "hashes"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                met.update(map(xxhash.xxh3_64_intdigest, own_keys(raw, min_chars)))
                if len(met) > GATHERED:
                    yield from chunks(met)
                    met.clear()
        yield from chunks(met)

    return spread(docs.select(text_col)).mapInArrow(over, "slice int, hashes binary")


def _twice(hashes: DataFrame, slices: int, bits: int) -> DataFrame:
    """(slice, filter): the Bloom filter of the keys seen twice in each slice, folded while it stays below an eighth full."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None and twice.any():
                small = twice
                while len(small) > 1024 and np.count_nonzero(small) * 16 <= len(small):
                    small = folded(small, 1)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(small).tobytes()], pa.binary())], names=["slice", "filter"])

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != at:
                    yield from done()
                    at, once, twice = s, np.zeros(bits, bool), np.zeros(bits, bool)
                h = np.frombuffer(raw.as_py(), np.uint64)
                again = np.r_[False, h[1:] == h[:-1]]  # several documents of one worker
                known = np.ones(len(h), bool)
                for p in _positions(h, bits):
                    known &= once[p]
                for p in _positions(h[again | known], bits):
                    twice[p] = True
                for p in _positions(h[~known], bits):
                    once[p] = True
        yield from done()

    return hashes.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(build, "slice int, filter binary")


def repeated_keys(docs: DataFrame, text_col: str, min_chars: int = 1) -> tuple[int, dict[int, np.ndarray]]:
    """The number of slices, and for each the Bloom filter of keys that stand in several documents, up to FILTER_BYTES together."""
    lines = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"))) + 1)).first()[0] or 0
    slices = max(1, -(-int(lines) // SLICE_LINES), min(docs.sparkSession.sparkContext.defaultParallelism, int(lines) // 1024))
    bits = 1 << max(10, (LINE_BITS * int(lines) // slices).bit_length())
    filters = checkpoint(_twice(_hashes(docs, text_col, slices, min_chars), slices, bits))
    size, times = int(filters.agg(F.sum(F.length("filter"))).first()[0] or 0), 0
    while size >> times > FILTER_BYTES:
        times += 1

    def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.packbits(folded(np.unpackbits(np.frombuffer(x.as_py(), np.uint8)).view(bool), times)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["slice", "filter"])

    sent = filters.mapInArrow(smaller, filters.schema) if times else filters
    return slices, {r["slice"]: np.frombuffer(bytes(r["filter"]), np.uint8) for r in sent.collect()}


class Suspects:
    """Tells which keys may stand in several documents."""

    def __init__(self, slices: int, filters: dict[int, np.ndarray]):
        self.slices = slices
        self.start = np.full(slices, -1, np.int64)
        self.bits = np.ones(slices, np.uint64)
        parts, at = [], 0
        for s, f in filters.items():
            self.start[s], self.bits[s] = at, 8 * len(f)
            parts.append(f)
            at += len(f)
        self.bytes = np.concatenate(parts) if parts else np.zeros(1, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        of = ((hashes >> np.uint64(44)) % np.uint64(self.slices)).astype(np.int64)
        start, mask = self.start[of], self.bits[of] - np.uint64(1)
        hit, step = start >= 0, (hashes >> np.uint64(24)) | np.uint64(1)
        for i in range(POSITIONS):
            p = ((hashes + np.uint64(i) * step) & mask).astype(np.int64)
            hit &= (self.bytes[np.maximum(start, 0) + (p >> 3)] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return hit


def suspected(raw: list[bytes | None], suspects: Suspects, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(row, key) of the suspected keys of texts, each once a text."""
    keys = [own_keys(r, min_chars) for r in raw]
    flat = [k for own in keys for k in own]
    rows = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
    hit = suspects(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)))
    for i in np.flatnonzero(hit):
        yield int(rows[i]), flat[i]


def frequent_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", known: tuple[int, dict[int, np.ndarray]] | None = None) -> DataFrame:
    """(token, docs, first): the keys found in ``min_docs`` documents, with the least id among these."""
    if min_docs < 2:
        raise ValueError("min_docs is at least 2: keys of a single document are not looked at")
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(known or repeated_keys(docs, text_col, min_chars))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects, met = Suspects(*sent.value), {}

        def out() -> pa.RecordBatch:
            made = [pa.array(met, pa.binary()), pa.array([n for n, _ in met.values()], pa.int64()), pa.array([f for _, f in met.values()], id_type)]
            return pa.RecordBatch.from_arrays(made, names=["token", "docs", "first"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = part.column(0).to_pylist()
                for row, key in suspected(as_bytes(part.column(1)), suspects, min_chars):
                    token, own = token_of(key), ids[row]
                    n, first = met.get(token, (0, None))
                    met[token] = n + 1, own if first is None else first if own is None else min(own, first)
                if len(met) > GATHERED:
                    yield out()
                    met.clear()
        yield out()

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = to_arrow_type(own.schema["id"].dataType)
    found = spread(own).mapInArrow(over, f"token binary, docs long, first {own.schema['id'].dataType.simpleString()}")
    return checkpoint(found.groupBy("token").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs))


def _holding(docs: DataFrame, text_col: str, rest: DataFrame, known: tuple[int, dict[int, np.ndarray]], min_chars: int) -> DataFrame:
    """(digest, lost): for each different text that holds keys of ``rest``, those keys."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = Suspects(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                raw = as_bytes(batch.slice(at, 200).column(0))
                found = [(hashlib.sha256(raw[row] or b"").digest(), token_of(key)) for row, key in suspected(raw, suspects, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([t for _, t in found], pa.binary())], names=["digest", "token"])

    pairs = spread(docs.select(text_col)).mapInArrow(over, "digest binary, token binary")
    return pairs.join(rest.select("token", "first"), "token").groupBy("digest").agg(F.collect_set(F.struct("token", "first")).alias("lost"))


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped", held: int = HELD) -> DataFrame:
    """``docs`` without the lines whose keys are found in ``min_docs`` documents, and the numbers of lines before and of those dropped.

    ``keep="first"`` leaves the first line with each such key. ``held`` keys at most go to every worker.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    if {lines_col.lower(), dropped_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {lines_col} or {dropped_col}: name others")
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    known = repeated_keys(docs, text_col, min_chars)
    frequent = frequent_keys(docs, min_docs, min_chars, id_col, text_col, known)
    n = frequent.count()
    top = frequent.orderBy(F.desc("docs"), "token").limit(held).collect()
    sent = sc.broadcast({bytes(r["token"]): r["first"] for r in top})
    lost, work = unused(docs, "lost"), docs
    if n > held:
        rest = frequent
        if top:
            least, token = top[-1]["docs"], F.lit(top[-1]["token"])
            rest = frequent.where((F.col("docs") < least) | ((F.col("docs") == least) & (F.col("token") > token)))
        holding = _holding(docs, text_col, rest, known, min_chars).withColumnRenamed("lost", lost)
        digest = unused(docs, "digest")
        work = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
        work = work.join(holding.withColumnRenamed("digest", digest), digest, "left").drop(digest).select(*docs.columns, lost)
    text_at, id_at, first_stays = docs.columns.index(text_col), docs.columns.index(id_col), keep == "first"
    schema = StructType([*docs.schema.fields]).add(lines_col, LongType()).add(dropped_col, LongType())

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                more = batch.column(len(schema) - 2).to_pylist() if batch.num_columns > len(schema) - 2 else [None] * batch.num_rows
                texts, n_lines, n_dropped = [], [], []
                for own, raw, extra in zip(batch.column(id_at).to_pylist(), as_bytes(batch.column(text_at)), more):
                    goes = held_keys if not extra else {x["token"]: x["first"] for x in extra}
                    lines, keys, seen, stay = (raw or b"").split(b"\n"), keys_of(raw), set(), []
                    for line, key in zip(lines, keys):
                        token = token_of(key)
                        known_as = goes if token in goes else held_keys
                        if token not in known_as or not counted(key, min_chars):
                            stay.append(line)
                        elif first_stays and known_as[token] in (own, None) and token not in seen:
                            stay.append(line)
                            seen.add(token)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    texts.append(raw if len(stay) == len(lines) else b"\n".join(stay))
                made = [pa.array(texts, pa.binary()).cast(pa.string()).cast(batch.column(i).type) if i == text_at else batch.column(i) for i in range(len(schema) - 2)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    return spread(work).mapInArrow(strip, schema)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), often AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), marked AS (
  SELECT k.*, often.key IS NOT NULL AS lost FROM k LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""
