"""Packing by power-of-two decomposition.

A document's tokens and its end mark are cut, in order, into pieces whose lengths are the binary digits of the total:
LONGEST-token pieces first, then the rest from the largest power of two down. Each piece is a sequence of its own, so no
sequence crosses documents and none is padded. Sequences of equal length form a bucket: each task holds one open batch a
bucket, fills it with sequences of that length up to BATCH_TOKENS, and hands it on whole, so the rows of a batch stand
together. A task's last batch of a bucket may hold less. Nothing is shuffled: a document is cut where it is read, and a task
holds at most one batch a bucket.

Tokens come from the ``tokenizers`` library. A pass over a text in plain Latin script cuts it into the tokenizer's own
pre-tokens and asks its model once for each distinct pre-token (a bounded cache); any other text, and any text under a
tokenizer that normalises or cuts otherwise, goes to the whole tokenizer.

Edge cases: null and empty texts have the end mark only, one piece of length 1; texts of any length are cut whole; repeated
rows are packed as often as they occur, each under its own sequence_id; a null doc_id stays null; an empty table gives an
empty result; other columns are ignored. sequence_id and batch_id are unique within a run, and the same again for the same
files and splits; no two pieces tie for a place.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, ship, spread, table

LONGEST = 4096
END = 2
#: Tokens of a batch of equal sequences.
BATCH_TOKENS = 1 << 16
#: Distinct pre-tokens that a worker remembers.
CACHE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(total: int, longest: int = LONGEST) -> list[int]:
    """Lengths that add up to ``total``: as many of ``longest`` as fit, then the binary digits of the rest, falling."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


#: What a text may hold for the quick path: ASCII without most controls, Latin letters and signs that normalise to themselves and whose lower case is below U+0250 too.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e" + "".join(chr(c) for c in range(0xA1, 0x250) if c != 0x130 and chr(c).lower() < "\u0250") + "]*")
_LETTERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


# What the quick path does before the model, as a tokenizer's file says it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def is_known(tokenizer: str) -> bool:
    """Whether the quick path does what the tokenizer (as JSON) does before its model, and its added tokens all begin with ``<|``."""
    told = json.loads(tokenizer)
    return told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and not told.get("truncation") and all(t["content"].startswith("<|") for t in told["added_tokens"])


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit numbers. As a mapping: pre-token -> its ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.chars = self.whole.model, _byte_chars()
        self.known = is_known(self.whole.to_str())

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        spelled = piece if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))
        self[piece] = ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PRE_TOKEN.findall(text.lower())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Callable[[str | None], bytes]:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path].encode


class Buckets:
    """The open batches of a task, one for each length."""

    def __init__(self, tokens: int):
        self.tokens, self.open, self.sizes = tokens, {}, {}

    def add(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows, (doc_id, start, length, ids, doc_tokens), go to their buckets; batches that are full come out."""
        for row in rows:
            held = self.open.setdefault(row[2], [])
            held.append(row)
            if len(held) * row[2] >= self.tokens:
                yield self.open.pop(row[2])

    def rest(self) -> Iterator[list[tuple]]:
        for length in sorted(self.open, reverse=True):
            yield self.open[length]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = LONGEST, end: int = END, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """A row a piece: doc_id, start, length, bucket (log2 of the length), ids (binary), doc_tokens, sequence_id, offset, batch_id. A batch has up to ``batch_tokens`` tokens in sequences of one length."""
    path = tokenizer or default_tokenizer()
    mark = np.array([end], "<u4").tobytes()
    pieces(1, longest)
    ship(docs.sparkSession)

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        encode = encoder(path)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = encode(text) + mark
            n, at = len(own) // 4, 0
            for k in pieces(n, longest):
                yield doc, at, k, own[4 * at : 4 * (at + k)], n
                at += k

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, number = Buckets(batch_tokens), 0

        def made(full: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal number
            size = [len(b) for b in full]
            doc, start, length, ids, total = zip(*(row for b in full for row in b))
            batch = number + np.repeat(np.arange(len(full)), size)
            number += len(full)
            bucket = np.log2(np.array(length)).astype(np.int32)
            arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(bucket), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(batch, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "bucket", "ids", "doc_tokens", "batch"])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                if full := list(buckets.add(cut(batch.slice(at, BATCH_ROWS)))):
                    yield made(full)
        if full := list(buckets.rest()):
            yield made(full)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = spread(own).mapInArrow(all_of, "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long, batch long")
    batch_id = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("batch")
    return found.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("batch_id", batch_id).drop("batch")


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces with their buckets and batches, and a checksum in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))
