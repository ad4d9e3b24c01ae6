"""Benchmark decontamination: an Aho-Corasick automaton over normalised test items scans each text once.

Normal form: A-Z lower-cased, words are runs of ``[0-9a-z]`` and non-ASCII characters. A window is WINDOW consecutive words
of an item; an item with fewer words, but not none, is one window. The automaton's symbols are words: each word of the
benchmark has a code of a few characters whose first can only begin a code, any other word of a text has the code of no
pattern, so matches begin and end at words and their places are counted in words. Word ranges are mapped back to the
code points of the original text.

An automaton has at most NODES nodes, which bounds a worker's memory and each broadcast at every size of the benchmark. A
larger benchmark is cut into runs of words that overlap by a window less a word, and these are dealt out to as many
automata as they need; texts are scanned once for each, and the ranges and items of a text are merged. The result does not
depend on the cut.

Edge cases: null or empty text has no words and no hits; null or wordless items have no windows; repeated items count
once by item_id; repeated documents give repeated rows; texts and items of any length are read whole; an empty table gives
an empty result (documents) or no hits (benchmark); windows that tie at a place all count; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.operators.order import running_total

from .common import arrow_pass, as_bytes, checkpoint, fits, table, unused, with_lengths, written

WINDOW = 8
#: Most nodes of one automaton; some 40 bytes each.
NODES = 5_000_000
#: Words of an item that stay together when a benchmark is cut.
PIECE = 4096
#: Rows and spans of documents with hits up to which they are broadcast to the texts.
BROADCAST_HITS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
#: Characters at each place of a code; their number bounds the children of a node.
BASE = 128


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """The windows of an item or of a run of its words."""
    for i in range(max(len(words) - window, 0) + 1 if words else 0):
        yield tuple(words[i : i + window])


class Codes(dict):
    """The code of each word of a benchmark; that of any other word occurs in no pattern."""

    def __init__(self, words: set[bytes]):
        self.width = 1
        while BASE**self.width < len(words):
            self.width += 1
        for n, w in enumerate(sorted(words)):
            places = []
            for k in range(self.width):
                n, digit = divmod(n, BASE)
                places.append(chr(BASE * (k + 1) + digit))
            self[w] = "".join(places)
        self.unknown = "\0" * self.width

    def __missing__(self, word: bytes) -> str:
        return self.unknown

    def line(self, words: list[bytes] | tuple[bytes, ...]) -> str:
        return "".join(map(self.__getitem__, words))


class Scanner:
    """One automaton over the windows of ``items``: (item, text), where a text may be a run of the item's words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        lists = [(item, words_of(text)) for item, text in items]
        self.codes = Codes({w for _, words in lists for w in words})
        owners: dict[str, set[str]] = {}
        for item, words in lists:
            for w in windows_of(words, window):
                owners.setdefault(self.codes.line(w), set()).add(item)
        self.found, known = ahocorasick.Automaton(), {}
        for line, who in owners.items():
            value = (len(line) // self.codes.width, frozenset(who))
            self.found.add_word(line, known.setdefault(value, value))
        if owners:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges under hits (end exclusive), and the items with occurring windows."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not words or not len(self.found):
            return ranges, items
        width, last = self.codes.width, None
        for end, (n, who) in self.found.iter(self.codes.line(words)):
            stop = (end + 1) // width
            start = stop - n
            while ranges and ranges[-1][1] >= start:
                low, high = ranges.pop()
                start, stop = min(start, low), max(stop, high)
            ranges.append((start, stop))
            if who is not last:
                items |= who
                last = who
        return ranges, items


_SCANNERS: dict[str, Scanner] = {}


def _scanner(run: str, items: list[tuple[str, bytes]], window: int) -> Scanner:
    """The worker's scanner of a run; one at a time is kept."""
    if run not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[run] = Scanner(items, window)
    return _SCANNERS[run]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(items: DataFrame, window: int, piece: int) -> DataFrame:
    """(item, at, text, nodes): each item's words in runs of ``piece``, with the window less a word that follows; and the most nodes that a run can add, at three characters a code."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_of(text)
            for at in range(0, max(len(words) - window + 1, min(len(words), 1)), piece):
                run = words[at : at + piece + window - 1]
                rows.append((item, at, b" ".join(run).decode(), 3 * window * (max(len(run) - window, 0) + 1)))
        columns = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["item", "at", "text", "nodes"])

    return arrow_pass(items, each, "item string, at long, text string, nodes long").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, nodes: int = NODES, piece: int = PIECE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words under hits), item_ids (sorted as strings), spans (code points of the original text)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = checkpoint(_pieces(items, window, piece))
    if not fits(pieces, F.col("nodes"), nodes):
        return _by_several(own, pieces, window, nodes)
    rows = [(r["item"], r["text"].encode()) for r in pieces.collect()]
    sent, run = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _scanner(run, sent.value, window)
        yield _result(batch.column(0), as_bytes(batch.column(1)), lambda words, _: own.scan(words))

    return arrow_pass(own, each, _SCHEMA)


def _result(ids: pa.Array, texts: list[bytes | None], hits) -> pa.RecordBatch:  # noqa: ANN001
    """The result's rows; ``hits(words, i)`` gives the ranges and the items of text i."""
    n_words, n_hit, found, spans = [], [], [], []
    for i, text in enumerate(texts):
        words = words_of(text or b"")
        ranges, who = hits(words, i)
        n_words.append(len(words))
        n_hit.append(sum(b - a for a, b in ranges))
        found.append(sorted(who))
        spans.append(_original(text, ranges))
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])


def _by_several(own: DataFrame, pieces: DataFrame, window: int, nodes: int) -> DataFrame:
    """The same result with as many automata as the benchmark needs, one after the other: the driver holds one automaton's items at a time, and each scan leaves only the texts with hits."""
    dealt = running_total(pieces, ["item", "at"], "upto", F.col("nodes"))
    dealt = checkpoint(dealt.withColumn("shard", F.floor((F.col("upto") - F.col("nodes")) / nodes)))
    shards = int(dealt.agg(F.max("shard")).first()[0]) + 1
    own = written(own.withColumn("row", F.monotonically_increasing_id()))
    hits = None
    for shard in range(shards):
        rows = [(r["item"], r["text"].encode()) for r in dealt.where(F.col("shard") == shard).collect()]
        if not rows:
            continue
        sent, run = own.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def each(batch: pa.RecordBatch, sent=sent, run=run) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            scanner, found = _scanner(run, sent.value, window), []
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ranges, who = scanner.scan(words_of(text or b""))
                if ranges:
                    found.append((row, [a for a, _ in ranges], [b for _, b in ranges], sorted(who)))
            columns = zip(*found) if found else ([], [], [], [])
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["row", "starts", "ends", "items"])

        part = checkpoint(arrow_pass(own.select("row", "text"), each, "row long, starts array<int>, ends array<int>, items array<string>"))
        sent.destroy()
        hits = part if hits is None else hits.unionAll(part)
    of = hits.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    of = checkpoint(of)
    joined = own.join(F.broadcast(of) if fits(of, F.lit(1) + F.size("starts"), BROADCAST_HITS) else of, "row", "left").select("doc_id", "text", "starts", "ends", "items")

    def join(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts, ends, items = (batch.column(c).to_pylist() for c in ("starts", "ends", "items"))
        yield _result(batch.column(0), as_bytes(batch.column(1)), lambda _, i: (merged(list(zip(starts[i] or [], ends[i] or []))), set(items[i] or [])))

    return arrow_pass(joined, join, _SCHEMA)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _original(text: bytes | None, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as offsets of the text as it came; only texts with hits are walked again."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer((text or b"").decode())]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", most_items: int = 1, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without rows that hold windows of more than ``most_items`` items; of the others, hit passages are cut out."""
    row, items, at = (unused(docs, c) for c in ("~row", "~items", "~spans"))
    own = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = contamination(own, benchmark, row, text_col, item_col, item_text_col).where("n_hit > 0")
    found = checkpoint(found.select(F.col("doc_id").alias(row), F.size("item_ids").alias(items), F.col("spans").alias(at)))
    hits = F.broadcast(found) if fits(found, F.lit(1) + F.size(at), BROADCAST_HITS) else found
    joined = own.join(hits, row, "left").where(F.coalesce(F.col(items), F.lit(0)) <= most_items)
    text = F.aggregate(at, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])).alias("out")), lambda acc: F.concat(acc["out"], F.substr(F.col(text_col), acc["at"] + 1)))
    kept = joined.withColumn(text_col, F.when(F.col(at).isNotNull(), text).otherwise(F.col(text_col))).select(*(f"`{c}`" for c in docs.columns))
    return with_lengths(kept, text_col, length_col)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format("text")} AS w FROM benchmark),
 place AS (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM i WHERE len(w) > 0),
 win AS (SELECT DISTINCT item, array_to_string(w[k : least(k + 7, len(w))], ' ') AS win, least(len(w), 8) AS n FROM place),
 sizes AS (SELECT DISTINCT n FROM win),
 d AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
 pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
 h AS (SELECT doc_id, k, win.n, item FROM pos JOIN win ON win.n = pos.n AND win.win = array_to_string(pos.w[k : k + pos.n - 1], ' ')),
 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, str, int]:
    """n_words, n_hit, items_sha256, n_items by comparing every position with every window."""
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, who = lower(text), set(), set()
    for item, body in items:
        own = lower(body)
        for i in range(max(len(own) - window, 0) + 1 if own else 0):
            w = own[i : i + window]
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    who.add(str(item))
    return len(words), len(hit), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(who)
