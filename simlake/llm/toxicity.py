"""Toxicity by class-conditional Kneser-Ney models.

Texts are sequences of symbols: a to z, the digits, letters and marks of all other scripts (4059 symbols, which code points of
one script share only past that many), and one boundary for a run of anything else. Each class (toxic, ordinary) has its own
counts of ORDER-symbol sequences, discounted; what the discount frees goes to one backoff model that both share, built from
continuation counts of the shorter orders. A sequence that is rare in a class so leans on what both know. The log-likelihood
ratio of the classes is normalised by length, over the whole text and over each word; logistic regression on held-apart
rows turns the two into a score.

The counts cover all labelled rows of folds 0, 1 and 3 and grow with them. Counts, backoff and ratios are made by shuffles
in tasks; no window holds more than the 4096 sequences of one context. Texts are scored with an index of the sequences and
contexts, ten bytes each, that is broadcast. Past SEQUENCES the index is cut by ranges of keys into pages of that many. Every
sequence and every context lies in the page of its range, a worker holds one page at once, and each text is asked of all
pages, so the scores are those of one index.

Calibration reads at most CALIBRATION rows of each class from fold 3, measured by a model of folds 0 and 1 alone; the
final model then counts fold 3 too. Both come from one pass over the counts. Fold 2 is never learned from.

Edge cases: null and empty texts score as a text without evidence; texts of any length are read whole; labels that are null
are ignored, repeated labels of a document count once, as toxic if any says so; without rows of both classes every score is
0; texts that tie have one score; repeated documents give repeated results; a null doc_id is scored, but not learned from;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_pass, checkpoint, fits, fold, least, ship, spread, table

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
DISCOUNT = 0.75
CALIBRATION = 3000
#: Most sequences of a page of the index that scores texts. With 5.3 million contexts a worker took up to 1053 MB to build a full one. Contexts are fewer.
SEQUENCES = 16_000_000
#: Characters of texts that a worker gathers before it goes through the pages of an index that has several.
GATHERED = 16_000_000
#: Labelled rows up to which the labels are broadcast to the texts; beyond, both are shuffled.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
#: A word's ratio counts as evidence from this many nats a symbol on.
EVIDENCE = 0.5

_SYMBOLS: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 boundary, 1 to 26 a to z, 27 to 36 digits, from 37 on other letters and marks."""
    if not _SYMBOLS:
        of = np.zeros(0x110000, np.uint16)
        for c in range(128, 0x33000):
            if unicodedata.category(chr(c))[0] in "LM":
                of[c] = 37 + c % (SYMBOLS - 37)
        for c in range(26):
            of[65 + c] = of[97 + c] = 1 + c
        of[48:58] = np.arange(27, 37)
        _SYMBOLS.append(of)
    return _SYMBOLS[0]


#: Characters whose arrays a worker holds at once; a longer text is a part of its own.
PART = 2_000_000


def parts(texts: list[str | None], most: int = PART) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of up to ``most`` characters together, each with the place of its first."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the ORDER symbols that end at each place, the text of each place, and the symbols themselves."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(t + " " for t in lower).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) + 1 for t in lower], np.int64)
    text = np.repeat(np.arange(len(lower), dtype=np.int32), size)
    symbol = _symbols()[points]
    last = np.r_[np.uint16(0), symbol[:-1]]
    keep = (symbol != 0) | (last != 0)
    symbol, text = symbol[keep].astype(np.int64), text[keep]
    if not len(symbol):
        return symbol, text, symbol
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    place = np.arange(len(text)) - np.repeat(start, np.diff(np.r_[start, len(text)]))
    key = symbol.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(place[k:] >= k, symbol[:-k], 0) << (BITS * k)
    return key, text, symbol


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The keys' bits mixed, one to one."""
    h = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Index:
    """Values of distinct keys, found by the top bits of their mixed form."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = _mixed(keys)
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order]
        self.bits = max(len(keys), 2).bit_length()
        self.start = np.searchsorted(self.mixed >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's value, -1 where it has none."""
        h = _mixed(keys)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out, open_ = np.full(len(keys), -1, np.int32), np.flatnonzero(at < end)
        while len(open_):
            place = at[open_]
            hit = self.mixed[place] == h[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


@dataclass
class Ratios:
    """Log ratio of the classes for every sequence that was seen, and for every context (the place of a sequence that was not), of the page of keys from ``first`` to before ``end``."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    first: int = 0
    end: int = 1 << BITS * ORDER


class Lookup:
    """The ratio of every sequence of the page: its own if it was seen, else that of its context, else none; 0 for those of other pages."""

    def __init__(self, ratios: Ratios):
        self.first, self.end = ratios.first, ratios.end
        self.sequences, self.contexts = Index(ratios.keys, ratios.ratio), Index(ratios.contexts, ratios.context_ratio)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.sequences.values):
            return np.zeros(len(keys))
        place = self.sequences.find(keys)
        out = self.sequences.values[place].astype(np.float64)
        out[place < 0] = 0
        unseen = np.flatnonzero((place < 0) & (keys >= self.first) & (keys < self.end))
        context = self.contexts.find(keys[unseen] >> BITS)
        out[unseen] = np.where(context < 0, 0, self.contexts.values[context])
        return out


def _without_first(key: str, order: int) -> Column:
    """A sequence of ``order`` symbols less its first."""
    return F.col(key).bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def shared_backoff(sequences: DataFrame, models: list[str], order: int = ORDER) -> DataFrame:
    """The backoff of ``sequences(key, in_MODEL ..)``, where in_MODEL is 1 for the sequences of a model and else 0: (key, lower_MODEL ..) for the sequences less their first symbols.

    It is the probability of the last symbol after those before it, by continuation counts of both classes.
    """
    levels = []
    for n in range(order, 1, -1):
        seen = [F.sum(f"in_{m}").alias(f"seen_{m}") for m in models]  # distinct symbols before each
        types = sequences.groupBy(_without_first("key", n).alias("key")).agg(*seen)
        sequences = checkpoint(types.select("*", *((F.col(f"seen_{m}") > 0).cast("long").alias(f"in_{m}") for m in models)))
        levels.append(sequences)
    context, lower = Window.partitionBy(F.shiftright("key", BITS)), None
    for n, types in zip(range(1, order), reversed(levels)):
        if n == 1:
            below = types.select("*", *(F.lit(1 / SYMBOLS).alias(f"lower_{m}") for m in models))
        else:
            below = types.withColumn("~next", _without_first("key", n)).join(lower.withColumnRenamed("key", "~next"), "~next")
        p = lambda m: F.try_divide(F.greatest(F.col(f"seen_{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.sum(f"in_{m}").over(context) * F.col(f"lower_{m}"), F.sum(f"seen_{m}").over(context))
        lower = below.select("key", *(F.coalesce(p(m), F.lit(0.0)).alias(f"lower_{m}") for m in models))
    return lower


def ratios(counts: DataFrame, models: list[str]) -> DataFrame:
    """The Kneser-Ney models of both classes over ``counts(key, toxic_MODEL, ordinary_MODEL ..)``: (key, context, ratio_MODEL, free_MODEL ..) with the log ratios of the sequences, null for those a model has not, and of their contexts."""
    own = counts.select("*", *((F.col(f"toxic_{m}") + F.col(f"ordinary_{m}") > 0).cast("long").alias(f"in_{m}") for m in models))
    lower = shared_backoff(own.select("key", *(f"in_{m}" for m in models)), models).withColumnRenamed("key", "~next")
    known = own.withColumn("~next", _without_first("key", ORDER)).join(lower, "~next").withColumn("context", F.shiftright("key", BITS))
    context, classes = Window.partitionBy("context"), [(m, c) for m in models for c in ("toxic", "ordinary")]
    known = known.select("*", *(F.sum(f"{c}_{m}").over(context).alias(f"total_{c}_{m}") for m, c in classes), *(F.sum((F.col(f"{c}_{m}") > 0).cast("int")).over(context).alias(f"kinds_{c}_{m}") for m, c in classes))
    known = known.select("*", *(F.when(F.col(f"total_{c}_{m}") > 0, DISCOUNT * F.col(f"kinds_{c}_{m}") / F.greatest(f"total_{c}_{m}", F.lit(1))).otherwise(1.0).alias(f"free_{c}_{m}") for m, c in classes))
    log = lambda m, c: F.log(F.greatest(F.col(f"{c}_{m}") - DISCOUNT, F.lit(0.0)) / F.greatest(f"total_{c}_{m}", F.lit(1)) + F.col(f"free_{c}_{m}") * F.col(f"lower_{m}"))
    columns = [x for m in models for x in (F.when(F.col(f"in_{m}") > 0, log(m, "toxic") - log(m, "ordinary")).alias(f"ratio_{m}"), (F.log(f"free_toxic_{m}") - F.log(f"free_ordinary_{m}")).alias(f"free_{m}"))]
    return known.select("key", "context", *columns)


def _own(found: DataFrame, model: str) -> DataFrame:
    """(key, context, ratio, free) of the sequences that a model has."""
    return found.where(F.col(f"ratio_{model}").isNotNull()).select("key", "context", F.col(f"ratio_{model}").cast("float").alias("ratio"), F.col(f"free_{model}").cast("float").alias("free"))


def _bounds(found: DataFrame, model: str, most: int) -> list[int]:
    """The first key of each page and the end of the last: pages of ``most`` of the model's sequences in the order of their keys, the last of what is left."""
    own, span = _own(found, model), 1 << BITS * ORDER
    if own.count() <= most:
        return [0, span]
    ordered = checkpoint(own.select("key").orderBy("key").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # the task, and the row in it
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = F.create_map(*(F.lit(x).cast("long") for (p, _), n in zip(sizes, accumulate((n for _, n in sizes), initial=0)) for x in (p, n)))
    firsts = sorted(r["key"] for r in ordered.where((before[part] + place) % most == 0).select("key").collect())
    return [0, *firsts[1:], span]


def _collected(found: DataFrame, model: str, most: int, page: int = 0, bounds: list[int] | None = None) -> Ratios:
    """A page of a model's ratios; there is one of all sequences up to ``most``."""
    first, end = (bounds or _bounds(found, model, most))[page : page + 2]
    own, start = _own(found, model), F.shiftleft("context", BITS)
    of_keys = own.where((F.col("key") >= first) & (F.col("key") < end)).select("key", "ratio").toArrow()
    of_contexts = own.where((start + (SYMBOLS - 1) >= first) & (start < end)).groupBy("context").agg(F.first("free").alias("ratio")).toArrow()
    columns = [t.column(c).to_numpy() for t, names in ((of_keys, ("key", "ratio")), (of_contexts, ("context", "ratio"))) for c in names]
    return Ratios(columns[0], columns[1].astype(np.float16), columns[2], columns[3].astype(np.float16), first, end)


def features(texts: list[str | None], lookup: Lookup) -> np.ndarray:
    """(texts, 3): the ratio a symbol of the whole text, that of its most toxic word, and the log of 1 + the words above EVIDENCE."""
    return np.concatenate([np.zeros((0, 3)), *(_features(run, lookup.of) for _, run in parts(texts))])


def paged_features(texts: list[str | None], pages: Iterable[Lookup]) -> np.ndarray:
    """The same by the pages of an index; all texts are asked of a page before the next is taken."""
    runs = [run for _, run in parts(texts)]
    ratios = [np.zeros(0, np.float16)] * len(runs)
    for page in pages:
        for i, run in enumerate(runs):
            own = page.of(sequences(run)[0]).astype(np.float16)
            ratios[i] = ratios[i] + own if len(ratios[i]) else own  # but one of the pages say 0
    return np.concatenate([np.zeros((0, 3)), *(_features(run, lambda key, r=r: r.astype(np.float64)) for run, r in zip(runs, ratios))])


def _features(texts: list[str | None], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    key, text, symbol = sequences(texts)
    out = np.zeros((len(texts), 3))
    if not len(key):
        return out
    r = of(key)
    n = np.bincount(text, minlength=len(texts))
    out[:, 0] = np.bincount(text, r, len(texts)) / np.maximum(n, 1)
    start = np.flatnonzero(np.r_[True, (symbol[:-1] == 0) | (text[1:] != text[:-1])])  # a word has its closing boundary
    length = np.diff(np.r_[start, len(key)])
    word, owner = np.add.reduceat(r, start) / (length + 1), text[start]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out[owner[first], 1] = np.maximum.reduceat(word, first)
    out[:, 2] = np.log1p(np.bincount(owner, word > EVIDENCE, len(texts)))
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and coefficients (bias last) by Newton's method."""
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * (len(w) - 1) + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def _by_class(docs: DataFrame, labels: DataFrame, folds: list[int]) -> DataFrame:
    """(text, toxic, held) of the labelled documents in the folds; held is 1 in fold 3, from which the calibration rows come."""
    own = docs.where(fold(F.col("doc_id")).isin(folds))
    labels = labels.where(fold(F.col("doc_id")).isin(folds))
    return own.join(F.broadcast(labels) if fits(labels, F.lit(1), BROADCAST_LABELS) else labels, "doc_id").select("text", "toxic", (fold(F.col("doc_id")) == 3).cast("int").alias("held"))


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    labels, held = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    for start, run in parts(batch.column(0).to_pylist()):
        key, text, _ = sequences(run)
        yield _counts(key, labels[start + text], held[start + text])


def _counts(key: np.ndarray, label: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    keys, counts = np.unique(key * 4 + held * 2 + label, return_counts=True)
    toxic = np.where(keys & 1, counts, 0)
    return pa.RecordBatch.from_arrays([pa.array(keys >> 2), pa.array((keys >> 1 & 1).astype(np.int32)), pa.array(toxic), pa.array(counts - toxic)], names=["key", "held", "toxic", "ordinary"])


@dataclass
class Scorer:
    ratios: Ratios
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: The pages after the first.
    more: list[Broadcast] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_LOOKUPS: dict[str, Lookup] = {}


def _with(run: str, sent: Ratios) -> Lookup:
    if run not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[run] = Lookup(sent)
    return _LOOKUPS[run]


def _loaded(sent: Broadcast) -> Ratios:
    """A page read from its file, which ``value`` would keep."""
    path = getattr(sent, "_path", None)  # an encrypted broadcast has none
    return sent.value if path is None else sent.load_from_path(path)


def _sent(found: DataFrame, model: str, most: int) -> tuple[Ratios, list[Broadcast]]:
    """The first page, and the others as they are broadcast; the driver holds two at once."""
    bounds, send = _bounds(found, model, most), found.sparkSession.sparkContext.broadcast
    others = [send(_collected(found, model, most, i, bounds)) for i in range(1, len(bounds) - 1)]
    return _collected(found, model, most, 0, bounds), others


def _measured(df: DataFrame, text: int, pages: list[Broadcast], made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``made`` of slices of ``df`` and the features of the texts in column ``text``: no shuffle. With several pages slices are gathered up to GATHERED characters."""
    ship(df.sparkSession)
    run, most = uuid.uuid4().hex, GATHERED if len(pages) > 1 else 0

    def through(slices: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, at = [t for s in slices for t in s.column(text).to_pylist()], 0
        x = features(texts, _with(run, pages[0].value)) if len(pages) == 1 else paged_features(texts, (Lookup(_loaded(p)) for p in pages))
        for s in slices:
            yield made(s, x[at : at + s.num_rows])
            at += s.num_rows

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                gathered.append(batch.slice(at, BATCH_ROWS))
                size += pc.sum(pc.utf8_length(gathered[-1].column(text))).as_py() or 0
                if size >= most:
                    yield from through(gathered)
                    gathered, size = [], 0
        if gathered:
            yield from through(gathered)

    return spread(df).mapInArrow(over, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """Learn from (doc_id, text) and (doc_id, toxic); None without rows of both classes."""
    spark = docs.sparkSession
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counted = arrow_pass(_by_class(docs, labels, [0, 1, 3]), _counted, "key long, held int, toxic long, ordinary long")
    sums = [F.sum(c if m == "whole" else F.when(F.col("held") == 0, F.col(c)).otherwise(0)).alias(f"{c}_{m}") for m in ("apart", "whole") for c in ("toxic", "ordinary")]
    every = checkpoint(counted.groupBy("key").agg(*sums))
    seen = every.agg(F.sum("toxic_apart"), F.sum("ordinary_apart")).first()
    held = labels.where(fold(F.col("doc_id")) == 3).withColumn("mark", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not all(seen) or len(sizes) < 2:
        return None
    found = checkpoint(ratios(every, ["apart", "whole"]))
    first, others = _sent(found, "apart", SEQUENCES)
    sent = [spark.sparkContext.broadcast(first), *others]
    sample = [(r["doc_id"], r["toxic"]) for r in least(held, "toxic", sizes, "mark", ["doc_id"], CALIBRATION)]

    def measured(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], names=["toxic", "a", "b", "c"])

    known = docs.where(fold(F.col("doc_id")) == 3).join(F.broadcast(spark.createDataFrame(sample, "doc_id long, toxic int")), "doc_id").select("text", "toxic")
    rows = np.array(sorted(tuple(r) for r in _measured(known, 0, sent, measured, "toxic int, a double, b double, c double").collect()), np.float64)
    for page in sent:
        page.destroy()
    if not len(rows) or len(set(rows[:, 0])) < 2:
        return None
    y, taken = rows[:, 0], np.bincount(rows[:, 0].astype(int), minlength=2)
    share = np.array([sizes.get(k, 0) / max(taken[k], 1) for k in (0, 1)])
    weight = share[y.astype(int)]
    first, others = _sent(found, "whole", SEQUENCES)
    return Scorer(first, *logistic(rows[:, 1:], y, weight / weight.mean()), others)


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(doc_id, score) for every row."""
    if scorer is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent, own = [docs.sparkSession.sparkContext.broadcast(scorer.ratios), *scorer.more], replace(scorer, ratios=None, more=[])

    def each(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(x))], names=["doc_id", "score"])

    return _measured(docs, 1, sent, each, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``labels`` has the id and the label."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
    found = score(own, fit(own, known))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
