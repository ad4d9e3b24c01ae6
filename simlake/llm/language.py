"""Language identification: a bidirectional gated recurrent network over UTF-8 bytes.

The network is trained in numpy by backpropagation through time, on a bounded sample of labelled rows: PER_LANGUAGE documents
of each of the LANGUAGES most frequent languages, a PIECE of each. It labels every byte; a document's probabilities are the
mean over its bytes. Whole texts are read, in windows of CORE bytes with CONTEXT bytes on both sides, many windows at a time.
The network's width and its training steps grow with the number of languages; the model is a few kilobytes to a megabyte
and goes to the workers with the function.

Edge cases: a text that is null or has no letter (no character of Unicode category L) is ``und`` with score 0; so is every
text if there are no labelled rows; NUL bytes count as padding; of languages that tie the first by name is said; texts of any
length are read whole; repeated rows give repeated results; a null doc_id is never held out, nor learned from; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, fold, least, table

#: Bound of the training sample: documents of each language, the languages by frequency (ties by name), characters of each document.
PER_LANGUAGE, LANGUAGES, PIECE = 400, 200, 384
#: Units of a direction and training steps: at least, and for each language; units at most.
HIDDEN, HIDDEN_EACH, HIDDEN_MOST, STEPS, STEPS_EACH = 8, 2, 64, 260, 65
BATCH, LENGTH, RATE, SEED = 96, 64, 0.02, 5
CORE, CONTEXT, AT_ONCE = 256, 16, 1024
UNKNOWN = "und"
#: What a filter accepts: this share of the way from a guess among the languages (1 / their number) to certainty.
ACCEPTED = 0.1


def least_score(languages: int, share: float = ACCEPTED) -> float:
    """The least score that is accepted: 1 / languages says nothing, 1 is certain."""
    return (1 + share * (languages - 1)) / languages


def units(languages: int, most: int = HIDDEN_MOST) -> int:
    return min(max(HIDDEN, HIDDEN_EACH * languages), most)


def has_letter(text: bytes | None) -> bool:
    """Whether a character of Unicode category L stands in the text; numerals and signs that look like letters are none."""
    return bool(text) and any(map(str.isalpha, text.decode()))


@dataclass
class Network:
    """x: input weights of each direction (2, 3H, 256), u: recurrent (2, 3H, H), b (2, 3H, 1), out (2, K, H), bias (K, 1). Gates: update, reset, new."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.out, self.bias]


def fresh(languages: list[str], hidden: int | None = None) -> Network:
    hidden = hidden or units(len(languages))
    rng = np.random.default_rng(SEED)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    k = len(languages)
    return Network(languages, draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=hidden**-0.5), np.zeros((2, 3 * hidden, 1), np.float32), draw(2, k, hidden, scale=hidden**-0.5), np.zeros((k, 1), np.float32))


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def run(net: Network, seq: np.ndarray, direction: int, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, H, B) of bytes (T, B), which the second direction reads from the end; zero bytes reset the state. keep: what training needs."""
    t, n = seq.shape
    h = net.u.shape[2]
    u, states, saved = net.u[direction], np.empty((t, h, n), np.float32), []
    weights = net.x[direction] + net.b[direction]
    now, shown = np.zeros((h, n), np.float32), seq != 0
    for i in range(t) if direction == 0 else range(t - 1, -1, -1):
        given = weights.take(seq[i], axis=1)
        rec = u @ now
        gates = _sigmoid(given[: 2 * h] + rec[: 2 * h])
        z, r = gates[:h], gates[h:]
        new = rec[2 * h :] * r
        new += given[2 * h :]
        np.tanh(new, out=new)
        after = now - new
        after *= z
        after += new
        after *= shown[i]
        if keep:
            saved.append((i, now, gates, new, rec[2 * h :]))
        states[i] = now = after
    return states, saved


def position_probabilities(net: Network, states: list[np.ndarray]) -> np.ndarray:
    """(T, K, B) after a softmax."""
    logits = net.out[0] @ states[0]
    logits += net.out[1] @ states[1]
    logits += net.bias
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def gradients(net: Network, seq: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all shown positions, and its gradient by backpropagation through time."""
    runs = [run(net, seq, d, keep=True) for d in (0, 1)]
    p = position_probabilities(net, [s for s, _ in runs])
    shown = (seq != 0)[:, None, :].astype(np.float32)
    total = shown.sum()
    picked = np.take_along_axis(p, np.broadcast_to(label[None, None, :], (len(seq), 1, len(label))), 1)
    loss = float(-(np.log(picked + 1e-9) * shown).sum() / total)
    err = p.copy()
    np.put_along_axis(err, np.broadcast_to(label[None, None, :], (len(seq), 1, len(label))), picked - 1, 1)
    err *= shown / total
    g = [np.zeros_like(a) for a in net.parts]
    g[4] += err.sum((0, 2))[:, None]
    h = net.u.shape[2]
    for d, (states, saved) in enumerate(runs):
        g[3][d] = np.einsum("tkb,thb->kh", err, states, optimize=True)
        into = net.out[d].T @ err  # (T, H, B)
        carried = np.zeros_like(states[0])
        for i, before, gates, new, rec in reversed(saved):
            dh = (into[i] + carried) * shown[i]
            z, r = gates[:h], gates[h:]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * rec * r * (1 - r)
            dgiven = np.concatenate([dz, dr, dnew])
            drec = np.concatenate([dz, dr, dnew * r])
            g[1][d] += drec @ before.T
            carried = dh * z + net.u[d].T @ drec
            order = np.argsort(seq[i], kind="stable")
            marks = seq[i][order]
            starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
            g[0][d][:, marks[starts]] += np.add.reduceat(dgiven[:, order], starts, axis=1)
            g[2][d] += dgiven.sum(1, keepdims=True)
    return loss, g


def train(samples: list[tuple[bytes, str]], steps: int | None = None, hidden_most: int = HIDDEN_MOST) -> Network | None:
    """Adam over random windows, the languages in turn; STEPS_EACH steps a language unless told otherwise, STEPS at least.

    The width grows with the languages up to ``hidden_most``, with the default up to 32 of them: past that more languages
    share it, and near ones are told apart less well.
    """
    by: dict[str, list[bytes]] = {}
    for text, lang in samples:
        if text:
            by.setdefault(lang, []).append(text)
    if not by:
        return None
    net, rng = fresh(sorted(by), units(len(by), hidden_most)), np.random.default_rng(SEED)
    steps = steps or max(STEPS, STEPS_EACH * len(by))
    mean, square = [np.zeros_like(a) for a in net.parts], [np.zeros_like(a) for a in net.parts]
    for step in range(1, steps + 1):
        seq, label = np.zeros((LENGTH, BATCH), np.uint8), np.zeros(BATCH, np.int64)
        for j in range(BATCH):
            label[j] = (step * BATCH + j) % len(net.languages)
            texts = by[net.languages[label[j]]]
            text = texts[rng.integers(len(texts))]
            at = rng.integers(max(len(text) - LENGTH // 2, 1))
            part = np.frombuffer(text[at : at + LENGTH], np.uint8)
            seq[: len(part), j] = part
        _, g = gradients(net, seq, label)
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for a, d, m, s in zip(net.parts, g, mean, square):
            np.clip(d, -1, 1, out=d)
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, K): the mean of the probabilities of all bytes of each text; texts must not be empty."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(size)][:-1]
    every = np.frombuffer(b"".join(texts), np.uint8)
    windows = -(-size // CORE)
    doc = np.repeat(np.arange(len(texts)), windows)
    at = first[doc] + CORE * (np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(windows)][:-1], windows))
    span = np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
    sums = np.zeros((len(texts), len(net.languages)))
    for i in range(0, len(doc), AT_ONCE):
        d = doc[i : i + AT_ONCE]
        place = at[i : i + AT_ONCE] + span
        own = (place >= first[d]) & (place < first[d] + size[d])
        seq = np.where(own, every[np.clip(place, 0, len(every) - 1)], 0).astype(np.uint8)
        p = position_probabilities(net, [run(net, seq, k)[0][CONTEXT:-CONTEXT] for k in (0, 1)])
        p *= own[CONTEXT:-CONTEXT, None, :]
        np.add.at(sums, d, p.sum(0, dtype=np.float64).T)
    return sums / size[:, None]


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """PIECE characters, from a place by hash, of ``per_language`` documents by hash of each of the ``languages`` most frequent languages; fold 2 is left out. A language past those is never said: its documents get the name of another."""
    known = docs.where((fold(F.col(id_col)) != 2) & F.col(lang_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    mark, size = F.xxhash64(id_col), F.length(text_col)
    place = (F.pmod(mark, F.greatest(size - PIECE, F.lit(1))) + 1).cast("int")
    pieces = known.where(size > 0).select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.substr(F.col(text_col), place, F.lit(PIECE)).alias("piece"))
    rows = least(pieces, "lang", {r["lang"]: r["n"] for r in sizes}, "mark", ["piece"], per_language)
    return [(r["piece"].encode(), r["lang"]) for r in rows]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(1))
        some = [i for i, t in enumerate(texts) if net and has_letter(t)]
        said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            p = pooled(net, [texts[i] for i in some])
            for i, k, s in zip(some, p.argmax(1), p.max(1)):
                said[i], score[i] = net.languages[k], min(float(s), 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(own, each, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, text_col: str = "text", share: float = ACCEPTED) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und``, and with a score of ``least_score`` or more. Without a model all rows with a letter."""
    at, enough = docs.columns.index(text_col), least_score(len(net.languages), share) if net else 0.0

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(at))
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if net and some:
            score = pooled(net, [texts[i] for i in some]).max(1)
            some = [i for i, s in zip(some, score) if s >= enough]
        if some:
            yield batch.take(pa.array(some))

    return arrow_pass(docs, each, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(training_sample(docs)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
