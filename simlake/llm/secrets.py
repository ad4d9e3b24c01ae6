"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns only at hits, then embedded checksums.

Base kinds are exact: leftmost, non-overlapping per kind, failing matches dropped without a retry.

* ``assign``: a keyword, an optional quote, ``:`` or ``=``, a value of 12 or more characters.
* ``access``: ``AKIA`` and upper-case letters or digits, 18 characters or more.
* ``hex``: 16 or more lower-case hex digits. No keyword announces these, so they are found by their own run scan.

The method adds kinds that a checksum or an inner structure confirms: ``github`` (base-62 CRC-32 in the last six
characters), ``npm`` (the same), ``jwt`` (a header that decodes to JSON with ``alg``), ``pem`` (a private key block),
``stripe``, ``slack`` and ``google`` (fixed formats).

A pattern fails within what its next rivals cannot read again (a key block ends at five dashes, a token begins where no token
character stands before it), so a text takes time linear in its length, however many openings it holds.

Edge cases: null text is an empty text; texts of any length are read whole; offsets are code points, end exclusive; spans
of different kinds may overlap, those that start together come in the order of KINDS; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, changed, table, with_lengths

# Token formats and keywords.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "stripe", "slack", "google")
_ANY_CASE = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ANY_CASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem", "sk_live_": "stripe", "rk_live_": "stripe", "xoxb-": "slack", "xoxp-": "slack", "xoxa-": "slack", "aiza": "google"}
ANCHORED = {
    "assign": ASSIGN,
    "access": ACCESS,
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    "stripe": re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"),
    "slack": re.compile(r"xox[bpa]-[0-9]{6,}-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits


def _jwt(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def valid(kind: str, m: re.Match[str]) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind in ("github", "npm"):
        return checksum62(m[0][4:-6]) == m[0][-6:]
    return _jwt(m[0]) if kind == "jwt" else True


_PREFILTER: list[ahocorasick.Automaton] = []


def prefilter() -> ahocorasick.Automaton:
    if not _PREFILTER:
        a = ahocorasick.Automaton()
        for k, kind in KEYWORDS.items():
            a.add_word(k, (len(k), kind))
        a.make_automaton()
        _PREFILTER.append(a)
    return _PREFILTER[0]


def find(raw: bytes | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text, in code points, by start and then by kind."""
    if not raw:
        return []
    low = raw.lower().decode()  # lower-cases ASCII only, so offsets stay
    text, out, done = None, [], {}
    for last, (n, kind) in prefilter().iter(low):
        start = last - n + 1
        if start < done.get(kind, 0):
            continue
        text = raw.decode() if text is None else text
        if m := ANCHORED[kind].match(text, start):
            done[kind] = m.end()
            if valid(kind, m):
                out.append((start, m.end(), kind))
    text = raw.decode() if text is None else text
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and the spans found, as structs of kind, start and end."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(own, each, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with every span replaced by ``[SECRET:kind]``; overlapping spans become one mark of the first kind."""
    at = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for raw in as_bytes(batch.column(at)):
            spans, parts, end = find(raw), [], 0
            text = None if raw is None else raw.decode()
            for a, b, kind in spans:
                if a >= end:
                    parts += [text[end:a], f"[SECRET:{kind}]"]
                end = max(end, b)
            texts.append("".join(parts) + text[end:] if spans else text)
        yield changed(batch, {text_col: pa.array(texts, pa.string())})

    return with_lengths(arrow_pass(docs, each, docs.schema), text_col, length_col)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    own = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(own([k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(own(KINDS[:3])).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Base spans by scanning the whole text with each pattern."""
    text = text or ""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16],
    }
