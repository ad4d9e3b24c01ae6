"""Personal data by candidate gradient boosting, with DataFrame expressions only.

1. Base kinds (email, ip, card, phone) are exact: leftmost, non-overlapping per kind, failing matches dropped without a retry.
2. High-recall generators propose further, overlapping candidates: national ids, bank accounts, local phone numbers, masked
   email addresses, IPv6 addresses and bare numbers.
3. Boosted trees score each candidate by its format (length, digits, separators, checksums) and its context (keywords
   before it, what stands next to it). They are fitted once a process, on EXAMPLES, whose features come from the same expressions.
4. A threshold per kind, calibrated on held-out examples, selects; the best of overlapping candidates stays, and none that
   overlaps a base span.

Patterns use possessive repeats and look-behind, so that a match takes time linear in the text and no recursion. A row is
handled on its own: nothing is exploded or collected, and only a small input is dealt out over the cores first.

What the generators propose is as long as its kind can be: 9 digits of a national id, 15 to 34 characters of a bank account,
7 to 10 digits of a local phone number, eight groups of an IPv6 address; masked email addresses and bare numbers (8
characters or more, digits with single spaces or dashes between them) have no greatest length.

Edge cases: null text is an empty text; texts of any length are read whole; offsets are code points, end exclusive; of
overlapping candidates with one score the first stays, and at one place the shorter; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

BASE = ("email", "ip", "card", "phone")
# Patterns of the base kinds, written for a matcher that backtracks; the same matches as the plain forms.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = ("ssn", "iban", "tel", "mail", "ipv6", "number")
# Generators of candidates.
GENERATORS = {
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])",
    "tel": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{](?:at|AT|@)[)\]}] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[{](?:dot|DOT|\.)[)\]}] ?)[A-Za-z0-9-]{2,}+)++",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "number": r"(?<![0-9A-Za-z.,+])(?<![0-9][ -])(?=[0-9][0-9 -]{6}[0-9]|[0-9][0-9 -]{7})[0-9]++(?:[ -][0-9]++)*+(?![0-9A-Za-z])",
}
CONTEXT = {
    "ctx_id": r"(?i)(?:ssn|social security|tax id|passport|national id|sozialversicherung|steuer-?id|s[eé]curit[eé] sociale|dni|nss)[^a-z0-9]{0,6}(?:(?:no|nr|number|is)\b[^a-z0-9]{0,4})?$",
    "ctx_phone": r"(?i)(?:phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|call|fon|fax|mobile|cell)[^a-z0-9]{0,6}(?:(?:no|nr|number|is|me at|us at)\b[^a-z0-9]{0,4})?$",
    "ctx_bank": r"(?i)(?:iban|account|konto|compte|cuenta|bank)[^a-z0-9]{0,6}(?:(?:no|nr|number|is)\b[^a-z0-9]{0,4})?$",
    "ctx_mail": r"(?i)(?:mail|contact|write to|reach)[^a-z0-9]{0,6}(?:(?:me|us|is|at)\b[^a-z0-9]{0,4})*$",
}
#: What a text must hold for any match of a kind; a cheap test that spares most texts the kind's pattern.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "ssn": "[0-9]{3}[- ]", "iban": "[A-Z]{2}[0-9]{2}", "tel": "[0-9]{3}[-. )]", "mail": r"[(\[{](?:at|AT|@)[)\]}]", "ipv6": "[0-9A-Fa-f]:[0-9A-Fa-f]", "number": "[0-9][0-9 -]{6}"}
#: Characters before and after a candidate that its context is read from, up to the candidates next to it.
BEFORE, AFTER = 32, 4
BLOCK = 128
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when((F.length(digits) - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    each = F.transform(F.split(digits, "(?!^)"), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _fine(kind: str, m: Column) -> Column:
    """The check a base match must pass."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def _matches(text: Column, kind: str, pattern: str, around: bool) -> Column:
    """Spans of all matches of a pattern. The gaps between the matches give the offsets, and the text around a match.

    Matches are walked in blocks of BLOCK, each from its own first offset: appending to an array copies it, and so only ever
    copies a block.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _let(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(gaps.alias("gap"), found.alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("next")))
    length = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["m"]), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["m"])
        span = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")]
        if around:
            span += [p["m"].alias("m"), F.right(p["gap"], F.lit(BEFORE)).alias("before"), F.left(p["next"], F.lit(AFTER)).alias("after")]
        keep = F.lit(True) if around else _fine(kind, p["m"])
        return F.struct((acc["at"] + length(p)).alias("at"), F.when(p["m"].isNotNull() & keep, F.concat(acc["spans"], F.array(F.struct(*span)))).otherwise(acc["spans"]).alias("spans"))

    empty = F.array().cast(_FOUND if around else _SPAN)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def walked(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, p: acc + length(p)))
        starts = F.aggregate(sizes, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])))

    cut = lambda pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(text.rlike(NEEDED[kind]), _let(pairs, lambda p: _let(cut(p), walked))).otherwise(empty)


def _stretches(spans: Column) -> Column:
    """The sorted spans of a kind in stretches of BLOCK, each with its first start and last end: what does not meet a stretch is not compared with its spans."""
    part = lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), part)
    told = F.transform(cut, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.get(p, F.size(p) - 1)["end"].alias("end"), p.alias("part")))
    return F.when(F.size(spans) > 0, told).otherwise(F.array().cast(f"array<struct<start:int,end:int,part:{_SPAN}>>"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row; an expression inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


FEATURES = ("kind", "digits", "letters", "seps", "length", "luhn", "mod97", "ssn_range", "same_digit", "colon_before", "ctx_id", "ctx_phone", "ctx_bank", "ctx_mail")


def _features(c: Column) -> list[Column]:
    """Numbers that describe a candidate: its format, then its context. In the order of FEATURES."""
    m, before = c["m"], c["before"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    compact = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    letters = F.transform(F.split(turned, "(?!^)"), lambda x: F.coalesce(F.conv(x, 36, 10).try_cast("int"), F.lit(0)))
    mod97 = F.aggregate(letters, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    return [
        F.array_position(F.array(*map(F.lit, ADDED)), c["kind"]).cast("int"),
        F.length(digits),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        F.length(m),
        flag(F.length(digits).between(12, 19) & luhn(digits)),
        flag(F.when(c["kind"] == "iban", F.when(m.rlike("^[A-Z0-9 ]+$"), mod97 == 1))),
        flag(m.rlike("^(?!000|666|9)[0-9]{3}[- ](?!00)[0-9]{2}[- ](?!0000)[0-9]{4}$")),
        flag(digits.rlike(r"^([0-9])\1*$")),
        flag(before.rlike(r"[:=#] ?$")),
        *(flag(before.rlike(CONTEXT[k])) for k in ("ctx_id", "ctx_phone", "ctx_bank", "ctx_mail")),
    ]


# ---- the boosted trees: a small labelled table, fitted on the driver in plain Python


def _iban(rng: random.Random, good: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(18))
    value = int(body + "131400") % 97  # DE00
    check = 98 - value
    return f"DE{check if good else (check + 7) % 97:02d}" + body


def examples(n: int = 40, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """EXAMPLES: (kind, before, match, after, label), ``n`` rounds from templates."""
    rng, rows = random.Random(seed), []
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))
    for _ in range(n):
        plain, end = f"{w()} {w()} ", rng.choice([" ", ".", ", ", "\n"])
        area = str(rng.choice([*range(1, 666), *range(667, 900)])).zfill(3)
        ssn = f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        rows += [
            ("ssn", plain + rng.choice(["SSN: ", "social security number ", "ssn ", "Tax ID: "]), ssn, end, 1),
            ("ssn", plain, ssn, end, 1),
            ("ssn", plain, f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", end, 0),
            ("ssn", plain, f"{area}-00-{d(4)}", end, 0),
            ("iban", plain + rng.choice(["IBAN: ", "", "Konto ", "account no. "]), _iban(rng, True), end, 1),
            ("iban", plain + rng.choice(["", "order ", "part no. "]), _iban(rng, False), end, 0),
            ("tel", plain + rng.choice(["phone: ", "call ", "Tel. ", "fax "]), f"({d(3)}) {d(3)}-{d(4)}", end, 1),
            ("tel", plain, rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]), end, 1),
            ("tel", plain + rng.choice(["call ", "mobile: "]), f"{d(3)} {d(3)} {d(4)}", end, 1),
            ("tel", plain, f"{d(3)} {d(3)} {d(4)}", end, 0),
            ("tel", plain, "0" * 3 + "-" + "0" * 3 + "-" + "0" * 4, end, 0),
            ("mail", plain + rng.choice(["mail ", "contact ", ""]), f"{w()}{d(2)} (at) {w()} (dot) com", end, 1),
            ("mail", plain + rng.choice(["", "write to "]), f"{w()}[at]{w()}.org", end, 1),
            ("ipv6", plain, ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8)), end, 1),
            ("ipv6", plain, ":".join(["0"] * 8), end, 0),
            ("number", plain, d(rng.randint(8, 20)), end, 0),
            ("number", plain, f"{d(4)}-{d(4)}-{d(4)}", end, 0),
            ("number", plain + rng.choice(["account number ", "Konto: ", "cuenta no. "]), d(rng.randint(8, 14)), end, 1),
            ("number", plain + rng.choice(["passport no. ", "national ID: ", "DNI "]), d(rng.randint(8, 10)), end, 1),
            ("number", plain + rng.choice(["page ", "ref: ", "order ", "id "]), d(rng.randint(8, 14)), end, 0),
            ("number", plain + rng.choice(["SSN: ", "Tax ID: "]), ssn, end, 0),  # a national id has its own kind
        ]
    return rows


Tree = tuple  # (feature, cut, below, above) or a number


def _grow(x: list[list[int]], grad: list[float], hess: list[float], at: list[int], depth: int) -> Tree | float:
    g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
    leaf = g / (h + 1.0)
    best: tuple = (1e-6,)
    for f in range(len(x[0])) if depth else ():
        sums: dict[int, list[float]] = {}
        for i in at:
            s = sums.setdefault(x[i][f], [0.0, 0.0])
            s[0] += grad[i]
            s[1] += hess[i]
        gl = hl = 0.0
        values = sorted(sums)
        for v, following in zip(values, values[1:]):
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, (v + following) / 2)
    if len(best) == 1:
        return leaf
    _, f, cut = best
    parts = [i for i in at if x[i][f] < cut], [i for i in at if x[i][f] >= cut]
    return (f, cut, *(_grow(x, grad, hess, p, depth - 1) for p in parts))


def _value(tree: Tree | float, row: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def boost(x: list[list[int]], y: list[int], rounds: int = 16, depth: int = 3, rate: float = 0.5) -> list[Tree | float]:
    """Trees of Newton steps on the logistic loss."""
    score, trees = [0.0] * len(y), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(x, [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], list(range(len(y))), depth)
        trees.append(tree)
        score = [s + rate * _value(tree, r) for s, r in zip(score, x)]
    return trees


def _scaled(tree: Tree | float, rate: float) -> Tree | float:
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def calibrated(scores: list[float], y: list[int], precision: float = 0.95) -> float:
    """The lowest score from which on at least ``precision`` of the examples are positive; infinity if there is none."""
    order, best, good = sorted(zip(scores, y), reverse=True), math.inf, 0
    for n, (s, label) in enumerate(order, 1):
        good += label
        if good >= precision * n and (n == len(order) or order[n][0] < s):
            best = s
    return best


_MODEL: list[tuple[list[Tree | float], dict[str, float]]] = []


def model(spark: SparkSession) -> tuple[list[Tree | float], dict[str, float]]:
    """Trees and thresholds, fitted once a process on the labelled table; features by the expressions of the main path."""
    if not _MODEL:
        rows = examples()
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        values = ", ".join(f"({n}, {', '.join(map(quote, r[:4]))}, {r[4]})" for n, r in enumerate(rows))
        data = spark.sql(f"SELECT n, struct(kind, before, m, after) AS c, label FROM VALUES {values} AS t(n, kind, before, m, after, label)")
        got = sorted(tuple(r) for r in data.select("n", "label", *(f.alias(k) for k, f in zip(FEATURES, _features(F.col("c"))))).collect())
        fit, held = [r for r in got if r[0] // 21 % 4], [r for r in got if not r[0] // 21 % 4]
        trees = [_scaled(t, 0.5) for t in boost([list(r[2:]) for r in fit], [r[1] for r in fit])]
        cuts = {}
        for k, kind in enumerate(ADDED, 1):
            own = [r for r in held if r[2] == k]
            cuts[kind] = calibrated([sum(_value(t, list(r[2:])) for t in trees) for r in own], [r[1] for r in own])
        _MODEL.append((trees, cuts))
    return _MODEL[0]


def _expression(tree: Tree | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] < tree[1], _expression(tree[2], f)).otherwise(_expression(tree[3], f))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, added): arrays of spans (kind, start, end) in the order of kinds, then of starts."""
    trees, cuts = model(docs.sparkSession)
    text = F.col("text")
    out = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    base = [_matches(text, k, PATTERNS[k], False) for k in BASE]
    candidates = [_matches(text, k, GENERATORS[k], True) for k in ADDED]
    out = out.select("doc_id", "text", F.array(*base).alias("by_kind"), F.concat(*candidates).alias("found"))
    out = out.select("doc_id", "text", F.flatten("by_kind").alias("base"), F.when(F.size("found") > 0, F.flatten(F.transform("by_kind", _stretches))).alias("stretches"), "found")

    def described(c: Column) -> Column:
        numbers = F.struct(*(f.alias(k) for k, f in zip(FEATURES, _features(c))))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), numbers.alias("f"))

    def scored(c: Column) -> Column:
        total = F.lit(0.0)
        for t in trees:
            total = total + _expression(t, c["f"])
        return F.struct((-total).alias("loss"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))

    cut = F.lit(math.inf)
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = F.filter("found", lambda c: ~F.exists("stretches", lambda k: overlap(k, c) & F.exists(k["part"], lambda b: overlap(b, c))))
    ranked = F.array_sort(F.transform(F.transform(apart, described), scored))
    out = out.withColumn("ranked", F.when(F.size("found") > 0, ranked))

    def enough(c: Column) -> Column:
        least = cut
        for kind in ADDED:
            least = F.when(c["kind"] == kind, F.lit(float(cuts[kind]))).otherwise(least)
        return -c["loss"] >= least

    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    none = F.array().cast(_SPAN)
    chosen = F.aggregate(F.filter("ranked", enough), none, lambda kept, c: F.when(F.exists(kept, lambda k: overlap(k, c)), kept).otherwise(F.concat(kept, F.array(span(c)))))
    order = F.array(*map(F.lit, ADDED))
    by_kind = F.transform(F.array_sort(F.transform(chosen, lambda c: F.struct(F.array_position(order, c["kind"]).alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))), span)
    return out.select("doc_id", "text", "base", F.coalesce(F.when(F.size("ranked") > 0, by_kind), none).alias("added"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
