"""Line dedup, conversation repair and source divergence: SQL, brute force, and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.llm import divergence, lines, repair
from simlake.llm.queries import ORACLE_SQL, QUERIES

NEW = ["op11_lines", "op12_repair", "op13_divergence"]


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, size):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{size}/{t}.parquet'")
    got, want = QUERIES[name](spark, f"/root/testdata/{size}").toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert dict(got.dtypes) == dict(want.dtypes)
    assert rows_of(got) == rows_of(want)


# lines


def plain_dedup(rows, min_docs, min_chars=1, keep="none"):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", re.sub("[A-Z]", lambda m: m[0].lower(), x))
    keys = [[key(x) for x in (t or "").split("\n")] for _, t in rows]
    met = Counter(k for own in keys for k in set(own) if len(k) >= min_chars)
    first = {}
    for (i, _), own in zip(rows, keys):
        for k in own:
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, t), own in zip(rows, keys):
        stay, seen = [], set()
        for line, k in zip((t or "").split("\n"), own):
            often = met[k] >= min_docs and len(k) >= min_chars
            if not often or (keep == "first" and k not in seen and first.get(k, i) == i):
                stay.append(line)
                seen |= {k} if often else set()
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay) if len(stay) < len(own) else t))
    return sorted(out, key=str)


LINES = [" Copyright \t", "COPYRIGHT", "copyright", "É", "é", "", "   ", "x" * 40, "X" * 40 + "\r", "only {}", "b", "long " * 2000 + "{}"]


def line_rows(n=300):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(LINES).format(rng.randrange(10**6)) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (None, "copyright\nb"), (None, None), (n, ""), (n + 1, None), (n + 2, "\n" * 50_000 + "copyright")]


def line_docs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lost", "digest", "slice", "token", "first", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("held", [lines.HELD, 2, 0])
def test_lines_equal_plain_counting(spark, keep, held):
    rows = line_rows()
    got = lines.deduplicated(line_docs(spark, rows), min_docs=5, keep=keep, held=held)
    assert got.columns[2:8] == ["lost", "digest", "slice", "token", "first", "id"] and got.columns[8:] == ["n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str)
    assert got == plain_dedup(rows, 5, keep=keep)


def test_lines_of_least_length(spark):
    rows = line_rows(120)
    got = lines.deduplicated(line_docs(spark, rows), min_docs=3, min_chars=2)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == plain_dedup(rows, 3, 2)


def test_lines_of_an_empty_table_and_wrong_settings(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicated(docs).collect() == []
    with pytest.raises(ValueError, match="min_docs"):
        lines.frequent_keys(docs, min_docs=1)
    with pytest.raises(ValueError, match="keep"):
        lines.deduplicated(docs, keep="last")
    with pytest.raises(ValueError, match="n_lines"):
        lines.deduplicated(docs.withColumn("N_LINES", F.lit(1)))


def test_filters_leave_most_single_lines_out_and_no_repeat(spark, monkeypatch):
    rng = random.Random(1)
    own = [f"line {rng.random()}" for _ in range(40_000)]
    rows = [(i, "\n".join([*own[i * 100 : i * 100 + 100], f"twice {i // 2}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for most in (lines.FILTER_BYTES, 512):
        monkeypatch.setattr(lines, "FILTER_BYTES", most)
        slices, filters = lines.repeated_keys(docs, "text")
        assert sum(map(len, filters.values())) <= max(most, 2 * len(filters))
        suspects = lines.Suspects(slices, filters)
        hit = lambda keys: suspects(np.array([lines.xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64))
        assert hit([f"twice {i}" for i in range(200)]).all()
        if most > 512:
            assert hit(own).mean() < 0.05
    got = {r["token"].decode(): (r["docs"], r["first"]) for r in lines.frequent_keys(docs, 2).collect()}  # filters that hold almost nothing back
    assert got == {f"twice {i}": (2, 2 * i) for i in range(200)}


# repair


def cheapest(rows):
    """(cost, audit, repaired turns) by trying edits in order of cost: a search over (row, what stands last)."""
    seen, said = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        said.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def walk(i, last, cost, audit, out, inserted):
        if (i, last, inserted) in best and best[i, last, inserted] < (cost, audit):
            return
        best[i, last, inserted] = (cost, audit)
        if i == len(rows) and last in "-a":
            done.append((cost, audit, out))
        nxt = {"-": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[nxt]
        if inserted < 2:
            walk(i, nxt, cost + 2, audit + "I", [*out, (name, "")], inserted + 1)
        if i < len(rows):
            role, text = rows[i]
            walk(i + 1, last, cost + 3, audit + "D", out, 0)
            if said[i] in ("", "truncated"):
                late = said[i] == "truncated"
                if role[:1] == nxt or (role[:1] == "s" and last == "-"):
                    walk(i + 1, role[:1], cost + late, audit + "K", [*out, (role, text)], 0)
                walk(i + 1, nxt, cost + 2 + late, audit + "R", [*out, (name, text)], 0)

    done = []
    walk(0, "-", 0, "", [], 0)
    return (*min(done, key=lambda d: d[:2]), Counter(said))


def conversation_rows(n=400):
    rng, rows = random.Random(3), []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "aide"])
            rows.append((c, rng.choice([t, t, t, t, None, t + 3]), role, rng.choice(["Yes.", "No!", "why", " ", None, "", "Go on?  ", "é", f"{rng.random()}."])))
    return rows


@pytest.mark.parametrize("chunk", [repair.CHUNK, 2, 1])
def test_repair_equals_search_over_all_edits(spark, chunk):
    rows = conversation_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0)).withColumn("place", F.lit("x"))
    got = {r["conv_id"]: r for r in repair.repair(turns, chunk=chunk).collect()}
    assert len(got) == 400
    for c, group in itertools.groupby(rows, lambda r: r[0]):
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for _, t, r, x in group))
        cost, audit, out, said = cheapest([(r, x) for _, _, r, x in own])
        row = got[c]
        assert (row["cost"], row["audit"]) == (cost, audit)
        assert [(t["role"], t["text"]) for t in row["repaired"]] == out
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in row["repaired"]))
        assert (row["blank"], row["duplicate"], row["truncated"]) == (said["blank"], said["duplicate"], said["truncated"])
        numbers = [t for known, t, _, _ in own if known]
        assert row["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert row["illegal"] == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))


def test_repair_of_long_and_of_absent_conversations(spark):
    n = 3000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.", True) for i in range(n)] + [(2, 0, "user", "gone.", False), (None, None, None, None, True), (None, 1, "user", "Hi.", True)]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean"), present_col="present").collect()}
    assert (got[1]["cost"], got[1]["audit"], len(got[1]["repaired"])) == (0, "K" * n, n)
    assert (got[2]["cost"], got[2]["audit"], got[2]["repaired"], got[2]["gaps"], got[2]["illegal"]) == (0, "", [], 0, 0)
    assert (got[None]["cost"], got[None]["audit"], got[None]["blank"]) == (5, "DKI", 1)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(empty).collect() == [] and repair.repair(repair.damaged(empty), present_col="present").collect() == []


def test_damage_follows_the_hash(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(60) for t in (0, 1, None)] + [(None, 1, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        want += [(c, t, "user" if how == 4 else role, text, how != 0)] * (2 if how == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# divergence


def plain_audit(rows, min_docs, top):
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in rows}:
        own = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))), s) for t, a, s in rows if a == lang]
        met = Counter(w for c, _ in own for w in c)
        kept = {w for w, n in met.items() if n >= min_docs}
        by = {s: Counter() for _, s in own}
        for c, s in own:
            by[s].update({w: n for w, n in c.items() if w in kept})
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        every = sum(by.values(), Counter())
        for s in by:
            pairs = [(-sum(abs(p(by[s], w) - p(by[o], w)) for w in kept), o.encode()) for o in by if o != s]
            terms = [(p(every, w) - p(by[s], w), w.encode()) for w in kept if by[s][w] and p(by[s], w) > p(every, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, w.decode(), -v, i) for i, (v, w) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [divergence.HELD_SOURCES, 0])
def test_divergence_equals_plain_counting(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_SOURCES", held)
    rng = random.Random(9)
    words = ["Alpha", "alpha", "béta", "Éa", "éa", "x", "don't", "a1b", "😀", "und", "der_die", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", None, "É", "z"])) for _ in range(400)]
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("rare", "fr", "b"), (None, None, None), ("12 _", "it", "only")] + [("copy copy", "en", "hot")] * 50
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).withColumn("i", F.lit(2))
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=10, top=4).collect())
    assert got == plain_audit(rows, 10, 4)


def test_divergence_of_long_texts_and_of_nothing(spark):
    long = ("word " * 5 + "é" * 3) * 300_000
    assert divergence.terms_of(long.encode()) == Counter(re.findall(rb"[a-z\x80-\xff]+", long.encode()))
    assert divergence.terms_of(None) == divergence.terms_of(b"") == Counter()
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_shares_are_exact_past_64_bits(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**6)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
