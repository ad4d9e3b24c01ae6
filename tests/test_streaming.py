from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from simlake.plans import extensions
from simlake.streaming import running

SCHEMA = "key string, id long, score double, ts timestamp"
NOON = dt.datetime(2024, 5, 1, 0, 0)


def at(minutes):
    return NOON + dt.timedelta(minutes=minutes)


def best(rows, k, closed):
    """The k best of each key and hour, each id once; hours that end by ``closed``."""
    groups = {}
    for key, i, score, ts in rows:
        if i is not None and score is not None and score == score and ts is not None:
            held = groups.setdefault((key, ts.replace(minute=0, second=0)), {})
            held[i] = max(score, held.get(i, score))
    out = []
    for (key, start), held in groups.items():
        if start + dt.timedelta(hours=1) <= closed:
            out += [(key, start, rank, i, held[i]) for rank, i in enumerate(sorted(held, key=lambda i: (-held[i], i))[:k], 1)]
    return sorted(out, key=str)


def test_a_replayed_stream_equals_the_batch_result(spark, tmp_path):
    """A hot and a null key, ties, nulls, repeats, rows up to ten minutes late; a row later than the watermark is dropped, and its hour is not given out again."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([float(rng.randrange(9)), rng.random(), None, float("nan")]), at(i * 0.5)) for i in range(600)]
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=rng.uniform(0, 10)))
    parts = [arrival[:200], arrival[190:420], arrival[400:]]  # parts overlap: repeats
    parts[0] += parts[0][:50] + [("a", None, 5.0, at(1)), ("a", 9001, 5.0, None)]
    parts[2] += [("hot", 9002, 1e9, at(5))]
    conf = {name: spark.conf.get(name) for name in running.SETTINGS}
    out = running.replayed(spark, [spark.createDataFrame(p, SCHEMA) for p in parts], str(tmp_path), lambda s: running.running_top(s, k=4, every="1 hour", late="30 minutes"))
    got = sorted(((r["key"], r["start"], r["rank"], r["id"], r["score"]) for r in out.collect()), key=str)
    last = max(r[3] for r in rows if r[2] is not None and r[2] == r[2])
    want = best(rows, 4, last - dt.timedelta(minutes=30))
    assert got == want and len(want) > 20
    assert {name: spark.conf.get(name) for name in running.SETTINGS} == conf


def test_a_part_that_is_read_again_adds_nothing(spark, tmp_path):
    rows = [("a", i, float(i), at(i * 10)) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    once = running.replayed(spark, [frame, frame.where("false"), frame], str(tmp_path), lambda s: running.running_top(s, k=2, every="1 hour", late="1 minute"))
    assert sorted(((r["key"], r["start"], r["rank"], r["id"], r["score"]) for r in once.collect()), key=str) == best(rows, 2, at(389))


def test_an_empty_stream_gives_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, of in (("top", running.running_top), ("sessions", running.sessions)):
        assert running.replayed(spark, [empty], f"{tmp_path}/{name}", of).collect() == []


def test_sessions_of_a_replayed_stream(spark, tmp_path):
    """Late rows join two sessions into one; repeats count once; null ids and times do not count; a session past the watermark is not opened again; open ones are held back."""
    first = [("a", 1, 1.0, at(0)), ("a", 2, 2.0, at(18)), (None, 3, None, at(1)), ("a", 1, 1.0, at(0)), ("a", None, 9.0, at(1)), ("a", 4, 9.0, None)]
    second = [("a", 5, 4.0, at(9)), ("a", 2, 2.0, at(18)), ("b", 6, 8.0, at(60))]
    third = [("a", 7, 16.0, at(2)), ("b", 8, 1.0, at(200))]
    parts = [spark.createDataFrame(p, SCHEMA) for p in (first, second, third)]
    out = running.replayed(spark, parts, str(tmp_path), lambda s: running.sessions(s, gap="10 minutes", late="30 minutes"))
    got = sorted(((r["key"], r["start"], r["last"], r["n"], r["total"]) for r in out.collect()), key=str)
    assert got == sorted([("a", at(0), at(18), 3, 7.0), (None, at(1), at(1), 1, None), ("b", at(60), at(60), 1, 8.0)], key=str)


def test_pieces_of_a_stream_are_read_in_one_pass_and_hold_every_event(spark, sf):
    events = extensions.table(spark, sf, "events").count()
    pieces = extensions._pieces(spark, sf, "user_id")
    assert all(p._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1 for p in pieces)
    whole = pieces[0].unionAll(pieces[1]).unionAll(pieces[2]).groupBy("id").agg(F.count("*").alias("n"))
    assert whole.count() == events and whole.where("n != 1 and id % 7 != 0").isEmpty()
    assert {r["n"] for r in whole.where("id % 7 = 0").collect()} == {2, 3}  # the last piece has no next one


def test_the_store_is_set_for_the_query_only(spark, tmp_path):
    frame = spark.createDataFrame([("a", i, float(i), at(i * 10)) for i in range(20)], SCHEMA)
    running.replayed(spark, [frame], str(tmp_path), lambda s: running.sessions(s, gap="5 minutes", late="1 minute"))
    assert running.STORE and all(spark.conf.get(name, None) is None for name in running.STORE)
