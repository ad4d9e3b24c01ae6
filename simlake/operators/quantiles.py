"""Exact quantiles and average ranks of many groups at once, where one group or value may hold most rows.

Quantiles select by rank: each pass counts the values of the intervals that still hold a wanted rank in BUCKETS parts, and keeps
the part in which the rank falls, until its least and greatest value are equal. Counts combine before the shuffle, so a pass
moves at most BUCKETS rows a task and wanted rank, and no task holds the values of a group. (``F.median`` and ``F.percentile``
hold a map of all distinct values of a group in one task.) The first pass parts the 128th roots of the values, which tells
magnitudes apart, the others the values themselves; each pass parts the least from the greatest, so they end.

Ranks come from counts of distinct values in ranges of (group, value), with the counts before each range carried over; a hot
value is one row there. Ranks meet the rows again by broadcast up to HELD values; past that only those of hot values do.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simlake.operators.order import running_total
from simlake.operators.runtime import checkpoint

#: Parts of an interval in a pass.
BUCKETS = 4096

#: The greatest finite double; infinities have parts of their own.
GREATEST = sys.float_info.max

#: Groups, or ranks, that go to every task; more are joined.
HELD = 1 << 20

#: A value is hot if it holds more than one row in so many.
HOT = 1000


def _magnitude(v: Column) -> Column:
    """Orders as v does, on a scale on which 1e-300 and 1e300 are near: square roots are rounded correctly, so they keep the order."""
    root = F.abs(v)
    for _ in range(7):
        root = F.sqrt(root)
    return F.signum(v) * root


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(*by, q array<double>): interpolated quantiles of each group's values; NULL and NaN are left out, and groups without others."""
    own = rows.select(*by, F.col(value).cast("double").alias("~v")).where(F.col("~v").isNotNull() & ~F.isnan("~v"))
    count = own.groupBy(*by).agg(F.count("*").alias("~n"), F.min("~v").alias("~lo"), F.max("~v").alias("~hi"))
    place = lambda p: (F.col("~n") - 1) * F.lit(float(p))
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)) + 1, F.ceil(place(p)) + 1) for p in at))))
    groups = checkpoint(count.select(*by, "~n", "~lo", "~hi", wanted.alias("~wanted")).where("`~n` > 0"))
    spread_groups = (lambda df: F.broadcast(df)) if groups.count() <= HELD else (lambda df: df)
    todo = groups.select(*by, F.array(F.struct(F.col("~lo").alias("lo"), F.col("~hi").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("~wanted").alias("wanted"))).alias("~open"))
    found, scale = None, _magnitude
    while True:
        closed = todo.select(*by, F.explode(F.filter("~open", lambda i: i["lo"] == i["hi"])).alias("i")).select(*by, F.explode("i.wanted").alias("~rank"), F.col("i.lo").alias("~value"))
        found = closed if found is None else found.unionAll(closed)
        todo = todo.select(*by, F.filter("~open", lambda i: i["lo"] < i["hi"]).alias("~open")).where(F.size("~open") > 0)
        if todo.isEmpty():
            break
        finite = lambda c, scale=scale: scale(F.least(F.greatest(c, F.lit(-GREATEST)), F.lit(GREATEST)))
        ends = F.transform("~open", lambda i: F.struct(i["lo"].alias("lo"), i["hi"].alias("hi"), finite(i["lo"]).alias("from"), finite(i["hi"]).alias("to")))
        named = [F.col(c).alias(f"~by{k}") for k, c in enumerate(by)]
        meets = [F.col(c).eqNullSafe(F.col(f"~by{k}")) for k, c in enumerate(by)]
        met = own.withColumn("~s", finite(F.col("~v"))).join(spread_groups(todo.select(*named, ends.alias("~ends"))), meets or F.lit(True))
        met = met.select(*by, "~v", "~s", F.inline(F.filter("~ends", lambda i: F.col("~v").between(i["lo"], i["hi"]))))  # a row lies in one interval at most
        lo, hi, v = F.col("from"), F.col("to"), F.col("~s")
        share = F.when(hi - lo < float("inf"), (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise((v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)))
        part = F.when(F.col("~v") < -GREATEST, -1).when(F.col("~v") > GREATEST, BUCKETS).when(hi > lo, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
        counted = met.groupBy(*by, F.col("lo").alias("~from"), part.alias("~part")).agg(F.count("*").alias("~k"), F.min("~v").alias("~lo"), F.max("~v").alias("~hi"))
        opened = spread_groups(todo.select(*named, F.explode("~open").alias("~i")))
        counted = counted.join(opened, [*meets, F.col("~from") == F.col("~i.lo")])
        up_to = F.sum("~k").over(Window.partitionBy(*by, "~from").orderBy("~part")) + F.col("~i.below")  # at most BUCKETS rows an interval
        kept = counted.select("*", up_to.alias("~up_to")).select("*", F.filter("~i.wanted", lambda r: (r > F.col("~up_to") - F.col("~k")) & (r <= F.col("~up_to"))).alias("~got")).where(F.size("~got") > 0)
        interval = F.struct(F.col("~lo").alias("lo"), F.col("~hi").alias("hi"), (F.col("~up_to") - F.col("~k")).alias("below"), F.col("~got").alias("wanted"))
        todo, scale = checkpoint(kept.groupBy(*by).agg(F.collect_list(interval).alias("~open"))), lambda c: c
    ranks = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("~rank", "~value"))).alias("~at"))
    back = groups.select(*(F.col(c).alias(f"~by{k}") for k, c in enumerate(by)), "~n")
    joined = ranks.join(back, [F.col(c).eqNullSafe(F.col(f"~by{k}")) for k, c in enumerate(by)] or F.lit(True))

    def one(p: float) -> Column:
        low = F.element_at("~at", F.floor(place(p)) + 1)
        high = F.element_at("~at", F.ceil(place(p)) + 1)
        share = place(p) - F.floor(place(p))
        return F.when(low == high, low).otherwise((1 - share) * low + share * high)

    return joined.select(*by, F.array(*(one(p) for p in at)).alias("q"))


def ranks(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, value, n, rank) of ``counts(*by, value, n)`` with distinct values: the mean rank of the n rows that share a value, in their group, less half of the group's rows and one: ranks around 0."""
    total = running_total(counts, [*by, value], "~up_to", F.col("n"))
    ends = total.groupBy(*by).agg(F.min(F.col("~up_to") - F.col("n")).alias("~before"), F.sum("n").alias("~rows"))
    if by:
        total = total.join(F.broadcast(ends) if ends.count() <= HELD else ends, by)
    else:
        total = total.crossJoin(F.broadcast(ends))
    rank = F.col("~up_to") - F.col("~before") - (F.col("n") - 1) / 2 - (F.col("~rows") + 1) / 2
    return total.select(*by, value, "n", rank.alias("rank"))


def with_rank(rows: DataFrame, ranked: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank of their value. Values of many rows are looked up in every task, so no join has a hot key."""
    on = [*by, value]
    own = ranked.select(*on, F.col("rank").alias(name))
    size, all_ = ranked.agg(F.count("*"), F.sum("n")).first()
    if size <= HELD:
        return rows.join(F.broadcast(own), on)
    hot = ranked.where(F.col("n") > all_ // HOT).select(*on, F.col("rank").alias(name))
    looked_up = rows.join(F.broadcast(hot), on, "left")
    return looked_up.where(F.col(name).isNotNull()).unionByName(looked_up.where(F.col(name).isNull()).drop(name).join(own, on))


def rank_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, spearman) of ``pairs(*by, x, y)`` without NULL and NaN; NULL where a side is constant or a group has one pair."""
    distinct = checkpoint(pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("n")))
    both = distinct
    for c in ("x", "y"):
        counts = checkpoint(distinct.groupBy(*by, c).agg(F.sum("n").alias("n")))
        both = with_rank(both, checkpoint(ranks(counts, by, c)), by, c, f"~r{c}")
    of = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    sums = both.groupBy(*by).agg(of("~rx", "~ry").alias("xy"), of("~rx", "~rx").alias("xx"), of("~ry", "~ry").alias("yy"))
    return sums.select(*by, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("spearman"))
