"""As-of joins: each left row with the last right row of its key at or before its time.

Both sides are put in one order of key, time and side, cut into ranges, so a hot key spans as many tasks as it needs. Within
a range a window carries the last right row forward; what a range leaves open at its start, the rows of the key that an
earlier range began, takes the last right row before the range, one row a range. No pair of rows is made that is not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simlake.operators.runtime import checkpoint


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, ties: list[str] | None = None, within: float | None = None) -> DataFrame:
    """All rows of ``left`` and the columns of ``right`` that it has not, NULL where no right row matches.

    ``by`` are columns of both sides; rows with a NULL in them or in their time match nothing. Of right rows of one time the
    one with the greatest ``ties`` counts. ``within`` bounds how much earlier it may be, in seconds for times of day and dates.
    """
    own = [c for c in right.columns if c not in by]
    if clash := {c.lower() for c in own} & {c.lower() for c in left.columns}:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    kind = left.schema[left_time].dataType
    order = lambda t: F.col(t).cast(kind)
    clock = kind.typeName() in ("timestamp", "timestamp_ntz", "date")
    packed = F.struct(*(F.col(c) for c in own))
    usable = lambda t: [*(F.col(c).isNotNull() for c in by), F.col(t).isNotNull()]
    both = lambda conditions: conditions[0] if len(conditions) == 1 else conditions[0] & both(conditions[1:])
    rank = F.struct(*(F.col(c) for c in (ties or own)))
    key = [f"~k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, key)]
    r = right.where(both(usable(right_time))).select(*named, order(right_time).alias("~t"), F.lit(0).alias("~side"), rank.alias("~tie"), packed.alias("~right"))
    r = r.groupBy(*key, "~t", "~side").agg(F.max_by("~right", "~tie").alias("~right"))  # one row a key and time
    kept = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    ordered = left.where(both(usable(left_time))).select(*named, order(left_time).alias("~t"), F.lit(1).alias("~side"), kept.alias("~left"))
    lone = left.where(~both(usable(left_time))).select(kept.alias("~left"))
    sides = r.withColumn("~left", F.lit(None).cast(ordered.schema["~left"].dataType)).unionByName(ordered.withColumn("~right", F.lit(None).cast(r.schema["~right"].dataType)))
    salt = F.xxhash64(F.col("~left"))  # left rows of one key and time may be many
    sort = [*key, "~t", "~side", "~salt"]
    ranged = checkpoint(sides.withColumn("~salt", salt).repartitionByRange(*sort).withColumn("~part", F.spark_partition_id()))
    at = F.struct(*key, "~t", "~side", "~salt")
    ends = ranged.groupBy("~part").agg(F.min(at).alias("~first"), F.max_by(F.struct(*key, "~t", "~right"), F.when(F.col("~side") == 0, at)).alias("~last"))
    before = F.last("~last", ignorenulls=True).over(Window.orderBy("~part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("~part", "~first", before.alias("~before"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col("~first")[k] == F.col("~before")[k])
    carried = F.broadcast(carried.where(F.col("~before").isNotNull() & same).select(F.col("~part").alias("~p"), F.struct(*(F.col("~before")[k].alias(k) for k in key)).alias("~of"), F.col("~before")["~t"].alias("~bt"), F.col("~before")["~right"].alias("~br")))
    along = Window.partitionBy("~part", *key).orderBy("~t", "~side", "~salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(F.when(F.col("~side") == 0, c), ignorenulls=True).over(along)
    met = ranged.select("*", last(F.col("~t")).alias("~rt"), last(F.col("~right")).alias("~found")).where("`~side` = 1")
    opened = F.struct(*key)
    met = met.join(carried, (F.col("~part") == F.col("~p")) & (opened == F.col("~of")), "left")
    time, found = F.coalesce("~rt", "~bt"), F.when(F.col("~rt").isNotNull(), F.col("~found")).otherwise(F.col("~br"))
    if within is not None:
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        passed = micros(F.col("~t")) - micros(time) if clock else F.col("~t") - time
        found = F.when(passed <= (round(within * 1e6) if clock else within), found)
    met = met.select("~left", found.alias("~found"))
    lone = lone.withColumn("~found", F.lit(None).cast(met.schema["~found"].dataType))
    return met.unionByName(lone).select(*(F.col("~left")[c].alias(c) for c in left.columns), *(F.col("~found")[c].alias(c) for c in own))
