"""Retrieval quality from a ranked result (q, id, sim, rank): one ranking serves all metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DENOMINATORS = ("retrieved", "k", "all_relevant")


def with_relevance(ranked: DataFrame, queries: DataFrame, database: DataFrame) -> DataFrame:
    """Adds ``rel`` (1 if the labels agree). ``queries(q, label)``, ``database(id, label)``; a database row without a label is an error."""
    found = ranked.join(queries.select("q", F.col("label").alias("q_label")), "q").join(database.select("id", F.col("label").alias("d_label")), "id", "left")
    label = F.when(F.col("d_label").isNull(), F.raise_error(F.concat(F.lit("no label for id "), F.col("id").cast("string"))).cast("int")).otherwise(F.col("d_label"))
    return found.withColumn("rel", (label == F.col("q_label")).cast("int")).drop("q_label", "d_label")


def average_precision(relevant: DataFrame, denominator: str = "retrieved", k: int | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(q, ap): the sum of precisions at relevant ranks, divided by the relevant rows retrieved (default), by k, or by all that exist.

    ``k`` cuts the ranking first; ``totals(q, n_relevant)`` is needed for ``all_relevant``. No relevant row gives 0.
    """
    if denominator not in DENOMINATORS:
        raise ValueError(f"denominator must be one of {DENOMINATORS}")
    cut = relevant.where(F.col("rank") <= k) if k is not None else relevant
    hits = F.sum("rel").over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = cut.withColumn("hits", hits).groupBy("q").agg(F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("s"), F.sum("rel").alias("r"), F.count("*").alias("n"))
    if denominator == "all_relevant":
        if totals is None:
            raise ValueError("all_relevant needs the totals of relevant rows")
        sums = sums.join(totals, "q")
    by = {"retrieved": F.col("r"), "k": F.col("n") if k is None else F.lit(k), "all_relevant": F.col("n_relevant") if denominator == "all_relevant" else None}[denominator]
    return sums.select("q", F.when(F.col("r") > 0, F.try_divide(F.col("s"), by.cast("double"))).otherwise(F.lit(0.0)).alias("ap"))


def mean_average_precision(relevant: DataFrame, denominator: str = "retrieved", k: int | None = None, totals: DataFrame | None = None) -> DataFrame:
    """One row: ``map``; NULL without queries."""
    return average_precision(relevant, denominator, k, totals).agg(F.avg("ap").alias("map"))


def mean_average_precisions(relevant: DataFrame, ks: tuple[int | None, ...] = (None,)) -> DataFrame:
    """(denominator, k, map) of every denominator and cut (0 where the ranking is not cut) in one pass over ``relevant``, which must hold whole rankings."""
    hits = F.sum("rel").over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = [F.sum("rel").alias("all")]
    for k in ks:
        cut = lambda c, k=k: F.sum(F.when(F.lit(k is None) | (F.col("rank") <= (k or 0)), c).otherwise(0))
        sums += [cut(F.col("rel") * F.col("hits") / F.col("rank")).alias(f"s{k}"), cut(F.col("rel")).alias(f"r{k}"), F.count("*").alias(f"n{k}")]
    per_query = relevant.withColumn("hits", hits).groupBy("q").agg(*sums)
    each = []
    for k in ks:
        by = {"retrieved": F.col(f"r{k}"), "k": F.col(f"n{k}") if k is None else F.lit(k), "all_relevant": F.col("all")}
        each += [F.struct(F.lit(d).alias("denominator"), F.lit(k or 0).alias("k"), F.avg(F.when(F.col(f"r{k}") > 0, F.try_divide(F.col(f"s{k}"), by[d].cast("double"))).otherwise(F.lit(0.0))).alias("map")) for d in DENOMINATORS]
    return per_query.agg(F.array(*each).alias("all")).select(F.inline("all"))


def mean_average_precisions_by_counting(ranks: DataFrame, queries: DataFrame, database: DataFrame, ks: tuple[int | None, ...] = (None,)) -> DataFrame:
    """(denominator, k, map) as ``mean_average_precisions`` gives it, from ``scoring.relevant_ranks``: no ranking of all rows. Queries without a relevant row count 0."""
    size, sums = database.count(), [F.count("*").alias("all")]
    for k in ks:
        cut = lambda c, k=k: F.sum(F.when(F.lit(k is None) | (F.col("rank") <= (k or 0)), c).otherwise(0))
        sums += [cut(F.col("hits") / F.col("rank")).alias(f"s{k}"), cut(F.lit(1)).alias(f"r{k}")]
    per_query = queries.select("q").join(ranks.groupBy("q").agg(*sums), "q", "left")
    each = []
    for k in ks:
        by = {"retrieved": F.col(f"r{k}"), "k": F.lit(size if k is None else k), "all_relevant": F.col("all")}
        each += [F.struct(F.lit(d).alias("denominator"), F.lit(k or 0).alias("k"), F.avg(F.when(F.col(f"r{k}") > 0, F.try_divide(F.col(f"s{k}"), by[d].cast("double"))).otherwise(F.lit(0.0))).alias("map")) for d in DENOMINATORS]
    return per_query.agg(F.array(*each).alias("all")).select(F.inline("all"))


def top_k_accuracy(relevant: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """One row: the share of queries with a relevant row in their first k. ``queries`` keeps those without any result in the count."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    any_ = relevant.groupBy("q").agg(F.max(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("hit"))
    if queries is not None:
        any_ = queries.select("q").join(any_, "q", "left")
    return any_.agg(F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")).alias("accuracy"))


def mean_below_diagonal(matrix: DataFrame) -> DataFrame:
    """One row: the mean of a long matrix (q, id, sim) strictly below its diagonal; NULL for one row."""
    return matrix.where(F.col("q") > F.col("id")).agg(F.avg("sim").alias("mean"))
