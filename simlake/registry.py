"""Every query of the library with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simlake.plans import analysis, encoding, extensions, retrieval, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **encoding.QUERIES, **analysis.QUERIES, **storage.QUERIES, **extensions.QUERIES}
ORACLE_SQL: dict[str, str] = {**retrieval.ORACLE_SQL, **encoding.ORACLE_SQL, **analysis.ORACLE_SQL, **storage.ORACLE_SQL, **extensions.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ret2_topk"](spark, sf_dir)
