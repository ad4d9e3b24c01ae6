"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents; the last
returns the packed pieces. Nothing is sampled: each stage works on every row that its predecessor kept.

* language: documents without a letter, and those that no language claims, go.
* near_duplicates: one document of each SimHash group stays, the one with the smallest doc_id.
* decontaminate: documents with windows of two or more benchmark items go; a passage of a single item is cut out of its document.
* secrets: every secret becomes a mark of its kind.
* packing: power-of-two pieces of the tokens.

Edge cases: a null or empty text has no letter and goes at the first stage, as do all rows of a table without one; null values
of other columns stay as they are, n_chars follows the text; a null doc_id goes only if its text has a group with another id,
and is packed as null; of documents that tie (equal ids in a group) one stays; repeated rows are near-duplicates, so one
stays; texts of any length are read whole; an empty table gives an empty result; further columns, whatever their names,
pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simlake.llm import decontaminate, language, packing, secrets, simhash
from simlake.llm.common import dropped, table, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.train(language.training_sample(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

#: No SQL engine trains the network or runs the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again, and goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
