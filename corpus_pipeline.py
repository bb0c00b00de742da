"""A training corpus in five stages; each takes what the one before it kept.

All stages take nulls in any column, repeated rows, texts of any length, tables without
rows, and further columns of any name, which all but the last hand on as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cobasket.llm import copies, decontam, mixing, pii, quality
from cobasket.llm.common import table
from cobasket.staging import stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from this stage's own input.

    Null and empty texts are judged by the shares of the classes. Repeated rows stay or go together.
    """
    return quality.keep_clean(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word runs with a similarity of 0.8 or more: that with the smallest id.

    Null and empty texts are one group. Of a repeated row one stays; a row without id stays only in a group without ids.
    """
    return copies.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no noteworthy part of the benchmark.

    Texts without words stay. Rows equal in id and text stay or go together, and all stay if the benchmark is empty.
    """
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; null texts stay null, repeated rows repeated."""
    return pii.redact(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of weights 1, 2, 3 takes of every document.

    Null texts have size 0, a null source is a source of its own, and every repeated row is a document.
    """
    return mixing.mix(docs)


STAGES = [("clean", clean), ("distinct", distinct), ("uncontaminated", uncontaminated), ("redacted", redacted), ("mixed", mixed)]

# No stage but the last of the kind that SQL can express: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
