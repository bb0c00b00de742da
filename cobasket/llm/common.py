"""Small helpers that the operators of this package share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seed of every hash order in this package.
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_share(share: float, *cols: Column) -> Column:
    """True for about ``share`` of the rows, by a hash of ``cols``: the same rows on every run."""
    if share >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 30)) < F.lit(math.floor(share * (1 << 30)))


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions the session asks for, never fewer than its cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
