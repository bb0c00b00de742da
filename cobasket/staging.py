"""Staged tables: the one way lineage is cut here.

A table that several branches of a job read, or that an iterative job rewrites
each round, is written once as Parquet under the shared checkpoint folder and
read back. The tables of an application share a folder, which may go when it ends.
Losing an executor then costs a re-read, not a recomputation, and
the optimiser sees the real size of the table, so joins against it are
broadcast only when it is small.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scopes", default=())


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if configured:
        if configured.startswith("file:") and not local:
            raise RuntimeError(f"spark.checkpoint.dir is {configured}, which executors on other machines do not share")
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[app]


def folder(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A fresh path in this application's folder, inside the scope that is open, or with ``outer`` the one around it."""
    app = spark.sparkContext.applicationId
    scopes = _SCOPES.get()[:-1] if outer else _SCOPES.get()
    return "/".join((checkpoint_dir(spark).rstrip("/"), "cobasket", app, *scopes, f"{label}-{uuid.uuid4().hex}"))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; results read from them must be stored before."""
    _delete(spark, f"{checkpoint_dir(spark).rstrip('/')}/cobasket/{spark.sparkContext.applicationId}")


@contextlib.contextmanager
def scope(spark: SparkSession, label: str = "scope") -> Iterator[None]:
    """Tables staged inside go when it ends; what is to stay is staged with ``outer``. Scopes nest."""
    path = folder(spark, label)
    token = _SCOPES.set((*_SCOPES.get(), path.rsplit("/", 1)[1]))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        _delete(spark, path)


def stage(df: DataFrame, label: str = "t", outer: bool = False) -> DataFrame:
    """Write ``df`` to a new staged table and return a scan of it."""
    spark = df.sparkSession
    path = folder(spark, label, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counting(df: DataFrame, label: str = "t", **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage`` that also returns aggregates taken while the rows are written."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    return staged, seen.get
