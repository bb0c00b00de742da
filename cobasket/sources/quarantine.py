"""Readers that set bad rows aside instead of turning them into nulls.

Each returns good rows and ``(file, line, reason)`` of the bad ones. A row is bad when it
cannot be parsed, or when a cell has text that is no value of its column's type; an
empty cell is a null and fine. The parsed rows are staged once, as both parts and their
counts are taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobasket.sources.readers import BASKET_SCHEMA, EDGE_SCHEMA, NODE_SCHEMA, basket_records, source_order
from cobasket.staging import stage

_BROKEN = "broken_line"
MALFORMED = "malformed"


def _parted(raw: DataFrame, reason: Column, good: list[Column], line: Column) -> tuple[DataFrame, DataFrame]:
    rows = stage(raw.select(*good, F.col("_metadata.file_path").alias("_file"), line.alias("_line"), reason.alias("_reason")), "checked")
    bad = rows.where("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return rows.where("_reason IS NULL").drop("_file", "_line", "_reason"), bad


def checked_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The columns of ``schema``, by header name, of CSV files that start with one header.

    The reason of a bad row is ``malformed`` (too many or too few cells) or names the columns.
    """
    header = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _BROKEN]])
    raw = spark.read.schema(text).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN)
    fields = T._parse_datatype_string(schema).fields
    typed = {f.name: F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})") for f in fields}
    wrong = F.array_compact(F.array(*[F.when(typed[f.name].isNull() & (F.trim(F.col(f.name)) != ""), F.lit(f.name)) for f in fields]))
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit(MALFORMED)).when(F.size(wrong) > 0, F.array_join(wrong, ","))
    line = F.coalesce(F.col(_BROKEN), F.concat_ws(",", *header))
    return _parted(raw, reason, [c.alias(name) for name, c in typed.items()], line)


def checked_graph_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``read_graph_csv`` with the bad rows of both files."""
    good_nodes, bad_nodes = checked_csv(spark, nodes, NODE_SCHEMA)
    good_edges, bad_edges = checked_csv(spark, edges, EDGE_SCHEMA)
    return good_nodes, good_edges, bad_nodes.unionByName(bad_edges)


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines, with ``src_ord``; a line is bad when it is no object or a field is of another type."""
    fields = T._parse_datatype_string(schema)
    with_text = T.StructType([*fields.fields, T.StructField(_BROKEN, T.StringType())])
    raw = spark.read.schema(with_text).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN)
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit(MALFORMED))
    return _parted(raw, reason, [*[F.col(f.name) for f in fields], source_order().alias("src_ord")], F.col(_BROKEN))


def checked_basket_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``read_basket_jsonl`` of one path with its bad lines."""
    good, bad = checked_json_lines(spark, path, BASKET_SCHEMA)
    return basket_records(good.withColumn("src_ord", F.struct(F.lit(0).alias("input"), "src_ord.*"))), bad


def counts(bad: DataFrame) -> DataFrame:
    """``(file, reason, n)``."""
    return bad.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))
