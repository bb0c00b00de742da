"""Finding items by part of their display name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.staging import stage


def name_pieces(text: Column) -> Column:
    """The pieces of one to three letters that a text holds, each once."""
    size = F.length(text)
    return F.array_distinct(F.flatten(F.transform(
        F.array(F.lit(1), F.lit(2), F.lit(3)),
        lambda n: F.when(
            size >= n,
            F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, n)),
        ).otherwise(F.array().cast("array<string>")),
    )))


def index_names(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items(item, display, freq)`` -> the stored index ``(gram, item, freq, shown)``, and ``(gram, df)``."""
    shown = items.select("item", "freq", F.lower("display").alias("shown"))
    index = stage(shown.select(F.explode(name_pieces(F.col("shown"))).alias("gram"), "item", "freq", "shown"), "name-index")
    return index, stage(index.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "name-pieces")


def search_items(
    queries: DataFrame, items: DataFrame, excluded: DataFrame | None = None, limit: int = 8, trim: bool = True,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``queries(query_id, query)``, ``items(item, display, freq)`` -> ranked hits.

    A hit contains the query; names that start with it come first, then the popular.
    ``excluded(query_id, item)`` is left out. A query meets names on the rarest of its
    three-letter pieces, a shorter one on its whole text, so a piece that is in
    every name costs nothing unless nothing else was asked for. ``index`` may hold what
    ``index_names`` made of the items before.
    """
    index, pieces = index or index_names(items)
    q = F.lower(F.trim("query") if trim else F.col("query"))
    asked = queries.select("query_id", q.alias("q")).where(F.length("q") > 0)
    texts = asked.select("q").distinct()
    width = F.least(F.length("q"), F.lit(3))
    grams = F.filter(name_pieces(F.col("q")), lambda g: F.length(g) == width)
    # One row for each text and piece: a piece that no name has is the rarest of all.
    rarest = texts.select("q", F.explode(grams).alias("gram")).join(pieces, "gram", "left").groupBy("q").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best")
    )
    asked = asked.join(rarest.where("best.df > 0").select("q", "best.gram"), "q")
    hits = asked.join(index, "gram").where(F.col("shown").contains(F.col("q")))
    if excluded is not None:
        hits = hits.join(excluded.select("query_id", "item"), ["query_id", "item"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.col("shown").startswith(F.col("q"))), F.desc("freq"), "item"
    )
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("query_id", "item", "freq", "rank")
    )
