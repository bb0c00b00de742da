"""Writers: Parquet as the store, JSON lines where the document formats are wanted.

A document export is written as one JSON object per item or basket. Its parts can be
read on their own, and no list of the whole graph passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobasket.operators.baskets import encode
from cobasket.operators.graph import dense_ids
from cobasket.staging import stage


def write_graph(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The stored graph, clustered by item so that a lookup reads few files."""
    edges.repartitionByRange("item").sortWithinPartitions("item", F.desc("score"), "partner").write.mode(mode).parquet(path)


def store_graph(edges: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The graph as a table bucketed and sorted by item: joins and groupings on the item do not move it.

    Choose ``buckets`` so that one fits a task; tables joined on one key want the same number.
    """
    return _bucketed(edges.select("item", "partner", "score"), table, path, buckets, "item")


def store_baskets(basket_items: DataFrame, table: str, path: str, by: str = "basket_id", buckets: int = 64) -> DataFrame:
    """Basket items as a table bucketed and sorted by basket, or by item for lookups of baskets by item."""
    return _bucketed(basket_items, table, path, buckets, by)


def _bucketed(df: DataFrame, table: str, path: str, buckets: int, by: str) -> DataFrame:
    # One task writes a bucket, so a bucket is one sorted file.
    dealt = df.repartition(buckets, by)
    dealt.write.bucketBy(buckets, by).sortBy(by).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def adjacency(items: DataFrame, edges: DataFrame, part_size: int = 10_000) -> DataFrame:
    """``(idx, item, part, partners)``: partner ids with scores, best first.

    ``items(item)`` with edges, numbered by name unless it has an ``item_id``. The list
    of an item with very many partners continues in further parts.
    """
    ids = items if "item_id" in items.columns else dense_ids(items.select("item"), ["item"])
    partner_ids = ids.select(F.col("item").alias("partner"), F.col("item_id").alias("pid"))
    # A place is what comes before the cell of the same score and id range, and the place
    # in the cell; a hub is never sorted as a whole.
    cell = ["item", "score", "slot"]
    spread = edges.join(partner_ids, "partner").withColumn("slot", F.floor(F.col("pid") / part_size))
    spread = stage(spread.select("pid", *cell), "spread")
    before = Window.partitionBy("item").orderBy(F.desc("score"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(*cell).count().select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*cell).orderBy("pid")
    lists = (
        spread.join(starts, cell)
        .withColumn("place", F.col("start") + F.row_number().over(inside) - 1)
        .groupBy("item", F.floor(F.col("place") / part_size).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "pid", "score"))).alias("l"))
    )
    return ids.join(lists, "item").select(
        F.col("item_id").alias("idx"), "item", "part", F.transform("l", lambda x: F.array(x["pid"], x["score"])).alias("partners")
    )


def write_affinity_export(items: DataFrame, edges: DataFrame, path: str, source: str, mode: str = "errorifexists") -> None:
    """``items``, ``lists`` and ``meta`` folders of compact JSON."""
    lists = adjacency(items, edges)
    heads = lists.where(F.col("part") == 0)
    heads.select("idx", "item").write.mode(mode).json(f"{path}/items")
    lists.select("idx", "part", "partners").write.mode(mode).json(f"{path}/lists")
    heads.agg(
        F.lit(2).alias("v"), F.lit(source).alias("source"), F.count(F.lit(1)).alias("ingredients")
    ).write.mode(mode).json(f"{path}/meta")


def encoded_rows(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and ``(src_ord, title, ids, url, lang)`` of admitted baskets."""
    vocab, refs = encode(kept)
    # A basket holds at most the admission maximum.
    ids = refs.groupBy("basket_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "local_id"))), lambda x: x["local_id"]).alias("ids")
    )
    return vocab, kept.join(ids, "basket_id").select("src_ord", "title", "ids", "url", "lang")


def manifest(kept: DataFrame, source: str) -> DataFrame:
    """One row of provenance: source, counts in all and per language, vocabulary size."""
    heads = kept.select("lang", F.lit(None).cast("string").alias("item"))
    words = kept.select(F.explode("items").alias("item")).distinct().select(F.lit(None).cast("string").alias("lang"), "item")
    return heads.unionByName(words).agg(
        F.lit(source).alias("source"),
        F.count_if(F.col("item").isNull()).alias("recipes"),
        F.count_if(F.col("lang") == "en").alias("en"),
        F.count_if(F.col("lang") == "fr").alias("fr"),
        F.count("item").alias("vocabulary"),
    )


def sample(kept: DataFrame, n: int = 40) -> DataFrame:
    """The first baskets in source order."""
    return kept.orderBy("src_ord", "basket_id").limit(n)


def write_baskets(kept: DataFrame, path: str, source: str, mode: str = "errorifexists") -> None:
    """Vocabulary, encoded baskets, manifest and a self-contained sample."""
    for folder, rows in (("", kept), ("/sample", sample(kept))):
        vocab, encoded = encoded_rows(rows)
        vocab.write.mode(mode).json(f"{path}{folder}/vocabulary")
        encoded.select("title", "ids", "url", "lang").write.mode(mode).json(f"{path}{folder}/baskets")
    manifest(kept, source).write.mode(mode).json(f"{path}/manifest")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports and decision tables as JSON lines."""
    df.write.mode(mode).json(path)
