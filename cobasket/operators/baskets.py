"""From mapped line items to the basket corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions.text import norm_title
from cobasket.operators.graph import dense_ids
from cobasket.operators.mapping import DETERMINISTIC_STAGES
from cobasket.params import DEFAULTS, Params


def map_occurrences(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """``lines(basket_id, pos, phrase)`` with the item and stage of each occurrence."""
    return lines.join(mapping.select("phrase", "item", "stage"), "phrase", "left").withColumn(
        "stage", F.coalesce("stage", F.lit("unmapped"))
    )


def admit(baskets: DataFrame, occurrences: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Baskets that are mostly canonical: ``(basket_id, title, lang, url, src_ord, items)``.

    ``items`` is in first-place order. Sizes are checked before any list is built,
    so a list never holds more than ``max_items``. The occurrences travel once, by basket;
    items, sizes and lists are found where they lie.
    """
    head = baskets.where((F.trim("title") != "") & (F.lit(True) if params.langs is None else F.col("lang").isin(*params.langs)))
    per_item = (
        occurrences.select("basket_id", "pos", "item").repartition("basket_id").groupBy("basket_id", "item")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"))
    )
    basket = Window.partitionBy("basket_id")
    mapped, total = F.count("item").over(basket), F.sum("times").over(basket)
    good = per_item.withColumns({"mapped": mapped, "total": total}).where(
        F.col("item").isNotNull()
        & F.col("mapped").between(params.min_items, params.max_items)
        & (F.col("mapped") / F.col("total") >= params.min_map_ratio)
    )
    lists = good.groupBy("basket_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")
    )
    return head.join(lists, "basket_id")


def dedupe(admitted: DataFrame) -> DataFrame:
    """First basket of each (language, title, item set).

    A hash of the three stands first in the key: rows are sorted by a number and seldom by lists.
    """
    row = F.struct(*[F.col(c) for c in admitted.columns])
    key = {"_l": F.col("lang"), "_t": norm_title(F.col("title")), "_s": F.array_sort("items")}
    return (
        admitted.groupBy(F.xxhash64(*key.values()).alias("_h"), *[c.alias(n) for n, c in key.items()])
        .agg(F.min_by(row, F.struct("src_ord", "basket_id")).alias("r"))
        .select("r.*")
    )


def budget(kept: DataFrame, target: int, params: Params = DEFAULTS) -> DataFrame:
    """Coverage-first choice of ``target`` baskets.

    With baskets in order of size, a basket is taken for coverage exactly when it is
    among the first ``coverage_quota`` of one of its items. The rest fills up by size.
    """
    size = F.size("items")
    order = [F.desc("size"), "src_ord", "basket_id"]
    rows = kept.withColumn("size", size)
    per_item = Window.partitionBy("item").orderBy(*order)
    covering = (
        rows.select("basket_id", "src_ord", "size", F.explode("items").alias("item"))
        .withColumn("_r", F.row_number().over(per_item))
        .where(F.col("_r") <= params.coverage_quota)
        .select("basket_id")
        .distinct()
        .withColumn("coverage_pick", F.lit(True))
    )
    placed = (
        rows.join(covering, "basket_id", "left")
        .withColumn("coverage_pick", F.coalesce("coverage_pick", F.lit(False)))
    )
    # Numbered by range partition, so that no task sorts all that is chosen.
    return dense_ids(placed, [F.desc("coverage_pick"), *order]).where(F.col("item_id") < target).drop("size", "item_id")


def encode(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary in first-appearance order and baskets as local ids.

    Returns ``vocab(item, local_id)`` and ``(basket_id, pos, local_id)``.
    """
    spread = kept.select("basket_id", "src_ord", F.posexplode("items").alias("pos", "item"))
    first = spread.groupBy("item").agg(F.min(F.struct("src_ord", "basket_id", "pos")).alias("f")).select("item", "f.*")
    vocab = dense_ids(first, ["src_ord", "basket_id", "pos"]).select("item", F.col("item_id").alias("local_id"))
    return vocab, spread.join(vocab, "item").select("basket_id", "pos", "local_id")


def counts_by(kept: DataFrame, column: str = "lang") -> DataFrame:
    """Baskets per language (or source) with the total as the row of null."""
    return kept.rollup(column).agg(F.count(F.lit(1)).alias("baskets"))


def mapping_report(occurrences: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row: occurrences, shares mapped and mapped deterministically, and the gate."""
    return occurrences.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("stage") != "unmapped").alias("mapped"),
        F.count_if(F.col("stage").isin(*DETERMINISTIC_STAGES)).alias("deterministic"),
    ).select(
        "*",
        (F.col("mapped") / F.nullif(F.col("total"), F.lit(0))).alias("mapped_share"),
        (F.col("deterministic") / F.nullif(F.col("total"), F.lit(0))).alias("deterministic_share"),
    ).withColumn("passes", F.col("deterministic_share") >= params.mapping_gate)


def stage_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("stage").agg(F.count(F.lit(1)).alias("occurrences"))


def summary(items: DataFrame, baskets: DataFrame, source: str | None = None) -> DataFrame:
    """One row: source label, item and basket counts."""
    rows = items.select(F.lit("item").alias("k")).unionByName(baskets.select(F.lit("basket").alias("k")))
    return rows.agg(
        F.lit(source or "demo").alias("source"),
        F.count_if(F.col("k") == "item").alias("items"),
        F.count_if(F.col("k") == "basket").alias("baskets"),
    )
