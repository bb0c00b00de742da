"""Replaying curation decisions over the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.operators.graph import degree, dense_ids
from cobasket.operators.resolve import resolve_merges
from cobasket.staging import stage


@dataclass
class Curated:
    items: DataFrame  # item
    edges: DataFrame  # item, partner, score[, context]
    resolved: DataFrame  # src, tgt (null: dropped)
    removed_bad: DataFrame  # the directed edges a bad pair removed


def live_items(items: DataFrame, deleted: DataFrame, merged: DataFrame) -> DataFrame:
    """Names that are neither deleted nor a merge source; chains play no part."""
    return items.join(deleted.select("item"), "item", "left_anti").join(
        merged.select(F.col("src").alias("item")), "item", "left_anti"
    )


def _rewrite(names: DataFrame, column: str, resolved: DataFrame, gone: DataFrame) -> DataFrame:
    """Send ``column`` through the resolved merges; rows on dropped names go."""
    hop = resolved.select(
        F.col("src").alias(column), F.col("tgt").alias("_tgt"), F.lit(True).alias("_moved")
    )
    kept = names.join(gone.select(F.col("item").alias(column)), column, "left_anti")
    return (
        kept.join(hop, column, "left")
        .where(F.col("_moved").isNull() | F.col("_tgt").isNotNull())
        .withColumn(column, F.coalesce("_tgt", column))
        .drop("_tgt", "_moved")
    )


def collapse_edges(edges: DataFrame, resolved: DataFrame, gone: DataFrame) -> DataFrame:
    """Rewrite both ends, drop self-edges, keep the highest score per pair.

    A ``context`` column, where present, stays part of the key.
    """
    keys = (["context"] if "context" in edges.columns else []) + ["item", "partner"]
    moved = _rewrite(_rewrite(edges, "item", resolved, gone), "partner", resolved, gone)
    return moved.where(F.col("item") != F.col("partner")).groupBy(*keys).agg(F.max("score").alias("score"))


def blocked_pairs(bad_pairs: DataFrame, resolved: DataFrame, gone: DataFrame) -> DataFrame:
    """``bad_pairs(names array)`` -> both directions of each well-formed pair, by final name."""
    pairs = bad_pairs.where(F.size("names") == 2).select(
        F.col("names")[0].alias("item"), F.col("names")[1].alias("partner")
    )
    named = _rewrite(_rewrite(pairs, "item", resolved, gone), "partner", resolved, gone)
    named = named.where(F.col("item") != F.col("partner"))
    return named.unionByName(named.select(F.col("partner").alias("item"), F.col("item").alias("partner"))).distinct()


def curate(
    items: DataFrame, edges: DataFrame, deleted: DataFrame, merged: DataFrame, bad_pairs: DataFrame
) -> Curated:
    """Apply deletions, merges and bad pairs to ``edges(item, partner, score[, context])``."""
    resolved = stage(resolve_merges(merged, deleted, items), "resolved")
    dropped = resolved.where(F.col("tgt").isNull()).select(F.col("src").alias("item"))
    gone = deleted.select("item").unionByName(dropped).distinct()
    kept = items.join(gone, "item", "left_anti").join(
        resolved.select(F.col("src").alias("item")), "item", "left_anti"
    )
    known = items.select("item")
    edges = edges.join(known, "item", "left_semi").join(
        known.withColumnRenamed("item", "partner"), "partner", "left_semi"
    )
    rewritten = collapse_edges(edges, resolved, gone)
    blocked = blocked_pairs(bad_pairs, resolved, gone)
    if "context" in edges.columns:
        # A bad pair reaches only context 0.
        blocked = blocked.withColumn("context", F.lit(0))
        keys = ["context", "item", "partner"]
    else:
        keys = ["item", "partner"]
    return Curated(
        items=kept,
        edges=rewritten.join(blocked, keys, "left_anti"),
        resolved=resolved,
        removed_bad=rewritten.join(blocked, keys, "left_semi"),
    )


def reindex(items: DataFrame, order_by: str = "item_id") -> DataFrame:
    """Kept items renumbered in their old order, for the exported document."""
    old = items.withColumnRenamed("item_id", "_old") if order_by == "item_id" else items
    key = "_old" if order_by == "item_id" else order_by
    return dense_ids(old, [key]).drop("_old")


def active_items(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items with at least one edge."""
    return items.join(edges.select("item").distinct(), "item", "left_semi")


def impact(before: DataFrame, result: Curated) -> DataFrame:
    """Per merge target: partners before, after and gained."""
    targets = result.resolved.where(F.col("tgt").isNotNull()).select(F.col("tgt").alias("item")).distinct()
    old = degree(before).withColumnRenamed("degree", "before")
    new = degree(result.edges).withColumnRenamed("degree", "after")
    return (
        targets.join(old, "item", "left").join(new, "item", "left")
        .select(
            "item",
            F.coalesce("before", F.lit(0)).alias("before"),
            F.coalesce("after", F.lit(0)).alias("after"),
        )
        .withColumn("gained", F.col("after") - F.col("before"))
    )


def impact_totals(items: DataFrame, deleted: DataFrame, result: Curated) -> DataFrame:
    """One row: names deleted and merged, directed bad edges removed, names left."""
    known = items.select("item")
    dropped = result.resolved.where(F.col("tgt").isNull()).select(F.col("src").alias("item"))
    gone = deleted.select("item").unionByName(dropped).distinct().join(known, "item", "left_semi")
    moved = result.resolved.where(F.col("tgt").isNotNull()).select(F.col("src").alias("item")).join(
        known, "item", "left_semi"
    )
    parts = [
        gone.select(F.lit("deleted").alias("kind")),
        moved.select(F.lit("merged").alias("kind")),
        result.removed_bad.select(F.lit("bad_edges").alias("kind")),
        result.items.select(F.lit("remaining").alias("kind")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("deleted", "merged", "bad_edges", "remaining")]
    )
