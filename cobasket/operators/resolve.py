"""Following links to their end: merge chains and parent links.

Pointer doubling: after round k every source points 2^k hops ahead, so a chain of
depth d takes log2(d) rounds. Each round is one equi-join of the link table with
itself, written to a staged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.staging import stage, stage_counting


def one_target(links: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """One row per source, the same on every run: the last by ``ord`` where there is one, else the first target by name."""
    pick = F.max_by(tgt, F.struct("ord", tgt)) if "ord" in links.columns else F.min(tgt)
    return links.groupBy(src).agg(pick.alias(tgt))


def _double(links: DataFrame) -> DataFrame:
    nxt = links.select(F.col("src").alias("_via"), F.col("dst").alias("_to"))
    return (
        links.join(nxt, F.col("dst") == F.col("_via"), "left")
        .select(
            "src",
            F.coalesce("_to", "dst").alias("dst"),
            F.col("_to").isNotNull().alias("open"),
        )
    )


def follow_links(links: DataFrame) -> DataFrame:
    """``links(src, dst)`` -> ``(src, dst, cyclic)``; of several links of a source ``one_target`` keeps one.

    ``dst`` is the end of the chain. Where the chain runs into a cycle, ``cyclic``
    is true and ``dst`` is the first cycle node on the way (a node of the cycle
    points to itself).
    """
    links = one_target(links.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), "src", "dst")
    current, pending = links, None
    # While chains of depth > 2^k are left, some chain has a node that ends exactly
    # in this round; a round that ends nothing new leaves only cycles.
    while True:
        current, seen = stage_counting(
            _double(current.select("src", "dst")), "links", open=F.count_if(F.col("open"))
        )
        still_open = seen["open"]
        if still_open == 0:
            return current.select("src", "dst", F.lit(False).alias("cyclic"))
        if still_open == pending:
            break
        pending = still_open

    closed = current.where(~F.col("open")).select("src", "dst", F.lit(False).alias("cyclic"))
    stuck = current.where("open").select("src")
    loop = stage(links.join(stuck, "src", "left_semi"), "links")
    ahead, hops = loop, 1
    # After at least as many hops as there are stuck nodes, every image lies on a cycle.
    while hops < still_open:
        ahead = stage(_double(ahead).select("src", "dst"), "links")
        hops *= 2
    on_cycle = stage(ahead.select(F.col("dst").alias("src")).distinct(), "cycle")
    tails = loop.join(on_cycle, "src", "left_anti")
    entered = follow_links(tails).select("src", "dst", F.lit(True).alias("cyclic"))
    cycle_nodes = on_cycle.select("src", F.col("src").alias("dst"), F.lit(True).alias("cyclic"))
    return closed.unionByName(entered).unionByName(cycle_nodes)


def chain_end_before_repeat(links: DataFrame) -> DataFrame:
    """Like ``follow_links``, but a chain in a cycle stops one step before it repeats."""
    ends = follow_links(links)
    previous = one_target(links, "src", "dst").select(F.col("src").alias("_prev"), F.col("dst").alias("_entry"))
    on_cycle = ends.where(F.col("cyclic") & (F.col("src") == F.col("dst"))).select(
        F.col("src").alias("_prev")
    )
    previous = previous.join(on_cycle, "_prev", "left_semi")
    return ends.join(previous, F.col("cyclic") & (F.col("dst") == F.col("_entry")), "left").select(
        "src", F.coalesce("_prev", "dst").alias("dst"), "cyclic"
    )


def resolve_base(taxonomy: DataFrame) -> DataFrame:
    """``taxonomy(item, base)`` -> ``(item, root)`` for every item."""
    links = taxonomy.where(F.col("base").isNotNull() & (F.col("base") != "")).select(
        F.col("item").alias("src"), F.col("base").alias("dst")
    )
    ends = chain_end_before_repeat(links).select(F.col("src").alias("item"), "dst")
    return taxonomy.select("item").join(ends, "item", "left").select(
        "item", F.coalesce("dst", "item").alias("root")
    )


def resolve_merges(merged: DataFrame, deleted: DataFrame, items: DataFrame) -> DataFrame:
    """Merge chains with precedence rules.

    ``merged(src, tgt)``, ``deleted(item)``, ``items(item)`` -> ``(src, tgt)`` where
    ``tgt`` is null for a source with nothing left to merge into: itself deleted,
    ending on a deleted or unknown name, or caught in a cycle.
    """
    merged = one_target(merged)
    gone = deleted.select(F.col("item").alias("src")).distinct()
    live_links = merged.join(gone, "src", "left_anti").select("src", F.col("tgt").alias("dst"))
    ends = follow_links(live_links)
    valid = items.select(F.col("item").alias("dst")).distinct().join(
        gone.select(F.col("src").alias("dst")), "dst", "left_anti"
    )
    good = (
        ends.where(~F.col("cyclic")).join(valid, "dst", "left_semi").select("src", F.col("dst").alias("_t"))
    )
    return merged.select("src").join(good, "src", "left").select("src", F.col("_t").alias("tgt"))


def resolve_names(merged: DataFrame, deleted: DataFrame, names: DataFrame) -> DataFrame:
    """The resolver for judgments: follow to the very end, null when that end is deleted.

    Unlike ``resolve_merges`` a deleted name half-way does not stop the chain.
    """
    links = one_target(merged).select("src", F.col("tgt").alias("dst"))
    ends = chain_end_before_repeat(links).select(F.col("src").alias("name"), "dst")
    gone = deleted.select(F.col("item").alias("final"), F.lit(True).alias("_gone")).distinct()
    return (
        names.select("name").distinct()
        .join(ends, "name", "left")
        .select("name", F.coalesce("dst", "name").alias("final"))
        .join(gone, "final", "left")
        .select("name", F.when(F.col("_gone").isNull(), F.col("final")).alias("resolved"))
    )
