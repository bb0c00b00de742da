"""Merging and compacting the decision tables that several curators write."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.operators.components import components
from cobasket.operators.resolve import follow_links
from cobasket.staging import stage


def last_writer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``.

    ``max_by`` on a struct is combined before the shuffle, so a key with very many
    versions never gathers in one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def replay(log: DataFrame) -> DataFrame:
    """The state ``(field, key, value)`` that a log of decisions ends in: the last writer of each key.

    Later versions win, then later files, then what stands further down.
    """
    return last_writer(log.select("field", "key", "value", "version", "file", "ord"), ["field", "key"], [F.col("version"), F.col("file"), F.col("ord")]).select(
        "field", "key", "value"
    )


def union_names(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Validated or deleted names of both sides."""
    return local.select("item").unionByName(remote.select("item")).distinct()


def overlay(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides; the local one wins where a key is in both.

    Merge maps use the key ``src``; judgments use ``(probe, candidate)``.
    """
    both = remote.withColumn("_side", F.lit(0)).unionByName(local.withColumn("_side", F.lit(1)))
    return last_writer(both, keys, [F.col("_side")]).select(*local.columns)


def merge_state(local: DataFrame, remote: DataFrame, united: tuple[str, ...], overlaid: tuple[str, ...]) -> DataFrame:
    """Two states as rows ``(field, key, value)``.

    Fields in ``united`` hold the keys of both sides, those in ``overlaid`` the local value
    where both have one. Any other field is not managed here and stays as it is remotely.
    """
    managed = [*united, *overlaid]
    both = local.where(F.col("field").isin(managed)).withColumn("_side", F.lit(1)).unionByName(remote.withColumn("_side", F.lit(0)))
    return last_writer(both.select("field", "key", "value", "_side"), ["field", "key"], [F.col("_side"), F.col("value")]).drop("_side")


def _closing_edges(loop: DataFrame, size: int) -> DataFrame:
    """The last-made edge of every cycle: ``loop(src, dst, ord)`` holds cycle edges only."""
    ahead, hops = loop.select("src", "dst", F.col("ord").alias("latest")), 1
    while hops < size:
        step = ahead.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("latest").alias("_l"))
        ahead = stage(
            ahead.join(step, "dst").select(
                "src", F.col("_to").alias("dst"), F.greatest("latest", "_l").alias("latest")
            ),
            "closing",
        )
        hops *= 2
    return loop.join(ahead.select("src", "latest"), "src").where(F.col("ord") == F.col("latest")).select("src")


#: Rounds over all proposals, before what still changes is taken component by component.
ROUNDS = 2
#: Links up to which a component is settled by one task.
SMALL_LINKS = 20_000


def compact_merges(proposed: DataFrame, existing: DataFrame, deleted: DataFrame, rounds: int = ROUNDS, small_links: int = SMALL_LINKS):
    """Fold proposed merges, in the order of ``ord``, into a chain-free map.

    ``proposed(src, tgt, ord)``, ``existing(src, tgt)``. Targets are resolved to
    their end and earlier merges into a new source are re-pointed. A proposal that
    reaches a deleted name or closes a cycle is rejected and the earlier map of its
    source stays. Returns ``(map(src, tgt), rejected(src, tgt))``.

    A rejection brings an earlier map back, which may close another cycle. After ``rounds``
    of this over all proposals, a connected component in which something still changed is
    settled by one task; only components of more than ``small_links`` links go on by rounds.
    """
    gone = deleted.select(F.col("item").alias("_end"), F.lit(True).alias("_gone")).distinct()
    base = existing.select("src", "tgt", F.lit(-1).cast("long").alias("ord"))
    latest = stage(last_writer(proposed.select("src", "tgt", F.col("ord").cast("long").alias("ord")), ["src"], [F.col("ord")]), "latest")
    refused = latest.where(F.col("src") == F.col("tgt")).select("src").unionByName(
        latest.join(gone.select(F.col("_end").alias("tgt")), "tgt", "left_semi").select("src")
    ).distinct()
    turn = 0
    while True:
        fine = stage(latest.join(refused, "src", "left_anti"), "fine")
        links = stage(
            overlay(fine, base, ["src"]).select("src", F.col("tgt").alias("dst"), "ord"), "links"
        )
        ends = stage(follow_links(links).join(gone.withColumnRenamed("_end", "dst"), "dst", "left"), "ends")
        loop = links.join(
            ends.where(F.col("cyclic") & (F.col("src") == F.col("dst"))).select("src"), "src", "left_semi"
        )
        size = loop.count()
        bad = fine.join(ends.where("_gone").select("src"), "src", "left_semi").select("src")
        if size:
            bad = bad.unionByName(_closing_edges(loop, size)).join(fine.select("src"), "src", "left_semi")
        bad = stage(bad.distinct(), "bad")
        if bad.isEmpty():
            break
        refused = refused.unionByName(bad).distinct()
        turn += 1
        if turn == rounds:
            refused = refused.unionByName(_refused_in_parts(latest, base, gone, stage(refused, "refused"), bad, small_links)).distinct()
        refused = stage(refused, "refused")
    return (
        ends.where(~F.col("cyclic")).select("src", F.col("dst").alias("tgt")),
        latest.join(refused, "src", "left_semi").select("src", "tgt"),
    )


def _refused_in_parts(latest: DataFrame, base: DataFrame, gone: DataFrame, refused: DataFrame, bad: DataFrame, small_links: int) -> DataFrame:
    """Further ``src`` to refuse, in components of bounded size that hold one of ``bad``."""
    rows = latest.withColumn("made", F.lit(True)).unionByName(base.withColumn("made", F.lit(False)))
    rows = rows.where(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    parts = components(rows.select(F.col("src").alias("a"), F.col("tgt").alias("b"))).withColumnRenamed("node", "src")
    rows = rows.join(parts, "src")
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= small_links).select("root")
    asked = parts.join(bad, "src", "left_semi").select("root").distinct().join(sizes, "root")
    out = refused.select("src", F.lit(True).alias("out"))
    ends = gone.select(F.col("_end").alias("tgt"), F.col("_gone").alias("tgt_gone"))
    starts = gone.select(F.col("_end").alias("src"), F.col("_gone").alias("src_gone"))
    rows = rows.join(asked, "root", "left_semi").join(out, "src", "left").join(ends, "tgt", "left").join(starts, "src", "left")
    rows = rows.fillna(False, ["out", "tgt_gone", "src_gone"])
    return rows.groupBy("root").applyInPandas(_refuse, "src string")


def _refuse(rows: pd.DataFrame) -> pd.DataFrame:
    """The rounds of one component: refuse what closes a cycle or ends at a deleted name, until nothing does."""
    base, made, refused, gone = {}, {}, set(), set()
    for row in rows.itertuples():
        if row.made:
            made[row.src] = (row.tgt, row.ord)
            if row.out:
                refused.add(row.src)
        else:
            base[row.src] = row.tgt
        gone.update(name for name, is_gone in ((row.src, row.src_gone), (row.tgt, row.tgt_gone)) if is_gone)
    before = set(refused)
    while True:
        fine = {src: tgt for src, (tgt, _) in made.items() if src not in refused}
        links = base | fine
        end, bad = {}, set()
        for src in links:
            path, at = {}, src
            while at in links and at not in end and at not in path:
                path[at] = len(path)
                at = links[at]
            if at in path:
                cycle = [name for name, place in path.items() if place >= path[at]]
                latest = max(made[name][1] if name in fine else -1 for name in cycle)
                bad.update(name for name in cycle if name in fine and made[name][1] == latest)
                end.update((name, name) for name in cycle)
            last = end.get(at, at)
            end.update((name, last) for name in path if name not in end)
        bad.update(src for src in fine if end[src] in gone)
        if not bad:
            return pd.DataFrame({"src": sorted(refused - before)}, dtype="object")
        refused |= bad


def apply_asset_changes(changes: DataFrame, manifest: DataFrame, overrides: DataFrame, credits: DataFrame):
    """Staged replacements and deletions applied to the three asset tables.

    ``changes(item, slug, kind)`` with kind ``replace`` or ``delete``;
    ``manifest(slug)``, ``overrides(item, title, file, scan, skip)``,
    ``credits(item, file, license, artist, description_url)``.
    """
    deletes = changes.where(F.col("kind") == "delete")
    adds = changes.where(F.col("kind") != "delete")
    new_manifest = (
        manifest.select("slug").unionByName(adds.select("slug")).distinct()
        .join(deletes.select("slug").join(adds.select("slug"), "slug", "left_anti"), "slug", "left_anti")
    )
    protected = changes.select(
        "item", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("boolean").alias("scan"), F.lit(True).alias("skip"),
    )
    new_overrides = overrides.join(changes.select("item"), "item", "left_anti").unionByName(protected)
    # The credit of an upload.
    uploaded = adds.select(
        "item", F.lit("owner upload").alias("file"), F.lit("provided by owner").alias("license"),
        F.lit("").alias("artist"), F.lit("").alias("description_url"),
    )
    new_credits = credits.join(changes.select("item"), "item", "left_anti").unionByName(uploaded)
    return new_manifest, new_overrides, new_credits
