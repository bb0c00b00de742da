"""Data-quality checks: every check counts all its violations.

Each returns rows ``(check, table, violations, sample)``, the sample being the first
few offenders by name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions.text import norm_title
from cobasket.operators.graph import degree
from cobasket.operators.resolve import follow_links
from cobasket.params import CATEGORIES
from cobasket.staging import stage

SAMPLE = 5


def _bad(rows: DataFrame, check: str, name) -> DataFrame:
    """The offenders of one check, as ``(check, n)``."""
    column = F.col(name) if isinstance(name, str) else name
    return rows.select(F.lit(check).alias("check"), column.cast("string").alias("n"))


def _flags(rows: DataFrame, **checks: tuple[Column, Column]) -> DataFrame:
    """Offenders of checks that look at one row each, found in one pass: name of a check -> (condition, offender)."""
    found = F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(check.replace("_", " ")).alias("check"), name.cast("string").alias("n")))
        for check, (bad, name) in checks.items()
    ])
    return rows.select(F.explode(F.array_compact(found)).alias("v")).select("v.*")


def _report(offenders: list[DataFrame], checks: list[str], table: str) -> DataFrame:
    """One row per check: the number of offenders and the first few by name.

    The sample is cut to its size before it is gathered.
    """
    found = stage(functools.reduce(DataFrame.unionByName, offenders), "offenders")
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    by_name = Window.partitionBy("check").orderBy("n")
    few = (
        found.where(F.col("n").isNotNull()).distinct().withColumn("_r", F.row_number().over(by_name))
        .where(F.col("_r") <= SAMPLE).groupBy("check").agg(F.array_sort(F.collect_list("n")).alias("sample"))
    )
    names = F.explode(F.array(*[F.lit(c) for c in checks])).alias("check")
    asked = found.sparkSession.range(1).select(names)
    return asked.join(counts, "check", "left").join(few, "check", "left").select(
        "check", F.lit(table).alias("table"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
    )


def check_graph(items: DataFrame, edges: DataFrame, meta_count: int | None = None, table: str = "edges") -> DataFrame:
    """Names, endpoints, scores, symmetry and the signature of a partner cap."""
    edges = stage(edges, "checked")
    pair = F.concat_ws(" ~ ", "item", "partner")
    known = items.select("item").distinct()
    tagged = edges.join(known.withColumn("_i", F.lit(True)), "item", "left").join(
        known.select(F.col("item").alias("partner"), F.lit(True).alias("_p")), "partner", "left"
    )
    flipped = edges.select(F.col("item").alias("partner"), F.col("partner").alias("item"), F.col("score").alias("_s"))
    asym = edges.join(flipped, ["item", "partner"], "left").where(~F.col("score").eqNullSafe(F.col("_s")))
    lengths = degree(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("lists"))
    mode = lengths.agg(
        F.max_by("degree", F.struct(F.col("lists"), F.col("degree"))).alias("mode"),
        F.max("lists").alias("lists"), F.sum("lists").alias("total"),
    ).where((F.col("mode") > 10) & (F.col("lists") > 0.25 * F.col("total")))
    checks = [
        "duplicate names", "unknown item", "unknown partner", "self pair", "score below 1", "duplicate partner",
        "asymmetric edge", "partner cap signature",
    ]
    offenders = [
        _bad(items.groupBy("item").count().where(F.col("count") > 1), checks[0], "item"),
        _flags(
            tagged, unknown_item=(F.col("_i").isNull(), F.col("item")), unknown_partner=(F.col("_p").isNull(), F.col("partner")),
            self_pair=(F.col("item") == F.col("partner"), F.col("item")), score_below_1=(F.coalesce("score", F.lit(0)) < 1, pair),
        ),
        _bad(edges.groupBy("item", "partner").count().where(F.col("count") > 1), "duplicate partner", pair),
        _bad(asym, "asymmetric edge", pair),
        _bad(mode, "partner cap signature", "mode"),
    ]
    if meta_count is not None:
        off = items.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != meta_count)
        checks.append("item count differs from metadata")
        offenders.append(_bad(off, checks[-1], "n"))
    return _report(offenders, checks, table)


def check_curation(items: DataFrame, deleted: DataFrame, merged: DataFrame, bad_pairs: DataFrame, tolerance: int = 5) -> DataFrame:
    """Shape of bad pairs, self-merges, sources merged twice, cycles, and too many unknown names."""
    ends = follow_links(merged.where(F.col("src") != F.col("tgt")).select("src", F.col("tgt").alias("dst")))
    twice = merged.groupBy("src").agg(F.count_distinct("tgt").alias("targets")).where(F.col("targets") > 1)
    names = deleted.select("item").unionByName(merged.select(F.col("src").alias("item")))
    unknown = names.join(items.select("item"), "item", "left_anti")
    counted = unknown.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tolerance)
    malformed = bad_pairs.where((F.size("names") != 2) | F.exists("names", lambda x: x.isNull()))
    offenders = [
        _bad(malformed, "malformed bad pair", F.array_join("names", ",")),
        _bad(merged.where(F.col("src") == F.col("tgt")), "self merge", "src"),
        _bad(twice, "duplicate merge source", "src"),
        _bad(ends.where("cyclic"), "merge cycle", "src"),
        _bad(counted, "unknown names over tolerance", "n"),
    ]
    checks = ["malformed bad pair", "self merge", "duplicate merge source", "merge cycle", "unknown names over tolerance"]
    return _report(offenders, checks, "curation")


def check_taxonomy(items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Full coverage, valid categories, acyclic parents."""
    missing = items.select("item").join(taxonomy.select("item"), "item", "left_anti")
    invalid = taxonomy.where(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)))
    links = taxonomy.where(F.col("base").isNotNull() & (F.col("base") != "")).select(
        F.col("item").alias("src"), F.col("base").alias("dst")
    )
    return _report([
        _bad(missing, "item without category", "item"),
        _bad(invalid, "invalid category", "item"),
        _bad(follow_links(links).where("cyclic"), "parent cycle", "src"),
    ], ["item without category", "invalid category", "parent cycle"], "taxonomy")


def check_deployed(items: DataFrame, edges: DataFrame, low: int = 800, high: int = 2500) -> DataFrame:
    """Every item keeps a partner; the item count stays in its band."""
    lonely = items.select("item").join(edges.select("item"), "item", "left_anti")
    outside = items.agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(low, high))
    return _report([
        _bad(lonely, "item without partner", "item"), _bad(outside, "item count outside band", "n"),
    ], ["item without partner", "item count outside band"], "deployed")


def check_baskets(
    baskets: DataFrame, refs: DataFrame, vocabulary: DataFrame, items: DataFrame, langs: tuple[str, ...] | None = ("en", "fr"),
    version: int | None = None,
) -> DataFrame:
    """``baskets(basket_id, title, url, lang)``, ``refs(basket_id, pos, local_id)``, ``vocabulary(local_id, item)``.

    Baskets with a column ``arity`` must have four fields; with ``version``, those with a
    column ``v`` must come from a document of that version.
    """
    baskets, refs = stage(baskets, "checked"), stage(refs, "checked")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    name = F.col("basket_id")
    strange = F.col("lang").isNull() if langs is None else ~F.coalesce(F.col("lang").isin(*langs), F.lit(False))
    flags = {"empty_title": (blank("title"), name), "unknown_language": (strange, name), "empty_url": (blank("url"), name)}
    if "arity" in baskets.columns:
        flags["wrong_arity"] = (F.coalesce("arity", F.lit(0)) != 4, name)
    if version is not None and "v" in baskets.columns:
        flags["wrong_document_version"] = (~F.col("v").eqNullSafe(F.lit(version)), name)
    offenders = [
        _bad(vocabulary.select("item").join(items.select("item"), "item", "left_anti"), "vocabulary name not live", "item"),
        _flags(baskets, **flags),
        _bad(baskets.join(refs.select("basket_id"), "basket_id", "left_anti"), "no items", "basket_id"),
        _bad(refs.join(vocabulary.select("local_id"), "local_id", "left_anti"), "index out of range", "basket_id"),
        _bad(refs.groupBy("basket_id", "local_id").count().where(F.col("count") > 1), "duplicate index", "basket_id"),
        _bad(duplicate_baskets(baskets, refs), "duplicate basket", "basket_id"),
    ]
    checks = ["vocabulary name not live", *[f.replace("_", " ") for f in flags], "no items", "index out of range", "duplicate index", "duplicate basket"]
    return _report(offenders, checks, "baskets")


def duplicate_baskets(baskets: DataFrame, refs: DataFrame) -> DataFrame:
    """Baskets repeating an earlier one of the same language, title and item set.

    The set is compared through order-free sums of two hashes of its ids and its
    size, so no basket's items are gathered.
    """
    ids = refs.select("basket_id", "local_id").distinct()
    print_ = ids.groupBy("basket_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("local_id").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit("b"), F.col("local_id")).cast("decimal(38,0)")).alias("h2"),
    )
    keyed = baskets.join(print_, "basket_id").select(
        "basket_id", "lang", norm_title(F.col("title")).alias("t"), "size", "h1", "h2"
    )
    first = keyed.groupBy("lang", "t", "size", "h1", "h2").agg(F.min("basket_id").alias("first"))
    return keyed.join(first, ["lang", "t", "size", "h1", "h2"]).where(F.col("basket_id") != F.col("first")).select("basket_id")


def audit_curation(items: DataFrame, edges: DataFrame, deleted: DataFrame, merged: DataFrame, validated: DataFrame, top: int = 60) -> dict[str, DataFrame]:
    """Screens for a curator, one table each."""
    links = merged.select("src", F.col("tgt").alias("dst"))
    ends = follow_links(links)
    gone = deleted.select(F.col("item").alias("dst"))
    known = items.select(F.col("item").alias("dst"))
    dead = ends.where("cyclic").select("src").unionByName(
        ends.join(gone, "dst", "left_semi").select("src")
    ).unionByName(ends.join(known, "dst", "left_anti").select("src")).distinct()
    decided_away = deleted.select("item").unionByName(merged.select(F.col("src").alias("item")))
    sizes = degree(edges)
    return {
        "dead_merges": dead,
        "contradictions": validated.select("item").intersect(decided_away),
        "chains": merged.join(merged.select(F.col("src").alias("tgt")), "tgt", "left_semi").select("src", "tgt"),
        "large_deletions": sizes.join(deleted.select("item"), "item", "left_semi").orderBy(F.desc("degree"), "item").limit(top),
        "sparse_items": items.select("item").join(sizes, "item", "left").where(F.coalesce("degree", F.lit(0)) <= 3).select(
            "item", F.coalesce("degree", F.lit(0)).alias("degree")
        ),
    }
