"""Ranking media candidates and keeping the asset tables in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions import media_text as m
from cobasket.functions.text import slugify


def eligible(candidates: DataFrame, min_width: int = 200) -> DataFrame:
    """Raster photos of a sufficient size under a free licence."""
    kind = F.upper(F.coalesce("mediatype", F.lit("")))
    return candidates.where(
        ~F.col("file").rlike(m.JUNK_PATTERN)
        & m.extension(F.col("file")).isin(*m.RASTER_EXTENSIONS)
        & kind.isin(*m.MEDIA_TYPES)
        & m.license_ok(F.col("license"))
        & (F.coalesce("width", F.lit(0)) >= min_width)
    )


def score_media(candidates: DataFrame, order_weight: float = 0.15, homonyms: bool = False) -> DataFrame:
    """Adds ``score`` to ``(item, title, file, width, ord)``."""
    named = candidates.withColumns({
        "_t": m.name_tokens(F.col("file")),
        "_w": m.name_tokens(F.concat_ws(" ", "item", "title")),
    })
    score = (
        3.0 * m.stem_matches(F.col("_w"), F.col("_t"))
        + 1.5 * m.count_of(F.col("_t"), m.BONUS_WORDS)
        - 3.5 * m.count_of(F.col("_t"), m.PENALTY_WORDS)
        + F.least(F.coalesce("width", F.lit(0)) / 1500.0, F.lit(2.0))
        - order_weight * F.col("ord")
    )
    if homonyms:
        score = score - 4.0 * m.count_of(F.col("_t"), m.HOMONYM_WORDS)
    return named.withColumn("score", score).drop("_t", "_w")


def rank_media(candidates: DataFrame, k: int = 1, min_width: int = 200, **kw) -> DataFrame:
    """The k best candidates of each item."""
    order = Window.partitionBy("item").orderBy(F.desc(F.round("score", 9)), "ord", "file")
    return (
        score_media(eligible(candidates, min_width), **kw)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def rubric_choice(graded: DataFrame, accept_over: int = 3) -> DataFrame:
    """``graded(item, file, grade, ord)``: the best candidate if good enough, else a skip."""
    best = graded.groupBy("item").agg(
        F.max_by(F.struct("file", "grade"), F.struct(F.col("grade"), -F.col("ord"))).alias("b")
    )
    good = F.col("b.grade") > accept_over
    return best.select(
        "item",
        F.when(good, F.col("b.file")).alias("file"),
        F.col("b.grade").alias("grade"),
        F.when(good, "take").otherwise("skip").alias("verdict"),
    )


def slug_coverage(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per slug: ``(slug, items, status)`` with status covered, missing or stale.

    More than one item on a slug is a collision.
    """
    live = items.groupBy(slugify(F.col("item")).alias("slug")).agg(F.count(F.lit(1)).alias("items"))
    have = manifest.select("slug").distinct().withColumn("_have", F.lit(True))
    return live.join(have, "slug", "full_outer").select(
        "slug",
        F.coalesce("items", F.lit(0)).alias("items"),
        F.when(F.col("items").isNull(), "stale").when(F.col("_have"), "covered").otherwise("missing").alias("status"),
    )


def coverage_summary(per_slug: DataFrame) -> DataFrame:
    """One row of counts and the share of live slugs that are covered."""
    live = F.count_if(F.col("items") > 0)
    return per_slug.agg(
        F.count_if(F.col("status") == "covered").alias("covered"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "stale").alias("stale"),
        F.count_if(F.col("items") > 1).alias("collisions"),
        (F.count_if(F.col("status") != "missing") / F.greatest(live, F.lit(1))).alias("coverage"),
    )


def route(items: DataFrame, overrides: DataFrame, cached: DataFrame) -> DataFrame:
    """Where an item's media comes from: skip, cached, file, scan or title.

    ``overrides(item, title, file, scan, skip)``, ``cached(slug)``.
    """
    have = cached.select("slug", F.lit(True).alias("_have")).dropDuplicates(["slug"])
    rows = (
        items.select("item", slugify(F.col("item")).alias("slug"))
        .join(overrides, "item", "left")
        .join(have, "slug", "left")
    )
    title = F.coalesce("title", "item")
    pinned = F.coalesce("file", F.lit("")) != ""
    kind = (
        F.when(F.col("skip"), "skip")
        .when(F.col("_have"), "cached")
        .when(pinned, "file")
        .when(F.col("scan"), "scan")
        .otherwise("title")
    )
    bare = F.replace(F.regexp_replace("file", "^File:", ""), F.lit(" "), F.lit("_"))
    return rows.select(
        "item", "slug", kind.alias("route"),
        F.when(kind == "file", bare).when(kind.isin("scan", "title"), title).alias("target"),
    )


def audit_queue(
    live: DataFrame, audit: DataFrame, threshold: int = 2, only: DataFrame | None = None, limit: int = 0
) -> DataFrame:
    """Items scored at or below the threshold, and items without a tile.

    ``live(item)``, ``audit(slug, score)``.
    """
    named = live.select("item", slugify(F.col("item")).alias("slug"))
    low = named.join(audit.where(F.col("score") <= threshold).select("slug"), "slug", "left_semi")
    untiled = named.join(audit.select("slug"), "slug", "left_anti")
    queue = low.unionByName(untiled).select("item").distinct()
    if only is not None:
        queue = live.select("item").join(only.select("item"), "item", "left_semi")
    return queue.orderBy(F.lower("item"), "item").limit(limit) if limit else queue


def run_report(misses: DataFrame, flags: DataFrame) -> DataFrame:
    """``(item, kind, reason)`` rows of a run."""
    tag = lambda df, kind: df.select("item", F.lit(kind).alias("kind"), "reason")
    return tag(misses, "miss").unionByName(tag(flags, "flag"))


def missing_translations(names: DataFrame, dictionary: DataFrame, batch: int = 100) -> DataFrame:
    """Names without an entry, as they are or in lower case, cut in batches."""
    from cobasket.operators.graph import dense_ids

    known = dictionary.select("name")
    todo = (
        names.select("name").distinct()
        .join(known, "name", "left_anti")
        .withColumn("low", F.lower("name"))
        .join(known.withColumnRenamed("name", "low"), "low", "left_anti")
        .drop("low")
    )
    return dense_ids(todo, ["name"]).select("name", F.floor(F.col("item_id") / batch).cast("int").alias("batch"))


def merge_translations(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same name."""
    o = old.select("name", F.col("translated").alias("_o"))
    n = new.select("name", F.col("translated").alias("_n"))
    return o.join(n, "name", "full_outer").select("name", F.coalesce("_n", "_o").alias("translated"))
