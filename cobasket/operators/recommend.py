"""Ranking companions for whole tables of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions.display import lookup
from cobasket.operators.graph import quartiles_lower
from cobasket.operators.resolve import resolve_base
from cobasket.params import DEFAULTS, Params
from cobasket.staging import stage

# Scores are rounded before they decide an order, so that the order does not hang
# on the last bit of a floating-point sum.
ORDER_DIGITS = 9
# Items with edges up to which all that a selection reaches is counted in the task that holds it.
FEW_ITEMS = 1 << 10


def _ordered(score: Column) -> Column:
    return F.round(score, ORDER_DIGITS)


def coverage_floor(n: Column, params: Params = DEFAULTS) -> Column:
    """At least this many selected items must reach a candidate (half rounds up)."""
    return F.greatest(F.lit(1), F.floor(n * params.coverage_fraction + 0.5))


def category_penalty(category: Column, selected: Column, params: Params = DEFAULTS) -> Column:
    """Factor of a candidate's category against the selection's category array."""
    damp = F.coalesce(lookup(params.global_damp, category), F.lit(1.0))
    out = F.when(category.isNull(), F.lit(1.0)).when(
        F.array_contains(selected, category),
        F.coalesce(lookup(params.self_penalty, category), F.lit(1.0)) * damp,
    )
    for group, factor in params.cross_groups:
        members = F.array(*[F.lit(g) for g in group])
        out = out.when(category.isin(*group) & F.arrays_overlap(selected, members), factor * damp)
    return out.otherwise(damp)


def rarity(avg100: Column, median: Column, iqr: Column, params: Params = DEFAULTS) -> Column:
    """How exceptional the score is for that candidate, clamped; 1 without statistics."""
    z = (avg100 - median) / F.greatest(iqr, F.lit(params.rarity_min_iqr))
    clamped = F.least(F.greatest(z, F.lit(params.rarity_floor)), F.lit(params.rarity_cap))
    return F.coalesce(clamped, F.lit(1.0))


def candidate_features(
    selections: DataFrame,
    edges: DataFrame,
    taxonomy: DataFrame | None = None,
    params: Params = DEFAULTS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Everything the score formula reads, one row per selection and candidate.

    ``selections(sel_id, item)``, ``edges(item, partner, score)``,
    ``taxonomy(item, category, base)``, ``stats(item, median, iqr)``. Reached
    candidates and the selected items themselves go through one aggregation, which
    both sums the scores and drops what is already selected.
    """
    # Read several times below.
    selections = stage(selections.select("sel_id", "item").distinct(), "selections")
    edges = edges.select("item", "partner", "score")
    if edges.select("item").distinct().limit(FEW_ITEMS + 1).count() <= FEW_ITEMS:
        # What a selection reaches is bounded: it is dealt out before that, and what follows stays where it is.
        selections, edges = selections.repartition("sel_id"), F.broadcast(edges)
    reached = selections.join(edges, "item").select(
        "sel_id", F.col("partner").alias("item"), F.col("score").cast("long").alias("score"), F.lit(1).alias("hit")
    )
    own = selections.select("sel_id", "item", F.lit(0).cast("long").alias("score"), F.lit(0).alias("hit"))
    summed = (
        reached.unionByName(own)
        .groupBy("sel_id", "item")
        .agg(F.sum("score").alias("total"), F.sum("hit").alias("coverage"), F.min("hit").alias("_other"))
    )
    passes = (F.col("_other") == 0) | (F.col("coverage") >= coverage_floor(F.col("n"), params))
    if taxonomy is None:
        profile = selections.groupBy("sel_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "cats", F.array().cast("array<string>")
        )
        gated = summed.join(profile, "sel_id").where(passes & (F.col("_other") == 1)).withColumn("category", F.lit(None).cast("string"))
    else:
        tagged_items = stage(
            taxonomy.select("item", "category").join(resolve_base(taxonomy), "item"), "tags"
        )
        # The set holds category slugs, of which there are a fixed few.
        profile = selections.join(tagged_items.select("item", "category"), "item", "left").groupBy("sel_id").agg(
            F.count(F.lit(1)).alias("n"), F.collect_set("category").alias("cats")
        )
        # Candidates below the floor go first; a root that a selected item has is nobody else's.
        same = Window.partitionBy("sel_id", "root")
        gated = (
            summed.join(profile, "sel_id").where(passes)
            .join(tagged_items, "item", "left")
            .withColumn("root", F.coalesce("root", "item"))
            .withColumn("_others", F.min("_other").over(same))
            .where(F.col("_others") == 1)
            .drop("root", "_others")
        )
    gated = gated.drop("_other")
    if stats is None and params.use_rarity:
        stats = quartiles_lower(edges)
    if stats is None:
        gated = gated.withColumns({c: F.lit(None).cast("double") for c in ("median", "iqr")})
    else:
        gated = gated.join(stats.select("item", "median", "iqr"), "item", "left")
    return gated.withColumn("avg100", F.col("total") / F.col("n")).drop("total")


def formula(params: Params = DEFAULTS) -> Column:
    """Average affinity x rarity x category penalty, over ``candidate_features``."""
    score = F.col("avg100") / 100
    if params.use_rarity:
        score = score * rarity(F.col("avg100"), F.col("median"), F.col("iqr"), params)
    if params.use_penalties:
        score = score * category_penalty(F.col("category"), F.col("cats"), params)
    return score


def score_candidates(
    selections: DataFrame,
    edges: DataFrame,
    taxonomy: DataFrame | None = None,
    params: Params = DEFAULTS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """The one scoring stage of every view: ``(sel_id, item, category, coverage, score)``."""
    return candidate_features(selections, edges, taxonomy, params, stats).select(
        "sel_id", "item", F.coalesce("category", F.lit("other")).alias("category"), "coverage",
        formula(params).alias("score"),
    )


def top_diverse(scored: DataFrame, params: Params = DEFAULTS, n: int | None = None) -> DataFrame:
    """Greedy pick with a per-category decay, as two windows.

    Inside a category scores fall, so the k-th pick of a category is its k-th item
    and the greedy order is the order of ``score * decay^(k-1)``. Beyond the n-th
    item of a category nothing can be picked, so the first window keeps n rows per
    category, which prunes before the shuffle.
    """
    n = params.top_n if n is None else n
    by_category = Window.partitionBy("sel_id", "category").orderBy(F.desc(_ordered(F.col("score"))), "item")
    ranked = scored.withColumn("_k", F.row_number().over(by_category)).where(F.col("_k") <= n)
    decay = 1.0 if params.diversity_decay is None else params.diversity_decay
    ranked = ranked.withColumn("eff", F.col("score") * F.pow(F.lit(decay), F.col("_k") - 1))
    overall = Window.partitionBy("sel_id").orderBy(
        F.desc(_ordered(F.col("eff"))), F.desc(_ordered(F.col("score"))), "item"
    )
    return (
        ranked.withColumn("rank", F.row_number().over(overall))
        .where(F.col("rank") <= n)
        .select("sel_id", "item", "category", "coverage", F.least("eff", F.lit(1.0)).alias("score"), "rank")
    )


def top_plain(scored: DataFrame, n: int) -> DataFrame:
    """The n best by score alone."""
    order = Window.partitionBy("sel_id").orderBy(F.desc(_ordered(F.col("score"))), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def lanes(scored: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Top items per category with the lanes in order of strength.

    A lane's strength is the mean of its few best clamped scores. It is computed on
    the ranked rows, so at most ``lane_k`` rows of a lane are ever sorted together.
    """
    order = Window.partitionBy("sel_id", "category").orderBy(F.desc(_ordered(F.col("score"))), "item")
    ranked = (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= params.lane_k)
        .withColumn("score", F.least("score", F.lit(1.0)))
    )
    lane = Window.partitionBy("sel_id", "category")
    strength = F.avg(F.when(F.col("rank") <= params.lane_rank_topk, F.col("score"))).over(lane)
    placed = Window.partitionBy("sel_id").orderBy(F.desc("_strength_key"), "category")
    return (
        ranked.withColumn("strength", strength)
        .withColumn("_strength_key", _ordered(F.col("strength")))
        .withColumn("lane_rank", F.dense_rank().over(placed))
        .select("sel_id", "category", "lane_rank", "strength", "item", "coverage", "score", "rank")
    )


def recommend(selections, edges, taxonomy=None, params: Params = DEFAULTS, stats=None) -> DataFrame:
    return top_diverse(score_candidates(selections, edges, taxonomy, params, stats), params)


def recommend_lanes(selections, edges, taxonomy=None, params: Params = DEFAULTS, stats=None) -> DataFrame:
    return lanes(score_candidates(selections, edges, taxonomy, params, stats), params)
