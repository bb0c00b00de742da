"""Matching selections to baskets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.operators.coherence import few_items, inner_edges, met_inside
from cobasket.operators.graph import Asked, affinity_edges, undirected_max
from cobasket.params import DEFAULTS, Params
from cobasket.staging import stage, stage_counting


def usable_baskets(basket_refs: DataFrame, vocabulary: DataFrame, items: DataFrame) -> DataFrame:
    """Encoded baskets to ``(basket_id, pos, item)`` over the live items.

    ``basket_refs(basket_id, pos, local_id)``, ``vocabulary(local_id, item)``.
    Unknown references drop out, an item counts once at its first place, and a
    basket with nothing left has no rows.
    """
    return (
        basket_refs.join(vocabulary, "local_id")
        .join(items.select("item"), "item", "left_semi")
        .groupBy("basket_id", "item")
        .agg(F.min("pos").alias("pos"))
    )


def static_gate(n: Column, params: Params = DEFAULTS) -> Column:
    """How many selected items a basket has to hold, whatever else is on offer."""
    return F.least(n, F.greatest(F.lit(params.match_min), F.ceil(n * params.match_fraction)))


def match_counts(selections: DataFrame, basket_items: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Baskets over the gate: ``(sel_id, basket_id, n, matched)``.

    A basket with g of the n items holds at least l of the n-g+l rarest. So only
    the rarest part of a selection walks the baskets, and items found in a large
    share of all baskets are looked up for the survivors alone.
    """
    picked = stage(selections.select("sel_id", "item").distinct(), "picked")
    # Of the baskets only selected items are looked at.
    postings = basket_items.select("basket_id", "item").join(picked.select("item").distinct(), "item", "left_semi")
    frequency = postings.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    sizes = picked.groupBy("sel_id").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("sel_id").orderBy("df", "item")
    placed = (
        picked.join(frequency, "item", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest))
        .join(sizes, "sel_id")
        .withColumn("gate", static_gate(F.col("n"), params))
        .withColumn("need", F.ceil(F.col("gate") / 2))
        .withColumn("leading", F.col("place") <= F.col("n") - F.col("gate") + F.col("need"))
    )
    placed = stage(placed.select("sel_id", "item", "n", "gate", "need", "leading"), "placed")
    survivors = (
        placed.where("leading")
        .join(postings, "item")
        .groupBy("sel_id", "basket_id", "n", "gate", "need")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= F.col("need"))
        .select("sel_id", "basket_id", "n", "gate", "hits")
    )
    survivors = stage(survivors, "survivors")
    rest = (
        survivors.select("sel_id", "basket_id")
        .join(placed.where(~F.col("leading")).select("sel_id", "item"), "sel_id")
        .join(postings, ["basket_id", "item"], "left_semi")
        .groupBy("sel_id", "basket_id")
        .agg(F.count(F.lit(1)).alias("more"))
    )
    counted = survivors.join(rest, ["sel_id", "basket_id"], "left").withColumn(
        "matched", F.col("hits") + F.coalesce("more", F.lit(0))
    ).where(F.col("matched") >= F.col("gate"))
    counted = stage(counted.select("sel_id", "basket_id", "n", "matched"), "counted")
    best = counted.groupBy("sel_id").agg(F.max("matched").alias("best"))
    return counted.join(best, "sel_id").where(
        F.col("matched") >= F.col("best") - params.match_tolerance
    ).drop("best")


def pick_pool(counted: DataFrame, sel_lang: DataFrame, baskets: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Language preference: adds ``tier``, and ``fill``, the place by match count in tier 2.

    Tier 1 is the selection's own language, or everything when it has none there; all its
    baskets are scored. Tier 2 only tops up what is missing.
    """
    tagged = counted.join(baskets.select("basket_id", "lang"), "basket_id").join(
        sel_lang.select("sel_id", F.col("lang").alias("want")), "sel_id"
    ).withColumn("same", F.col("lang") == F.col("want"))
    share = tagged.groupBy("sel_id").agg(
        F.count_if("same").alias("n_same"), F.count(F.lit(1)).alias("n_all")
    )
    order = Window.partitionBy("sel_id").orderBy(F.desc("matched"), "basket_id")
    has_same = F.col("n_same") > 0
    scored = F.least(F.when(has_same, F.col("n_same")).otherwise(F.col("n_all")), F.lit(params.match_limit))
    placed = tagged.join(share, "sel_id").withColumn("tier", F.when(~has_same | F.col("same"), 1).otherwise(2))
    placed = stage(placed.withColumn("open", params.match_limit - scored), "placed-tiers")
    columns = ["sel_id", "basket_id", "n", "matched", "lang", "tier"]
    own = placed.where("tier = 1").select(*columns, F.lit(None).cast("int").alias("fill"))
    others = placed.where("tier = 2 AND open > 0").withColumn("fill", F.row_number().over(order)).where(
        F.col("fill") <= params.match_limit
    )
    return own.unionByName(others.where(F.col("fill") <= F.col("open")).select(*columns, "fill"))


def pairing_fit(
    pairs: DataFrame, basket_items: DataFrame, edges: DataFrame, params: Params = DEFAULTS, symmetric: bool = False
) -> DataFrame:
    """How well an item would go with a basket: mean of its strongest few affinities.

    ``pairs(basket_id, item)`` -> ``(basket_id, item, fit)``. Absent edges count as
    0, the item itself is left out, and a basket with no other item gives 0.
    """
    edges = edges if symmetric else stage(undirected_max(edges), "undirected")
    near = few_items(edges)
    pairs, postings = pairs.select("basket_id", "item"), basket_items.select("basket_id", "item")
    if near:
        # Dealt out by basket once; what follows stays where it is.
        pairs, postings = pairs.repartition("basket_id"), postings.repartition("basket_id")
    pairs = pairs.distinct()
    # Where all is dealt out by basket, finding out which baskets are asked for costs more than it saves.
    touched = postings if near else postings.join(pairs.select("basket_id").distinct(), "basket_id", "left_semi")
    sizes = touched.groupBy("basket_id").agg(F.count(F.lit(1)).alias("total"))
    strongest = Window.partitionBy("basket_id", "item").orderBy(F.desc("score"), "partner")
    if near:
        met = met_inside(pairs, touched.distinct(), edges, "basket_id")
    else:
        # What a basket holds is met first: it has fewer items than an item may have partners.
        met = pairs.join(touched.distinct().withColumnRenamed("item", "partner"), "basket_id").join(
            edges.select("item", "partner", "score"), ["item", "partner"]
        )
    top = met.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= params.fit_topk)
    others = F.col("total") - F.coalesce("own", F.lit(0))
    fit = F.when(others > 0, F.coalesce("sum100", F.lit(0)) / 100.0 / F.least(others, F.lit(params.fit_topk))).otherwise(F.lit(0.0))
    if near:
        def rows(df: DataFrame, score: Column, own: int, asked: int) -> DataFrame:
            return df.select("basket_id", "item", score.cast("long").alias("score"), F.lit(own).alias("own"), F.lit(asked).alias("asked"))

        every = rows(pairs, F.lit(0), 0, 1).unionByName(rows(top, F.col("score"), 0, 0))
        every = every.unionByName(rows(touched.where(F.col("item").isNotNull()), F.lit(0), 1, 0))
        summed = every.groupBy("basket_id", "item").agg(F.sum("score").alias("sum100"), F.max("own").alias("own"), F.max("asked").alias("asked"))
        return summed.where(F.col("asked") == 1).join(sizes, "basket_id", "left").select("basket_id", "item", fit.alias("fit"))
    top = top.groupBy("basket_id", "item").agg(F.sum("score").alias("sum100"))
    inside = postings.select("basket_id", "item", F.lit(1).alias("own"))
    return (
        pairs.join(sizes, "basket_id", "left")
        .join(inside, ["basket_id", "item"], "left")
        .join(top, ["basket_id", "item"], "left")
        .select("basket_id", "item", fit.alias("fit"))
    )


def match_score(pairing: Column, avg_fit: Column, params: Params = DEFAULTS) -> Column:
    """The score of a row with ``matched``, ``n`` and ``total``."""
    p, m, n, total = params, F.col("matched"), F.col("n"), F.col("total")
    extras = F.greatest(F.lit(0), total - m)
    return (
        p.w_cover_selection * (m / n)
        + p.w_matched * (m / (m + p.matched_k))
        + p.w_pairing * pairing
        + p.w_cover_basket * (m / total)
        + p.w_fit * avg_fit
        - p.w_extras * (extras / (extras + p.extras_k))
    )


def basket_totals(baskets: DataFrame, basket_items: DataFrame) -> DataFrame:
    """``(basket_id, total)``: the items of each of ``baskets``."""
    asked = baskets.select("basket_id").distinct()
    return basket_items.join(asked, "basket_id", "left_semi").groupBy("basket_id").agg(F.count(F.lit(1)).alias("total"))


def held_items(pool: DataFrame, basket_items: DataFrame) -> DataFrame:
    """The rows of ``basket_items`` of the pool's baskets, staged."""
    return stage(basket_items.join(pool.select("basket_id").distinct(), "basket_id", "left_semi"), "held")


def pool_edges(pool: DataFrame, selections: DataFrame, held: DataFrame, basket_items: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Of the graph of ``basket_items``, which are staged and do not repeat, the edges that scoring looks at.

    These are edges between selected items, and those of the items that a basket of the pool
    lacks; ``held`` are the items of the pool's baskets.
    """
    picked = selections.select("sel_id", "item").distinct()
    wanted = pool.select("sel_id", "basket_id").join(picked, "sel_id")
    lacking = wanted.join(held.select("basket_id", "item"), ["basket_id", "item"], "left_anti")
    asked = Asked(picked.select("item").distinct(), stage(lacking.select("item").distinct(), "lacking"))
    return stage(affinity_edges(basket_items, params, unique=True, staged=True, asked=asked), "edges")


def score_matches(
    pool: DataFrame, selections: DataFrame, basket_items: DataFrame, edges: DataFrame, params: Params = DEFAULTS,
    symmetric: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adds ``extras``, ``pairing``, ``avg_fit`` and ``score`` to the pool.

    Returns ``(scored, used, leftovers)``; the last two are the selected items a
    basket holds, and those it lacks with their fit.
    """
    edges = edges if symmetric else stage(undirected_max(edges), "both-ways")
    pool = stage(pool, "pool")
    picked = selections.select("sel_id", "item").distinct()
    place = F.col("pos") if "pos" in basket_items.columns else F.lit(0)
    postings = basket_items.select("basket_id", "item", place.alias("pos"))
    if "total" not in pool.columns:
        pool = pool.join(basket_totals(pool, postings), "basket_id")
    wanted = (
        pool.select("sel_id", "basket_id")
        .join(picked, "sel_id")
        .join(postings, ["basket_id", "item"], "left")
    )
    wanted = stage(wanted, "wanted")
    used = wanted.where(F.col("pos").isNotNull())
    lacking = wanted.where(F.col("pos").isNull()).drop("pos")

    half = inner_edges(picked, edges).where(F.col("item") < F.col("partner"))
    pairing = (
        used.select("sel_id", "basket_id", "item")
        .join(half, ["sel_id", "item"])
        .join(
            used.select("sel_id", "basket_id", F.col("item").alias("partner")),
            ["sel_id", "basket_id", "partner"],
            "left_semi",
        )
        .groupBy("sel_id", "basket_id")
        .agg(F.sum("score").alias("pair100"))
    )
    fits = pairing_fit(lacking, basket_items, edges, params, symmetric=True)
    leftovers = stage(lacking.join(fits, ["basket_id", "item"]), "leftovers")
    avg_fit = leftovers.groupBy("sel_id", "basket_id").agg(
        F.avg("fit").alias("avg_fit")
    )
    m = F.col("matched")
    internal = F.when(m < 2, F.lit(params.neutral_pairing)).otherwise(
        F.coalesce("pair100", F.lit(0)) / 100.0 / (m * (m - 1) / 2)
    )
    scored = (
        pool.join(pairing, ["sel_id", "basket_id"], "left")
        .join(avg_fit, ["sel_id", "basket_id"], "left")
        .withColumn("extras", F.greatest(F.lit(0), F.col("total") - m))
        .withColumn("pairing", internal)
        .withColumn("avg_fit", F.coalesce("avg_fit", F.lit(0.0)))
        .withColumn("score", match_score(F.col("pairing"), F.col("avg_fit"), params))
        .drop("pair100")
    )
    return scored, used, leftovers


def best_possible(pair_cap: Column, fit_cap: Column, params: Params = DEFAULTS) -> Column:
    """A bound of the score: no affinity is above its cap, and nothing is left to fit when all is matched."""
    m = F.col("matched")
    pairing = F.when(m < 2, F.lit(params.neutral_pairing)).otherwise(pair_cap)
    return match_score(pairing, F.when(m < F.col("n"), fit_cap).otherwise(0.0), params)


def affinity_caps(picked: DataFrame, edges: DataFrame) -> DataFrame:
    """``(sel_id, pair_cap, fit_cap)``: the best affinity inside a selection, and the best one any of its items has."""
    inside = inner_edges(picked, edges).groupBy("sel_id").agg((F.max("score") / 100.0).alias("pair_cap"))
    most = edges.groupBy("item").agg(F.max("score").alias("most"))
    fits = picked.join(most, "item").groupBy("sel_id").agg((F.max("most") / 100.0).alias("fit_cap"))
    return fits.join(inside, "sel_id", "left")


def score_best(
    pool: DataFrame, selections: DataFrame, basket_items: DataFrame, edges: DataFrame, params: Params = DEFAULTS,
    symmetric: bool = False, first_wave: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``score_matches`` of the baskets that may be among a selection's best, wave by wave.

    Baskets come in the order of ``best_possible``. Once a selection has ``match_limit`` scores,
    all whose bound is below the last of these are out, with everything behind them. Waves
    grow eightfold, so there are few even if every basket has to be looked at. Baskets that only
    fill up (tier 2) come first: they are no more than the limit.
    """
    edges = edges if symmetric else stage(undirected_max(edges), "both-ways")
    picked = stage(selections.select("sel_id", "item").distinct(), "picked")
    pool = pool.join(basket_totals(pool, basket_items), "basket_id").join(affinity_caps(picked, edges), "sel_id", "left")
    caps = [F.coalesce(c, F.lit(0.0)) for c in ("pair_cap", "fit_cap")]
    pool = pool.withColumn("bound", best_possible(*caps, params)).drop("pair_cap", "fit_cap")
    order = Window.partitionBy("sel_id").orderBy(F.desc("tier"), F.desc("bound"), "basket_id")
    left = stage(pool.withColumn("place", F.row_number().over(order)), "bounded")
    upto = first_wave or 2 * params.match_limit
    waves: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while True:
        found = score_matches(left.where(F.col("place") <= upto).drop("bound", "place"), picked, basket_items, edges, params, symmetric=True)
        waves.append((stage(found[0], "scored"), *found[1:]))
        scored, used, leftovers = (functools.reduce(DataFrame.unionByName, part) for part in zip(*waves, strict=True))
        by_score = Window.partitionBy("sel_id").orderBy(F.desc("score"))
        last = scored.where("tier = 1").withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == params.match_limit)
        # Scores are compared to nine places.
        least = last.select("sel_id", (F.col("score") - 1e-8).alias("least"))
        behind = left.where(F.col("place") > upto).join(least, "sel_id", "left")
        left, seen = stage_counting(behind.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least"), "bounded", n=F.count(F.lit(1)))
        if not seen["n"]:
            return scored, used, leftovers
        upto *= 8


def rank_matches(scored: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Best first; rows of the other language follow by match count. Adds ``rank``."""
    order = Window.partitionBy("sel_id").orderBy(
        "tier",
        F.when(F.col("tier") == 2, F.col("fill")),
        F.desc(F.round("score", 9)),
        "extras",
        "basket_id",
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= params.match_limit
    )


def basket_matches(
    selections: DataFrame,
    baskets: DataFrame,
    basket_items: DataFrame,
    edges: DataFrame | None,
    params: Params = DEFAULTS,
    symmetric: bool = False,
) -> DataFrame:
    """The ranked answer: ``(sel_id, rank, basket_id, title, url, lang, used, suggested, missing, score)``.

    ``selections(sel_id, item, lang)``, ``baskets(basket_id, title, url, lang)``. Without
    ``edges`` they are those of ``pool_edges``.
    """
    langs = selections.groupBy("sel_id").agg(F.min("lang").alias("lang"))
    pool = stage(pick_pool(match_counts(selections, basket_items, params), langs, baskets, params), "pool")
    held = held_items(pool, basket_items)
    if edges is None:
        edges = pool_edges(pool, selections, held, basket_items, params)
    else:
        edges = stage(edges if symmetric else undirected_max(edges), "edges")
    scored, used, leftovers = score_best(pool, selections, held, edges, params, symmetric=True)
    best = stage(rank_matches(scored, params), "best")
    keys = ["sel_id", "basket_id"]
    # At most match_limit baskets per selection, each with the selection's own items.
    held = used.join(best.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("used")
    )
    open_items = leftovers.join(best.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("fit")).alias("k"), "item", "fit"))),
            lambda x: F.struct(x["item"].alias("name"), x["fit"].alias("fit")),
        ).alias("suggested")
    )
    none = F.array().cast("array<struct<name:string,fit:double>>")
    return (
        best.join(held, keys, "left")
        .join(open_items, keys, "left")
        .join(baskets.select("basket_id", "title", "url"), "basket_id")
        .select(
            "sel_id", "rank", "basket_id", "title", "url", "lang", "used",
            F.coalesce("suggested", none).alias("suggested"),
            F.col("extras").alias("missing"), "score",
        )
    )
