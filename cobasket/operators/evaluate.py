"""Pooled relevance evaluation of ranking formulas."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions.text import eval_split
from cobasket.operators.graph import quartiles_exclusive
from cobasket.operators.recommend import candidate_features, formula
from cobasket.params import DEFAULTS, Params


def variants(params: Params = DEFAULTS) -> dict[int, Params]:
    """The five formulas whose answers are pooled."""
    return {
        1: replace(params, use_penalties=False, use_rarity=False, diversity_decay=None),
        2: replace(params),
        3: replace(params, use_rarity=False),
        4: replace(params, rarity_floor=0.10, rarity_cap=2.5),
        5: replace(params, use_penalties=False, diversity_decay=None),
    }


def variant_rankings(
    probes: DataFrame, edges: DataFrame, taxonomy: DataFrame, params: Params = DEFAULTS, depth: int | None = None
) -> DataFrame:
    """``probes(probe)`` -> ``(probe, variant, candidate, rank)``.

    The features of a candidate are computed once; the variants are five scores of
    the same row. Equal scores are ordered by name, last name first. Rankings are whole
    unless the caller gives a ``depth``.
    """
    selections = probes.select(F.col("probe").alias("sel_id"), F.col("probe").alias("item"))
    feats = candidate_features(
        selections, edges, taxonomy, replace(params, use_rarity=True), quartiles_exclusive(edges)
    )
    scores = F.array(*[
        F.struct(
            F.lit(v).alias("variant"),
            formula(p).alias("score"),
            F.lit(1.0 if p.diversity_decay is None else p.diversity_decay).alias("decay"),
        )
        for v, p in variants(params).items()
    ])
    rows = feats.select(
        F.col("sel_id").alias("probe"), F.col("item").alias("candidate"),
        F.coalesce("category", F.lit("other")).alias("category"), F.explode(scores).alias("s"),
    ).select("probe", "candidate", "category", "s.*")
    in_category = Window.partitionBy("probe", "variant", "category").orderBy(
        F.desc(F.round("score", 9)), F.desc("candidate")
    )
    overall = Window.partitionBy("probe", "variant").orderBy(
        F.desc(F.round("eff", 9)), F.desc(F.round("score", 9)), F.desc("candidate")
    )
    wanted = F.lit(True) if depth is None else F.col("_k") <= depth
    ranked = (
        rows.withColumn("_k", F.row_number().over(in_category))
        .where(wanted)
        .withColumn("eff", F.col("score") * F.pow("decay", F.col("_k") - 1))
        .withColumn("rank", F.row_number().over(overall))
        .select("probe", "variant", "candidate", "rank")
    )
    return ranked if depth is None else ranked.where(F.col("rank") <= depth)


def build_pool(rankings: DataFrame, params: Params = DEFAULTS, seed: str = "50") -> DataFrame:
    """Union of the variants' tops plus hashed picks from the raw middle ranks.

    ``(probe, split, candidate, ord)``; ``ord`` is a hashed order that gives the
    rank away to nobody.
    """
    top = (
        rankings.where(F.col("rank") <= params.pool_depth)
        .select("probe", "candidate").distinct()
    )
    middle = rankings.where(
        (F.col("variant") == 1)
        & (F.col("rank") > params.pool_extra_from)
        & (F.col("rank") <= params.pool_extra_to)
    ).select("probe", "candidate").join(top, ["probe", "candidate"], "left_anti")
    draw = lambda tag: F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), "probe", "candidate"))
    extras = middle.withColumn(
        "_r", F.row_number().over(Window.partitionBy("probe").orderBy(draw("extra"), "candidate"))
    ).where(F.col("_r") <= params.pool_extras).select("probe", "candidate")
    shuffled = Window.partitionBy("probe").orderBy(draw("order"), "candidate")
    return top.unionByName(extras).select(
        "probe", eval_split(F.col("probe")).alias("split"), "candidate",
        F.row_number().over(shuffled).alias("ord"),
    )


def annotation_queue(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """Pooled pairs nobody judged yet."""
    return pool.join(judgments.select("probe", "candidate"), ["probe", "candidate"], "left_anti")


def progress(pool: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: judged and total pooled pairs."""
    marked = pool.join(
        judgments.select("probe", "candidate", F.lit(1).alias("_j")), ["probe", "candidate"], "left"
    )
    return marked.agg(F.count("_j").alias("judged"), F.count(F.lit(1)).alias("total"))


def resolved_judgments(judgments: DataFrame, names: DataFrame) -> DataFrame:
    """Judgments by final name: ``names(name, resolved)``; the best grade wins a collision."""
    p = names.select(F.col("name").alias("probe"), F.col("resolved").alias("_p"))
    c = names.select(F.col("name").alias("candidate"), F.col("resolved").alias("_c"))
    return (
        judgments.join(p, "probe").join(c, "candidate")
        .where(F.col("_p").isNotNull() & F.col("_c").isNotNull() & (F.col("_p") != F.col("_c")))
        .groupBy(F.col("_p").alias("probe"), F.col("_c").alias("candidate"))
        .agg(F.max("grade").alias("grade"))
    )


def metrics(recommended: DataFrame, judgments: DataFrame, top: int = 9, recall_depth: int = 36) -> DataFrame:
    """``recommended(probe, candidate, rank)``, ``judgments(probe, candidate, grade)``.

    Per probe ``(precision, discovery, recall, ndcg, judged)``. Unjudged items are
    taken out of the top and positions close up. A probe without a judged item in
    its top has no row.
    """
    graded = judgments.select("probe", "candidate", "grade")
    # The tops are short: at most ``top`` rows of a probe meet in a window.
    head = recommended.where(F.col("rank") <= top).join(graded, ["probe", "candidate"])
    closed = Window.partitionBy("probe").orderBy("rank")
    gain = lambda pos: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(pos + 1)
    tops = (
        head.withColumn("pos", F.row_number().over(closed))
        .groupBy("probe")
        .agg(
            F.count(F.lit(1)).alias("judged"),
            F.avg((F.col("grade") >= 1).cast("int")).alias("precision"),
            F.avg((F.col("grade") == 2).cast("int")).alias("discovery"),
            F.sum(gain(F.col("pos"))).alias("dcg"),
        )
    )
    best_order = Window.partitionBy("probe").orderBy(F.desc("grade"), "candidate")
    ideal = (
        graded.withColumn("pos", F.row_number().over(best_order))
        .where(F.col("pos") <= top)
        .join(tops.select("probe", "judged"), "probe")
        .where(F.col("pos") <= F.col("judged"))
        .groupBy("probe")
        .agg(F.sum(gain(F.col("pos"))).alias("ideal"))
    )
    within = recommended.where(F.col("rank") <= recall_depth).select("probe", "candidate", F.lit(1).alias("_hit"))
    recall = (
        graded.where(F.col("grade") == 2)
        .join(within, ["probe", "candidate"], "left")
        .groupBy("probe")
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    )
    return (
        tops.join(ideal, "probe", "left")
        .join(recall, "probe", "left")
        .select(
            "probe", "judged", "precision", "discovery",
            F.coalesce("recall", F.lit(1.0)).alias("recall"),
            F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        )
    )


def split_averages(
    per_probe: DataFrame, probes: DataFrame, staples: DataFrame | None = None,
    judgments: DataFrame | None = None, params: Params = DEFAULTS,
) -> DataFrame:
    """Macro averages per split; staple probes stand apart as the split ``staple``.

    With ``judgments`` there are no averages at all unless there are enough of them.
    """
    rows = per_probe.join(probes.select("probe", "split").distinct(), "probe")
    if staples is not None:
        flagged = staples.select("probe", F.lit(True).alias("_staple"))
        rows = rows.join(flagged, "probe", "left").withColumn(
            "split", F.when(F.col("_staple"), "staple").otherwise(F.col("split"))
        )
    if judgments is not None:
        rows = rows.where(F.lit(enough_judgments(judgments, params).first()["enough"]))
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("probes"),
        *[F.avg(m).alias(m) for m in ("precision", "discovery", "recall", "ndcg")],
    )


def enough_judgments(judgments: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row: the number of judgments and whether an evaluation may run."""
    return judgments.agg(F.count(F.lit(1)).alias("judgments")).withColumn(
        "enough", F.col("judgments") >= params.min_judgments
    )
