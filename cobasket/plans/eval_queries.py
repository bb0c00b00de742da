"""Pooled evaluation of the ranking formulas, and probe checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobasket.operators import evaluate as ev
from cobasket.operators import graph as g
from cobasket.operators import recommend as r
from cobasket.params import DEFAULTS
from cobasket.plans import inputs as i
from cobasket.plans.graph_queries import EXCLUSIVE_SQL, order_edges
from cobasket.plans.rank_queries import (
    _DAMP,
    SCORED_SQL,
    SINGLE_SQL,
    features_sql,
    score_sql,
    single_selections,
    taxonomy,
)
from cobasket.plans.registry import query
from cobasket.staging import stage

# Every part name is a probe.
BASE_SQL = f"{i.ORDER_EDGES_SQL}, {SINGLE_SQL}, {i.TAXONOMY_SQL}"
_FEATS = features_sql().replace("st AS (", "st_lower AS (")


def _variants_sql() -> str:
    rows = []
    for v, p in ev.variants().items():
        score = score_sql(p.use_penalties, p.use_rarity, p.rarity_floor, p.rarity_cap)
        decay = 1.0 if p.diversity_decay is None else p.diversity_decay
        rows.append(f"SELECT sel_id AS probe, item AS candidate, coalesce(category, 'other') AS category, "
                    f"{v} AS variant, {score} AS score, {decay}::DOUBLE AS decay FROM fd")
    return " UNION ALL ".join(rows)


VARIANTS_SQL = f"""
WITH {BASE_SQL},{EXCLUSIVE_SQL},{_FEATS},
fd AS (SELECT *, CASE category {_DAMP} ELSE 1.0::DOUBLE END AS damp FROM feat),
va AS ({_variants_sql()}),
vk AS (SELECT *, row_number() OVER (PARTITION BY probe, variant, category ORDER BY round(score, 9) DESC, candidate DESC) AS k FROM va),
ve AS (SELECT *, score * pow(decay, k - 1) AS eff FROM vk),
rk AS (SELECT probe, variant, candidate, row_number() OVER (PARTITION BY probe, variant
         ORDER BY round(eff, 9) DESC, round(score, 9) DESC, candidate DESC) AS rank FROM ve),
tp AS (SELECT DISTINCT probe, candidate FROM rk WHERE rank <= 15),
ex AS (SELECT probe, candidate, row_number() OVER (PARTITION BY probe ORDER BY md5('50:extra:' || probe || ':' || candidate), candidate) AS q
       FROM rk WHERE variant = 1 AND rank > 20 AND rank <= 120 AND (probe, candidate) NOT IN (SELECT (probe, candidate) FROM tp)),
al AS (SELECT * FROM tp UNION ALL SELECT probe, candidate FROM ex WHERE q <= 5),
pool AS (SELECT probe, CASE WHEN (SELECT sum(('0x' || c)::INT) FROM (SELECT unnest(string_split(sha1(probe), '')) AS c)) % 5 < 2
                  THEN 'holdout' ELSE 'dev' END AS split, candidate,
                row_number() OVER (PARTITION BY probe ORDER BY md5('50:order:' || probe || ':' || candidate), candidate) AS ord FROM al)"""


def rankings(spark, sf_dir, edges):
    probes = i.part_items(spark, sf_dir).withColumnRenamed("item", "probe")
    return stage(ev.variant_rankings(probes, edges, taxonomy(spark, sf_dir)), "rankings")


@query("formula_variants", f"{VARIANTS_SQL} SELECT * FROM rk")
def formula_variants(spark, sf_dir):
    return rankings(spark, sf_dir, order_edges(spark, sf_dir))


@query("eval_pool", f"{VARIANTS_SQL} SELECT * FROM pool")
def eval_pool(spark, sf_dir):
    return ev.build_pool(rankings(spark, sf_dir, order_edges(spark, sf_dir)))


@query("eval_split", """
WITH n AS (SELECT doc_id, source || '-' || doc_id AS name FROM documents),
d AS (SELECT doc_id, name, unnest(string_split(sha1(name), '')) AS c FROM n)
SELECT name, CASE WHEN sum(('0x' || c)::INT) % 5 < 2 THEN 'holdout' ELSE 'dev' END AS split FROM d GROUP BY doc_id, name""")
def eval_split(spark, sf_dir):
    from cobasket.functions.text import eval_split as split_of

    name = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return i.table(spark, sf_dir, "documents").select(name.alias("name")).select("name", split_of(F.col("name")).alias("split"))


# Grades stand on the edges between different modifiers: their score modulo 3.
GRADES_SQL = """
jd AS (SELECT item AS probe, partner AS candidate, score % 3 AS grade FROM e
       WHERE split_part(item, ' ', 1) <> split_part(partner, ' ', 1))"""


def grades(edges):
    word = lambda c: F.substring_index(c, " ", 1)
    return edges.where(word("item") != word("partner")).select(
        F.col("item").alias("probe"), F.col("partner").alias("candidate"), (F.col("score") % 3).alias("grade")
    )


@query("annotation_queue", f"""{VARIANTS_SQL}, {GRADES_SQL}
SELECT probe, split, candidate, ord FROM pool WHERE (probe, candidate) NOT IN (SELECT (probe, candidate) FROM jd)""")
def annotation_queue(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    pool = ev.build_pool(rankings(spark, sf_dir, edges))
    return ev.annotation_queue(pool, grades(edges)).select("probe", "split", "candidate", "ord")


@query("eval_progress", f"""{VARIANTS_SQL}, {GRADES_SQL}
SELECT count(grade) AS judged, count(*) AS total FROM pool LEFT JOIN jd USING (probe, candidate)""")
def eval_progress(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    return ev.progress(ev.build_pool(rankings(spark, sf_dir, edges)), grades(edges))


METRICS_SQL = f"""
WITH {BASE_SQL},{features_sql()},{SCORED_SQL}, {GRADES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY sel_id, category ORDER BY round(score, 9) DESC, item) AS k FROM scored),
ef AS (SELECT *, score * pow(0.8::DOUBLE, k - 1) AS eff FROM k),
rec AS (SELECT sel_id AS probe, item AS candidate, row_number() OVER (PARTITION BY sel_id
          ORDER BY round(eff, 9) DESC, round(score, 9) DESC, item) AS rank FROM ef),
hd AS (SELECT probe, candidate, grade, row_number() OVER (PARTITION BY probe ORDER BY rank) AS pos
       FROM rec JOIN jd USING (probe, candidate) WHERE rank <= 9),
tops AS (SELECT probe, count(*) AS judged, avg((grade >= 1)::INT) AS precision, avg((grade = 2)::INT) AS discovery,
                sum((pow(2.0::DOUBLE, grade) - 1) / log2(pos + 1)) AS dcg FROM hd GROUP BY 1),
id AS (SELECT probe, sum((pow(2.0::DOUBLE, grade) - 1) / log2(pos + 1)) AS ideal
       FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY grade DESC, candidate) AS pos FROM jd)
       JOIN tops USING (probe) WHERE pos <= judged GROUP BY 1),
rc AS (SELECT j.probe, count(r.candidate)::DOUBLE / count(*) AS recall FROM jd j LEFT JOIN rec r
       ON r.probe = j.probe AND r.candidate = j.candidate AND r.rank <= 36 WHERE grade = 2 GROUP BY 1),
me AS (SELECT probe, judged, precision, discovery, coalesce(recall, 1.0::DOUBLE) AS recall,
              CASE WHEN coalesce(ideal, 0) > 0 THEN dcg / ideal ELSE 0.0::DOUBLE END AS ndcg
       FROM tops LEFT JOIN id USING (probe) LEFT JOIN rc USING (probe))"""


def per_probe(spark, sf_dir, edges):
    top = r.top_diverse(
        r.score_candidates(single_selections(spark, sf_dir), edges, taxonomy(spark, sf_dir)), DEFAULTS, 36
    ).select(F.col("sel_id").alias("probe"), F.col("item").alias("candidate"), "rank")
    return ev.metrics(stage(top, "top"), stage(grades(edges), "grades"))


_M = ("precision", "discovery", "recall", "ndcg")


@query("eval_metrics", f"""{METRICS_SQL}
SELECT probe, judged, {', '.join(f'round({c}, 9) AS {c}' for c in _M)} FROM me""")
def eval_metrics(spark, sf_dir):
    return per_probe(spark, sf_dir, order_edges(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in _M})


@query("eval_averages", f"""{METRICS_SQL},
sp AS (SELECT probe, CASE WHEN ends_with(probe, 'widget') THEN 'staple'
              WHEN sum(('0x' || c)::INT) % 5 < 2 THEN 'holdout' ELSE 'dev' END AS split
       FROM (SELECT sel_id AS probe, unnest(string_split(sha1(sel_id), '')) AS c FROM sel) GROUP BY 1)
SELECT split, count(*) AS probes, {', '.join(f'round(avg({c}), 9) AS {c}' for c in _M)} 
FROM me JOIN sp USING (probe) WHERE (SELECT count(*) FROM jd) >= 200 GROUP BY 1""")
def eval_averages(spark, sf_dir):
    from cobasket.functions.text import eval_split as split_of

    names = i.part_items(spark, sf_dir).withColumnRenamed("item", "probe")
    probes = names.withColumn("split", split_of(F.col("probe")))
    staples = names.where(F.col("probe").endswith("widget"))
    edges = order_edges(spark, sf_dir)
    return ev.split_averages(per_probe(spark, sf_dir, edges), probes, staples, grades(edges)).withColumns({c: F.round(c, 9) for c in _M})


@query("resolved_judgments", f"""
WITH {i.ORDER_EDGES_SQL}, {GRADES_SQL},
f AS (SELECT DISTINCT p_name AS name, CASE WHEN split_part(p_name, ' ', 2) = 'gizmo' AND starts_with(p_name, 'hot') THEN NULL
        WHEN starts_with(p_name, 'old ') THEN 'hot ' || split_part(p_name, ' ', 2) ELSE p_name END AS r FROM part),
g AS (SELECT name, CASE WHEN r = 'hot gizmo' THEN NULL ELSE r END AS r FROM f)
SELECT p.r AS probe, c.r AS candidate, max(grade) AS grade FROM jd JOIN g p ON p.name = probe JOIN g c ON c.name = candidate
WHERE p.r IS NOT NULL AND c.r IS NOT NULL AND p.r <> c.r GROUP BY 1, 2""")
def resolved_judgments(spark, sf_dir):
    from cobasket.operators.resolve import resolve_names

    names = i.part_items(spark, sf_dir)
    noun = F.substring_index("item", " ", -1)
    merged = names.where(F.col("item").startswith("old ")).select(
        F.col("item").alias("src"), F.concat(F.lit("hot "), noun).alias("tgt")
    )
    deleted = names.where(F.col("item") == "hot gizmo")
    resolved = resolve_names(merged, deleted, names.withColumnRenamed("item", "name"))
    return ev.resolved_judgments(grades(order_edges(spark, sf_dir)), resolved)


@query("enough_judgments", f"""
WITH {i.ORDER_EDGES_SQL}, {GRADES_SQL} SELECT count(*) AS judgments, count(*) >= 200 AS enough FROM jd""")
def enough_judgments(spark, sf_dir):
    return ev.enough_judgments(grades(order_edges(spark, sf_dir)))


# -- probes after an enrichment ------------------------------------------------------

PROBE_SQL = f"""
WITH {i.ORDER_EDGES_SQL},
nn AS (SELECT DISTINCT p_name AS item, split_part(p_name, ' ', 2) AS w FROM part),
rk AS (SELECT item, partner, score, split_part(partner, ' ', 2) AS category,
              row_number() OVER (PARTITION BY item ORDER BY score DESC, partner) AS rank FROM e)"""


def ranked_edges(edges, deepest):
    """The best partners of every item, to the deepest place that is asked for."""
    from pyspark.sql import Window

    order = Window.partitionBy("item").orderBy(F.desc("score"), "partner")
    return edges.select(
        "item", "partner", F.substring_index("partner", " ", -1).alias("category"), F.row_number().over(order).alias("rank")
    ).where(F.col("rank") <= deepest)


@query("golden_probes", f"""{PROBE_SQL},
pb AS (SELECT item, 'red ' || w AS partner FROM nn)
SELECT pb.item, pb.partner, score, rank, coalesce(score >= 2 AND rank <= 9, false) AS passed
FROM pb LEFT JOIN rk USING (item, partner)""")
def golden_probes(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    probes = i.part_items(spark, sf_dir).select("item", F.concat(F.lit("red "), F.substring_index("item", " ", -1)).alias("partner"))
    return g.golden_probes(probes, edges, min_score=2, max_rank=9)


@query("regression_probes", f"""{PROBE_SQL},
top AS (SELECT * FROM rk WHERE rank <= 9)
SELECT item, 'red ' || w AS what, 'missing' AS failure FROM nn WHERE (item, 'red ' || w) NOT IN (SELECT (item, partner) FROM top)
UNION ALL SELECT item, 'hot ' || w, 'present' FROM nn WHERE (item, 'hot ' || w) IN (SELECT (item, partner) FROM top)
UNION ALL SELECT item, category, 'crowded' FROM top JOIN nn USING (item) WHERE category = w GROUP BY 1, 2 HAVING count(*) > 1""")
def regression_probes(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    noun = F.substring_index("item", " ", -1)
    pair = lambda word: names.select("item", F.concat(F.lit(word + " "), noun).alias("partner"))
    limits = names.select("item", noun.alias("category"), F.lit(1).alias("at_most"))
    return g.regression_probes(pair("red"), pair("hot"), limits, stage(ranked_edges(order_edges(spark, sf_dir), 9), "ranked"))
