"""Recommendation, coherence, matching and search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from cobasket.functions import display as d
from cobasket.operators import coherence, match, search
from cobasket.operators import graph as g
from cobasket.operators import recommend as r
from cobasket.operators.taxonomy import classify, find_parents
from cobasket.params import CROSS_GROUPS, DEFAULTS, GLOBAL_DAMP, SELF_PENALTY
from cobasket.plans import inputs as i
from cobasket.plans.graph_queries import order_edges
from cobasket.plans.registry import query
from cobasket.staging import stage


def taxonomy(spark, sf_dir):
    """Categories and direct parents of the part names; some names stay unmapped."""
    names, rules = i.part_items(spark, sf_dir), i.rules(spark)
    table = classify(names, rules).join(find_parents(names, rules), "item")
    return stage(table.where(F.col("category").isNotNull()), "taxonomy")


_SELF = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SELF_PENALTY.items())
_DAMP = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in GLOBAL_DAMP.items())
_CROSS = " ".join(
    f"WHEN category IN {group} AND list_has_any(cats, {list(group)}) THEN {factor}::DOUBLE * damp"
    for group, factor in CROSS_GROUPS
)


def features_sql(sel: str = "sel", e: str = "e") -> str:
    """``feat``: one row per selection and candidate, as in ``candidate_features``."""
    return f"""
q AS (SELECT item, list_sort(list(score)) AS l, count(*) AS n FROM {e} GROUP BY item),
st AS (SELECT item, l[floor((n - 1) * 0.5)::INT + 1]::DOUBLE AS median,
              (l[floor((n - 1) * 0.75)::INT + 1] - l[floor((n - 1) * 0.25)::INT + 1])::DOUBLE AS iqr FROM q),
prof AS (SELECT sel_id, count(*) AS n, coalesce(list(DISTINCT category) FILTER (WHERE category IS NOT NULL), []) AS cats
         FROM {sel} LEFT JOIN tax USING (item) GROUP BY 1),
roots AS (SELECT DISTINCT sel_id, coalesce(root, item) AS root FROM {sel} LEFT JOIN tax USING (item)),
reach AS (SELECT s.sel_id, e.partner AS item, sum(e.score) AS total, count(*) AS coverage
          FROM {sel} s JOIN {e} e ON e.item = s.item
          WHERE NOT EXISTS (SELECT 1 FROM {sel} o WHERE o.sel_id = s.sel_id AND o.item = e.partner)
          GROUP BY 1, 2),
feat AS (SELECT r.sel_id, r.item, category, cats, coverage, n, total::DOUBLE / n AS avg100, median, iqr
         FROM reach r JOIN prof USING (sel_id) LEFT JOIN tax ON tax.item = r.item LEFT JOIN st ON st.item = r.item
         WHERE coverage >= greatest(1, floor(n * 0.5 + 0.5))
           AND NOT EXISTS (SELECT 1 FROM roots o WHERE o.sel_id = r.sel_id AND o.root = coalesce(tax.root, r.item)))"""


def score_sql(penalties: bool = True, rarity: bool = True, floor=0.25, cap=1.5) -> str:
    score = "avg100 / 100"
    if rarity:
        score += f" * coalesce(least(greatest((avg100 - median) / greatest(iqr, 5.0::DOUBLE), {floor}::DOUBLE), {cap}::DOUBLE), 1.0::DOUBLE)"
    if penalties:
        score += f""" * CASE WHEN category IS NULL THEN 1.0::DOUBLE
          WHEN list_contains(cats, category) THEN (CASE category {_SELF} ELSE 1.0::DOUBLE END) * damp {_CROSS} ELSE damp END"""
    return score


SCORED_SQL = f"""
scored AS (SELECT sel_id, item, coalesce(category, 'other') AS category, coverage, {score_sql()} AS score
           FROM (SELECT *, CASE category {_DAMP} ELSE 1.0::DOUBLE END AS damp FROM feat))"""


def diverse_sql(n: int = 30) -> str:
    return f"""
k AS (SELECT *, row_number() OVER (PARTITION BY sel_id, category ORDER BY round(score, 9) DESC, item) AS k FROM scored),
ef AS (SELECT *, score * pow(0.8::DOUBLE, k - 1) AS eff FROM k),
div AS (SELECT *, row_number() OVER (PARTITION BY sel_id ORDER BY round(eff, 9) DESC, round(score, 9) DESC, item) AS rank FROM ef)
SELECT sel_id, item, category, coverage, round(least(eff, 1.0::DOUBLE), 9) AS score, rank FROM div WHERE rank <= {n}"""


SINGLE_SQL = "sel AS (SELECT DISTINCT p_name AS sel_id, p_name AS item FROM part)"
ORDER_RANK_SQL = f"{i.ORDER_EDGES_SQL}, {i.SELECTIONS_SQL}, {i.TAXONOMY_SQL}"


def _digits(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def single_selections(spark, sf_dir):
    return i.part_items(spark, sf_dir).select(F.col("item").alias("sel_id"), "item")


@query("recommend_diverse", f"""
WITH {i.ORDER_EDGES_SQL}, {SINGLE_SQL}, {i.TAXONOMY_SQL},{features_sql()},{SCORED_SQL},{diverse_sql()}""")
def recommend_diverse(spark, sf_dir):
    ranked = r.recommend(single_selections(spark, sf_dir), order_edges(spark, sf_dir), taxonomy(spark, sf_dir))
    return _digits(ranked, "score")


@query("recommend_orders", f"""
WITH {ORDER_RANK_SQL},{features_sql()},{SCORED_SQL},{diverse_sql()}""")
def recommend_orders(spark, sf_dir):
    ranked = r.recommend(i.order_selections(spark, sf_dir), order_edges(spark, sf_dir), taxonomy(spark, sf_dir))
    return _digits(ranked, "score")


@query("recommend_raw", f"""
WITH {ORDER_RANK_SQL},{features_sql()},
scored AS (SELECT sel_id, item, coverage, {score_sql(False, False)} AS score FROM feat),
x AS (SELECT *, row_number() OVER (PARTITION BY sel_id ORDER BY round(score, 9) DESC, item) AS rank FROM scored)
SELECT sel_id, item, coverage, round(score, 9) AS score, rank FROM x WHERE rank <= 30""")
def recommend_raw(spark, sf_dir):
    plain = replace(DEFAULTS, use_penalties=False, use_rarity=False)
    scored = r.score_candidates(
        i.order_selections(spark, sf_dir), order_edges(spark, sf_dir), taxonomy(spark, sf_dir), plain
    )
    return _digits(r.top_plain(scored, 30), "score").drop("category")


@query("candidate_coverage", f"""
WITH {ORDER_RANK_SQL},{features_sql()}
SELECT sel_id, item, coverage, n, round(avg100, 9) AS avg100 FROM feat""")
def candidate_coverage(spark, sf_dir):
    feats = r.candidate_features(
        i.order_selections(spark, sf_dir), order_edges(spark, sf_dir), taxonomy(spark, sf_dir)
    )
    return _digits(feats.select("sel_id", "item", "coverage", "n", "avg100"), "avg100")


LANES_SQL = f"""
WITH {ORDER_RANK_SQL},{features_sql()},{SCORED_SQL},
k AS (SELECT sel_id, category, item, coverage, least(score, 1.0::DOUBLE) AS score,
             row_number() OVER (PARTITION BY sel_id, category ORDER BY round(score, 9) DESC, item) AS rank FROM scored),
l AS (SELECT *, avg(CASE WHEN rank <= 3 THEN score END) OVER (PARTITION BY sel_id, category) AS strength
      FROM k WHERE rank <= 12),
p AS (SELECT *, dense_rank() OVER (PARTITION BY sel_id ORDER BY round(strength, 9) DESC, category) AS lane_rank FROM l)"""


def order_lanes(spark, sf_dir):
    return r.recommend_lanes(i.order_selections(spark, sf_dir), order_edges(spark, sf_dir), taxonomy(spark, sf_dir))


@query("lanes", f"""{LANES_SQL}
SELECT sel_id, category, lane_rank, round(strength, 9) AS strength, item, coverage, round(score, 9) AS score, rank FROM p""")
def lanes(spark, sf_dir):
    return _digits(order_lanes(spark, sf_dir), "strength", "score")


_LABEL = " ".join(f"WHEN '{k}' THEN '{v['fr']}'" for k, v in d.CATEGORY_LABELS.items())


@query("lane_order", f"""{LANES_SQL}
SELECT sel_id, lane_rank, CASE category {_LABEL} END AS label, round(strength, 9) AS strength,
       floor(least(greatest(round(strength, 9), 0), 1) * 99 + 0.5)::INT AS badge,
       CASE WHEN round(strength, 9) >= 0.25 THEN 'great' WHEN round(strength, 9) >= 0.1 THEN 'good' ELSE 'weak' END AS fit
FROM p WHERE rank = 1""")
def lane_order(spark, sf_dir):
    heads = _digits(order_lanes(spark, sf_dir).where(F.col("rank") == 1), "strength")
    return heads.select(
        "sel_id", "lane_rank", d.category_label(F.col("category"), "fr").alias("label"), "strength",
        d.badge(F.col("strength")).alias("badge"), d.fit_bucket(F.col("strength")).alias("fit"),
    )


LOO_SQL = f"""
WITH {i.ORDER_EDGES_SQL}, {i.SELECTIONS_SQL},
sz AS (SELECT sel_id, count(*) AS n FROM sel GROUP BY 1 HAVING count(*) >= 2),
inn AS (SELECT s.sel_id, s.item, sum(e.score) AS t FROM sel s JOIN e ON e.item = s.item
        JOIN sel o ON o.sel_id = s.sel_id AND o.item = e.partner GROUP BY 1, 2),
loo AS (SELECT sel_id, item, n, coalesce(t, 0) / 100.0::DOUBLE / (n - 1) AS loo
        FROM sel JOIN sz USING (sel_id) LEFT JOIN inn USING (sel_id, item))"""


def order_lists(spark, sf_dir):
    """The items of every order, repeated ones too: the scores take each once."""
    return i.order_lines(spark, sf_dir).select(F.col("basket_id").alias("sel_id"), "item")


def order_loo(spark, sf_dir):
    return coherence.loo_scores(order_lists(spark, sf_dir), order_edges(spark, sf_dir), symmetric=True)


@query("loo_scores", f"{LOO_SQL} SELECT sel_id, item, n, round(loo, 9) AS loo FROM loo")
def loo_scores(spark, sf_dir):
    return _digits(order_loo(spark, sf_dir), "loo")


# The larger direction is kept for even scores, the other way round for odd ones.
@query("loo_one_way", f"{LOO_SQL} SELECT sel_id, item, n, round(loo, 9) AS loo FROM loo")
def loo_one_way(spark, sf_dir):
    """The same scores from a table that holds a pair in one direction, or less in the other."""
    edges = order_edges(spark, sf_dir)
    ahead = (F.col("item") < F.col("partner")) == (F.col("score") % 2 == 0)
    partial = edges.where(ahead).unionByName(edges.where(~ahead & (F.col("score") % 3 == 0)).withColumn("score", F.col("score") - 1))
    return _digits(coherence.loo_scores(order_lists(spark, sf_dir), partial), "loo")


# A name with its five best partners and a stranger; affinities here are small, so is the floor.
GUESTS = replace(DEFAULTS, outlier_min_mean=0.001)


@query("loo_outliers", f"""
WITH {i.ORDER_EDGES_SQL},
five AS (SELECT item AS sel_id, partner AS item FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, partner) AS r FROM e) WHERE r <= 5),
sel AS (SELECT * FROM five UNION SELECT sel_id, sel_id FROM five UNION SELECT sel_id, 'stranger' FROM five),
sz AS (SELECT sel_id, count(*) AS n FROM sel GROUP BY 1),
inn AS (SELECT s.sel_id, s.item, sum(e.score) AS t FROM sel s JOIN e ON e.item = s.item
        JOIN sel o ON o.sel_id = s.sel_id AND o.item = e.partner GROUP BY 1, 2),
loo AS (SELECT sel_id, item, coalesce(t, 0) / 100.0::DOUBLE / (n - 1) AS loo FROM sel JOIN sz USING (sel_id) LEFT JOIN inn USING (sel_id, item)),
h AS (SELECT sel_id, avg(loo) AS m, stddev_pop(loo) AS s FROM loo GROUP BY 1)
SELECT sel_id, item, round(loo, 9) AS loo, round(m, 9) AS harmony FROM loo JOIN h USING (sel_id)
WHERE m >= 0.001::DOUBLE AND loo < m - s AND loo < m * 0.5""")
def loo_outliers(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "partner")
    five = edges.withColumn("_r", F.row_number().over(best)).where("_r <= 5")
    members = F.explode(F.array("partner", "item", F.lit("stranger"))).alias("member")
    guests = five.select(F.col("item").alias("sel_id"), members).select("sel_id", F.col("member").alias("item")).distinct()
    flagged = coherence.outliers(coherence.loo_scores(guests, edges, symmetric=True), GUESTS).where("outlier")
    return _digits(flagged.select("sel_id", "item", "loo", "harmony"), "loo", "harmony")


@query("harmony", f"{LOO_SQL} SELECT sel_id, count(*) AS n, round(avg(loo), 9) AS harmony FROM loo GROUP BY 1")
def harmony(spark, sf_dir):
    return _digits(coherence.harmony(order_loo(spark, sf_dir)), "harmony")


@query("base_suppression", f"""
WITH {i.TAXONOMY_SQL}
SELECT item, root FROM tax""")
def base_suppression(spark, sf_dir):
    from cobasket.operators.resolve import resolve_base

    return resolve_base(taxonomy(spark, sf_dir))


# -- matching: benchmark texts are selections, documents are the baskets ------------

MATCH_SQL = r"""
bs AS (SELECT DISTINCT item_id AS sel_id, w AS item
       FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM benchmark) WHERE w <> ''),
sn AS (SELECT sel_id, count(*) AS n FROM bs GROUP BY 1),
mc AS (SELECT sel_id, basket_id, n, count(*) AS matched FROM bs JOIN dw USING (item) JOIN sn USING (sel_id) GROUP BY 1, 2, 3),
mx AS (SELECT sel_id, max(matched) AS best FROM mc GROUP BY 1),
gated AS (SELECT mc.* FROM mc JOIN mx USING (sel_id)
          WHERE matched >= greatest(least(n, greatest(2, ceil(n * 0.6::DOUBLE))), best - 1))"""
POOL_SQL = """
tg AS (SELECT g.*, lang, lang = 'en' AS same FROM gated g JOIN documents d ON d.doc_id = g.basket_id),
sh AS (SELECT sel_id, count(*) FILTER (WHERE same) AS n_same, count(*) AS n_all FROM tg GROUP BY 1),
ti AS (SELECT *, CASE WHEN n_same = 0 OR same THEN 1 ELSE 2 END AS tier,
              least(CASE WHEN n_same > 0 THEN n_same ELSE n_all END, 8) AS scored FROM tg JOIN sh USING (sel_id)),
fl AS (SELECT *, row_number() OVER (PARTITION BY sel_id, tier ORDER BY matched DESC, basket_id) AS fill FROM ti),
pool AS (SELECT sel_id, basket_id, n, matched, lang, tier, CASE WHEN tier = 2 THEN fill END AS fill FROM fl
         WHERE tier = 1 OR fill <= 8 - scored)"""


def text_selections(spark, sf_dir):
    """The words of each benchmark text, asked for in English."""
    texts = i.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return texts.select(
        F.col("item_id").alias("sel_id"), F.explode(i.words(F.col("text"))).alias("item"), F.lit("en").alias("lang")
    ).distinct()


def text_baskets(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("basket_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        F.concat(F.lit("https://docs/"), "doc_id").alias("url"), "lang",
    )


def text_basket_items(spark, sf_dir):
    return stage(i.document_words(spark, sf_dir), "words")


@query("match_gate", f"WITH {i.DOC_WORDS_SQL}, {MATCH_SQL} SELECT sel_id, basket_id, n, matched FROM gated")
def match_gate(spark, sf_dir):
    return match.match_counts(text_selections(spark, sf_dir), text_basket_items(spark, sf_dir))


@query("match_pool", f"WITH {i.DOC_WORDS_SQL}, {MATCH_SQL}, {POOL_SQL} SELECT * FROM pool")
def match_pool(spark, sf_dir):
    selections = text_selections(spark, sf_dir)
    counted = match.match_counts(selections, text_basket_items(spark, sf_dir))
    return match.pick_pool(counted, selections.select("sel_id", "lang").distinct(), text_baskets(spark, sf_dir))


MATCH_ALL_SQL = f"""
WITH {i.DOC_WORDS_SQL}, {MATCH_SQL}, {POOL_SQL}, {i.edges_sql('dw')},
tot AS (SELECT basket_id, count(*) AS total FROM dw WHERE basket_id IN (SELECT basket_id FROM pool) GROUP BY 1),
wa AS (SELECT p.sel_id, p.basket_id, bs.item, d.item IS NOT NULL AS held
       FROM pool p JOIN bs USING (sel_id) LEFT JOIN dw d ON d.basket_id = p.basket_id AND d.item = bs.item),
pairw AS (SELECT x.sel_id, x.basket_id, sum(e.score) AS s FROM wa x JOIN e ON e.item = x.item AND e.item < e.partner
          JOIN wa y ON y.sel_id = x.sel_id AND y.basket_id = x.basket_id AND y.item = e.partner AND y.held
          WHERE x.held GROUP BY 1, 2),
need AS (SELECT DISTINCT basket_id, item FROM wa WHERE NOT held),
tp AS (SELECT basket_id, item, score, row_number() OVER (PARTITION BY basket_id, item ORDER BY score DESC, partner) AS r
       FROM need JOIN e USING (item) JOIN (SELECT basket_id, item AS partner FROM dw) USING (basket_id, partner)),
ft AS (SELECT n.basket_id, n.item, coalesce(sum(score), 0) / 100.0::DOUBLE / least(total, 3) AS fit
       FROM need n JOIN tot USING (basket_id) LEFT JOIN (SELECT * FROM tp WHERE r <= 3) t USING (basket_id, item)
       GROUP BY n.basket_id, n.item, total),
lo AS (SELECT sel_id, basket_id, item, fit FROM wa JOIN ft USING (basket_id, item) WHERE NOT held),
af AS (SELECT sel_id, basket_id, avg(fit) AS avg_fit FROM lo GROUP BY 1, 2),
sc AS (SELECT sel_id, basket_id, tier, fill, lang, matched, n, total, greatest(0, total - matched) AS extras,
              CASE WHEN matched < 2 THEN 0.3::DOUBLE ELSE coalesce(s, 0) / 100.0::DOUBLE / (matched * (matched - 1) / 2) END AS pairing,
              coalesce(avg_fit, 0.0::DOUBLE) AS avg_fit
       FROM pool JOIN tot USING (basket_id) LEFT JOIN pairw USING (sel_id, basket_id) LEFT JOIN af USING (sel_id, basket_id)),
sd AS (SELECT *, 1.0::DOUBLE * (matched / n) + 0.5::DOUBLE * (matched / (matched + 3.0::DOUBLE)) + 0.6::DOUBLE * pairing
              + 0.3::DOUBLE * (matched / total) + 0.5::DOUBLE * avg_fit - 0.4::DOUBLE * (extras / (extras + 6.0::DOUBLE)) AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY sel_id ORDER BY tier, CASE WHEN tier = 2 THEN fill END,
              round(score, 9) DESC, extras, basket_id) AS rank FROM sd)"""


@query("basket_match_score", f"""{MATCH_ALL_SQL}
SELECT sel_id, basket_id, tier, matched, extras, round(pairing, 9) AS pairing, round(avg_fit, 9) AS avg_fit,
       round(score, 9) AS score FROM sd""")
def basket_match_score(spark, sf_dir):
    selections, postings = text_selections(spark, sf_dir), text_basket_items(spark, sf_dir)
    counted = match.match_counts(selections, postings)
    pool = stage(match.pick_pool(counted, selections.select("sel_id", "lang").distinct(), text_baskets(spark, sf_dir)), "pool")
    held = match.held_items(pool, postings)
    edges = match.pool_edges(pool, selections, held, postings)
    scored = match.score_matches(pool, selections, held, edges, symmetric=True)[0]
    return _digits(scored, "pairing", "avg_fit", "score").select(
        "sel_id", "basket_id", "tier", "matched", "extras", "pairing", "avg_fit", "score"
    )


@query("basket_matches", f"""{MATCH_ALL_SQL}
SELECT r.sel_id, rank, r.basket_id, 'doc ' || r.basket_id AS title, 'https://docs/' || r.basket_id AS url, lang,
       (SELECT string_agg(item, ' ' ORDER BY item) FROM wa w WHERE w.sel_id = r.sel_id AND w.basket_id = r.basket_id AND held) AS used,
       coalesce((SELECT string_agg(item, ' ' ORDER BY round(fit, 9) DESC, item) FROM lo l
                 WHERE l.sel_id = r.sel_id AND l.basket_id = r.basket_id), '') AS suggested,
       extras AS missing, round(score, 9) AS score
FROM rk r WHERE rank <= 8""")
def basket_matches(spark, sf_dir):
    found = match.basket_matches(text_selections(spark, sf_dir), text_baskets(spark, sf_dir), text_basket_items(spark, sf_dir), None)
    names = F.transform("suggested", lambda x: x["name"])
    return _digits(found, "score").withColumns(
        {"used": F.array_join("used", " "), "suggested": F.array_join(names, " ")}
    )


@query("pairing_fit", f"""
WITH {i.ORDER_EDGES_SQL},
od AS (SELECT basket_id, count(*) AS total FROM bi GROUP BY 1),
pa AS (SELECT DISTINCT basket_id, 'new ' || split_part(item, ' ', 2) AS item FROM bi),
ow AS (SELECT pa.*, total - (bi.item IS NOT NULL)::INT AS others
       FROM pa JOIN od USING (basket_id) LEFT JOIN bi ON bi.basket_id = pa.basket_id AND bi.item = pa.item),
tp AS (SELECT pa.basket_id, pa.item, score, row_number() OVER (PARTITION BY pa.basket_id, pa.item ORDER BY score DESC, e.partner) AS r
       FROM pa JOIN e ON e.item = pa.item JOIN bi ON bi.basket_id = pa.basket_id AND bi.item = e.partner),
ts AS (SELECT basket_id, item, sum(score) AS s FROM tp WHERE r <= 3 GROUP BY 1, 2)
SELECT basket_id, item, round(CASE WHEN others > 0 THEN coalesce(s, 0) / 100.0::DOUBLE / least(others, 3) ELSE 0 END, 9) AS fit
FROM ow LEFT JOIN ts USING (basket_id, item)""")
def pairing_fit(spark, sf_dir):
    postings = stage(i.order_lines(spark, sf_dir).select("basket_id", "item").distinct(), "postings")
    wanted = postings.select(
        "basket_id", F.concat(F.lit("new "), F.substring_index("item", " ", -1)).alias("item")
    ).distinct()
    return _digits(match.pairing_fit(wanted, postings, order_edges(spark, sf_dir)), "fit")


@query("search_items", f"""
WITH {i.ORDER_EDGES_SQL}, nm AS (SELECT DISTINCT p_name AS item FROM part),
fr AS (SELECT nm.item, coalesce(sum(score), 0)::BIGINT AS freq FROM nm LEFT JOIN e ON e.item = nm.item GROUP BY nm.item),
qs AS (SELECT DISTINCT left(p_type, 2) || '' AS query_id, lower(left(p_type, 2)) AS q FROM part
       UNION SELECT DISTINCT p_name, lower(trim(substr(p_name, 3, 4))) FROM part),
h AS (SELECT query_id, fr.item, freq, row_number() OVER (PARTITION BY query_id
             ORDER BY starts_with(fr.item, q) DESC, freq DESC, fr.item) AS rank
      FROM qs JOIN fr ON contains(fr.item, q) WHERE q <> '' AND fr.item <> query_id)
SELECT query_id, item, freq, rank FROM h WHERE rank <= 8""")
def search_items(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    items = g.popularity(names, order_edges(spark, sf_dir)).withColumn("display", F.upper("item"))
    types = i.parts(spark, sf_dir).select(F.substr("p_type", F.lit(1), F.lit(2)).alias("query")).distinct()
    asked = types.select(F.col("query").alias("query_id"), "query").unionByName(
        names.select(F.col("item").alias("query_id"), F.substr("item", F.lit(3), F.lit(4)).alias("query"))
    )
    chosen = names.select(F.col("item").alias("query_id"), "item")
    return search.search_items(asked, items, chosen)
