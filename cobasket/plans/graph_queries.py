"""Graph building, vertex measures and enrichment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cobasket.operators import graph as g
from cobasket.params import DEFAULTS
from cobasket.plans import inputs as i
from cobasket.plans.registry import query
from cobasket.staging import stage


def order_edges(spark, sf_dir):
    """The order graph as a staged table: later joins see its size."""
    return stage(g.affinity_edges(i.order_lines(spark, sf_dir)), "edges")


@query("npmi_edges", f"""
WITH {i.ORDER_EDGES_SQL}
SELECT a, b, n_ab, round(npmi, 6) AS npmi, score FROM pr""")
def npmi_edges(spark, sf_dir):
    pairs = g.npmi_pairs(i.order_lines(spark, sf_dir))
    return pairs.withColumn("npmi", F.round("npmi", 6))


@query("npmi_edges_docs", f"""
WITH {i.DOC_WORDS_SQL},{i.edges_sql('dw')}
SELECT a, b, n_ab, round(npmi, 6) AS npmi, score FROM pr""")
def npmi_edges_docs(spark, sf_dir):
    pairs = g.npmi_pairs(i.document_words(spark, sf_dir), unique=True)
    return pairs.withColumn("npmi", F.round("npmi", 6))


@query("symmetrised_degree", f"""
WITH {i.ORDER_EDGES_SQL}
SELECT item, count(*) AS degree FROM e GROUP BY item""")
def symmetrised_degree(spark, sf_dir):
    return g.degree(g.affinity_edges(i.order_lines(spark, sf_dir)))


@query("popularity", f"""
WITH {i.ORDER_EDGES_SQL}, nm AS (SELECT DISTINCT p_name AS item FROM part)
SELECT nm.item, coalesce(sum(score), 0)::BIGINT AS freq
FROM nm LEFT JOIN e ON e.item = nm.item GROUP BY nm.item""")
def popularity(spark, sf_dir):
    return g.popularity(i.part_items(spark, sf_dir), g.affinity_edges(i.order_lines(spark, sf_dir)))


@query("quartiles_lower", f"""
WITH {i.ORDER_EDGES_SQL},
s AS (SELECT item, list_sort(list(score)) AS l, count(*) AS n FROM e GROUP BY item)
SELECT item, l[floor((n - 1) * 0.5)::INT + 1]::DOUBLE AS median,
       (l[floor((n - 1) * 0.75)::INT + 1] - l[floor((n - 1) * 0.25)::INT + 1])::DOUBLE AS iqr
FROM s""")
def quartiles_lower(spark, sf_dir):
    return g.quartiles_lower(g.affinity_edges(i.order_lines(spark, sf_dir)))


def _quartile_sql(k: int) -> str:
    j = f"greatest(1, least(({k} * (n + 1)) // 4, n - 1))"
    d = f"({k} * (n + 1) - 4 * {j})"
    return f"(((4 - {d}) * l[{j}] + {d} * l[{j} + 1]) / 4.0)"


EXCLUSIVE_SQL = f"""
s AS (SELECT item, list_sort(list(score)) AS l, count(*) AS n FROM e GROUP BY item),
st AS (SELECT item, (l[(n + 1) // 2] + l[n // 2 + 1]) / 2.0 AS median,
       CASE WHEN n < 4 THEN 10.0 ELSE {_quartile_sql(3)} - {_quartile_sql(1)} END AS iqr FROM s)"""


@query("quartiles_exclusive", f"""
WITH {i.ORDER_EDGES_SQL},{EXCLUSIVE_SQL}
SELECT item, median::DOUBLE AS median, iqr::DOUBLE AS iqr FROM st""")
def quartiles_exclusive(spark, sf_dir):
    return g.quartiles_exclusive(g.affinity_edges(i.order_lines(spark, sf_dir)))


# -- raw graph import: parts are nodes, line items carry (part, supplier) edges ---

RAW_GRAPH_SQL = """
nodes AS (SELECT p_partkey AS id, lower(trim(replace(upper(replace(p_name, ' ', '_')), '_', ' '))) || ' ' || p_partkey AS item
          FROM part WHERE p_type <> 'PROMO'),
raw AS (SELECT l_partkey AS id_1, l_suppkey AS id_2, l_discount AS score,
               CASE WHEN l_returnflag = 'A' THEN 'ingr-comp' ELSE 'ingr-ingr' END AS edge_type FROM lineitem),
typed AS (SELECT a.item AS a, b.item AS b, score FROM raw LEFT JOIN nodes a ON a.id = id_1
          LEFT JOIN nodes b ON b.id = id_2 WHERE edge_type = 'ingr-ingr')"""


def raw_graph(spark, sf_dir):
    nodes = i.parts(spark, sf_dir).select(
        F.col("p_partkey").alias("node_id"),
        F.concat_ws("_", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_type") == "PROMO", "compound").otherwise("ingredient").alias("node_type"),
    )
    edges = i.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id_1"), F.col("l_suppkey").alias("id_2"), F.col("l_discount").alias("score"),
        F.when(F.col("l_returnflag") == "A", "ingr-comp").otherwise("ingr-ingr").alias("edge_type"),
    )
    return nodes, edges


@query("graph_import", f"""
WITH {RAW_GRAPH_SQL},
kept AS (SELECT a, b, round_even(score * 100, 0)::INT AS score FROM typed
         WHERE a IS NOT NULL AND b IS NOT NULL AND score >= 0.01::DOUBLE)
SELECT a AS item, b AS partner, score FROM kept UNION ALL SELECT b, a, score FROM kept""")
def graph_import(spark, sf_dir):
    return g.import_graph(*raw_graph(spark, sf_dir))[0]


@query("graph_import_skipped", f"""
WITH {RAW_GRAPH_SQL}
SELECT count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS skipped_edges FROM typed""")
def graph_import_skipped(spark, sf_dir):
    return g.import_graph(*raw_graph(spark, sf_dir))[1]


@query("dense_item_ids", f"""
WITH {i.ORDER_EDGES_SQL}, a AS (SELECT DISTINCT item FROM e)
SELECT item, (row_number() OVER (ORDER BY item) - 1)::BIGINT AS item_id FROM a""")
def dense_item_ids(spark, sf_dir):
    edges = g.affinity_edges(i.order_lines(spark, sf_dir))
    return g.dense_ids(edges.select("item").distinct(), ["item"])


@query("support_sizing", f"""
WITH {i.ORDER_ITEMS_SQL},{i.edges_sql(p=replace(DEFAULTS, min_support=1))},
b AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100])::INT AS support)
SELECT support, count(*) FILTER (WHERE n_ab >= support) AS pairs,
       round(count(*) FILTER (WHERE n_ab >= support)::DOUBLE / count(*), 6) AS share
FROM pc CROSS JOIN b GROUP BY support""")
def support_sizing(spark, sf_dir):
    inc = g.incidence(i.order_lines(spark, sf_dir))
    return g.support_sizing(inc).withColumn("share", F.round("share", 6))


# -- enrichment: orders of the last priority are the incoming corpus ---------------

ENRICH = replace(DEFAULTS, min_item_freq=10, min_support=5)
TWO_CORPORA_SQL = f"""
lines AS (SELECT DISTINCT l_orderkey AS basket_id, p_name AS item, o_orderstatus AS status
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
old_bi AS (SELECT basket_id, item FROM lines WHERE status <> 'P'),
new_bi AS (SELECT basket_id, item FROM lines WHERE status = 'P'),
{i.edges_sql('old_bi', 'old_e', ENRICH, 'o_')},
{i.edges_sql('new_bi', 'new_e', ENRICH, 'n_')},
merged AS (SELECT item, partner, max(score) AS score
           FROM (SELECT * FROM old_e UNION ALL SELECT * FROM new_e) GROUP BY ALL),
prov AS (SELECT m.item, m.partner, o.score AS old_score, m.score AS new_score,
                CASE WHEN o.score IS NULL THEN 'added' ELSE 'raised' END AS change
         FROM merged m LEFT JOIN old_e o ON o.item = m.item AND o.partner = m.partner
         WHERE m.item < m.partner AND (o.score IS NULL OR m.score > o.score))"""


def two_corpora(spark, sf_dir):
    status = i.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("basket_id"), F.col("o_orderstatus").alias("status")
    )
    # Read by both graphs.
    lines = stage(i.order_lines(spark, sf_dir).join(status, "basket_id").select("basket_id", "item", "status"), "lines")
    old = g.affinity_edges(lines.where(F.col("status") != "P"), ENRICH, staged=True)
    new = g.affinity_edges(lines.where(F.col("status") == "P"), ENRICH, staged=True)
    return stage(old, "old"), stage(new, "new")


@query("max_merge", f"WITH {TWO_CORPORA_SQL} SELECT item, partner, score FROM merged")
def max_merge(spark, sf_dir):
    return g.max_merge(*two_corpora(spark, sf_dir))


# Incoming edges through decisions: "old" names are merged into "hot" ones, one name is
# deleted, one is neither live nor approved.
INCOMING_SQL = f"""
WITH {TWO_CORPORA_SQL},
hop AS (SELECT DISTINCT p_name AS src, CASE WHEN p_name = 'red rod' THEN NULL
          WHEN starts_with(p_name, 'old ') THEN 'hot ' || split_part(p_name, ' ', 2) ELSE p_name END AS tgt FROM part),
mapped AS (SELECT a.tgt AS item, b.tgt AS partner, score FROM new_e JOIN hop a ON a.src = item JOIN hop b ON b.src = partner
           WHERE a.tgt IS NOT NULL AND b.tgt IS NOT NULL)"""


def incoming(spark, sf_dir):
    old, new = two_corpora(spark, sf_dir)
    names = i.part_items(spark, sf_dir)
    merged = names.where(F.col("item").startswith("old ")).select(
        F.col("item").alias("src"), F.concat(F.lit("hot "), F.substring_index("item", " ", -1)).alias("tgt")
    )
    deleted = names.where(F.col("item") == "red rod").select(F.col("item").alias("src"), F.lit(None).cast("string").alias("tgt"))
    live = names.where(F.col("item") != "blue widget")
    return old, *g.resolve_incoming(new, merged.unionByName(deleted), live)


@query("enriched_edges", f"""{INCOMING_SQL},
fine AS (SELECT * FROM mapped WHERE item <> 'blue widget' AND partner <> 'blue widget' AND item <> partner),
alle AS (SELECT * FROM old_e UNION ALL SELECT * FROM fine UNION ALL SELECT partner, item, score FROM fine)
SELECT item, partner, max(score) AS score FROM alle GROUP BY 1, 2""")
def enriched_edges(spark, sf_dir):
    old, edges, _ = incoming(spark, sf_dir)
    return g.max_merge(old, edges)


@query("dropped_names", f"""{INCOMING_SQL}
SELECT 'blue widget' AS item, count(*) AS edges FROM mapped WHERE item = 'blue widget' OR partner = 'blue widget' HAVING count(*) > 0""")
def dropped_names(spark, sf_dir):
    return incoming(spark, sf_dir)[2]


@query("provenance", f"WITH {TWO_CORPORA_SQL} SELECT * FROM prov")
def provenance(spark, sf_dir):
    old, new = two_corpora(spark, sf_dir)
    return g.provenance(old, g.max_merge(old, new))


@query("score_histogram", f"""
WITH {TWO_CORPORA_SQL},
x AS (SELECT (score // 10 * 10)::INT AS band, 'before' AS side FROM old_e WHERE item < partner
      UNION ALL SELECT (score // 10 * 10)::INT, 'after' FROM merged WHERE item < partner)
SELECT band, count(*) FILTER (WHERE side = 'before') AS before,
       count(*) FILTER (WHERE side = 'after') AS after FROM x GROUP BY band""")
def score_histogram(spark, sf_dir):
    old, new = two_corpora(spark, sf_dir)
    return g.score_histogram(old, g.max_merge(old, new))


@query("most_raised", f"""
WITH {TWO_CORPORA_SQL}
SELECT *, new_score - old_score AS gain FROM prov WHERE change = 'raised'
ORDER BY gain DESC, item, partner LIMIT 20""")
def most_raised(spark, sf_dir):
    old, new = two_corpora(spark, sf_dir)
    return g.most_raised(g.provenance(old, g.max_merge(old, new)))


@query("append_items", """
WITH x AS (SELECT p_name AS item, bool_and(p_type = 'PROMO') AS fresh FROM part GROUP BY 1),
o AS (SELECT item, (row_number() OVER (ORDER BY item) - 1)::BIGINT AS item_id FROM x WHERE left(item, 3) <> 'new'),
n AS (SELECT item, (row_number() OVER (ORDER BY item) - 1 + (SELECT count(*) FROM o))::BIGINT AS item_id
      FROM x WHERE left(item, 3) = 'new')
SELECT * FROM o UNION ALL SELECT * FROM n""")
def append_items(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    old = g.dense_ids(names.where(~F.col("item").startswith("new")), ["item"])
    return g.append_items(old, names)


@query("new_item_candidates", f"""
WITH {i.DOC_WORDS_SQL}
SELECT item AS phrase, count(*) AS baskets FROM dw GROUP BY 1 HAVING count(*) >= 30""")
def new_item_candidates(spark, sf_dir):
    return g.new_item_candidates(i.document_words(spark, sf_dir).withColumnRenamed("item", "phrase"), unique=True)


@query("name_collisions", """
WITH prop AS (SELECT DISTINCT p_name || ' kits' AS item FROM part
              UNION SELECT DISTINCT 'fine ' || p_name || 's' FROM part),
skip AS (SELECT unnest(['blue', 'new', 'old', 'red', 'large', 'small', 'fine']) AS w),
all_names AS (SELECT item, 'p' AS side FROM prop UNION ALL SELECT DISTINCT p_name, 'e' FROM part),
terms AS (SELECT DISTINCT side, item, CASE WHEN regexp_matches(w, '[^s]s$') AND length(w) > 3 THEN w[:-2] ELSE w END AS t
          FROM (SELECT side, item, unnest(string_split(item, ' ')) AS w FROM all_names)
          WHERE w NOT IN (SELECT w FROM skip)),
keys AS (SELECT side, item, string_agg(t, ' ' ORDER BY t) AS k FROM terms GROUP BY 1, 2),
known AS (SELECT k, min(item) AS target FROM keys WHERE side = 'e' GROUP BY 1)
SELECT item, CASE WHEN target IS NULL THEN 'new' ELSE 'map' END AS verdict, target
FROM keys LEFT JOIN known USING (k) WHERE side = 'p'""")
def name_collisions(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    proposed = names.select(F.concat("item", F.lit(" kits")).alias("item")).unionByName(
        names.select(F.concat(F.lit("fine "), "item", F.lit("s")).alias("item"))
    )
    return g.accept_new_names(proposed, names)


@query("audit_sample", """
WITH x AS (SELECT doc_id::VARCHAR AS doc, source, row_number() OVER (PARTITION BY source
           ORDER BY md5('7:' || doc_id), doc_id::VARCHAR) AS pick FROM documents)
SELECT doc, source, pick FROM x WHERE pick <= 5""")
def audit_sample(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "source")
    return g.stratified_sample(docs, "source", "doc", 5, seed="7")


@query("audit_agreement", """
WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, 1 - toxic AS quality FROM labels)
SELECT count(*) AS audited, round(avg((a.quality = b.quality)::INT), 6) AS agreement FROM a JOIN b USING (doc_id)""")
def audit_agreement(spark, sf_dir):
    labels = i.table(spark, sf_dir, "labels")
    again = labels.select("doc_id", (1 - F.col("toxic")).alias("quality"))
    return g.agreement(labels.select("doc_id", "quality"), again, "doc_id", "quality").withColumn(
        "agreement", F.round("agreement", 6)
    )


@query("dataset_summary", """
SELECT 'orders' AS source, (SELECT count(DISTINCT p_name) FROM part) AS items, (SELECT count(*) FROM orders) AS baskets""")
def dataset_summary(spark, sf_dir):
    from cobasket.operators.baskets import summary

    return summary(i.part_items(spark, sf_dir), i.table(spark, sf_dir, "orders"), "orders")
