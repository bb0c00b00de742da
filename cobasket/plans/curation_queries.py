"""Merge chains, curated graphs and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobasket.functions.text import KEY_TERM_SKIP
from cobasket.operators import curate as c
from cobasket.operators import decisions as dec
from cobasket.operators import groups, quality
from cobasket.operators import graph as g
from cobasket.operators import resolve as rs
from cobasket.plans import inputs as i
from cobasket.plans.graph_queries import order_edges
from cobasket.plans.rank_queries import taxonomy
from cobasket.plans.registry import query
from cobasket.staging import stage

# Decisions over the part names. The rules give chains of two hops, a cycle, an
# unknown target, chains that end on a deleted name, and a name both merged and deleted.
SPECIAL_MERGES = {
    "cold rod": "hot rod",
    "hot rod": "cold rod",
    "blue plate": "steel plate",
    "blue gear": "large gear",
    "small ring": "red ring",
}
DELETED = ("large gear", "small ring", "red gizmo")

_SPECIAL = " ".join(f"WHEN item = '{k}' THEN '{v}'" for k, v in SPECIAL_MERGES.items())
DECISIONS_SQL = f"""
nm AS (SELECT DISTINCT p_name AS item FROM part),
merged AS (SELECT item AS src, CASE {_SPECIAL}
             WHEN starts_with(item, 'old ') THEN replace(item, 'old ', 'new ')
             WHEN starts_with(item, 'new ') THEN replace(item, 'new ', 'red ') END AS tgt FROM nm),
merged_ AS (SELECT * FROM merged WHERE tgt IS NOT NULL),
deleted AS (SELECT item FROM nm WHERE item IN {DELETED})"""
CHAINS_SQL = f"""{DECISIONS_SQL},
lk AS (SELECT * FROM merged_ WHERE src NOT IN (SELECT item FROM deleted)),
walk AS (SELECT src, tgt, 1 AS hops FROM lk UNION ALL
         SELECT w.src, l.tgt, hops + 1 FROM walk w JOIN lk l ON l.src = w.tgt WHERE hops < 100),
fin AS (SELECT src, tgt FROM walk WHERE tgt NOT IN (SELECT src FROM lk)),
res AS (SELECT m.src, CASE WHEN f.tgt IN (SELECT item FROM nm) AND f.tgt NOT IN (SELECT item FROM deleted)
                           THEN f.tgt END AS tgt
        FROM merged_ m LEFT JOIN fin f ON f.src = m.src),
gone AS (SELECT item FROM deleted UNION SELECT src FROM res WHERE tgt IS NULL),
mv AS (SELECT nm.item, coalesce(r.tgt, nm.item) AS final FROM nm LEFT JOIN res r ON r.src = nm.item
       WHERE nm.item NOT IN (SELECT item FROM gone))"""
BAD_SQL = """
bp AS (SELECT ['old ' || w, 'small gear'] AS names FROM (SELECT DISTINCT split_part(item, ' ', 2) AS w FROM nm)
       UNION ALL SELECT ['blue ' || w] FROM (SELECT DISTINCT split_part(item, ' ', 2) AS w FROM nm)
       UNION ALL SELECT ['new ' || w, 'red ' || w] FROM (SELECT DISTINCT split_part(item, ' ', 2) AS w FROM nm)),
bl AS (SELECT x.final AS a, y.final AS b FROM bp JOIN mv x ON x.item = names[1] JOIN mv y ON y.item = names[2]
       WHERE len(names) = 2 AND x.final <> y.final),
bl2 AS (SELECT a, b FROM bl UNION SELECT b, a FROM bl)"""
CURATED_SQL = f"""{BAD_SQL},
rw AS (SELECT x.final AS item, y.final AS partner, max(score) AS score FROM e JOIN mv x ON x.item = e.item
       JOIN mv y ON y.item = e.partner WHERE x.final <> y.final GROUP BY 1, 2),
cur AS (SELECT * FROM rw WHERE NOT EXISTS (SELECT 1 FROM bl2 WHERE a = item AND b = partner))"""


def decisions(spark, sf_dir):
    """items, merged(src, tgt), deleted(item), bad_pairs(names)."""
    names = i.part_items(spark, sf_dir)
    tgt = F.lit(None).cast("string")
    for src, to in SPECIAL_MERGES.items():
        tgt = F.coalesce(tgt, F.when(F.col("item") == src, to))
    noun = F.substring_index("item", " ", -1)
    tgt = (
        F.when(tgt.isNotNull(), tgt)
        .when(F.col("item").startswith("old "), F.concat(F.lit("new "), noun))
        .when(F.col("item").startswith("new "), F.concat(F.lit("red "), noun))
    )
    merged = names.select(F.col("item").alias("src"), tgt.alias("tgt")).where(F.col("tgt").isNotNull())
    deleted = names.where(F.col("item").isin(*DELETED))
    nouns = names.select(noun.alias("w")).distinct()
    pair = lambda *parts: F.array(*[F.concat(F.lit(p), "w") if p.endswith(" ") else F.lit(p) for p in parts])
    bad = nouns.select(
        F.explode(F.array(pair("old ", "small gear"), pair("blue "), pair("new ", "red "))).alias("names")
    )
    return names, merged, deleted, bad


def curated(spark, sf_dir):
    names, merged, deleted, bad = decisions(spark, sf_dir)
    edges = order_edges(spark, sf_dir)
    return edges, c.curate(names, edges, deleted, merged, bad)


@query("merge_chains", f"WITH RECURSIVE {CHAINS_SQL} SELECT src, tgt FROM res")
def merge_chains(spark, sf_dir):
    names, merged, deleted, _ = decisions(spark, sf_dir)
    return rs.resolve_merges(merged, deleted, names)


@query("live_items", f"""
WITH {DECISIONS_SQL}
SELECT item FROM nm WHERE item NOT IN (SELECT item FROM deleted) AND item NOT IN (SELECT src FROM merged_)""")
def live_items(spark, sf_dir):
    names, merged, deleted, _ = decisions(spark, sf_dir)
    return c.live_items(names, deleted, merged)


@query("curate_edges", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{CURATED_SQL}
SELECT item, partner, score FROM cur""")
def curate_edges(spark, sf_dir):
    return curated(spark, sf_dir)[1].edges


@query("bad_pairs", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{CURATED_SQL}
SELECT item, partner, score FROM rw WHERE EXISTS (SELECT 1 FROM bl2 WHERE a = item AND b = partner)""")
def bad_pairs(spark, sf_dir):
    return curated(spark, sf_dir)[1].removed_bad


@query("curation_impact", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{CURATED_SQL},
t AS (SELECT DISTINCT tgt AS item FROM res WHERE tgt IS NOT NULL),
o AS (SELECT item, count(*) AS c FROM e GROUP BY 1), n AS (SELECT item, count(*) AS c FROM cur GROUP BY 1)
SELECT item, coalesce(o.c, 0) AS before, coalesce(n.c, 0) AS after, coalesce(n.c, 0) - coalesce(o.c, 0) AS gained
FROM t LEFT JOIN o USING (item) LEFT JOIN n USING (item)""")
def curation_impact(spark, sf_dir):
    edges, result = curated(spark, sf_dir)
    return c.impact(edges, result)


@query("curation_totals", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{CURATED_SQL}
SELECT (SELECT count(*) FROM gone WHERE item IN (SELECT item FROM nm)) AS deleted,
       (SELECT count(*) FROM res WHERE tgt IS NOT NULL) AS merged,
       (SELECT count(*) FROM rw WHERE EXISTS (SELECT 1 FROM bl2 WHERE a = item AND b = partner)) AS bad_edges,
       (SELECT count(*) FROM mv WHERE item NOT IN (SELECT src FROM res)) AS remaining""")
def curation_totals(spark, sf_dir):
    names, _, deleted, _ = decisions(spark, sf_dir)
    return c.impact_totals(names, deleted, curated(spark, sf_dir)[1])


@query("curated_ids", f"""
WITH RECURSIVE {CHAINS_SQL},
o AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS old FROM nm)
SELECT item, (row_number() OVER (ORDER BY old) - 1)::BIGINT AS item_id FROM o
WHERE item IN (SELECT item FROM mv) AND item NOT IN (SELECT src FROM res)""")
def curated_ids(spark, sf_dir):
    names, merged, deleted, bad = decisions(spark, sf_dir)
    numbered = g.dense_ids(names, ["item"])
    kept = c.curate(numbered, order_edges(spark, sf_dir), deleted, merged, bad).items
    return c.reindex(kept).select("item", "item_id")


@query("context_edges", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{BAD_SQL},
ce AS (SELECT k AS context, item, partner, score + k AS score FROM e, (SELECT unnest([0, 1]) AS k)),
rw AS (SELECT context, x.final AS item, y.final AS partner, max(score) AS score FROM ce JOIN mv x ON x.item = ce.item
       JOIN mv y ON y.item = ce.partner WHERE x.final <> y.final GROUP BY 1, 2, 3)
SELECT context, item, partner, score FROM rw
WHERE context > 0 OR NOT EXISTS (SELECT 1 FROM bl2 WHERE a = item AND b = partner)""")
def context_edges(spark, sf_dir):
    names, merged, deleted, bad = decisions(spark, sf_dir)
    edges = order_edges(spark, sf_dir).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("context"), "item", "partner", "score")
    edges = edges.withColumn("score", F.col("score") + F.col("context"))
    return c.curate(names, edges, deleted, merged, bad).edges


@query("judgment_names", f"""
WITH RECURSIVE {DECISIONS_SQL},
walk AS (SELECT item, item AS cur, [item] AS seen FROM nm UNION ALL
         SELECT w.item, m.tgt, list_append(seen, m.tgt) FROM walk w JOIN merged_ m ON m.src = w.cur
         WHERE NOT list_contains(seen, m.tgt)),
fin AS (SELECT item, arg_max(cur, len(seen)) AS final FROM walk GROUP BY 1)
SELECT item AS name, CASE WHEN final NOT IN (SELECT item FROM deleted) THEN final END AS resolved FROM fin""")
def judgment_names(spark, sf_dir):
    names, merged, deleted, _ = decisions(spark, sf_dir)
    return rs.resolve_names(merged, deleted, names.withColumnRenamed("item", "name"))


@query("compact_merges", """
WITH nm AS (SELECT DISTINCT p_name AS item FROM part),
n AS (SELECT item, split_part(item, ' ', 1) AS m, split_part(item, ' ', 2) AS w FROM nm)
SELECT item AS src, CASE WHEN m = 'cold' THEN 'hot ' || w ELSE 'red ' || w END AS tgt FROM n
WHERE m IN ('old', 'blue') OR (m = 'new' AND w <> 'gear') OR (m = 'cold' AND w = 'gear')""")
def compact_merges(spark, sf_dir):
    return _compacted(spark, sf_dir)[0]


@query("rejected_merges", """
WITH nm AS (SELECT DISTINCT p_name AS item FROM part),
n AS (SELECT item, split_part(item, ' ', 1) AS m, split_part(item, ' ', 2) AS w FROM nm)
SELECT item AS src, CASE WHEN m = 'red' THEN 'blue ' || w ELSE 'small ' || w END AS tgt FROM n
WHERE m = 'red' OR (m = 'new' AND w = 'gear')""")
def rejected_merges(spark, sf_dir):
    return _compacted(spark, sf_dir)[1]


def _compacted(spark, sf_dir):
    """Old names already go to red ones. Blue then joins old, new joins blue, and red joining
    blue would close a circle. Small names are deleted: new gear cannot go there."""
    names = i.part_items(spark, sf_dir)
    m, w = F.substring_index("item", " ", 1), F.substring_index("item", " ", -1)
    to = lambda word: F.concat(F.lit(word + " "), w)
    existing = names.where(m == "old").select(F.col("item").alias("src"), to("red").alias("tgt"))
    rule = (
        F.when((m == "new") & (w == "gear"), F.struct(to("small").alias("tgt"), F.lit(1).alias("ord")))
        .when(m == "blue", F.struct(to("old").alias("tgt"), F.lit(2).alias("ord")))
        .when(m == "new", F.struct(to("blue").alias("tgt"), F.lit(3).alias("ord")))
        .when(m == "red", F.struct(to("blue").alias("tgt"), F.lit(4).alias("ord")))
        .when((m == "cold") & (w == "gear"), F.struct(to("hot").alias("tgt"), F.lit(5).alias("ord")))
    )
    proposed = names.select(F.col("item").alias("src"), rule.alias("r")).where(F.col("r").isNotNull())
    deleted = names.where(m == "small")
    return dec.compact_merges(proposed.select("src", "r.tgt", "r.ord"), existing, deleted)


@query("decision_lww", """
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY 1, 2""")
def decision_lww(spark, sf_dir):
    log = i.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dec.last_writer(log, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select(
        "user_id", "event_type", "value", "event_id"
    )


JUDGE_SQL = """
remote AS (SELECT source AS probe, doc_id AS candidate, quality AS grade FROM labels JOIN documents USING (doc_id)),
loc AS (SELECT source AS probe, doc_id AS candidate, quality + 1 - toxic AS grade
        FROM labels JOIN documents USING (doc_id) WHERE lang <> 'en')"""


@query("judgment_merge", f"""
WITH {JUDGE_SQL}
SELECT * FROM loc UNION ALL SELECT * FROM remote WHERE (probe, candidate) NOT IN (SELECT (probe, candidate) FROM loc)""")
def judgment_merge(spark, sf_dir):
    rows = i.table(spark, sf_dir, "labels").join(
        i.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id"
    )
    keys = [F.col("source").alias("probe"), F.col("doc_id").alias("candidate")]
    remote = rows.select(*keys, F.col("quality").alias("grade"))
    local = rows.where(F.col("lang") != "en").select(*keys, (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return dec.overlay(local, remote, ["probe", "candidate"])


@query("decision_union", f"""
WITH {DECISIONS_SQL}
SELECT item FROM deleted UNION SELECT src FROM merged_""")
def decision_union(spark, sf_dir):
    _, merged, deleted, _ = decisions(spark, sf_dir)
    return dec.union_names(deleted, merged.withColumnRenamed("src", "item"))


STATE_SQL = """
rows_ AS (SELECT event_type AS field, user_id::VARCHAR AS key, event_id, CASE WHEN user_id < 75 THEN 'local' ELSE 'remote' END AS side FROM events),
loc AS (SELECT field, key, max(event_id)::VARCHAR AS value FROM rows_ WHERE side = 'local' OR event_id < 5000 GROUP BY 1, 2),
rem AS (SELECT field, key, min(event_id)::VARCHAR AS value FROM rows_ WHERE side = 'remote' OR event_id < 5000 GROUP BY 1, 2)"""


# One kind of event is united, one overlaid; the others are fields that nobody manages here.
@query("decision_state", f"""
WITH {STATE_SQL},
man AS (SELECT * FROM loc WHERE field IN ('click', 'view'))
SELECT * FROM man UNION ALL SELECT * FROM rem WHERE (field, key) NOT IN (SELECT (field, key) FROM man)""")
def decision_state(spark, sf_dir):
    rows = i.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("field"), F.col("user_id").cast("string").alias("key"), "event_id",
        (F.col("user_id") < 75).alias("local"),
    )
    early = F.col("event_id") < 5000
    local = rows.where(F.col("local") | early).groupBy("field", "key").agg(F.max("event_id").cast("string").alias("value"))
    remote = rows.where(~F.col("local") | early).groupBy("field", "key").agg(F.min("event_id").cast("string").alias("value"))
    return dec.merge_state(local, remote, ("click",), ("view",))


# -- duplicate grouping and quality -------------------------------------------------

_SKIP = ", ".join(f"'{w}'" for w in KEY_TERM_SKIP)
_TERM = """CASE WHEN ends_with(x, 'ies') AND length(x) > 4 THEN x[:-4] || 'y'
        WHEN regexp_matches(x, '[^aeiou]ves$') AND length(x) > 4 THEN x[:-4] || 'fe'
        WHEN regexp_matches(x, '[aeiou]ves$') AND length(x) > 4 THEN x[:-2]
        WHEN ends_with(x, 'oes') AND length(x) > 4 THEN x[:-3]
        WHEN regexp_matches(x, '[^s]s$') AND length(x) > 3 THEN x[:-2] ELSE x END"""


# Names of up to four terms compete for each other's groups; the terms are taken in turn.
@query("dup_groups", f"""
WITH RECURSIVE nm AS (SELECT p_name || ' ' || p_type || ' kits' AS item, count(*) AS degree FROM part GROUP BY 1),
w AS (SELECT item, degree, regexp_replace(u, '[^a-z]', '', 'g') AS x
      FROM (SELECT item, degree, unnest(regexp_split_to_array(lower(item), '[\\s\\-/]+')) AS u FROM nm)),
t AS (SELECT DISTINCT item, degree, term FROM (SELECT item, degree, {_TERM} AS term FROM w WHERE length(x) >= 3 AND x NOT IN ({_SKIP}))
      WHERE length(term) >= 3 AND term NOT IN ({_SKIP})),
sz AS (SELECT term, count(*) AS size, list(item ORDER BY degree DESC, item) AS members FROM t GROUP BY term HAVING count(*) >= 2),
od AS (SELECT term, members, row_number() OVER (ORDER BY size DESC, term) AS k FROM sz),
rec AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS term, []::VARCHAR[] AS picked, []::VARCHAR[] AS claimed
        UNION ALL
        SELECT nk, term, CASE WHEN len(f) >= 2 THEN f[1:8] ELSE []::VARCHAR[] END,
               list_concat(claimed, CASE WHEN len(f) >= 2 THEN f[1:8] ELSE []::VARCHAR[] END)
        FROM (SELECT od.k AS nk, od.term, rec.claimed, list_filter(od.members, lambda m: NOT list_contains(rec.claimed, m)) AS f
              FROM rec JOIN od ON od.k = rec.k + 1))
SELECT term, unnest(picked) AS item, generate_subscripts(picked, 1)::INT AS place FROM rec""")
def dup_groups(spark, sf_dir):
    """Part names with their type, grouped by their key terms."""
    name = F.concat_ws(" ", "p_name", "p_type", F.lit("kits")).alias("item")
    sized = i.parts(spark, sf_dir).groupBy(name).agg(F.count(F.lit(1)).alias("degree"))
    return groups.duplicate_groups(sized).select("term", "item", "place")


# A single word has one key term, so its groups do not compete and SQL can state them.
@query("dup_groups_words", f"""
WITH {i.DOC_WORDS_SQL},
w AS (SELECT item, count(*) AS degree, regexp_replace(item, '[^a-z]', '', 'g') AS x FROM dw GROUP BY 1),
t AS (SELECT item, degree, CASE WHEN ends_with(x, 'ies') AND length(x) > 4 THEN x[:-4] || 'y'
        WHEN regexp_matches(x, '[^aeiou]ves$') AND length(x) > 4 THEN x[:-4] || 'fe'
        WHEN regexp_matches(x, '[aeiou]ves$') AND length(x) > 4 THEN x[:-2]
        WHEN ends_with(x, 'oes') AND length(x) > 4 THEN x[:-3]
        WHEN regexp_matches(x, '[^s]s$') AND length(x) > 3 THEN x[:-2] ELSE x END AS term
      FROM w WHERE length(x) >= 3 AND x NOT IN ({_SKIP})),
g AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY degree DESC, item) AS place, count(*) OVER (PARTITION BY term) AS size
      FROM t WHERE length(term) >= 3 AND term NOT IN ({_SKIP}))
SELECT term, item, place FROM g WHERE size >= 2 AND place <= 8""")
def dup_groups_words(spark, sf_dir):
    words = i.document_words(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("degree"))
    # Read twice: the texts are taken apart once.
    return groups.duplicate_groups(stage(words, "degrees")).select("term", "item", "place")


def _flat(checks):
    return checks.withColumn("sample", F.array_join("sample", "|"))


def broken_graph(spark, sf_dir):
    """The order graph with faults: one-sided edges, self pairs, low scores, repeats."""
    edges = order_edges(spark, sf_dir)
    one = edges.where(F.col("item").startswith("old") & F.col("partner").startswith("red"))
    return (
        edges.unionByName(one)
        .unionByName(one.select("item", F.concat("partner", F.lit("s")).alias("partner"), "score"))
        .unionByName(one.select("item", F.col("item").alias("partner"), F.lit(0).alias("score")))
    )


BROKEN_SQL = """
one AS (SELECT * FROM e WHERE starts_with(item, 'old') AND starts_with(partner, 'red')),
be AS (SELECT * FROM e UNION ALL SELECT * FROM one UNION ALL SELECT item, partner || 's', score FROM one
       UNION ALL SELECT item, item, 0 FROM one),
nm AS (SELECT DISTINCT p_name AS item FROM part),
deg AS (SELECT item, count(*) AS d FROM be GROUP BY 1),
mo AS (SELECT d, count(*) AS lists FROM deg GROUP BY 1),
v AS (SELECT 'duplicate names' AS "check", item AS n FROM nm GROUP BY item HAVING count(*) > 1
      UNION ALL SELECT 'unknown item', item FROM be WHERE item NOT IN (SELECT item FROM nm)
      UNION ALL SELECT 'unknown partner', partner FROM be WHERE partner NOT IN (SELECT item FROM nm)
      UNION ALL SELECT 'self pair', item FROM be WHERE item = partner
      UNION ALL SELECT 'score below 1', item || ' ~ ' || partner FROM be WHERE score < 1
      UNION ALL SELECT 'duplicate partner', item || ' ~ ' || partner FROM be GROUP BY item, partner HAVING count(*) > 1
      UNION ALL SELECT 'asymmetric edge', x.item || ' ~ ' || x.partner FROM be x LEFT JOIN be y
                ON y.item = x.partner AND y.partner = x.item WHERE y.score IS DISTINCT FROM x.score
      UNION ALL SELECT 'partner cap signature', d::VARCHAR FROM mo
                WHERE (lists, d) = (SELECT max((lists, d)) FROM mo) AND d > 10 AND lists > 0.25 * (SELECT count(*) FROM deg)
      UNION ALL SELECT 'item count differs from metadata', count(*)::VARCHAR FROM nm HAVING count(*) <> 60),
ch AS (SELECT unnest(['duplicate names', 'unknown item', 'unknown partner', 'self pair', 'score below 1',
                      'duplicate partner', 'asymmetric edge', 'partner cap signature',
                      'item count differs from metadata']) AS "check")"""
CHECK_SELECT = """
SELECT "check", '{table}' AS "table", count(n) AS violations,
       coalesce(array_to_string(list_sort(list(DISTINCT n) FILTER (WHERE n IS NOT NULL))[1:5], '|'), '') AS sample
FROM ch LEFT JOIN v USING ("check") GROUP BY "check" """


@query("quality_graph", f"WITH {i.ORDER_EDGES_SQL}, {BROKEN_SQL} {CHECK_SELECT.format(table='edges')}")
def quality_graph(spark, sf_dir):
    return _flat(quality.check_graph(i.part_items(spark, sf_dir), broken_graph(spark, sf_dir), meta_count=60))


@query("quality_curation", f"""
WITH RECURSIVE {CHAINS_SQL},{BAD_SQL},
allm AS (SELECT * FROM merged_ UNION ALL SELECT 'ghost ' || item, 'ghost ' || item FROM deleted),
ln AS (SELECT * FROM allm WHERE src <> tgt),
w2 AS (SELECT src, tgt, 1 AS h FROM ln UNION ALL SELECT w2.src, l.tgt, h + 1 FROM w2 JOIN ln l ON l.src = w2.tgt WHERE h < 100),
un AS (SELECT count(*) AS n FROM (SELECT item FROM deleted UNION ALL SELECT src FROM allm) WHERE item NOT IN (SELECT item FROM nm)),
v AS (SELECT 'malformed bad pair' AS "check", array_to_string(names, ',') AS n FROM bp WHERE len(names) <> 2
      UNION ALL SELECT 'self merge', src FROM allm WHERE src = tgt
      UNION ALL SELECT 'duplicate merge source', src FROM allm GROUP BY src HAVING count(DISTINCT tgt) > 1
      UNION ALL SELECT 'merge cycle', src FROM w2 WHERE h = 100
      UNION ALL SELECT 'unknown names over tolerance', n::VARCHAR FROM un WHERE n > 2),
ch AS (SELECT unnest(['malformed bad pair', 'self merge', 'duplicate merge source', 'merge cycle', 'unknown names over tolerance']) AS "check")
{CHECK_SELECT.format(table='curation')}""")
def quality_curation(spark, sf_dir):
    names, merged, deleted, bad = decisions(spark, sf_dir)
    ghosts = deleted.select(F.concat(F.lit("ghost "), "item").alias("src")).withColumn("tgt", F.col("src"))
    return _flat(quality.check_curation(names, deleted, merged.unionByName(ghosts), bad, tolerance=2))


@query("quality_taxonomy", f"""
WITH {i.TAXONOMY_SQL},
bt AS (SELECT item, CASE WHEN category = 'meat' THEN 'metal' ELSE category END AS category,
              CASE item WHEN 'new rod' THEN 'old rod' WHEN 'old rod' THEN 'new rod' ELSE base END AS base FROM tax),
v AS (SELECT 'item without category' AS "check", item AS n FROM nm WHERE item NOT IN (SELECT item FROM bt)
      UNION ALL SELECT 'invalid category', item FROM bt WHERE category = 'metal'
      UNION ALL SELECT 'parent cycle', item FROM bt WHERE item IN ('new rod', 'old rod')),
ch AS (SELECT unnest(['item without category', 'invalid category', 'parent cycle']) AS "check")
{CHECK_SELECT.format(table='taxonomy')}""")
def quality_taxonomy(spark, sf_dir):
    broken = taxonomy(spark, sf_dir).select(
        "item", F.when(F.col("category") == "meat", "metal").otherwise(F.col("category")).alias("category"),
        F.when(F.col("item") == "new rod", "old rod").when(F.col("item") == "old rod", "new rod").otherwise(F.col("base")).alias("base"),
    )
    return _flat(quality.check_taxonomy(i.part_items(spark, sf_dir), broken))


@query("quality_deployed", f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {CHAINS_SQL},{CURATED_SQL},
kept AS (SELECT item FROM mv WHERE item NOT IN (SELECT src FROM res)),
v AS (SELECT 'item without partner' AS "check", item AS n FROM kept WHERE item NOT IN (SELECT item FROM cur)
      UNION ALL SELECT 'item count outside band', count(*)::VARCHAR FROM kept HAVING count(*) NOT BETWEEN 800 AND 2500),
ch AS (SELECT unnest(['item without partner', 'item count outside band']) AS "check")
{CHECK_SELECT.format(table='deployed')}""")
def quality_deployed(spark, sf_dir):
    result = curated(spark, sf_dir)[1]
    return _flat(quality.check_deployed(result.items, result.edges))


SCREENS_SQL = f"""
WITH RECURSIVE {i.ORDER_EDGES_SQL}, {DECISIONS_SQL},
walk AS (SELECT src, tgt, 1 AS h FROM merged_ UNION ALL
         SELECT w.src, m.tgt, h + 1 FROM walk w JOIN merged_ m ON m.src = w.tgt WHERE h < 100),
fin AS (SELECT src, tgt FROM walk WHERE tgt NOT IN (SELECT src FROM merged_)),
deg AS (SELECT item, count(*) AS d FROM e GROUP BY 1),
val AS (SELECT item FROM nm WHERE starts_with(item, 'small') OR starts_with(item, 'old'))
SELECT 'dead_merges' AS screen, src AS name, NULL::BIGINT AS degree FROM merged_ m
WHERE src NOT IN (SELECT src FROM fin) OR (SELECT tgt FROM fin f WHERE f.src = m.src) IN (SELECT item FROM deleted)
   OR (SELECT tgt FROM fin f WHERE f.src = m.src) NOT IN (SELECT item FROM nm)
UNION ALL SELECT 'contradictions', item, NULL FROM (SELECT item FROM val INTERSECT
          (SELECT item FROM deleted UNION SELECT src FROM merged_))
UNION ALL SELECT 'chains', src, NULL FROM merged_ WHERE tgt IN (SELECT src FROM merged_)
UNION ALL (SELECT 'large_deletions', item, d FROM deg WHERE item IN (SELECT item FROM deleted) ORDER BY d DESC, item LIMIT 60)
UNION ALL SELECT 'sparse_items', item, coalesce(d, 0) FROM nm LEFT JOIN deg USING (item) WHERE coalesce(d, 0) <= 3"""


@query("curation_screens", SCREENS_SQL)
def curation_screens(spark, sf_dir):
    names, merged, deleted, _ = decisions(spark, sf_dir)
    validated = names.where(F.col("item").startswith("small") | F.col("item").startswith("old"))
    screens = quality.audit_curation(names, order_edges(spark, sf_dir), deleted, merged, validated)
    rows = None
    for screen, df in screens.items():
        size = F.col("degree") if "degree" in df.columns else F.lit(None)
        part = df.select(F.lit(screen).alias("screen"), F.col(df.columns[0]).alias("name"), size.cast("long").alias("degree"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
