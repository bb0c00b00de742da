"""Media candidates, asset tables and translation work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobasket.functions import media_text as mt
from cobasket.functions.text import slugify
from cobasket.operators import decisions as dec
from cobasket.operators import media as md
from cobasket.plans import inputs as i
from cobasket.plans.registry import query

# Pages stand for candidate files: the site is the item, the page title the file name.
MEDIA_SQL = r"""
me AS (SELECT page_id, regexp_extract(url, '([a-z]+)\.example', 1) AS item, regexp_extract(url, '/(en|fr|de|es)/', 1) AS title,
              regexp_extract(html, '<title>([^<]*)', 1) || CASE length(html) % 3 WHEN 0 THEN ' seeds bowl' WHEN 1 THEN ' tree map' ELSE '' END
                || CASE WHEN contains(url, '?') THEN '.svg' ELSE '.jpg' END AS file,
              CASE length(url) % 4 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'CC BY-NC 2.0' WHEN 2 THEN 'Public domain' ELSE '' END AS license,
              length(html) % 2000 AS width, CASE WHEN starts_with(url, 'https') THEN 'bitmap' ELSE '' END AS mediatype,
              row_number() OVER (PARTITION BY regexp_extract(url, '([a-z]+)\.example', 1) ORDER BY page_id) - 1 AS ord FROM pages)"""
JUNK_RE2 = mt.JUNK_PATTERN.replace("'", "''")
OK_SQL = f"""
ok AS (SELECT * FROM me WHERE NOT regexp_matches(file, '{JUNK_RE2}') AND ends_with(file, '.jpg')
       AND license IN ('CC BY-SA 4.0', 'Public domain') AND width >= 200)"""


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _token_sql(text: str) -> str:
    return f"list_distinct(regexp_split_to_array(lower({text}), '[^a-z0-9]+'))"


SCORE_SQL = f"""
tk AS (SELECT *, {_token_sql('file')} AS t, {_token_sql("item || ' ' || title")} AS w FROM ok),
wt AS (SELECT page_id, count(*) AS hits FROM (SELECT page_id, t, unnest(w) AS x FROM tk)
       WHERE x <> '' AND CASE WHEN length(x) < 3 THEN list_contains(t, x)
             ELSE (SELECT bool_or(y = x OR (length(y) >= 3 AND (starts_with(y, x) OR starts_with(x, y)))) FROM (SELECT unnest(t) AS y)) END
       GROUP BY 1),
sc AS (SELECT tk.*, 3.0::DOUBLE * coalesce(hits, 0) + 1.5::DOUBLE * len(list_intersect(t, {_words(mt.BONUS_WORDS)}))
              - 3.5::DOUBLE * len(list_intersect(t, {_words(mt.PENALTY_WORDS)})) + least(width / 1500.0::DOUBLE, 2.0::DOUBLE)
              - 0.15::DOUBLE * ord - 4.0::DOUBLE * len(list_intersect(t, {_words(mt.HOMONYM_WORDS)})) AS score
       FROM tk LEFT JOIN wt USING (page_id)),
mr AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, ord, file) AS rank FROM sc)"""


def media(spark, sf_dir):
    from pyspark.sql import Window

    # A page's place in its site: what earlier ranges of ids hold, and its place in its own
    # range, so that a large site is never sorted as a whole.
    site, span = F.regexp_extract("url", r"([a-z]+)\.example", 1), F.floor(F.col("page_id") / 1000)
    pages = i.table(spark, sf_dir, "pages").withColumns({"site": site, "span": span})
    earlier = Window.partitionBy("site").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.groupBy("site", "span").count().select("site", "span", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    pages = pages.join(starts, ["site", "span"])
    place = F.row_number().over(Window.partitionBy("site", "span").orderBy("page_id"))
    size = F.length("html")
    name = F.concat(
        F.regexp_extract("html", "<title>([^<]*)", 1),
        F.when(size % 3 == 0, " seeds bowl").when(size % 3 == 1, " tree map").otherwise(""),
        F.when(F.col("url").contains("?"), ".svg").otherwise(".jpg"),
    )
    kind = F.length("url") % 4
    return pages.select(
        "page_id", F.col("site").alias("item"), F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("title"), name.alias("file"),
        F.when(kind == 0, "CC BY-SA 4.0").when(kind == 1, "CC BY-NC 2.0").when(kind == 2, "Public domain").otherwise("").alias("license"),
        (size % 2000).alias("width"), F.when(F.col("url").startswith("https"), "bitmap").otherwise("").alias("mediatype"),
        (F.col("start") + place - 1).cast("int").alias("ord"),
    )


@query("media_filter", f"WITH {MEDIA_SQL}, {OK_SQL} SELECT page_id, item, file, width FROM ok")
def media_filter(spark, sf_dir):
    return md.eligible(media(spark, sf_dir)).select("page_id", "item", "file", "width")


@query("media_rank", f"""
WITH {MEDIA_SQL}, {OK_SQL}, {SCORE_SQL}
SELECT page_id, item, file, round(score, 9) AS score, rank FROM mr WHERE rank <= 12""")
def media_rank(spark, sf_dir):
    ranked = md.rank_media(media(spark, sf_dir), k=12, homonyms=True)
    return ranked.select("page_id", "item", "file", F.round("score", 9).alias("score"), "rank")


@query("rubric_gate", f"""
WITH {MEDIA_SQL},
b AS (SELECT item, arg_max({{'file': file, 'grade': width % 6}}, (width % 6, -ord)) AS b FROM me GROUP BY 1)
SELECT item, CASE WHEN b.grade > 3 THEN b.file END AS file, b.grade AS grade,
       CASE WHEN b.grade > 3 THEN 'take' ELSE 'skip' END AS verdict FROM b""")
def rubric_gate(spark, sf_dir):
    graded = media(spark, sf_dir).select("item", "file", (F.col("width") % 6).alias("grade"), "ord")
    return md.rubric_choice(graded)


# Slugs: part names are live items, customer segments and nouns fill the manifest.
SLUG_SQL = """
lv AS (SELECT DISTINCT p_name || CASE WHEN p_size > 25 THEN '!' ELSE '' END AS item FROM part),
sl AS (SELECT item, trim(regexp_replace(lower(item), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM lv),
mf AS (SELECT DISTINCT lower(c_mktsegment) AS slug FROM customer
       UNION SELECT DISTINCT replace(p_name, ' ', '-') FROM part WHERE p_name < 'n')"""


def live_names(spark, sf_dir):
    mark = F.when(F.col("p_size") > 25, "!").otherwise("")
    return i.parts(spark, sf_dir).select(F.concat("p_name", mark).alias("item")).distinct()


def manifest(spark, sf_dir):
    segments = i.table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("slug"))
    tiles = i.part_items(spark, sf_dir).where(F.col("item") < "n").select(F.replace("item", F.lit(" "), F.lit("-")).alias("slug"))
    return segments.unionByName(tiles).distinct()


COVERAGE_SQL = f"""
WITH {SLUG_SQL}, g AS (SELECT slug, count(*) AS items FROM sl GROUP BY 1),
co AS (SELECT coalesce(g.slug, mf.slug) AS slug, coalesce(items, 0) AS items,
              CASE WHEN items IS NULL THEN 'stale' WHEN mf.slug IS NOT NULL THEN 'covered' ELSE 'missing' END AS status
       FROM g FULL JOIN mf ON mf.slug = g.slug)"""


@query("slug_coverage", f"{COVERAGE_SQL} SELECT * FROM co")
def slug_coverage(spark, sf_dir):
    return md.slug_coverage(live_names(spark, sf_dir), manifest(spark, sf_dir))


@query("slug_summary", f"""{COVERAGE_SQL}
SELECT count(*) FILTER (WHERE status = 'covered') AS covered, count(*) FILTER (WHERE status = 'missing') AS missing,
       count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE items > 1) AS collisions,
       round(count(*) FILTER (WHERE status <> 'missing')::DOUBLE / greatest(count(*) FILTER (WHERE items > 0), 1), 9) AS coverage FROM co""")
def slug_summary(spark, sf_dir):
    per_slug = md.slug_coverage(live_names(spark, sf_dir), manifest(spark, sf_dir))
    return md.coverage_summary(per_slug).withColumn("coverage", F.round("coverage", 9))


OVERRIDE_SQL = """
ov AS (SELECT DISTINCT p_name AS item, CASE WHEN starts_with(p_name, 'hot') THEN upper(p_name) END AS title,
              CASE WHEN starts_with(p_name, 'new') THEN 'File:' || p_name || '.jpg' END AS file,
              starts_with(p_name, 'hot') AND ends_with(p_name, 'd') AS scan, p_name = 'red rod' AS skip FROM part
       WHERE left(p_name, 3) IN ('hot', 'new', 'red'))"""


def overrides(spark, sf_dir):
    name = F.col("item")
    return i.part_items(spark, sf_dir).where(F.left("item", F.lit(3)).isin("hot", "new", "red")).select(
        "item", F.when(name.startswith("hot"), F.upper(name)).alias("title"),
        F.when(name.startswith("new"), F.concat(F.lit("File:"), name, F.lit(".jpg"))).alias("file"),
        (name.startswith("hot") & name.endswith("d")).alias("scan"), (name == "red rod").alias("skip"),
    )


@query("override_routing", f"""
WITH {SLUG_SQL}, {OVERRIDE_SQL},
x AS (SELECT sl.item, sl.slug, title, file, CASE WHEN skip THEN 'skip' WHEN mf.slug IS NOT NULL THEN 'cached'
             WHEN coalesce(file, '') <> '' THEN 'file' WHEN scan THEN 'scan' ELSE 'title' END AS route
      FROM sl LEFT JOIN ov USING (item) LEFT JOIN mf ON mf.slug = sl.slug)
SELECT item, slug, route, CASE WHEN route = 'file' THEN replace(replace(file, 'File:', ''), ' ', '_')
       WHEN route IN ('scan', 'title') THEN coalesce(title, item) END AS target FROM x""")
def override_routing(spark, sf_dir):
    return md.route(live_names(spark, sf_dir), overrides(spark, sf_dir), manifest(spark, sf_dir))


AUDIT_SQL = "au AS (SELECT slug, (length(slug) % 5)::INT AS score FROM mf)"


@query("audit_queue", f"""
WITH {SLUG_SQL}, {AUDIT_SQL}
SELECT item FROM sl WHERE slug IN (SELECT slug FROM au WHERE score <= 2) OR slug NOT IN (SELECT slug FROM au)""")
def audit_queue(spark, sf_dir):
    audit = manifest(spark, sf_dir).select("slug", (F.length("slug") % 5).alias("score"))
    return md.audit_queue(live_names(spark, sf_dir), audit)


ASSET_SQL = f"""
WITH {SLUG_SQL}, {OVERRIDE_SQL},
chg AS (SELECT item, slug, CASE WHEN ends_with(item, 'gear') THEN 'delete' ELSE 'replace' END AS kind FROM sl
        WHERE ends_with(item, 'gear') OR ends_with(item, 'bolt')),
cr AS (SELECT item, item || '.jpg' AS file, 'CC0' AS license, '' AS artist, '' AS description_url FROM ov)"""


def asset_changes(spark, sf_dir):
    names = live_names(spark, sf_dir).where(F.col("item").endswith("gear") | F.col("item").endswith("bolt"))
    changes = names.select(
        "item", slugify(F.col("item")).alias("slug"), F.when(F.col("item").endswith("gear"), "delete").otherwise("replace").alias("kind")
    )
    given = overrides(spark, sf_dir)
    credits = given.select(
        "item", F.concat("item", F.lit(".jpg")).alias("file"), F.lit("CC0").alias("license"), F.lit("").alias("artist"),
        F.lit("").alias("description_url"),
    )
    return dec.apply_asset_changes(changes, manifest(spark, sf_dir), given, credits)


@query("asset_manifest", f"""{ASSET_SQL}
SELECT slug FROM mf WHERE slug NOT IN (SELECT slug FROM chg WHERE kind = 'delete')
UNION SELECT slug FROM chg WHERE kind = 'replace'""")
def asset_manifest(spark, sf_dir):
    return asset_changes(spark, sf_dir)[0]


@query("asset_overrides", f"""{ASSET_SQL}
SELECT * FROM ov WHERE item NOT IN (SELECT item FROM chg) UNION ALL SELECT item, NULL, NULL, NULL, true FROM chg""")
def asset_overrides(spark, sf_dir):
    return asset_changes(spark, sf_dir)[1]


@query("asset_credits", f"""{ASSET_SQL}
SELECT * FROM cr WHERE item NOT IN (SELECT item FROM chg)
UNION ALL SELECT item, 'owner upload', 'provided by owner', '', '' FROM chg WHERE kind = 'replace'""")
def asset_credits(spark, sf_dir):
    return asset_changes(spark, sf_dir)[2]


@query("run_report", f"""
WITH {SLUG_SQL}, {OVERRIDE_SQL}
SELECT item, 'miss' AS kind, 'skipped (override)' AS reason FROM ov WHERE skip
UNION ALL SELECT item, 'flag', 'slug collision: ' || slug FROM sl WHERE slug IN (SELECT slug FROM sl GROUP BY 1 HAVING count(*) > 1)""")
def run_report(spark, sf_dir):
    misses = overrides(spark, sf_dir).where("skip").select("item", F.lit("skipped (override)").alias("reason"))
    names = live_names(spark, sf_dir).select("item", slugify(F.col("item")).alias("slug"))
    twice = names.groupBy("slug").count().where(F.col("count") > 1).select("slug")
    flags = names.join(twice, "slug").select("item", F.concat(F.lit("slug collision: "), "slug").alias("reason"))
    return md.run_report(misses, flags)


@query("translation_delta", f"""
WITH {i.DOC_WORDS_SQL}, w AS (SELECT DISTINCT item AS name FROM dw),
d AS (SELECT DISTINCT upper(lang) AS name FROM documents UNION SELECT DISTINCT item FROM dw JOIN documents ON doc_id = basket_id WHERE lang = 'fr'),
t AS (SELECT name FROM w WHERE name NOT IN (SELECT name FROM d) AND lower(name) NOT IN (SELECT name FROM d))
SELECT name, ((row_number() OVER (ORDER BY name) - 1) // 100)::INT AS batch FROM t""")
def translation_delta(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents")
    names = i.document_words(spark, sf_dir).select(F.col("item").alias("name"))
    french = docs.where(F.col("lang") == "fr").select(F.explode(i.words(F.col("text"))).alias("name")).distinct()
    known = docs.select(F.upper("lang").alias("name")).distinct().unionByName(french)
    return md.missing_translations(names, known)


@query("translation_merge", """
WITH o AS (SELECT DISTINCT p_name AS name, 'old' AS translated FROM part WHERE p_name > 'c'),
n AS (SELECT DISTINCT p_name AS name, 'new' AS translated FROM part WHERE p_name < 'o')
SELECT coalesce(n.name, o.name) AS name, coalesce(n.translated, o.translated) AS translated FROM o FULL JOIN n ON n.name = o.name""")
def translation_merge(spark, sf_dir):
    names = i.part_items(spark, sf_dir).withColumnRenamed("item", "name")
    old = names.where(F.col("name") > "c").withColumn("translated", F.lit("old"))
    new = names.where(F.col("name") < "o").withColumn("translated", F.lit("new"))
    return md.merge_translations(old, new)
