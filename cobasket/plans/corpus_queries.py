"""Text rules, phrase mapping, basket corpus, taxonomy and names in another language."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobasket.functions import lines as ln
from cobasket.functions import localise, text
from cobasket.operators import baskets as b
from cobasket.operators import mapping as m
from cobasket.operators import match, quality
from cobasket.operators import taxonomy as tx
from cobasket.plans import inputs as i
from cobasket.plans.curation_queries import CHECK_SELECT, DECISIONS_SQL, _flat, decisions
from cobasket.plans.rank_queries import taxonomy
from cobasket.plans.registry import query
from cobasket.sources import readers, writers
from cobasket.staging import stage

# -- text rules -----------------------------------------------------------------


@query("word_forms", f"""
WITH {i.DOC_WORDS_SQL}, w AS (SELECT DISTINCT item AS word FROM dw),
n AS (SELECT word, strip_accents(word) AS norm FROM w)
SELECT word, norm,
  concat_ws('|', norm,
    CASE WHEN ends_with(norm, 'ies') AND length(norm) > 4 THEN norm[:-4] || 'y' END,
    CASE WHEN ends_with(norm, 'aux') AND length(norm) > 4 THEN norm[:-4] || 'al' END,
    CASE WHEN ends_with(norm, 'x') AND length(norm) > 3 THEN norm[:-2] END,
    CASE WHEN ends_with(norm, 'es') AND length(norm) > 4 THEN norm[:-3] END,
    CASE WHEN ends_with(norm, 's') AND length(norm) > 3 THEN norm[:-2] END) AS stems,
  CASE WHEN length(word) < 4 THEN word WHEN ends_with(word, 'ies') THEN word[:-4] || 'y'
       WHEN ends_with(word, 'oes') THEN word[:-3] WHEN regexp_matches(word, '(ss|us|is)$') THEN word
       WHEN ends_with(word, 's') THEN word[:-2] ELSE word END AS singular
FROM n""")
def word_forms(spark, sf_dir):
    words = i.document_words(spark, sf_dir).select(F.col("item").alias("word")).distinct()
    return words.withColumn("norm", text.norm(F.col("word"))).select(
        "word", "norm", F.array_join(text.stems(F.col("norm")), "|").alias("stems"),
        text.singular(F.col("word")).alias("singular"),
    )


@query("page_text", r"""
SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ') AS body,
       CASE WHEN trim(bare) = '' THEN '' WHEN starts_with(trim(bare), 'http') THEN trim(bare) ELSE 'https://' || trim(bare) END AS url,
       trim(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM (SELECT *, replace(url, 'https://', ' ') AS bare FROM pages)""")
def page_text(spark, sf_dir):
    bare = F.replace("url", F.lit("https://"), F.lit(" "))
    return i.table(spark, sf_dir, "pages").select(
        "page_id", text.strip_tags(F.col("html")).alias("body"), ln.normalise_url(bare).alias("url"),
        text.slugify(F.col("url")).alias("slug"),
    )


@query("parse_lines", "SELECT DISTINCT l_linenumber AS form, p_name, p_name AS phrase FROM lineitem JOIN part ON l_partkey = p_partkey")
def parse_lines(spark, sf_dir):
    """Line items dressed in quantities, measures, partitives and preparations."""
    rows = i.order_lines(spark, sf_dir).select(F.col("pos").alias("form"), F.col("item").alias("p_name")).distinct()
    dressed = [
        ("12,5 g de ", ""), ("2 cuillères à soupe de ", ""), ("1/2 Sachet d'", ""), ("3 ", ", coupé en dés"),
        ("", " haché fin"), ("de la ", " selon goût"), ("10 kg ", " ."),
    ]
    line = F.col("p_name")
    for form, (before, after) in enumerate(dressed, 1):
        line = F.when(F.col("form") == form, F.concat(F.lit(before), "p_name", F.lit(after))).otherwise(line)
    return rows.select("form", "p_name", ln.parse_line(line).alias("phrase"))


@query("list_cells", """
SELECT doc_id, source || ',' || lang || ',' || n_chars AS joined FROM documents""")
def list_cells(spark, sf_dir):
    """Lists in a cell in each of the accepted forms."""
    docs = i.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("string").alias("n"))
    cell = (
        F.when(F.col("lang") == "en", F.concat(F.lit('["'), F.concat_ws('", "', "source", "lang", "n"), F.lit('"]')))
        .when(F.col("lang") == "fr", F.concat_ws(";", "source", "lang", "n"))
        .otherwise(F.concat_ws("|\n", "source", "lang", "n"))
    )
    return docs.select("doc_id", F.array_join(ln.cell_to_lines(cell), ",").alias("joined"))


@query("long_records", """
WITH h AS (SELECT conv_id::VARCHAR AS basket_id, arg_min(trim(role), turn) AS title FROM conversations GROUP BY 1)
SELECT basket_id, title, 'https://' || basket_id AS url, count(*) AS lines, sum(length(text))::BIGINT AS chars
FROM h JOIN conversations ON conv_id::VARCHAR = basket_id GROUP BY 1, 2""")
def long_records(spark, sf_dir):
    rows = i.table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("ord"), F.col("conv_id").cast("string").alias("url"), F.trim("role").alias("title"),
        F.col("text").alias("line"),
    )
    heads, lines = readers.split_lines(rows)
    sizes = lines.groupBy("basket_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))
    return heads.join(sizes, "basket_id").select("basket_id", "title", "url", "lines", "chars")


# -- phrase mapping: half of the part names are canonical, the rest are variants ----
# Form 1 exact, 2 upper case, 3 plural, 4 and 5 with words around, 6 accents, 7 a typo.

CANONICAL_MODIFIERS = ("blue", "red", "large", "new")
PHRASE_SQL = """
ph AS (SELECT l_orderkey AS basket_id, l_linenumber AS pos, p_name AS nm, split_part(p_name, ' ', 1) AS m,
              split_part(p_name, ' ', 2) AS w,
              CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN p_name || 's'
                WHEN 4 THEN 'fresh ' || p_name || ' chopped' WHEN 5 THEN p_name || ', sliced'
                WHEN 6 THEN replace(p_name, 'e', 'é') ELSE p_name || right(p_name, 1) END AS phrase
       FROM lineitem JOIN part ON l_partkey = p_partkey),
mp AS (SELECT *, CASE m WHEN 'cold' THEN 'blue ' || w WHEN 'hot' THEN 'red ' || w WHEN 'old' THEN 'new ' || w
                   WHEN 'small' THEN NULL ELSE nm END AS target FROM ph),
ma AS (SELECT *, CASE WHEN target IS NULL THEN 'unmapped' WHEN pos IN (1, 2) OR (pos = 6 AND phrase = nm) THEN 'C1'
                   WHEN pos IN (3, 6) THEN 'C2' WHEN pos = 7 THEN 'C5'
                   WHEN m IN ('blue', 'red', 'new', 'old') THEN 'C3' ELSE 'unmapped' END AS stage FROM mp),
oc AS (SELECT basket_id, pos, phrase, stage, CASE WHEN stage <> 'unmapped' THEN target END AS item FROM ma)"""


def phrase_lines(spark, sf_dir):
    rows = i.order_lines(spark, sf_dir)
    name, form = F.col("item"), F.col("pos")
    phrase = (
        F.when(form == 1, name).when(form == 2, F.upper(name)).when(form == 3, F.concat(name, F.lit("s")))
        .when(form == 4, F.concat(F.lit("fresh "), name, F.lit(" chopped")))
        .when(form == 5, F.concat(name, F.lit(", sliced")))
        .when(form == 6, F.replace(name, F.lit("e"), F.lit("é")))
        .otherwise(F.concat(name, F.right(name, F.lit(1))))
    )
    return rows.select("basket_id", "pos", phrase.alias("phrase"))


def lookup(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    modifier, noun = F.substring_index("item", " ", 1), F.substring_index("item", " ", -1)
    numbered = F.xxhash64("item").alias("ord")
    canonical = names.where(modifier.isin(*CANONICAL_MODIFIERS)).select("item", numbered)
    move = lambda word, to: names.where(modifier == word).select(
        F.col("item").alias("src"), F.concat(F.lit(to + " "), noun).alias("tgt"), numbered
    )
    none = move("cold", "blue").limit(0)
    variants = m.variant_table(move("cold", "blue"), move("hot", "red"), move("old", "new"), none)
    return canonical, m.lookup_table(canonical, variants)


def mapped(spark, sf_dir):
    lines = stage(phrase_lines(spark, sf_dir), "lines")
    mapping = m.map_phrases(lines.select("phrase"), lookup(spark, sf_dir)[1])
    return b.map_occurrences(lines, mapping)


@query("phrase_cascade", f"WITH {PHRASE_SQL} SELECT DISTINCT phrase, item, stage FROM oc")
def phrase_cascade(spark, sf_dir):
    phrases = phrase_lines(spark, sf_dir).select("phrase")
    return m.map_phrases(phrases, lookup(spark, sf_dir)[1]).select("phrase", "item", "stage")


@query("stage_counts", f"WITH {PHRASE_SQL} SELECT stage, count(*) AS occurrences FROM oc GROUP BY 1")
def stage_counts(spark, sf_dir):
    return b.stage_counts(mapped(spark, sf_dir))


@query("mapping_report", f"""
WITH {PHRASE_SQL}, r AS (SELECT count(*) AS total, count(item) AS mapped,
  count(*) FILTER (WHERE stage IN ('C1', 'C2', 'C3')) AS deterministic FROM oc)
SELECT *, round(mapped / total, 9) AS mapped_share, round(deterministic / total, 9) AS deterministic_share,
       deterministic / total >= 0.9 AS passes FROM r""")
def mapping_report(spark, sf_dir):
    return b.mapping_report(mapped(spark, sf_dir)).withColumns(
        {c: F.round(c, 9) for c in ("mapped_share", "deterministic_share")}
    )


@query("reverse_grammar", """
WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part)
SELECT 'huile de ' || w || 's' AS phrase, w || ' oil' AS item, 'grammar' AS stage FROM n
UNION ALL SELECT w || ' rouge', 'red ' || w, 'grammar' FROM n
UNION ALL SELECT w || ' en poudre', NULL, NULL FROM n""")
def reverse_grammar(spark, sf_dir):
    nouns = i.part_items(spark, sf_dir).select(F.substring_index("item", " ", -1).alias("w")).distinct()
    names = nouns.select(F.explode(F.array(F.col("w"), F.concat("w", F.lit(" oil")), F.concat(F.lit("red "), "w"))).alias("item"))
    canonical = names.withColumn("ord", F.xxhash64("item"))
    phrases = nouns.select(F.explode(F.array(
        F.concat(F.lit("huile de "), "w", F.lit("s")), F.concat("w", F.lit(" rouge")), F.concat("w", F.lit(" en poudre"))
    )).alias("phrase"))
    pairs = names.select(F.col("item").alias("src"), F.col("item").alias("tgt"), F.lit(0).alias("ord"))
    table = m.lookup_table(canonical, m.variant_table(pairs.limit(0), pairs.limit(0), pairs.limit(0), pairs.limit(0)))
    return m.map_reversed(phrases, stage(table, "lookup"), canonical).select("phrase", "item", "stage")


# -- basket corpus ------------------------------------------------------------------

ADMIT_SQL = f"""{PHRASE_SQL},
hd AS (SELECT o_orderkey AS basket_id, o_orderpriority AS title,
              CASE o_orderstatus WHEN 'F' THEN 'fr' WHEN 'O' THEN 'en' ELSE 'de' END AS lang FROM orders),
sz AS (SELECT basket_id, count(DISTINCT item) AS k, count(*) AS total FROM oc GROUP BY 1),
it AS (SELECT basket_id, item, min(pos) AS pos FROM oc WHERE item IS NOT NULL GROUP BY 1, 2),
ad AS (SELECT basket_id, title, lang, string_agg(item, '|' ORDER BY pos, item) AS items,
              string_agg(item, '|' ORDER BY item) AS item_set, count(*) AS size
       FROM it JOIN sz USING (basket_id) JOIN hd USING (basket_id)
       WHERE k BETWEEN 3 AND 20 AND k / total >= 0.6 AND lang IN ('en', 'fr') GROUP BY 1, 2, 3),
dd AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY lang, lower(title), item_set ORDER BY basket_id) = 1),
pi AS (SELECT basket_id, item, pos, size FROM dd JOIN it USING (basket_id))"""


def order_heads(spark, sf_dir):
    status = F.col("o_orderstatus")
    return i.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("basket_id"), F.col("o_orderpriority").alias("title"),
        F.when(status == "F", "fr").when(status == "O", "en").otherwise("de").alias("lang"),
        F.concat(F.lit("https://orders/"), "o_orderkey").alias("url"), F.col("o_orderkey").alias("src_ord"),
    )


def corpus(spark, sf_dir):
    return stage(b.dedupe(b.admit(order_heads(spark, sf_dir), mapped(spark, sf_dir))), "corpus")


def _joined(df):
    return df.withColumn("items", F.array_join("items", "|"))


@query("basket_admission", f"WITH {ADMIT_SQL} SELECT basket_id, title, lang, items FROM ad")
def basket_admission(spark, sf_dir):
    return _joined(b.admit(order_heads(spark, sf_dir), mapped(spark, sf_dir))).select("basket_id", "title", "lang", "items")


@query("basket_dedupe", f"WITH {ADMIT_SQL} SELECT basket_id, title, lang, items FROM dd")
def basket_dedupe(spark, sf_dir):
    return _joined(corpus(spark, sf_dir)).select("basket_id", "title", "lang", "items")


@query("coverage_budget", f"""
WITH {ADMIT_SQL},
rk AS (SELECT basket_id, row_number() OVER (PARTITION BY item ORDER BY size DESC, basket_id) AS r FROM pi),
cv AS (SELECT DISTINCT basket_id FROM rk WHERE r <= 6)
SELECT basket_id, items, basket_id IN (SELECT basket_id FROM cv) AS coverage_pick FROM dd
ORDER BY coverage_pick DESC, size DESC, basket_id LIMIT 400""")
def coverage_budget(spark, sf_dir):
    return _joined(b.budget(corpus(spark, sf_dir), 400)).select("basket_id", "items", "coverage_pick")


@query("vocab_encode", f"""
WITH {ADMIT_SQL}, fa AS (SELECT item, min((basket_id, pos, item)) AS f FROM pi GROUP BY 1)
SELECT item, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS local_id FROM fa""")
def vocab_encode(spark, sf_dir):
    return b.encode(corpus(spark, sf_dir))[0]


@query("encoded_baskets", f"""
WITH {ADMIT_SQL}, fa AS (SELECT item, min((basket_id, pos, item)) AS f FROM pi GROUP BY 1),
vo AS (SELECT item, (row_number() OVER (ORDER BY f) - 1)::INT AS local_id FROM fa)
SELECT basket_id AS src_ord, title, lang, string_agg(local_id::VARCHAR, ',' ORDER BY pos, item) AS ids
FROM dd JOIN pi USING (basket_id) JOIN vo USING (item) GROUP BY 1, 2, 3""")
def encoded_baskets(spark, sf_dir):
    _, rows = writers.encoded_rows(corpus(spark, sf_dir))
    return rows.select("src_ord", "title", "lang", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("corpus_manifest", f"""
WITH {ADMIT_SQL}
SELECT 'orders' AS source, count(*) AS recipes, count(*) FILTER (WHERE lang = 'en') AS en,
       count(*) FILTER (WHERE lang = 'fr') AS fr, (SELECT count(DISTINCT item) FROM pi) AS vocabulary FROM dd""")
def corpus_manifest(spark, sf_dir):
    return writers.manifest(corpus(spark, sf_dir), "orders")


@query("corpus_sample", f"WITH {ADMIT_SQL} SELECT basket_id, items FROM dd ORDER BY basket_id LIMIT 40")
def corpus_sample(spark, sf_dir):
    return _joined(writers.sample(corpus(spark, sf_dir))).select("basket_id", "items")


@query("language_counts", f"""
WITH {ADMIT_SQL} SELECT lang, count(*) AS baskets FROM dd GROUP BY ROLLUP (lang)""")
def language_counts(spark, sf_dir):
    return b.counts_by(corpus(spark, sf_dir))


@query("usable_baskets", f"""
WITH {DECISIONS_SQL}
SELECT l_orderkey AS basket_id, p_name AS item, min(l_linenumber) AS pos
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type <> 'PROMO' AND p_name NOT IN (SELECT item FROM deleted) GROUP BY 1, 2""")
def usable_baskets(spark, sf_dir):
    refs = i.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("local_id")
    )
    names, _, deleted, _ = decisions(spark, sf_dir)
    return match.usable_baskets(refs, _vocabulary(spark, sf_dir), names.join(deleted, "item", "left_anti")).select(
        "basket_id", "item", "pos"
    )


def _vocabulary(spark, sf_dir):
    known = i.parts(spark, sf_dir).where(F.col("p_type") != "PROMO")
    return known.select(F.col("p_partkey").alias("local_id"), F.col("p_name").alias("item"))


@query("quality_baskets", f"""
WITH {DECISIONS_SQL},
ba AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS title,
              CASE o_orderstatus WHEN 'F' THEN 'fr' WHEN 'O' THEN 'en' ELSE 'de' END AS lang,
              CASE WHEN o_totalprice > 400000 THEN '' ELSE 'u' END AS url FROM orders),
rf AS (SELECT l_orderkey AS id, l_partkey AS local_id FROM lineitem),
vo AS (SELECT p_partkey AS local_id, p_name AS item FROM part WHERE p_type <> 'PROMO'),
st AS (SELECT id, list_sort(list(DISTINCT local_id)) AS l FROM rf GROUP BY 1),
v AS (SELECT 'vocabulary name not live' AS "check", item AS n FROM vo WHERE item IN (SELECT item FROM deleted)
      UNION ALL SELECT 'empty title', id::VARCHAR FROM ba WHERE trim(title) = ''
      UNION ALL SELECT 'unknown language', id::VARCHAR FROM ba WHERE lang = 'de'
      UNION ALL SELECT 'empty url', id::VARCHAR FROM ba WHERE url = ''
      UNION ALL SELECT 'no items', id::VARCHAR FROM ba WHERE id NOT IN (SELECT id FROM rf)
      UNION ALL SELECT 'index out of range', id::VARCHAR FROM rf WHERE local_id NOT IN (SELECT local_id FROM vo)
      UNION ALL SELECT 'duplicate index', id::VARCHAR FROM rf GROUP BY id, local_id HAVING count(*) > 1
      UNION ALL SELECT 'duplicate basket', id::VARCHAR FROM (SELECT id, row_number() OVER
                (PARTITION BY lang, trim(lower(title)), l ORDER BY id) AS r FROM ba JOIN st USING (id)) WHERE r > 1),
ch AS (SELECT unnest(['vocabulary name not live', 'empty title', 'unknown language', 'empty url', 'no items',
                      'index out of range', 'duplicate index', 'duplicate basket']) AS "check")
{CHECK_SELECT.format(table='baskets')}""")
def quality_baskets(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders")
    heads = order_heads(spark, sf_dir).drop("url").join(
        orders.select(F.col("o_orderkey").alias("basket_id"), F.when(F.col("o_totalprice") > 400000, "").otherwise("u").alias("url")),
        "basket_id",
    ).withColumn("title", F.when(F.col("title") == "5-LOW", " ").otherwise(F.col("title")))
    refs = i.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("local_id")
    )
    names, _, deleted, _ = decisions(spark, sf_dir)
    live = names.join(deleted, "item", "left_anti")
    return _flat(quality.check_baskets(heads, refs, _vocabulary(spark, sf_dir), live))


# -- taxonomy -----------------------------------------------------------------------

NAMES_SQL = """
n0 AS (SELECT DISTINCT p_name AS nm, split_part(p_name, ' ', 1) AS m, split_part(p_name, ' ', 2) AS w FROM part),
tn AS (SELECT nm AS item, 'plain' AS kind, w FROM n0
       UNION SELECT nm || 's', 'plural', w FROM n0
       UNION SELECT nm || ' oil', 'oil', w FROM n0
       UNION SELECT 'creme de ' || w, 'creme', w FROM n0
       UNION SELECT w || ' star anise pod', 'anise', w FROM n0
       UNION SELECT 'xx ' || m, 'none', w FROM n0)"""
_CAT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in i.NOUN_CATEGORY.items())
CLASS_SQL = f"""{NAMES_SQL},
cl AS (SELECT DISTINCT item, kind, CASE WHEN item = 'hot rod' THEN 'dairy' WHEN kind = 'creme' THEN 'alcohol'
         WHEN kind = 'oil' THEN 'fat'
         WHEN kind = 'anise' THEN (CASE WHEN w IN ('anvil', 'bolt') THEN CASE w WHEN 'anvil' THEN 'meat' ELSE 'seafood' END ELSE 'spice' END)
         WHEN kind = 'none' THEN NULL ELSE CASE w {_CAT} END END AS category
       FROM (SELECT item, kind, CASE WHEN kind = 'none' THEN '' ELSE w END AS w FROM tn))"""
# Names of one noun share a key; the plain name of three letters and first in order is the shortest.
PARENT_SQL = f"""{CLASS_SQL},
ky AS (SELECT item, kind, CASE WHEN kind IN ('plain', 'plural') THEN rtrim(split_part(item, ' ', 2), 's')
         WHEN kind = 'oil' THEN split_part(item, ' ', 2) || ' oil' WHEN kind = 'none' THEN 'xx' ELSE item END AS k FROM cl),
sh AS (SELECT k, min((length(item), item)) AS best FROM ky GROUP BY 1),
pa AS (SELECT item, CASE WHEN item = 'old rod' THEN NULL WHEN item = 'new gear' THEN 'blue gear'
         WHEN kind = 'oil' THEN replace(item, ' oil', '')
         WHEN kind IN ('plain', 'plural', 'none') AND best[1] < length(item) THEN best[2] END AS base
       FROM ky JOIN sh USING (k))"""


def taxonomy_names(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    m_, w = F.substring_index("item", " ", 1), F.substring_index("item", " ", -1)
    forms = F.array(
        F.col("item"), F.concat("item", F.lit("s")), F.concat("item", F.lit(" oil")),
        F.concat(F.lit("creme de "), w), F.concat(w, F.lit(" star anise pod")), F.concat(F.lit("xx "), m_),
    )
    return names.select(F.explode(forms).alias("item")).distinct()


def taxonomy_rules(spark):
    return tx.make_rules(
        spark,
        keywords=[*i.NOUN_CATEGORY.items(), ("star anise", "spice")],
        suffixes=[("oil", "fat"), ("ring", None)],
        overrides=[("hot rod", "dairy")],
        base_overrides=[("old rod", None), ("new gear", "blue gear")],
        stopwords=i.MODIFIERS, derivative_suffixes=("oil",), prefixes={"creme de ": "alcohol", "creme d": "alcohol"},
    )


@query("taxonomy_classify", f"WITH {CLASS_SQL} SELECT item, category FROM cl")
def taxonomy_classify(spark, sf_dir):
    return tx.classify(taxonomy_names(spark, sf_dir), taxonomy_rules(spark))


@query("taxonomy_parent", f"WITH {PARENT_SQL} SELECT item, base FROM pa")
def taxonomy_parent(spark, sf_dir):
    return tx.find_parents(taxonomy_names(spark, sf_dir), taxonomy_rules(spark))


FULL_SQL = f"""
WITH RECURSIVE {PARENT_SQL},
walk AS (SELECT item, base, 1 AS h FROM pa WHERE base IS NOT NULL UNION ALL
         SELECT w.item, p.base, h + 1 FROM walk w JOIN pa p ON p.item = w.base WHERE p.base IS NOT NULL AND h < 50),
rt AS (SELECT item, arg_max(base, h) AS base FROM walk GROUP BY 1),
full_ AS (SELECT c.item, coalesce(c.category, p.category, 'other') AS category, r.base
          FROM cl c LEFT JOIN rt r ON r.item = c.item LEFT JOIN cl p ON p.item = r.base)"""


@query("taxonomy_full", f"{FULL_SQL} SELECT * FROM full_")
def taxonomy_full(spark, sf_dir):
    return tx.build_taxonomy(taxonomy_names(spark, sf_dir), taxonomy_rules(spark))


@query("taxonomy_distribution", f"{FULL_SQL} SELECT category, count(*) AS items, count(base) AS with_parent FROM full_ GROUP BY 1")
def taxonomy_distribution(spark, sf_dir):
    return tx.distribution(tx.build_taxonomy(taxonomy_names(spark, sf_dir), taxonomy_rules(spark)))


@query("category_lookup", f"""
WITH {i.TAXONOMY_SQL} SELECT nm.item, coalesce(category, 'other') AS category FROM nm LEFT JOIN tax USING (item)""")
def category_lookup(spark, sf_dir):
    known = taxonomy(spark, sf_dir).select("item", "category")
    return i.part_items(spark, sf_dir).join(known, "item", "left").select("item", F.coalesce("category", F.lit("other")).alias("category"))


# -- names in another language -------------------------------------------------------


@query("localise_names", """
WITH n0 AS (SELECT DISTINCT p_name AS nm, split_part(p_name, ' ', 1) AS m, split_part(p_name, ' ', 2) AS w FROM part),
tr AS (SELECT *, CASE WHEN w <> 'anvil' THEN 'x' || w END AS t FROM n0),
r AS (SELECT nm AS name, CASE WHEN t IS NULL OR m IN ('blue', 'new', 'old') THEN nm ELSE t || ' ' ||
        CASE m WHEN 'red' THEN 'rouge' WHEN 'cold' THEN 'froid' WHEN 'hot' THEN 'chaud' WHEN 'large' THEN 'grand'
               WHEN 'small' THEN 'petit' END END AS localised FROM tr
      UNION SELECT w || 's', coalesce(t, w || 's') FROM tr
      UNION SELECT upper(w), coalesce(t, upper(w)) FROM tr
      UNION SELECT w || ' oil', CASE WHEN t IS NULL THEN 'huile d''' || w ELSE 'huile de ' || t END FROM tr
      UNION SELECT w || ' powder', coalesce(t, w) || ' en poudre' FROM tr
      UNION SELECT w || ' sauce', 'sauce ' || coalesce(t, w) FROM tr)
SELECT * FROM r""")
def localise_names(spark, sf_dir):
    names = i.part_items(spark, sf_dir)
    w = F.substring_index("item", " ", -1)
    forms = F.array(
        F.col("item"), F.concat(w, F.lit("s")), F.upper(w), F.concat(w, F.lit(" oil")),
        F.concat(w, F.lit(" powder")), F.concat(w, F.lit(" sauce")),
    )
    nouns = names.select(w.alias("name")).distinct().where(F.col("name") != "anvil")
    dictionary = nouns.select("name", F.concat(F.lit("x"), "name").alias("translated"))
    return localise.localise(names.select(F.explode(forms).alias("name")), dictionary)


@query("variant_table", """
WITH v AS (SELECT lower(p_type) AS src, 'm' || p_partkey AS tgt, p_partkey AS ord, 1 AS seq, 1 AS prio FROM part WHERE p_size <= 10
           UNION ALL SELECT 'c' || p_partkey, 'c' || least(p_partkey - p_partkey % 5 + 4, 1 + (SELECT max(p_partkey) FROM part)), p_partkey, 2, 2 FROM part WHERE p_partkey % 5 <> 4
           UNION ALL SELECT lower(p_type), 'a' || p_partkey, p_partkey, 3, 3 FROM part WHERE p_size BETWEEN 20 AND 22
           UNION ALL SELECT lower(p_type), 't' || p_partkey, p_partkey, 4, 0 FROM part)
SELECT src, arg_max(tgt, struct_pack(prio, o := -ord)) AS tgt, min(struct_pack(seq, ord)).seq AS seq, min(struct_pack(seq, ord)).ord AS ord FROM v GROUP BY src""")
def variant_table(spark, sf_dir):
    """Variants from all four sources: merges, curation chains, aliases, and an inverted translation that fills the gaps."""
    parts = i.parts(spark, sf_dir).select("p_partkey", "p_type", "p_size")
    key = F.col("p_partkey")

    def source(rows, src, letter, number=key):
        return rows.select(src.alias("src"), F.concat(F.lit(letter), number).alias("tgt"), key.alias("ord"))

    kind = F.lower("p_type")
    return m.variant_table(
        source(parts.where("p_size <= 10"), kind, "m"), source(parts.where("p_partkey % 5 <> 4"), F.concat(F.lit("c"), key), "c", key + 1),
        source(parts.where("p_size BETWEEN 20 AND 22"), kind, "a"), source(parts, F.upper("p_type"), "t"),
    )
