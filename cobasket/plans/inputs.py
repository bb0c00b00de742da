"""The standard tables in the roles of the engine: baskets, items, rules, decisions.

Orders are baskets and part names their items; documents are text baskets of words.
A part name is a modifier and a noun: the noun stands for a category, the modifier
for a word the classifier skips. Next to each DataFrame stands the SQL that derives
the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobasket.operators.taxonomy import Rules, make_rules
from cobasket.params import DEFAULTS
from cobasket.staging import stage

NOUN_CATEGORY = {
    "anvil": "meat",
    "bolt": "seafood",
    "gear": "spice",
    "gizmo": "beverage",
    "plate": "alcohol",
    "ring": "fruit",
    "rod": "vegetable",
}  # "widget" has no category on purpose
MODIFIERS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
WORD_SPLIT = r"[^\p{L}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``table``, dealt out by the unique ``key``, for heavy work on each row.

    A row group is read by one task; after this its rows are spread over all tasks, and
    adaptive execution sees to their number.
    """
    return table(spark, sf_dir, name).repartition(F.col(key))


# -- orders and parts -------------------------------------------------------

def parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part")


def order_lines(spark, sf_dir) -> DataFrame:
    """``(basket_id, pos, item)``, one row per line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    names = parts(spark, sf_dir).select("p_partkey", "p_name")
    return lines.join(names, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("basket_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("item")
    )


def order_selections(spark, sf_dir) -> DataFrame:
    """Every order's items as a selection."""
    return order_lines(spark, sf_dir).select(F.col("basket_id").alias("sel_id"), "item").distinct()


def part_items(spark, sf_dir) -> DataFrame:
    """The names of all parts as a staged table: rules and merges read it many times, the parts once."""
    return stage(parts(spark, sf_dir).select(F.col("p_name").alias("item")).distinct(), "part-names")


def rules(spark: SparkSession) -> Rules:
    return make_rules(spark, keywords=NOUN_CATEGORY.items(), stopwords=MODIFIERS)


ORDER_ITEMS_SQL = """
bi AS (SELECT DISTINCT l_orderkey AS basket_id, p_name AS item
       FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SELECTIONS_SQL = "sel AS (SELECT basket_id AS sel_id, item FROM bi)"


def edges_sql(baskets: str = "bi", out: str = "e", p=DEFAULTS, tag: str = "") -> str:
    """CTEs from ``baskets(basket_id, item)`` to ``out(item, partner, score)``."""
    return f"""
{tag}nb AS (SELECT count(DISTINCT basket_id)::DOUBLE AS n FROM {baskets}),
{tag}ic AS (SELECT item, count(*)::DOUBLE AS c FROM {baskets} GROUP BY item HAVING count(*) >= {p.min_item_freq}),
{tag}fi AS (SELECT b.basket_id, b.item FROM {baskets} b JOIN {tag}ic USING (item)),
{tag}pc AS (SELECT x.item AS a, y.item AS b, count(*)::DOUBLE AS n_ab
       FROM {tag}fi x JOIN {tag}fi y ON x.basket_id = y.basket_id AND x.item < y.item
       GROUP BY 1, 2 HAVING count(*) >= {p.min_support}),
{tag}np AS (SELECT a, b, n_ab, CASE WHEN n_ab = n THEN 1.0::DOUBLE
             ELSE least(ln((n_ab / n) / ((i.c / n) * (j.c / n))) / -ln(n_ab / n), 1.0::DOUBLE) END AS npmi
       FROM {tag}pc JOIN {tag}ic i ON i.item = a JOIN {tag}ic j ON j.item = b CROSS JOIN {tag}nb),
{tag}pr AS (SELECT a, b, n_ab::BIGINT AS n_ab, npmi, round_even(npmi * 100, 0)::INT AS score
       FROM {tag}np WHERE npmi >= {p.min_score}::DOUBLE),
{out} AS (SELECT a AS item, b AS partner, score FROM {tag}pr UNION ALL SELECT b, a, score FROM {tag}pr)"""


ORDER_EDGES_SQL = ORDER_ITEMS_SQL + "," + edges_sql()

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOUN_CATEGORY.items())
TAXONOMY_SQL = f"""
nm AS (SELECT DISTINCT p_name AS item FROM part),
par AS (SELECT item, CASE WHEN length(best.name) < length(item) THEN best.name END AS base
        FROM nm JOIN (SELECT split_part(item, ' ', 2) AS noun,
                             min(struct_pack(len := length(item), name := item)) AS best
                      FROM nm GROUP BY 1) k ON k.noun = split_part(item, ' ', 2)),
tax AS (SELECT item, CASE split_part(item, ' ', 2) {_CASE} END AS category, base,
               coalesce(base, item) AS root
        FROM par WHERE split_part(item, ' ', 2) <> 'widget')"""


# -- documents --------------------------------------------------------------

def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD_SPLIT), lambda w: w != "")


def document_words(spark, sf_dir) -> DataFrame:
    """``(basket_id, item)`` over the whole texts, each word of a document once.

    The words of a row are distinct by themselves. Only those of ids that several rows have,
    or that are null, meet in an aggregation: none holds all words of all documents.
    """

    def found(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("basket_id"), F.explode(F.array_distinct(words(F.col("text")))).alias("item"))

    docs = spread(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    ids = table(spark, sf_dir, "documents").groupBy("doc_id").count()
    shared = ids.where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared"))
    if shared.isEmpty():
        return found(docs)
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    return found(docs.join(shared, same, "left_anti")).unionByName(found(docs.join(shared, same, "left_semi")).distinct())


DOC_WORDS_SQL = r"""
dw AS (SELECT DISTINCT doc_id AS basket_id, w AS item
       FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents)
       WHERE w <> '')"""
