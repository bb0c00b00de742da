"""Classifying items by rules, and linking derived items to a parent.

The rule words are the user's: tables ``(item, category)``, ``(suffix, category)``,
``(keyword, category)`` and ``(item, base)``, and short lists of stopwords and
derivative suffixes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobasket.functions.text import raw_tokens, tokens
from cobasket.operators.resolve import follow_links
from cobasket.params import CATEGORY_PRIORITY
from cobasket.staging import stage


@dataclass
class Rules:
    keywords: DataFrame  # keyword, category
    suffixes: DataFrame  # suffix, category
    overrides: DataFrame  # item, category
    base_overrides: DataFrame  # item, base (null: no parent)
    stopwords: tuple[str, ...] = ()
    derivative_suffixes: tuple[str, ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)  # literal prefix -> category
    priority: tuple[str, ...] = CATEGORY_PRIORITY


def make_rules(spark: SparkSession, keywords=(), suffixes=(), overrides=(), base_overrides=(), **lists) -> Rules:
    """Rules from Python pairs; rule files go through the readers instead."""
    table = lambda rows, cols: spark.createDataFrame(list(rows), cols)
    return Rules(
        table(keywords, "keyword string, category string"),
        table(suffixes, "suffix string, category string"),
        table(overrides, "item string, category string"),
        table(base_overrides, "item string, base string"),
        **lists,
    )


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _stop(token: Column, rules: Rules) -> Column:
    return F.array_contains(_words(rules.stopwords), token)


def _keyword_hits(named: DataFrame, rules: Rules) -> DataFrame:
    """``(item, category)`` votes of single tokens and of multi-word phrases."""
    words = rules.keywords.where(~F.col("keyword").contains(" "))
    voting = (F.size("toks") == 1) | ~_stop(F.col("t.tok"), rules)
    forms = (
        named.select("item", "toks", F.explode(F.arrays_zip(F.col("raw").alias("raw"), F.col("toks").alias("tok"))).alias("t"))
        .where(voting)
        .select("item", F.explode(F.array("t.raw", "t.tok")).alias("keyword"))
    )
    single = forms.join(words, "keyword").select("item", "category")
    # A phrase may start inside a word, so names meet phrases on three letters of
    # the phrase and are then compared in full.
    phrases = rules.keywords.where(F.col("keyword").contains(" ")).withColumn(
        "gram", F.substr(F.col("keyword"), F.lit(1), F.lit(3))
    )
    joined = F.array_join("toks", " ")
    grams = named.select("item", joined.alias("joined")).where(F.length("joined") >= 3).select(
        "item", "joined",
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("joined") - 2), lambda i: F.substr(F.col("joined"), i, F.lit(3))
        ))).alias("gram"),
    )
    multi = grams.join(phrases, "gram").where(F.col("joined").contains(F.col("keyword"))).select("item", "category")
    return single.unionByName(multi)


def classify(items: DataFrame, rules: Rules) -> DataFrame:
    """``items(item)`` -> ``(item, category)``, null where no rule speaks.

    Override, literal prefix, suffix of the last meaningful word, then the keyword
    vote with the best priority.
    """
    named = items.select(
        "item", raw_tokens(F.col("item")).alias("raw"), tokens(F.col("item")).alias("toks")
    )
    last = F.try_element_at(F.filter("toks", lambda t: ~_stop(t, rules)), F.lit(-1))
    prefixed = F.lit(None).cast("string")
    for prefix, category in rules.prefixes.items():
        prefixed = F.coalesce(prefixed, F.when(F.col("item").startswith(prefix), category))
    order = F.array_position(_words(rules.priority), F.col("category"))
    votes = (
        _keyword_hits(named, rules)
        .where(order > 0)
        .groupBy("item")
        .agg(F.min_by("category", order).alias("_vote"))
    )
    return (
        named.withColumn("suffix", last)
        .join(rules.overrides.select("item", F.col("category").alias("_over")), "item", "left")
        .join(
            rules.suffixes.where(F.col("category").isNotNull()).select("suffix", F.col("category").alias("_suffix")),
            "suffix", "left",
        )
        .join(votes, "item", "left")
        .select("item", F.coalesce("_over", prefixed, "_suffix", "_vote").alias("category"))
    )


def find_parents(items: DataFrame, rules: Rules) -> DataFrame:
    """``items(item)`` -> ``(item, base)``: the direct parent or null.

    Names with the same words once modifiers are gone share a key. Only the shortest
    name of a key can be a parent, so one aggregation replaces comparing all names.
    """
    toks = tokens(F.col("item"))
    content = F.array_sort(F.array_distinct(F.filter("toks", lambda t: ~_stop(t, rules))))
    named = items.select("item", toks.alias("toks")).withColumn("key", F.array_join(content, " "))
    size = F.size("toks")
    derived = F.when(
        (size >= 2) & F.array_contains(_words(rules.derivative_suffixes), F.try_element_at("toks", F.lit(-1))),
        F.array_join(F.slice("toks", F.lit(1), F.greatest(size - 1, F.lit(0))), " "),
    )
    exists = items.select(F.col("item").alias("rest"))
    shortest = (
        named.where(F.col("key") != "")
        .groupBy("key")
        .agg(F.min(F.struct(F.length("item").alias("len"), F.col("item").alias("name"))).alias("best"))
    )
    variant = F.when((size >= 2) & (F.col("best.len") < F.length("item")), F.col("best.name"))
    given = rules.base_overrides.select("item", F.col("base").alias("_base"), F.lit(True).alias("_given"))
    return (
        named.withColumn("rest", derived)
        .join(exists.withColumn("_exists", F.lit(True)), "rest", "left")
        .join(shortest, "key", "left")
        .join(given, "item", "left")
        .select(
            "item",
            F.when(F.col("_given"), F.col("_base"))
            .otherwise(
                F.coalesce(
                    F.when(F.col("_exists") & (F.col("rest") != F.col("item")), F.col("rest")), variant
                )
            )
            .alias("base"),
        )
    )


def build_taxonomy(items: DataFrame, rules: Rules) -> DataFrame:
    """``(item, category, base)``: parents resolved to the root, categories inherited."""
    direct = stage(find_parents(items, rules), "parents")
    links = direct.where(F.col("base").isNotNull()).select(F.col("item").alias("src"), F.col("base").alias("dst"))
    roots = follow_links(links).select(F.col("src").alias("item"), F.col("dst").alias("root"))
    # A parent given by an override need not be an item; it is classified all the same.
    names = items.select("item").unionByName(links.select(F.col("dst").alias("item"))).distinct()
    own = stage(classify(names, rules), "categories")
    inherited = own.select(F.col("item").alias("root"), F.col("category").alias("_parent"))
    return (
        items.select("item")
        .join(own, "item", "left")
        .join(roots, "item", "left")
        .join(inherited, "root", "left")
        .select(
            "item",
            F.coalesce("category", "_parent", F.lit("other")).alias("category"),
            F.col("root").alias("base"),
        )
    )


def distribution(taxonomy: DataFrame) -> DataFrame:
    """Items and assigned parents per category."""
    return taxonomy.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), F.count("base").alias("with_parent")
    )


