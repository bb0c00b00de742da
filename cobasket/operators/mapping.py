"""Mapping free-text phrases to canonical items through a staged cascade.

Stages: C1 exact, C2 normalised with singular candidates, C3 sub-phrase, C5 fuzzy.
A phrase stops at its first hit. Distinct phrases are mapped once; only survivors
of a cheap stage reach the next.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobasket.functions import text
from cobasket.functions.localise import REVERSE_PATTERNS
from cobasket.operators.resolve import follow_links
from cobasket.params import DEFAULTS, Params
from cobasket.staging import stage

# Words that never decide a name; peeled before sub-phrases are tried.
QUALIFIERS = (
    "fresh", "dried", "ground", "chopped", "minced", "grated", "sliced",
    "whole", "large", "small", "medium", "ripe", "raw", "cooked", "boneless",
    "skinless", "extra", "virgin", "unsalted", "salted", "organic", "frozen",
    "canned", "crushed", "shredded", "finely", "roughly", "peeled", "smoked",
    "toasted", "roasted", "cold", "warm", "hot", "plain", "pure", "light",
    "dark", "sweet", "sour", "hard", "soft", "lean", "thin", "thick",
    "petit", "petite", "gros", "grosse", "frais", "fraiche", "sec", "seche",
    "hache", "hachee", "emince", "emincee", "rape", "rapee",
)
DETERMINISTIC_STAGES = ("C1", "C2", "C3", "C4")

# Precedence of the sources of variants; a later one wins. The inverted
# translation only fills gaps.
SOURCES = {"translation": 0, "merge": 1, "curation": 2, "alias": 3}


def variant_table(
    merges: DataFrame, curated: DataFrame, aliases: DataFrame, translation: DataFrame
) -> DataFrame:
    """All sources of ``(src, tgt, ord)`` to one row per variant: ``(src, tgt, seq, ord)``.

    ``curated`` chains are followed to their end. ``translation`` holds
    ``(src=translated name, tgt=name)``; its first entry for a name wins. ``seq`` and
    ``ord`` are the place where a variant first appeared.
    """
    ends = follow_links(curated.select("src", F.col("tgt").alias("dst"))).select("src", F.col("dst").alias("_end"))
    chained = curated.join(ends, "src").select("src", F.col("_end").alias("tgt"), "ord")
    parts = [
        ("merge", 1, merges), ("curation", 2, chained), ("alias", 3, aliases),
        ("translation", 4, translation.withColumn("src", F.lower("src"))),
    ]
    rows = None
    for name, seq, df in parts:
        part = df.select(
            "src", "tgt", F.col("ord").cast("long").alias("ord"),
            F.lit(seq).alias("seq"), F.lit(SOURCES[name]).alias("prio"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("src").agg(
        F.max_by("tgt", F.struct(F.col("prio"), -F.col("ord"))).alias("tgt"),
        F.min(F.struct("seq", "ord")).alias("_first"),
    ).select("src", "tgt", "_first.seq", "_first.ord")


def lookup_table(canonical: DataFrame, variants: DataFrame) -> DataFrame:
    """``canonical(item, ord)`` and variants -> ``(kind, key, item)``.

    Kind ``e`` matches the phrase as it stands, kind ``n`` its normalised form. A
    variant counts when it, or its one-hop target, is canonical. Canonical names
    come first in both kinds.
    """
    names = canonical.select("item")
    as_is = variants.join(names.withColumnRenamed("item", "src"), "src", "left_semi").select(
        "src", F.col("src").alias("item"), "seq", "ord"
    )
    hop = (
        variants.join(names.withColumnRenamed("item", "src"), "src", "left_anti")
        .join(names.select(F.col("item").alias("tgt")), "tgt", "left_semi")
        .select("src", F.col("tgt").alias("item"), "seq", "ord")
    )
    known = as_is.unionByName(hop)
    base = canonical.select(F.col("item").alias("src"), "item", F.lit(0).alias("seq"), F.col("ord").cast("long").alias("ord"))
    place = F.struct("seq", "ord")
    normed = (
        base.unionByName(known)
        .groupBy(text.norm(F.col("src")).alias("key"))
        .agg(F.min_by("item", place).alias("item"))
        .select(F.lit("n").alias("kind"), "key", "item")
    )
    # Names that differ only by case: the later variant holds; a canonical name beats both.
    lowered = known.groupBy(F.lower("src").alias("key")).agg(F.max_by("item", place).alias("_v"))
    exact = (
        lowered.join(names.select(F.col("item").alias("key"), F.col("item").alias("_c")), "key", "full_outer")
        .select(F.lit("e").alias("kind"), "key", F.coalesce("_c", "_v").alias("item"))
    )
    return exact.unionByName(normed)


def _probes(key: str, normed: str, rank_prefix: list[Column]) -> Column:
    """Probes of one candidate text: exact, then normalised singular candidates.

    The columns are names: both texts are computed once, in a projection before this one.
    """
    key = F.col(key)
    rank = lambda k: F.array(*rank_prefix, k)
    exact = F.array(F.struct(F.lit("e").alias("kind"), key.alias("key"), rank(F.lit(0)).alias("rank")))
    forms = F.transform(
        text.stems(F.col(normed)),
        lambda s, i: F.struct(F.lit("n").alias("kind"), s.alias("key"), rank(i + 1).alias("rank")),
    )
    return F.concat(exact, forms)


def _first_hits(probed: DataFrame, table: DataFrame) -> DataFrame:
    """``probed(phrase, probe)`` -> ``(phrase, item, rank)`` of the lowest-ranked hit."""
    return (
        probed.select("phrase", "probe.kind", "probe.key", "probe.rank")
        .join(table, ["kind", "key"])
        .groupBy("phrase")
        .agg(F.min(F.struct("rank", "item")).alias("hit"))
        .select("phrase", "hit.item", "hit.rank")
    )


def map_exact(phrases: DataFrame, table: DataFrame) -> DataFrame:
    """C1 and C2: ``(phrase, item, stage)``, item null for survivors."""
    p = text.phrase_key(F.col("phrase"))
    keyed = phrases.select("phrase", p.alias("p")).select("phrase", "p", text.norm(F.col("p")).alias("normed"))
    probed = keyed.select("phrase", F.explode(_probes("p", "normed", [])).alias("probe"))
    hits = _first_hits(probed, table).select(
        "phrase", "item", F.when(F.col("rank")[0] == 0, "C1").otherwise("C2").alias("stage")
    )
    return phrases.join(hits, "phrase", "left")


def map_subphrase(phrases: DataFrame, table: DataFrame, qualifiers=QUALIFIERS) -> DataFrame:
    """C3: contiguous word windows, earliest start first, longest first.

    A window longer than the longest key of the table cannot hit, so the number of
    windows of a phrase grows with its words, not with their square.
    """
    longest = table.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(0))).first()[0]
    words = F.filter(F.split(text.phrase_key(F.col("phrase")), r"[\s,]+"), lambda w: w != "")
    stop = F.array(*[F.lit(q) for q in qualifiers])
    cored = phrases.select("phrase", words.alias("words")).select(
        "phrase", F.filter("words", lambda w: ~F.array_contains(stop, w)).alias("core"), "words"
    ).select("phrase", F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("words")).alias("core"))
    size = F.size("core")
    starts = cored.where(size > 0).select("phrase", "core", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    ends = F.sequence(F.least(size, F.col("s") + int(longest)), F.col("s") + 1, F.lit(-1))
    if longest == 0:
        return phrases.select("phrase", F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("stage"))
    windows = starts.select("phrase", "core", "s", F.explode(ends).alias("e")).select(
        "phrase", "s", "e", F.array_join(F.slice("core", F.col("s") + 1, F.col("e") - F.col("s")), " ").alias("cand")
    )
    windows = windows.withColumn("normed", text.norm(F.col("cand")))
    probed = windows.select("phrase", F.explode(_probes("cand", "normed", [F.col("s"), -F.col("e")])).alias("probe"))
    hits = _first_hits(probed, table).select("phrase", "item", F.lit("C3").alias("stage"))
    return phrases.join(hits, "phrase", "left")


@F.pandas_udf(T.DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of a key and a phrase as the standard library measures it."""
    for keys, phrases in batches:
        yield pd.Series(
            [difflib.SequenceMatcher(None, k, p).ratio() for k, p in zip(keys, phrases)], dtype="float64"
        )


def fuzzy_candidates(phrases: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Pairs that may reach the cutoff: ``(phrase, p, key)``; no reachable pair is missed.

    A ratio r of texts of lengths a and b leaves at most u = (1-r)(a+b) letters
    unmatched. Cut the key in u+1 pieces: one piece has to survive whole, shifted by
    at most u. So pairs meet on (key length, piece number, piece text).
    """
    slack = 1.0 - cutoff
    lb = F.length("key")
    # the largest u of any phrase this key can match
    upper = lambda b: F.floor(slack * b * (1 + (1 + slack) / (1 - slack)) + 1e-9).cast("int")
    pieces = upper(lb) + 1
    begin = lambda b, k, i: F.floor(b * i / k).cast("int")
    indexed = (
        keys.select("key", lb.alias("lb"), pieces.alias("k"))
        .select("key", "lb", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
        .select(
            "key", "lb", "i",
            F.substr(F.col("key"), begin(F.col("lb"), F.col("k"), F.col("i")) + 1,
                     begin(F.col("lb"), F.col("k"), F.col("i") + 1) - begin(F.col("lb"), F.col("k"), F.col("i"))).alias("piece"),
        )
    )
    la = F.length("p")
    lo = F.ceil(la * cutoff / (2 - cutoff) - 1e-9).cast("int")
    hi = F.floor(la * (2 - cutoff) / cutoff + 1e-9).cast("int")
    # Only lengths that some key has: a text far longer than every key takes no part.
    top = int(keys.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0])
    lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, F.lit(top))
    lengths = phrases.where((la > 0) & (lo <= hi)).select("phrase", "p", F.explode(F.sequence(lo, hi)).alias("lb"))
    u = F.floor(slack * (F.length("p") + F.col("lb")) + 1e-9).cast("int")
    k = upper(F.col("lb")) + 1
    cut = lengths.select("phrase", "p", "lb", u.alias("u"), k.alias("k")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")
    ).select(
        "phrase", "p", "lb", "u", "i",
        begin(F.col("lb"), F.col("k"), F.col("i")).alias("at"),
        (begin(F.col("lb"), F.col("k"), F.col("i") + 1) - begin(F.col("lb"), F.col("k"), F.col("i"))).alias("len"),
    )
    first = F.greatest(F.col("at") - F.col("u"), F.lit(0))
    last = F.least(F.col("at") + F.col("u"), F.length("p") - F.col("len"))
    shifted = cut.where(last >= first).select(
        "phrase", "p", "lb", "i", "u", "len", F.explode(F.sequence(first, last)).alias("s")
    ).select("phrase", "p", "lb", "i", "u", F.substr(F.col("p"), F.col("s") + 1, F.col("len")).alias("piece"))
    met = shifted.distinct().join(indexed, ["lb", "i", "piece"])
    # Unmatched letters bound the edit distance, which the JVM checks cheaply.
    return met.where(F.levenshtein("p", "key") <= F.col("u")).select("phrase", "p", "key").distinct()


def map_fuzzy(phrases: DataFrame, table: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """C5: best similarity over the cutoff, ties to the greatest key."""
    p = text.norm(text.phrase_key(F.col("phrase")))
    keys = table.where(F.col("kind") == "n").select("key", "item")
    rated = (
        fuzzy_candidates(phrases.select("phrase", p.alias("p")), keys.select("key"), params.fuzzy_cutoff)
        .withColumn("ratio", _ratio("key", "p"))
        .where(F.col("ratio") >= params.fuzzy_cutoff)
    )
    best = rated.groupBy("phrase").agg(F.max(F.struct("ratio", "key")).alias("hit")).select("phrase", F.col("hit.key").alias("key"))
    hits = best.join(keys, "key").select("phrase", "item", F.lit("C5").alias("stage"))
    return phrases.join(hits, "phrase", "left")


def map_phrases(phrases: DataFrame, table: DataFrame, params: Params = DEFAULTS, qualifiers=QUALIFIERS, fuzzy: bool = True) -> DataFrame:
    """``phrases(phrase)`` -> ``(phrase, item, stage)``, one row per distinct phrase.

    Unmapped phrases keep a null item and the stage ``unmapped``.
    """
    table = stage(table, "lookup")
    done = stage(map_exact(phrases.select("phrase").distinct(), table), "c12")
    open_ = done.where(F.col("item").isNull()).select("phrase")
    third = stage(map_subphrase(open_, table, qualifiers), "c3")
    result = done.where(F.col("item").isNotNull()).unionByName(third.where(F.col("item").isNotNull()))
    last = third.where(F.col("item").isNull())
    if fuzzy:
        last = map_fuzzy(last.select("phrase"), table, params)
    return result.unionByName(last).withColumn("stage", F.coalesce("stage", F.lit("unmapped")))


def map_reversed(phrases: DataFrame, table: DataFrame, canonical: DataFrame) -> DataFrame:
    """Peel a translated pattern, map its base, rebuild the name, accept if canonical.

    ``(phrase, item, stage)`` with stage ``grammar``; the first pattern that ends on
    a canonical name wins.
    """
    p = text.phrase_key(F.col("phrase"))
    tried = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.regexp_extract(p, pattern, 1).alias("base"),
            F.lit(before).alias("before"), F.lit(after).alias("after"),
        )
        for i, (pattern, before, after) in enumerate(REVERSE_PATTERNS)
    ])
    peeled = phrases.select("phrase", F.explode(tried).alias("t")).where(F.col("t.base") != "")
    bases = map_exact(peeled.select(F.col("t.base").alias("phrase")).distinct(), table)
    bases = bases.where(F.col("item").isNotNull()).select(F.col("phrase").alias("base"), F.col("item").alias("mapped"))
    rebuilt = (
        peeled.select("phrase", "t.*")
        .join(bases, "base")
        .select("phrase", "i", F.concat("before", "mapped", "after").alias("item"))
        .join(canonical.select("item"), "item", "left_semi")
        .groupBy("phrase")
        .agg(F.min_by("item", "i").alias("item"))
        .withColumn("stage", F.lit("grammar"))
    )
    return phrases.select("phrase").distinct().join(rebuilt, "phrase", "left")
