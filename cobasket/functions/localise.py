"""Names in another language, by a dictionary and a small modifier grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.functions.display import lookup

# ---------------------------------------------------------------------------
# French modifiers, colours and suffix patterns.
# ---------------------------------------------------------------------------
PREFIXES = {
    "fresh": "frais", "freshly": "fraîchement moulu",
    "ground": "moulu", "dried": "séché", "frozen": "surgelé",
    "minced": "émincé", "chopped": "haché", "sliced": "en tranches",
    "shredded": "râpé", "grated": "râpé", "whole": "entier",
    "cooked": "cuit", "raw": "cru", "canned": "en conserve",
    "cold": "froid", "warm": "chaud", "hot": "chaud",
    "unsalted": "non salé", "salted": "salé", "lean": "maigre",
    "smoked": "fumé", "pickled": "mariné", "roasted": "rôti",
    "toasted": "grillé", "candied": "confit", "grilled": "grillé",
    "blanched": "blanchi", "marinated": "mariné", "organic": "bio",
    "wild": "sauvage", "baby": "jeune", "large": "grand", "small": "petit",
    "sweet": "doux", "sour": "aigre", "spicy": "épicé", "mild": "doux",
    "extra": "extra", "reduced": "réduit", "instant": "instantané",
    "powdered": "en poudre", "crushed": "écrasé", "peeled": "pelé",
    "pitted": "dénoyauté", "halved": "coupé en deux", "softened": "ramolli",
    "melted": "fondu", "room": "température ambiante",
}
COLOURS = {
    "red": "rouge", "green": "vert", "black": "noir", "white": "blanc",
    "yellow": "jaune", "golden": "doré", "purple": "violet",
    "orange": "orange", "brown": "brun", "pink": "rose", "dark": "foncé",
    "light": "léger",
}
# Last word -> what goes before the base; "de" becomes "d'" before a vowel.
HEADS_DE = {
    "oil": "huile", "juice": "jus", "seeds": "graines", "seed": "graines",
    "leaves": "feuilles", "leaf": "feuille", "extract": "extrait",
    "flour": "farine", "vinegar": "vinaigre", "milk": "lait", "syrup": "sirop",
    "paste": "pâte", "butter": "beurre", "cream": "crème", "broth": "bouillon",
    "stock": "bouillon", "starch": "fécule", "flakes": "flocons",
}
HEADS_PLAIN = {"sauce": "sauce ", "chips": "chips de ", "spread": "tartinade de "}
TAILS = {"powder": " en poudre"}


def _reverse_patterns() -> list[tuple[str, str, str]]:
    """The same grammar read backwards: (pattern with the base, text before, text after)."""
    rules = []
    for word, head in HEADS_DE.items():
        rules.append((rf"^{head} (?:de |d')(.+)$", "", f" {word}"))
    for word, head in HEADS_PLAIN.items():
        rules.append((rf"^{head}(.+)$", "", f" {word}"))
    for word, tail in TAILS.items():
        rules.append((rf"^(.+){tail}$", "", f" {word}"))
    for table in (PREFIXES, COLOURS):
        for word, modifier in table.items():
            rules.append((rf"^(.+) {modifier}$", f"{word} ", ""))
    return rules


REVERSE_PATTERNS = _reverse_patterns()


def _elided(base: Column) -> Column:
    return F.when(base.rlike("(?i)^[aeiouy]"), F.concat(F.lit(" d'"), base)).otherwise(
        F.concat(F.lit(" de "), base)
    )


def localise(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``names(name)``, ``dictionary(name, translated)`` -> ``(name, localised)``.

    Every way to look a name up becomes a ranked key; one join finds the hits and the
    lowest rank decides: the name itself, a leading modifier, a colour, its plural or
    singular, a suffix pattern, else the name as it is.
    """
    name = F.col("name")
    lower = F.lower(F.trim(name))
    first = F.substring_index(lower, " ", 1)
    has_rest = F.instr(lower, " ") > 0
    rest = F.substr(name, F.length(first) + 2)
    last = F.element_at(F.split(lower, " "), -1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(last) - 1)
    suffixed = last.isin(*HEADS_DE, *HEADS_PLAIN, *TAILS) & has_rest

    def both(rank: int, rule: str, key: Column, when: Column) -> list[Column]:
        return [
            F.when(when, F.struct(F.lit(rank + d).alias("rank"), F.lit(rule).alias("rule"), k.alias("key")))
            for d, k in enumerate((key, F.lower(key)))
        ]

    keys = F.array_compact(F.array(
        *both(0, "exact", name, F.lit(True)),
        *both(2, "prefix", rest, has_rest & first.isin(*PREFIXES)),
        *both(4, "colour", rest, has_rest & first.isin(*COLOURS)),
        *both(6, "exact", F.concat(lower, F.lit("s")), F.lit(True)),
        *both(8, "exact", F.substr(lower, F.lit(1), F.length(lower) - 1), lower.endswith("s")),
        *both(10, "suffix", stem, suffixed),
    ))
    words = dictionary.where(F.col("translated") != "").select(F.col("name").alias("key"), "translated")
    distinct = names.select("name").distinct()
    hits = (
        distinct.select("name", F.explode(keys).alias("k"))
        .select("name", "k.*")
        .join(words, "key")
        .groupBy("name")
        .agg(F.min(F.struct("rank", "rule", "translated")).alias("hit"))
    )
    base = F.coalesce(F.col("hit.translated"), stem)
    patterned = (
        F.when(last.isin(*HEADS_DE), F.concat(lookup(HEADS_DE, last), _elided(base)))
        .when(last.isin(*HEADS_PLAIN), F.concat(lookup(HEADS_PLAIN, last), base))
        .otherwise(F.concat(base, lookup(TAILS, last)))
    )
    rule = F.col("hit.rule")
    return distinct.join(hits, "name", "left").select(
        "name",
        F.when(rule == "exact", F.col("hit.translated"))
        .when(rule == "prefix", F.concat(F.col("hit.translated"), F.lit(" "), lookup(PREFIXES, first)))
        .when(rule == "colour", F.concat(F.col("hit.translated"), F.lit(" "), lookup(COLOURS, first)))
        .when(suffixed, patterned)
        .otherwise(name)
        .alias("localised"),
    )
