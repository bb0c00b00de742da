"""Turning recipe-style line items into bare phrases, and list cells into arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Units, partitives and preparation words of French line items.
# ---------------------------------------------------------------------------
UNITS = (
    "g", "kg", "mg", "l", "cl", "ml", "dl",
    "c", "cs", "cc", "cuillère", "cuillères", "cuiller", "cuillere", "cuilleres",
    "sachet", "sachets", "pincée", "pincées", "gousse", "gousses",
    "tranche", "tranches", "feuille", "feuilles", "brin", "brins",
    "branche", "branches", "botte", "bottes", "boîte", "boîtes",
    "pot", "pots", "verre", "verres", "tasse", "tasses", "pièce", "pièces",
    "filet", "filets", "zeste", "zestes", "noix", "morceau", "morceaux",
    "rondelle", "rondelles", "poignée", "poignées", "cà",
)
PARTITIVES = (
    "de la ", "de l'", "d'", "du ", "des ", "de ", "la ", "le ", "les ", "l'", "au ", "à ",
)
PREPARATIONS = (
    "haché", "hachée", "hachés", "hachées", "émincé", "émincée", "émincés",
    "râpé", "râpée", "râpés", "coupé", "coupée", "coupés", "coupées",
    "fondu", "fondue", "battu", "battue", "tamisé", "écrasé", "écrasée",
    "ciselé", "ciselée", "épluché", "épluchée", "dénoyauté", "surgelé",
    "surgelée", "en dés", "en tranches", "en morceaux", "en rondelles",
    "facultatif", "facultative", "selon goût",
)
# Fixed values as well: what counts as a leading quantity and as a spoon measure.
QUANTITY_PATTERN = r"(?U)^\s*[\d.,/½¼¾⅓⅔\s-]+"
SPOON_PATTERN = r"(?iU)^.*?\b(?:à|a)\s*(?:soupe|caf[eé]|s\.|c\.)\.?\s*(?:de\s+|d')?"


def parse_line(
    c: Column,
    units: tuple[str, ...] = UNITS,
    partitives: tuple[str, ...] = PARTITIVES,
    preparations: tuple[str, ...] = PREPARATIONS,
) -> Column:
    """Strip quantity, measure, partitive and preparation; keep the name.

    The lists are parameters: another language passes its own.
    """
    s = F.lower(F.trim(c))
    s = F.trim(F.regexp_replace(s, QUANTITY_PATTERN, ""))
    s = F.trim(F.regexp_replace(s, SPOON_PATTERN, ""))
    first = F.regexp_replace(F.substring_index(s, " ", 1), r"\.+$", "")
    rest = F.substr(s, F.instr(s, " ") + 1)
    s = F.when((F.instr(s, " ") > 0) & first.isin(*units), rest).otherwise(s)
    s = F.regexp_replace(s, "^(?:" + "|".join(map(re.escape, partitives)) + ")", "")
    s = F.substring_index(s, ",", 1)
    # Each word cuts from its first place to the end, so one alternation cutting
    # at the leftmost place gives the same prefix.
    longest_first = sorted(preparations, key=len, reverse=True)
    s = F.regexp_replace(s, r"(?U)\b(?:" + "|".join(longest_first) + r")\b.*$", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.regexp_replace(s, r"^[ .\-]+|[ .\-]+$", "")


def cell_to_lines(c: Column) -> Column:
    """A cell with a JSON list, else text split on newline, ``;`` or ``|``."""
    return F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"[\n;|]+"))


def _json_escapes(c: Column) -> Column:
    """Escapes that only list literals know, in the form that JSON knows."""
    return F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")


def cell_to_list(c: Column) -> Column:
    """A cell with a JSON list or a list literal in single quotes; anything else is empty."""
    return F.coalesce(
        F.from_json(c, "array<string>", {"allowSingleQuotes": "true"}),
        F.from_json(_json_escapes(c), "array<string>", {"allowSingleQuotes": "true"}),
        F.array().cast("array<string>"),
    )


def normalise_url(c: Column) -> Column:
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.when(u == "", "").when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
