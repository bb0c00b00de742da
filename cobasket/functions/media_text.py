"""Licence and file-name rules of media candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Licence patterns, junk names and the words that move a score.
# ---------------------------------------------------------------------------
NON_FREE_PATTERN = r"(?i)nc|nd|fair use|non-free"
FREE_PATTERN = (
    r"(?i)(cc0|public domain|pd-|^pd$|no restrictions|cc[- ]by(?!.*(nc|nd))|gfdl|attribution|"
    r"copyrighted free use|mit|apache)"
)
JUNK_PATTERN = (
    r"(?i)(commons-logo|wiki|\bicon\b|\.svg$|\.ogg$|\.oga$|\.ogv$|\.webm$|\.mid$|\.pdf$|\.tif$|\.tiff$|"
    r"\bmap\b|distribution|range|locator|\bflag\b|coat[_ ]of[_ ]arms|\bseal\b|"
    r"ambox|question[_ ]book|edit-|padlock|symbol|barnstar|nuvola|crystal[_ ]clear|"
    r"diagram|chart|graph|\bplate\b|illustration|drawing|engraving|botanical|herbarium)"
)
RASTER_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
MEDIA_TYPES = ("", "BITMAP", "DRAWING")
PENALTY_WORDS = (
    "plant", "plants", "tree", "trees", "flower", "flowers", "flowering",
    "leaf", "leaves", "foliage", "seedling", "sapling", "field", "garden",
    "orchard", "wild", "growing", "bush", "shrub", "vine", "blossom",
    "live", "alive", "animal", "bird", "whole", "farm", "crop", "harvest",
)
BONUS_WORDS = (
    "dried", "seed", "seeds", "powder", "ground", "roasted", "peeled",
    "sliced", "cut", "bowl", "pile", "heap", "closeup", "close-up", "macro",
    "food", "cooked", "raw", "fresh", "ripe", "pod", "pods", "kernel",
    "kernels", "grain", "grains", "root", "roots", "bulb", "bulbs", "clove",
    "cloves", "fruit", "fruits", "berry", "berries", "nut", "nuts", "paste",
    "jar", "bottle", "isolated", "white",
)
HOMONYM_WORDS = (
    "aphid", "aphids", "aphis", "portrait", "portraits", "map", "town", "city",
    "village", "county", "street", "church", "building", "station", "coat",
    "arms", "flag", "coin", "coins", "stamp", "banknote", "cigarette", "poster",
    "logo", "disease", "rot", "blight", "pest", "larva", "larvae", "moth",
    "beetle", "caterpillar", "fungus", "mould", "mold", "person", "man", "woman",
    "player", "band", "album", "castle", "river", "mountain", "island",
)


def license_ok(c: Column) -> Column:
    """Free, and without any of the restrictive letter pairs anywhere in the name."""
    short = F.coalesce(c, F.lit(""))
    return (short != "") & ~short.rlike(NON_FREE_PATTERN) & short.rlike(FREE_PATTERN)


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))


def extension(c: Column) -> Column:
    return F.element_at(F.split(F.lower(c), r"\."), -1)


def count_of(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))


def stem_matches(want: Column, tokens: Column) -> Column:
    """Wanted words found in the name; longer words also match as a prefix either way."""

    def found(w: Column) -> Column:
        near = lambda t: (t == w) | ((F.length(t) >= 3) & (t.startswith(w) | w.startswith(t)))
        return F.when(F.length(w) < 3, F.array_contains(tokens, w)).otherwise(F.exists(tokens, near))

    return F.size(F.filter(want, found))
