"""Badge, bucket and label projections of the result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobasket.functions.text import sentence_case

# Display labels of the categories.
CATEGORY_LABELS = {
    "vegetable": {"en": "Vegetables", "fr": "Légumes"},
    "fruit": {"en": "Fruits", "fr": "Fruits"},
    "herb": {"en": "Herbs", "fr": "Herbes"},
    "spice": {"en": "Spices", "fr": "Épices"},
    "meat": {"en": "Meat", "fr": "Viandes"},
    "seafood": {"en": "Seafood", "fr": "Poissons & fruits de mer"},
    "egg": {"en": "Eggs", "fr": "Œufs"},
    "dairy": {"en": "Dairy", "fr": "Produits laitiers"},
    "starch": {"en": "Starches", "fr": "Féculents"},
    "legume-nut": {"en": "Legumes & nuts", "fr": "Légumineuses & noix"},
    "fat": {"en": "Fats & oils", "fr": "Matières grasses"},
    "condiment": {"en": "Condiments", "fr": "Condiments"},
    "sweet": {"en": "Sweet", "fr": "Sucré"},
    "alcohol": {"en": "Alcohol", "fr": "Alcools"},
    "beverage": {"en": "Beverages", "fr": "Boissons"},
    "other": {"en": "Other", "fr": "Autres"},
}


def lookup(mapping: dict, key: Column) -> Column:
    """A fixed small mapping as a literal map expression."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)


def badge(score: Column) -> Column:
    """0-99 badge of a score in [0, 1]."""
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.floor(clamped * 99 + 0.5).cast("int")


def fit_bucket(fit: Column) -> Column:
    return F.when(fit >= 0.25, "great").when(fit >= 0.10, "good").otherwise("weak")


def category_label(category: Column, lang: str = "en") -> Column:
    labels = {slug: names[lang] for slug, names in CATEGORY_LABELS.items()}
    return F.coalesce(lookup(labels, category), sentence_case(category))
