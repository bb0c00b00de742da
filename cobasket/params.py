"""Every threshold and weight in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Factors that the ranking results depend on.
# ---------------------------------------------------------------------------
SELF_PENALTY = {
    "meat": 0.35,
    "seafood": 0.35,
    "spice": 0.45,
    "beverage": 0.4,
    "alcohol": 0.4,
    "fruit": 0.5,
    "fat": 0.5,
    "starch": 0.55,
    "sweet": 0.7,
    "condiment": 0.7,
    "legume-nut": 0.7,
    "herb": 0.75,
    "dairy": 0.8,
    "vegetable": 1.0,
    "egg": 1.0,
    "other": 1.0,
}
CROSS_GROUPS = (
    (("meat", "seafood"), 0.35),
    (("alcohol", "beverage"), 0.4),
)
GLOBAL_DAMP = {"alcohol": 0.6}

# The category vocabulary, and the order in which several keyword
# hits are resolved.
CATEGORIES = (
    "meat", "seafood", "dairy", "egg", "vegetable", "fruit", "herb", "spice",
    "starch", "legume-nut", "fat", "condiment", "sweet", "beverage", "alcohol",
    "other",
)
CATEGORY_PRIORITY = (
    "seafood", "meat", "egg", "herb", "spice", "legume-nut", "fat",
    "alcohol", "beverage", "sweet", "condiment", "starch", "dairy",
    "fruit", "vegetable",
)


@dataclass(frozen=True)
class Params:
    # graph build
    min_item_freq: int = 30
    min_support: int = 20
    min_score: float = 0.01
    # A basket with more frequent items than this is counted by the heavy path.
    light_basket_items: int = 65_536

    # basket admission and budget
    min_items: int = 3
    max_items: int = 20
    min_map_ratio: float = 0.6
    # Languages that are admitted; None admits all.
    langs: tuple[str, ...] | None = ("en", "fr")
    coverage_quota: int = 6
    mapping_gate: float = 0.9
    new_item_min_freq: int = 30

    # ranking
    coverage_fraction: float = 0.5
    use_penalties: bool = True
    use_rarity: bool = True
    rarity_floor: float = 0.25
    rarity_cap: float = 1.5
    rarity_min_iqr: float = 5.0
    diversity_decay: float | None = 0.8
    top_n: int = 30
    lane_k: int = 12
    lane_rank_topk: int = 3
    self_penalty: dict = field(default_factory=lambda: dict(SELF_PENALTY))
    cross_groups: tuple = CROSS_GROUPS
    global_damp: dict = field(default_factory=lambda: dict(GLOBAL_DAMP))

    # outliers
    outlier_min_mean: float = 0.05
    outlier_mean_fraction: float = 0.5

    # basket matching
    w_cover_selection: float = 1.0
    w_matched: float = 0.5
    matched_k: float = 3.0
    w_pairing: float = 0.6
    neutral_pairing: float = 0.3
    w_cover_basket: float = 0.3
    w_extras: float = 0.4
    extras_k: float = 6.0
    w_fit: float = 0.5
    fit_topk: int = 3
    match_min: int = 2
    match_fraction: float = 0.6
    match_tolerance: int = 1
    match_limit: int = 8

    # evaluation
    pool_depth: int = 15
    pool_extras: int = 5
    pool_extra_from: int = 20
    pool_extra_to: int = 120
    min_judgments: int = 200

    # fuzzy matching
    fuzzy_cutoff: float = 0.9


DEFAULTS = Params()
