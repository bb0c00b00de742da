"""Matching counts the pairs it looks at, and no others."""

import random

import pytest
from test_graph import as_df, brute_pairs, got_pairs, random_baskets

from cobasket.functions import pairs
from cobasket.operators import graph as g
from cobasket.operators import match as mt
from cobasket.params import Params


def small_units(monkeypatch):
    for name, value in {"FEW_ITEMS": 0, "BLOCK_ITEMS": 3, "UNIT_PAIRS": 40, "HELD_IDS": 16, "SORTED_PAIRS": 10}.items():
        monkeypatch.setattr(pairs, name, value)


@pytest.mark.parametrize("outer", [[], ["i03", "i17", "unknown"]])
@pytest.mark.parametrize("giant", [0, 6])
def test_pairs_asked_for_count_as_brute_force(spark, monkeypatch, giant, outer):
    small_units(monkeypatch)
    p = Params(min_item_freq=3, min_support=3, light_basket_items=8)
    baskets = random_baskets(11 + giant, giant=giant)
    inner = [f"i{k:02d}" for k in range(0, 30, 4)] + ["i03"]
    asked = g.Asked(*(spark.createDataFrame([(x,) for x in xs], "item string") for xs in (inner, outer)))
    got = got_pairs(g.npmi_pairs(as_df(spark, baskets), p, asked=asked))
    wanted = lambda a, b: a in outer or b in outer or (a in inner and b in inner)
    assert got == {k: v for k, v in brute_pairs(baskets, p).items() if wanted(*k)} and got


@pytest.mark.parametrize("few", [0, 1024])
def test_matches_need_no_other_edges(spark, monkeypatch, few):
    """The answer is that of the whole graph; what is counted is a part of it."""
    p = Params(min_item_freq=2, min_support=2, match_limit=3)
    rng = random.Random(8)
    items = [f"i{k:02d}" for k in range(40)]
    baskets = {k: rng.sample(items, rng.randint(3, 12)) for k in range(150)}
    rows = [(k, x) for k, b in baskets.items() for x in b]
    basket_items = spark.createDataFrame(rows, "basket_id int, item string")
    heads = spark.createDataFrame([(k, f"t{k}", f"u{k}", rng.choice(["en", "fr"])) for k in baskets], "basket_id int, title string, url string, lang string")
    sel = spark.createDataFrame([(s, x, "en") for s in range(6) for x in rng.sample(items[:20], 5)], "sel_id int, item string, lang string")
    whole = g.affinity_edges(basket_items, p, unique=True)
    want = sorted(map(str, mt.basket_matches(sel, heads, basket_items, whole, p, symmetric=True).collect()))
    small_units(monkeypatch)
    monkeypatch.setattr(pairs, "FEW_ITEMS", few)
    got = []
    monkeypatch.setattr(mt, "affinity_edges", lambda *a, of=mt.affinity_edges, **k: got.append(of(*a, **k)) or got[0])
    assert sorted(map(str, mt.basket_matches(sel, heads, basket_items, None, p).collect())) == want and want
    assert few or 0 < got[0].count() < whole.count()


def test_fit_meets_what_a_basket_holds_first(spark, monkeypatch):
    """An item with many partners is met with its baskets, not with all of them; repeated rows count once."""
    from cobasket.operators import coherence

    monkeypatch.setattr(coherence, "FEW_ITEMS", 0)
    monkeypatch.setattr(mt, "few_items", lambda edges: False)
    partners = [f"p{k:03d}" for k in range(300)]
    edges = spark.createDataFrame([r for k, x in enumerate(partners) for r in (("a", x, 1 + k % 90), (x, "a", 1 + k % 90))], "item string, partner string, score int")
    basket = spark.createDataFrame([(1, "p005"), (1, "p005"), (1, "p007"), (2, "zz")], "basket_id int, item string")
    asked = spark.createDataFrame([(1, "a"), (2, "a")], "basket_id int, item string")
    found = mt.pairing_fit(asked, basket, edges, symmetric=True)
    assert {r.basket_id: round(r.fit, 9) for r in found.collect()} == {1: round(14 / 100 / 3, 9), 2: 0.0}
