"""Pairs of many items are named where they are counted, and ids travel a bounded number of times."""

import pytest
from test_asked_pairs import small_units
from test_graph import as_df, brute_pairs, got_pairs, random_baskets

from cobasket.functions import pairs
from cobasket.operators import graph as g
from cobasket.params import Params


@pytest.mark.parametrize("part", [1, 25])
@pytest.mark.parametrize("unit_pairs", [4, 1 << 31])
def test_named_units_count_as_brute_force(spark, monkeypatch, unit_pairs, part):
    """Units in shares and whole ones, some left items at a time."""
    small_units(monkeypatch)
    monkeypatch.setattr(pairs, "UNIT_PAIRS", unit_pairs)
    monkeypatch.setattr(pairs, "PART_IDS", part)
    p = Params(min_item_freq=3, min_support=3)
    baskets = random_baskets(11)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


def test_no_pair_meets_a_table_of_names(spark, monkeypatch):
    small_units(monkeypatch)
    monkeypatch.setattr(pairs, "UNIT_PAIRS", 1 << 31)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = g.npmi_pairs(as_df(spark, random_baskets(3)), Params(min_item_freq=3, min_support=3))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Above the units nothing is joined or dealt out again.
    assert "Join" not in plan[:plan.index("RepartitionByExpression")]


def test_blocks_do_not_grow_with_the_baskets():
    """An id travels once for each block; counts of shares would travel as well."""
    weights = [150_000_000 // (k + 20) for k in range(16_000)]
    loads = pairs.Loads(weights, 3_000_000)
    assert 900_000_000 < sum(weights) and len(loads.weights) < 30 and not loads.any_shared()
    # Most of it is bounded by the ids that a unit holds.
    assert max(pairs.Loads([w * 10 for w in weights], 30_000_000).weights) <= max(1 << 26, 10 * weights[0])
