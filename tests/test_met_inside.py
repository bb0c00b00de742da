"""Pairs of few items looked up inside a selection: no row meets all partners of its item."""

import random

from cobasket.operators import coherence, match
from cobasket.staging import stage


def test_selections_meet_their_own_items_only(spark, monkeypatch):
    rng = random.Random(8)
    items = [f"i{k}" for k in range(60)]
    edges = stage(spark.createDataFrame(
        [(a, b, rng.randint(1, 60)) for a in items for b in items if a != b and rng.random() < 0.9], "item string, partner string, score int"
    ))
    chosen = [(k, x) for k in range(50) for x in rng.choices([*items, "alone", None], k=rng.randint(1, 6))]
    chosen += [(None, "i1"), (None, "i2")]
    rows = stage(spark.createDataFrame(chosen, "sel_id int, item string"))
    baskets = stage(rows.withColumnRenamed("sel_id", "basket_id").distinct())
    wanted = stage(spark.createDataFrame([(k, rng.choice([*items, "alone", None])) for k in [*range(55), None] for _ in range(3)], "basket_id int, item string"))
    found = []
    for few in (1 << 10, 0):
        monkeypatch.setattr(coherence, "FEW_ITEMS", few)
        loo, fit = coherence.loo_scores(rows, edges), match.pairing_fit(wanted, baskets, edges)
        if few:
            for key, df in (("sel_id", loo), ("basket_id", fit)):
                plan = df._jdf.queryExecution().executedPlan().toString()
                dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
                assert dealt and not [d for d in dealt if d.startswith(key) and "item#" in d.split(")")[0]]
        found.append((sorted(loo.collect(), key=str), sorted(fit.collect(), key=str)))
    assert found[0] == found[1] and found[0][0] and found[0][1]
