"""Selections dealt out once: what they reach is added up where they are."""

import random

from cobasket.operators import recommend as r
from cobasket.staging import stage


def test_features_need_no_exchange_of_what_is_reached(spark, monkeypatch):
    rng = random.Random(4)
    items = [f"i{k}" for k in range(12)]
    pairs = [(a, b, rng.randint(1, 60)) for a in items for b in items if a < b and rng.random() < 0.6]
    edges = stage(spark.createDataFrame(pairs + [(b, a, s) for a, b, s in pairs], "item string, partner string, score int"))
    chosen = [(k, x) for k in range(40) for x in rng.sample([*items, "alone"], rng.randint(1, 5))]
    selections = spark.createDataFrame(chosen, "sel_id int, item string")
    tax = stage(spark.createDataFrame([(x, "meat" if k % 2 else None, items[k - 1] if k % 5 == 1 else None) for k, x in enumerate(items)], "item string, category string, base string"))

    def rows(df):
        return sorted((x.sel_id, x.item, x.category, x.coverage, x.n, sorted(x.cats), x.avg100, x["median"], x.iqr) for x in df.collect())

    for table in (None, tax):
        monkeypatch.setattr(r, "FEW_ITEMS", 1 << 10)
        near = r.candidate_features(selections, edges, table)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning(sel_id" in line and "item#" in line.split("hashpartitioning")[1].split(")")[0]]
        monkeypatch.setattr(r, "FEW_ITEMS", 0)
        assert rows(near) == rows(r.candidate_features(selections, edges, table))
        assert rows(near)
