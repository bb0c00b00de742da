"""Basket admission against brute force, and how often the lines travel."""

import random

from cobasket.operators import baskets as b
from cobasket.params import Params


def heads_and_lines(seed):
    rng = random.Random(seed)
    heads = [(k, rng.choice(["A", "a", " ", "B"]), rng.choice(["en", "fr", "de"]), f"u{k}", k // 2) for k in range(150)]
    lines = [(rng.choice([None, *range(160)]), pos, rng.choice([None, *"abcde"])) for pos in range(900)]
    return heads, lines


def slow_admit(heads, lines, p):
    found = {}
    for key, title, lang, url, ord_ in heads:
        own = [(pos, item) for k, pos, item in lines if k == key]
        first = {}
        for pos, item in own:
            if item is not None:
                first[item] = min(pos, first.get(item, pos))
        if title.strip() and lang in p.langs and p.min_items <= len(first) <= p.max_items and len(first) / len(own) >= p.min_map_ratio:
            found[key] = (title, lang, url, ord_, [x for _, x in sorted((pos, x) for x, pos in first.items())])
    return found


def slow_dedupe(found):
    best = {}
    for key, (title, lang, _, ord_, items) in found.items():
        group = (lang, title.lower(), tuple(sorted(items)))
        best[group] = min(best.get(group, (ord_, key)), (ord_, key))
    return {key for _, key in best.values()}


def tables(spark, heads, lines):
    return (
        spark.createDataFrame(heads, "basket_id long, title string, lang string, url string, src_ord long"),
        spark.createDataFrame(lines, "basket_id long, pos long, item string"),
    )


def test_admission_is_as_brute_force(spark):
    p = Params(min_items=2, max_items=4)
    heads, lines = heads_and_lines(1)
    want = slow_admit(heads, lines, p)
    admitted = b.admit(*tables(spark, heads, lines), p)
    assert {r.basket_id: (r.title, r.lang, r.url, r.src_ord, r["items"]) for r in admitted.collect()} == want and len(want) > 20
    kept = [r.basket_id for r in b.dedupe(admitted).collect()]
    assert sorted(kept) == sorted(slow_dedupe(want)) and len(kept) < len(want)


def test_occurrences_travel_once(spark):
    """One shuffle of the occurrences and one of the heads."""
    plan = b.admit(*tables(spark, *heads_and_lines(2)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2
