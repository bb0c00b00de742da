import math
import random
import statistics
from collections import Counter
from dataclasses import replace
from itertools import combinations

import pyarrow as pa
import pytest

from cobasket.functions import pairs
from cobasket.operators import graph as g
from cobasket.params import Params


def brute_pairs(baskets, p):
    """Pair counts and NPMI of {id: set of items} straight from the definition."""
    n = len(baskets)
    single = Counter(x for b in baskets.values() for x in b)
    double = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    out = {}
    for (a, b), c in double.items():
        if single[a] < p.min_item_freq or single[b] < p.min_item_freq or c < p.min_support:
            continue
        v = 1.0 if c == n else math.log((c / n) / ((single[a] / n) * (single[b] / n))) / -math.log(c / n)
        if v >= p.min_score:
            out[a, b] = (c, round(v, 9))
    return out


def as_df(spark, baskets):
    rows = [(k, x) for k, b in baskets.items() for x in b for _ in range(1 + (k % 2))]
    return spark.createDataFrame(rows, "basket_id long, item string")


def got_pairs(df):
    return {(r.a, r.b): (r.n_ab, round(r.npmi, 9)) for r in df.collect()}


def random_baskets(seed, n=120, giant=0):
    rng = random.Random(seed)
    items = [f"i{k:02d}" for k in range(30)]
    baskets = {k: set(rng.sample(items, rng.randint(1, 6))) for k in range(n)}
    for k in range(giant):
        baskets[n + k] = set(rng.sample(items, rng.randint(18, 30)))
    return baskets


def test_npmi_matches_definition(spark):
    p = Params(min_item_freq=5, min_support=3)
    baskets = random_baskets(1)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


@pytest.mark.parametrize("giant", [1, 6])
def test_oversized_baskets_and_hot_items_count_the_same(spark, giant):
    """A few giant baskets (below the support) and many (above it), items split in parts."""
    p = Params(min_item_freq=5, min_support=3, light_basket_items=8)
    baskets = random_baskets(2 + giant, giant=giant)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


def test_pair_in_every_basket_scores_one(spark):
    baskets = {k: {"a", "b"} | ({"c"} if k % 2 else set()) for k in range(10)}
    p = Params(min_item_freq=2, min_support=2, min_score=-2.0)
    rows = {(r.a, r.b): r for r in g.npmi_pairs(as_df(spark, baskets), p).collect()}
    assert rows["a", "b"].npmi == 1.0 and rows["a", "b"].score == 100
    assert rows["a", "c"].npmi == 0.0


def test_score_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.005,), (0.625,)], "s double")
    assert [r[0] for r in df.select(g.quantise(df.s)).collect()] == [12, 14, 0, 62]


def star_edges(spark, lists):
    rows = [(k, f"p{n}", s) for k, scores in lists.items() for n, s in enumerate(scores)]
    return spark.createDataFrame(rows, "item string, partner string, score int")


LISTS = {"one": [7], "two": [3, 9], "three": [1, 2, 10], "four": [1, 5, 5, 20], "five": [2, 4, 8, 16, 32],
         "nine": [1, 1, 2, 3, 3, 8, 9, 40, 41]}


def test_quartiles_lower(spark):
    got = {r.item: (r.median, r.iqr) for r in g.quartiles_lower(star_edges(spark, LISTS)).collect()}
    at = lambda s, f: sorted(s)[math.floor((len(s) - 1) * f)]
    assert got == {k: (at(s, 0.5), at(s, 0.75) - at(s, 0.25)) for k, s in LISTS.items()}


def test_quartiles_exclusive(spark):
    got = {r.item: (r.median, r.iqr) for r in g.quartiles_exclusive(star_edges(spark, LISTS)).collect()}
    want = {}
    for k, s in LISTS.items():
        q = statistics.quantiles(s, n=4) if len(s) >= 4 else None
        want[k] = (statistics.median(s), q[2] - q[0] if q else 10)
    assert got == want


def test_import_keeps_item_edges_both_ways(spark):
    nodes = spark.createDataFrame(
        [(1, "Sea_Salt ", "ingredient"), (2, "egg", "ingredient"), (3, "x", "compound")], "node_id int, name string, node_type string"
    )
    edges = spark.createDataFrame(
        [(1, 2, 0.255, "ingr-ingr"), (1, 3, 0.9, "ingr-ingr"), (2, 1, 0.5, "ingr-dcomp"), (2, 1, 0.009, "ingr-ingr")],
        "id_1 int, id_2 int, score double, edge_type string",
    )
    kept, skipped = g.import_graph(nodes, edges)
    assert sorted(map(tuple, kept.collect())) == [("egg", "sea salt", 26), ("sea salt", "egg", 26)]
    assert skipped.first()[0] == 1


def test_dense_ids_follow_the_order(spark):
    df = spark.createDataFrame([(f"n{k:03d}",) for k in range(200)], "item string").repartition(5)
    got = {r.item: r.item_id for r in g.dense_ids(df, ["item"]).collect()}
    assert got == {f"n{k:03d}": k for k in range(200)}


def test_append_never_moves_ids(spark):
    old = spark.createDataFrame([("b", 0), ("a", 4)], "item string, item_id int")
    new = spark.createDataFrame([("c",), ("a",), ("aa",)], "item string")
    assert {r.item: r.item_id for r in g.append_items(old, new).collect()} == {"b": 0, "a": 4, "aa": 5, "c": 6}


def test_max_merge_is_idempotent_and_symmetric(spark):
    base = spark.createDataFrame([("a", "b", 10), ("b", "a", 10), ("a", "c", 5), ("c", "a", 5)], "item string, partner string, score int")
    new = spark.createDataFrame([("a", "b", 30), ("c", "d", 7), ("d", "d", 9)], "item string, partner string, score int")
    once = g.max_merge(base, new)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == [("a", "b", 30), ("a", "c", 5), ("b", "a", 30), ("c", "a", 5), ("c", "d", 7), ("d", "c", 7)]
    assert rows(g.max_merge(once, new)) == rows(once)
    assert rows(g.provenance(base, once)) == [("a", "b", 10, 30, "raised"), ("c", "d", None, 7, "added")]


def test_incoming_edges_respect_curation(spark):
    edges = spark.createDataFrame(
        [("old a", "b", 9), ("gone", "b", 8), ("b", "what", 7), ("a", "old a", 6), ("b", "fresh", 5)], "item string, partner string, score int"
    )
    resolved = spark.createDataFrame([("old a", "a"), ("gone", None)], "src string, tgt string")
    live = spark.createDataFrame([("a",), ("b",)], "item string")
    approved = spark.createDataFrame([("fresh",)], "item string")
    kept, dropped = g.resolve_incoming(edges, resolved, live, approved)
    assert sorted(map(tuple, kept.collect())) == [("a", "b", 9), ("b", "fresh", 5)]
    assert sorted(map(tuple, dropped.collect())) == [("what", 1)]


def test_params_are_one_place():
    assert replace(Params(), min_support=1).min_item_freq == 30


def test_units_of_blocks_count_all_pairs(spark, monkeypatch):
    """Blocks of three items, units of few pairs, lists that turn into arrays: the same counts."""
    for name, value in {"BLOCK_ITEMS": 3, "UNIT_PAIRS": 40, "HELD_IDS": 16, "SORTED_PAIRS": 10}.items():
        monkeypatch.setattr(pairs, name, value)
    p = Params(min_item_freq=3, min_support=3)
    baskets = random_baskets(11)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


def test_a_pair_in_all_baskets_is_spread(spark, monkeypatch):
    """Baskets of a hot unit are dealt out in shares, and one count for each share travels."""
    monkeypatch.setattr(pairs, "UNIT_PAIRS", 20)
    rows = spark.createDataFrame([(b, x) for b in range(400) for x in (0, 1)], "basket_id int, id long")
    numbered = spark.createDataFrame([(0, 400), (1, 400)], "id long, n long")
    loads = pairs.Loads([800], 400)
    assert loads.shares(0, 0) == 81
    counted = g._light_counts(rows, numbered, 400)
    assert [tuple(r) for r in counted.collect()] == [(0, 1, 400)]
    packed = list(pairs.pack(loads)(iter([pa.RecordBatch.from_pydict({"hash": list(range(400)), "ids": [[0, 1]] * 400})])))
    assert sorted(packed[0].column(2).to_pylist()) == list(range(81))
    partial = list(pairs.count(loads, 3)(iter(packed)))
    assert sum(b.num_rows for b in partial) == 81 and sum(sum(b.column(2).to_pylist()) for b in partial) == 400


def test_rank_of_a_probe_however_deep(spark):
    rows = [("hub", f"p{k:03d}", 90 - k // 7) for k in range(300)] + [("hub", "zz", 1), ("one", "hub", 5)]
    edges = spark.createDataFrame(rows, "item string, partner string, score int")
    probes = spark.createDataFrame([("hub", "p000"), ("hub", "p299"), ("hub", "zz"), ("one", "hub"), ("one", "none")], "item string, partner string")
    got = {(r["item"], r.partner): (r.score, r["rank"], r.passed) for r in g.golden_probes(probes, edges, min_score=5).collect()}
    assert got == {
        ("hub", "p000"): (90, 1, True), ("hub", "p299"): (48, 300, False), ("hub", "zz"): (1, 301, False),
        ("one", "hub"): (5, 1, True), ("one", "none"): (None, None, False),
    }
