"""Order graphs: few items counted where their baskets are, each graph built once."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from test_graph import as_df, brute_pairs, got_pairs, random_baskets

from cobasket.functions import pairs
from cobasket.operators import graph as g
from cobasket.params import Params


@pytest.mark.parametrize("at_once", [1, 4, 1 << 20])
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_a_task_counts_as_brute_force(monkeypatch, size, at_once):
    """Baskets that go on in the next batch, repeated rows, rows without id, baskets of such rows alone."""
    monkeypatch.setattr(pairs, "SORTED_PAIRS", at_once)
    rng = random.Random(size + at_once)
    baskets = {k: [rng.choice([None, *range(9)]) for _ in range(rng.randint(1, 8))] for k in range(60)}
    rows = [(k, x) for k, b in baskets.items() for x in b]
    columns = lambda part: [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32())]
    batches = [pa.RecordBatch.from_arrays(columns(rows[i:i + size]), names=["hash", "id"]) for i in range(0, len(rows), size)]
    got = {(r["a"], r["b"]): r["n"] for b in pairs.count_few(9)(iter(batches)) for r in b.to_pylist()}
    want = Counter({(-1, -1): len(baskets)})
    for b in baskets.values():
        held = sorted({x for x in b if x is not None})
        want.update(combinations(held, 2))
        want.update((x, x) for x in held)
    assert got == dict(want)


def test_cells_of_all_tasks_are_added_up(spark):
    """What the tasks count is the baskets, the items and the pairs."""
    rows = as_df(spark, random_baskets(5))
    numbered = spark.createDataFrame([(k, f"i{k:02d}", 9) for k in range(30)], "id long, item string, n long")
    counted, single, n_baskets = g._few_counts(rows, numbered, 30)
    want = Counter(p for b in random_baskets(5).values() for p in combinations(sorted(int(x[1:]) for x in b), 2))
    assert {(r.a, r.b): r.n_ab for r in counted.collect()} == want
    assert {r.id: r.n for r in single.collect()} == Counter(int(x[1:]) for b in random_baskets(5).values() for x in b)
    assert n_baskets == 120


def test_rare_items_and_repeats_do_not_make_an_item_frequent(spark):
    p = Params(min_item_freq=3, min_support=1, min_score=-2.0)
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "b"), (3, "c"), (4, "c"), (5, "c"), (6, "rare")]
    found = g.npmi_pairs(spark.createDataFrame(rows, "basket_id long, item string"), p)
    assert [(r.a, r.b, r.n_ab) for r in found.collect()] == [("b", "c", 1)]
    assert g.npmi_pairs(spark.createDataFrame([], "basket_id long, item string"), p).count() == 0


@pytest.mark.parametrize("giant", [0, 1, 6])
def test_many_items_count_the_same(spark, monkeypatch, giant):
    """The blocks, and oversized baskets, as for more items than a task's table has."""
    monkeypatch.setattr(pairs, "FEW_ITEMS", 0)
    p = Params(min_item_freq=5, min_support=3, light_basket_items=8)
    baskets = random_baskets(2 + giant, giant=giant)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


def test_many_items_in_small_units_count_the_same(spark, monkeypatch):
    for name, value in {"FEW_ITEMS": 0, "BLOCK_ITEMS": 3, "UNIT_PAIRS": 40, "HELD_IDS": 16, "SORTED_PAIRS": 10}.items():
        monkeypatch.setattr(pairs, name, value)
    p = Params(min_item_freq=3, min_support=3)
    baskets = random_baskets(11)
    assert got_pairs(g.npmi_pairs(as_df(spark, baskets), p)) == brute_pairs(baskets, p)


@pytest.mark.parametrize("name", ["eval_averages", "eval_progress", "annotation_queue"])
def test_a_query_builds_its_graph_once(spark, monkeypatch, name):
    from cobasket.plans import catalogue, eval_queries, graph_queries

    built = []
    for module in (eval_queries, graph_queries):
        monkeypatch.setattr(module, "order_edges", lambda *a, of=graph_queries.order_edges: built.append(1) or of(*a))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001") is not None
    assert len(built) == 1


def test_two_corpora_read_the_lines_once(spark, monkeypatch):
    from cobasket.plans import graph_queries

    read = []
    lines = graph_queries.i.order_lines
    monkeypatch.setattr(graph_queries.i, "order_lines", lambda *a: read.append(1) or lines(*a))
    staged = []
    monkeypatch.setattr(g, "stage", lambda df, label="t", of=g.stage: staged.append(label) or of(df, label))
    graph_queries.two_corpora(spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and "incidence" not in staged
