import random
from dataclasses import replace

from pyspark.sql import functions as F

from cobasket.operators import coherence, evaluate
from cobasket.operators import recommend as r
from cobasket.params import DEFAULTS


def greedy(cands, n, decay):
    """Pick one at a time: best decayed score, then score, then name."""
    left, seen, out = list(cands), {}, []
    while left and len(out) < n:
        best = min(left, key=lambda x: (-round(x[2] * decay ** seen.get(x[1], 0), 9), -round(x[2], 9), x[0]))
        left.remove(best)
        out.append(best[0])
        seen[best[1]] = seen.get(best[1], 0) + 1
    return out


def test_windows_equal_the_greedy_pick(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for sel in range(25):
        cands = [(f"i{k:02d}", rng.choice("abc"), rng.choice([0.5, 0.4, 0.25, rng.random()])) for k in range(40)]
        rows += [(sel, i, c, 1, s) for i, c, s in cands]
        want[sel] = greedy(cands, 12, 0.8)
    scored = spark.createDataFrame(rows, "sel_id int, item string, category string, coverage int, score double")
    got = {}
    for row in r.top_diverse(scored, n=12).orderBy("sel_id", "rank").collect():
        got.setdefault(row.sel_id, []).append(row.item)
    assert got == want


def test_penalty_branches(spark):
    cases = [
        (None, ["meat"], 1.0), ("meat", ["meat"], 0.35), ("seafood", ["meat"], 0.35), ("alcohol", ["beverage"], 0.4 * 0.6),
        ("alcohol", ["alcohol"], 0.4 * 0.6), ("alcohol", ["fruit"], 0.6), ("vegetable", ["vegetable"], 1.0), ("herb", [], 1.0),
        ("unheard", ["unheard"], 1.0),
    ]
    df = spark.createDataFrame([(c, s) for c, s, _ in cases], "c string, s array<string>")
    got = [x[0] for x in df.select(r.category_penalty(F.col("c"), F.col("s"))).collect()]
    assert got == [w for _, _, w in cases]


def graph(spark, pairs):
    rows = [(a, b, s) for a, b, s in pairs] + [(b, a, s) for a, b, s in pairs]
    return spark.createDataFrame(rows, "item string, partner string, score int")


def selections(spark, table):
    return spark.createDataFrame([(k, x) for k, v in table.items() for x in v], "sel_id int, item string")


def test_scores_gate_exclude_and_average(spark):
    edges = graph(spark, [("a", "x", 40), ("b", "x", 20), ("c", "y", 60), ("a", "b", 10), ("d", "x", 30)])
    plain = replace(DEFAULTS, use_rarity=False, use_penalties=False)
    got = {
        (x.sel_id, x.item): (x.coverage, round(x.score, 6))
        for x in r.score_candidates(selections(spark, {1: "abcd", 2: "a"}), edges, None, plain).collect()
    }
    # Two of four have to reach a candidate; the average is over all selected.
    assert got == {(1, "x"): (3, 0.225), (2, "x"): (1, 0.4), (2, "b"): (1, 0.1)}


def test_variants_of_the_selection_are_suppressed(spark):
    edges = graph(spark, [("potato", "hash brown", 90), ("potato", "onion", 30)])
    tax = spark.createDataFrame(
        [("potato", "vegetable", None), ("hash brown", "starch", "potato"), ("onion", "vegetable", None)],
        "item string, category string, base string",
    )
    got = [x.item for x in r.recommend(selections(spark, {1: ["potato"], }), edges, tax).collect()]
    assert got == ["onion"]
    got = [x.item for x in r.recommend(selections(spark, {1: ["hash brown"]}), edges, tax).collect()]
    assert got == []


def test_lanes_order_by_their_three_best(spark):
    rows = [(1, "one", "a", 1, 0.9), (1, "two", "a", 1, 0.1), (1, "three", "b", 1, 0.6), (1, "four", "b", 1, 0.55), (1, "big", "c", 1, 1.4)]
    scored = spark.createDataFrame(rows, "sel_id int, item string, category string, coverage int, score double")
    got = {x.category: (x.lane_rank, round(x.strength, 6)) for x in r.lanes(scored).collect()}
    assert got == {"c": (1, 1.0), "b": (2, 0.575), "a": (3, 0.5)}


def test_leave_one_out_and_outliers(spark):
    edges = graph(spark, [("a", "b", 50), ("a", "c", 50), ("b", "c", 50), ("a", "z", 1), ("p", "q", 4)])
    loo = coherence.loo_scores(selections(spark, {1: "abcz", 2: "pq", 3: "a", 4: "az"}), edges)
    rows = {(x.sel_id, x.item): x for x in coherence.outliers(loo).collect()}
    assert round(rows[1, "a"].loo, 6) == round(1.01 / 3, 6)
    assert [k for k, x in rows.items() if x.outlier] == [(1, "z")]
    # below the minimum mean nothing is flagged, one item has no score
    assert rows[2, "p"].loo == 0.04 and not rows[2, "p"].outlier and (3, "a") not in rows
    assert rows[4, "a"].loo == rows[4, "z"].loo == 0.01


def test_metrics_close_up_over_unjudged(spark):
    rec = spark.createDataFrame(
        [("p", "u", 1), ("p", "love", 2), ("p", "no", 3), ("p", "late", 20), ("q", "u", 1), ("n", "no", 1)],
        "probe string, candidate string, rank int",
    )
    jud = spark.createDataFrame(
        [("p", "love", 2), ("p", "no", 0), ("p", "late", 2), ("p", "never", 2), ("q", "x", 1), ("n", "no", 0)],
        "probe string, candidate string, grade int",
    )
    rows = {x.probe: x for x in evaluate.metrics(rec, jud).collect()}
    assert set(rows) == {"p", "n"}
    p = rows["p"]
    assert (p.judged, p.precision, p.discovery, round(p.recall, 6)) == (2, 0.5, 0.5, 0.666667)
    # gain 3 at place 1; the ideal has 3 at both places
    assert round(p.ndcg, 6) == round(3 / (3 + 3 / 1.584962500721156), 6)
    assert rows["n"].ndcg == 0.0 and rows["n"].recall == 1.0
