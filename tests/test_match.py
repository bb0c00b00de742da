import math
import random

from pyspark.sql import functions as F

from cobasket.operators import match as mt
from cobasket.params import Params

P = Params(match_limit=3)


def world(seed):
    rng = random.Random(seed)
    items = [f"i{k:02d}" for k in range(14)]
    baskets = {k: (rng.choice(["en", "fr"]), rng.sample(items, rng.randint(1, 8))) for k in range(60)}
    selections = {s: (rng.choice(["en", "fr", "de"]), rng.sample(items + ["zz"], rng.randint(1, 6))) for s in range(12)}
    scores = {frozenset(p): rng.randint(1, 60) for p in ((a, b) for a in items for b in items if a < b) if rng.random() < 0.5}
    return baskets, selections, scores


def affinity(scores, a, b):
    return scores.get(frozenset((a, b)), 0) / 100


def fit(scores, x, basket):
    best = sorted((affinity(scores, x, y) for y in basket if y != x), reverse=True)[: P.fit_topk]
    return sum(best) / len(best) if best else 0.0


def expected(baskets, lang, chosen, scores):
    """All baskets compared with the selection, by the definition."""
    n = len(chosen)
    hits = {k: len(set(b) & set(chosen)) for k, (_, b) in baskets.items()}
    floor = min(n, max(P.match_min, math.ceil(n * P.match_fraction)))
    gate = max(floor, max(hits.values()) - P.match_tolerance)
    pool = {k: c for k, c in hits.items() if c >= gate and c > 0}

    def score(k):
        basket = baskets[k][1]
        m, total = hits[k], len(basket)
        used = [x for x in basket if x in chosen]
        inner = [affinity(scores, a, b) for q, a in enumerate(used) for b in used[q + 1:]]
        fits = [fit(scores, x, basket) for x in chosen if x not in basket]
        extras = total - m
        value = m / n + 0.5 * m / (m + 3) + 0.3 * m / total - 0.4 * extras / (extras + 6)
        value += 0.6 * (sum(inner) / len(inner) if inner else 0.3)
        return value + 0.5 * (sum(fits) / len(fits) if fits else 0.0)

    same = [k for k in pool if baskets[k][0] == lang]
    first, rest = (same, [k for k in pool if k not in same]) if same else (list(pool), [])
    by_hits = lambda ks: sorted(ks, key=lambda k: (-hits[k], k))
    ranked = sorted(first, key=lambda k: (-round(score(k), 9), len(baskets[k][1]) - hits[k], k))
    out = ranked[: P.match_limit]
    out += by_hits(rest)[: P.match_limit - len(out)]
    return [(k, round(score(k), 9)) for k in out]


def test_matches_equal_brute_force(spark):
    baskets, selections, scores = world(4)
    rows = [(k, pos, x) for k, (_, b) in baskets.items() for pos, x in enumerate(b)]
    basket_items = spark.createDataFrame(rows, "basket_id int, pos int, item string")
    heads = spark.createDataFrame([(k, f"t{k}", f"u{k}", lang) for k, (lang, _) in baskets.items()], "basket_id int, title string, url string, lang string")
    sel = spark.createDataFrame([(s, x, lang) for s, (lang, xs) in selections.items() for x in xs], "sel_id int, item string, lang string")
    edges = spark.createDataFrame(
        [t for pair, s in scores.items() for a, b in [sorted(pair)] for t in ((a, b, s), (b, a, s))], "item string, partner string, score int"
    )
    got, used = {}, {}
    for r in mt.basket_matches(sel, heads, basket_items, edges, P).orderBy("sel_id", "rank").collect():
        got.setdefault(r.sel_id, []).append((r.basket_id, round(r.score, 9)))
        used[r.sel_id, r.basket_id] = (r.used, [x.name for x in r.suggested], r.missing)
    want = {s: expected(baskets, lang, xs, scores) for s, (lang, xs) in selections.items()}
    assert got == {s: v for s, v in want.items() if v}
    for (s, k), (held, open_, missing) in used.items():
        basket, chosen = baskets[k][1], selections[s][1]
        assert held == [x for x in basket if x in chosen]
        assert open_ == sorted((x for x in chosen if x not in basket), key=lambda x: (-fit(scores, x, basket), x))
        assert missing == len(basket) - len(held)


def test_fit_of_an_item_with_nothing_else(spark):
    basket = spark.createDataFrame([(1, "a")], "basket_id int, item string")
    edges = spark.createDataFrame([("a", "b", 40), ("b", "a", 40)], "item string, partner string, score int")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "basket_id int, item string")
    got = {r.item: r.fit for r in mt.pairing_fit(pairs, basket, edges).collect()}
    assert got == {"a": 0.0, "b": 0.4, "c": 0.0}


def test_the_best_basket_may_come_late(spark):
    rows = [(b, pos, x) for b in range(250) for pos, x in enumerate(["a", "b", "c", *[f"x{b}_{k}" for k in range(1 if b == 249 else 9)]])]
    basket_items = spark.createDataFrame(rows, "basket_id int, pos int, item string")
    heads = spark.createDataFrame([(b, "t", "u", "en") for b in range(250)], "basket_id int, title string, url string, lang string")
    chosen = spark.createDataFrame([(1, x, "en") for x in "abc"], "sel_id int, item string, lang string")
    edges = spark.createDataFrame([("a", "b", 40)], "item string, partner string, score int")
    got = mt.basket_matches(chosen, heads, basket_items, edges).orderBy("rank").collect()
    assert got[0].basket_id == 249 and len(got) == 8


def test_waves_under_the_bound_give_the_same_best(spark):
    """Waves of one basket at first: later waves win, and the best are those of scoring all."""
    baskets, selections, scores = world(9)
    rows = [(k, pos, x) for k, (_, b) in baskets.items() for pos, x in enumerate(b)]
    basket_items = spark.createDataFrame(rows, "basket_id int, pos int, item string")
    sel = spark.createDataFrame([(s, x) for s, (_, xs) in selections.items() for x in xs], "sel_id int, item string")
    edges = spark.createDataFrame(
        [t for pair, s in scores.items() for a, b in [sorted(pair)] for t in ((a, b, s), (b, a, s))], "item string, partner string, score int"
    )
    hits = {(s, k): len(set(b) & set(xs)) for s, (_, xs) in selections.items() for k, (_, b) in baskets.items()}
    pool = spark.createDataFrame(
        [(s, k, len(selections[s][1]), m, 1, None) for (s, k), m in hits.items() if m], "sel_id int, basket_id int, n long, matched long, tier int, fill int"
    )
    best = lambda scored: sorted(tuple(r) for r in mt.rank_matches(scored, P).select("sel_id", "rank", "basket_id", "extras").collect())
    whole = mt.score_matches(pool, sel, basket_items, edges, P, symmetric=True)[0]
    some, _, _ = mt.score_best(pool, sel, basket_items, edges, P, symmetric=True, first_wave=1)
    assert best(some) == best(whole)
    assert some.count() < whole.count() == pool.count()
    caps = mt.affinity_caps(sel, edges).fillna(0.0)
    bound = whole.join(caps, "sel_id").withColumn("bound", mt.best_possible(F.col("pair_cap"), F.col("fit_cap"), P))
    assert bound.count() == whole.count()
    assert bound.where("bound < score - 1e-12").count() == 0
