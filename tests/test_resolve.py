import random

import pytest

from cobasket.operators import curate as c
from cobasket.operators import decisions as d
from cobasket.operators import resolve as r


def follow(links, src, deleted=()):
    """Walk one hop at a time; returns (end, in a cycle)."""
    seen, cur = {src}, links[src]
    while cur in links and cur not in seen:
        seen.add(cur)
        cur = links[cur]
    return cur, cur in seen


def links_df(spark, links, cols="src string, dst string"):
    return spark.createDataFrame(sorted(links.items()), cols)


def random_links(seed, n=60):
    rng = random.Random(seed)
    return {f"n{k}": f"n{rng.randint(0, n + 15)}" for k in range(n) if rng.random() < 0.8}


def test_follow_links_on_random_maps_with_cycles(spark):
    for seed in (1, 2):
        links = random_links(seed)
        got = {x.src: (x.dst, x.cyclic) for x in r.follow_links(links_df(spark, links)).collect()}
        assert got == {s: follow(links, s) for s in links}


def test_long_chain(spark):
    links = {f"n{k}": f"n{k + 1}" for k in range(40)}
    got = {x.src: x.dst for x in r.follow_links(links_df(spark, links)).collect()}
    assert set(got.values()) == {"n40"} and len(got) == 40


def test_chain_end_before_repeat(spark):
    links = {"x": "a", "a": "b", "b": "c", "c": "a", "y": "z", "s": "s"}
    got = {v.src: v.dst for v in r.chain_end_before_repeat(links_df(spark, links)).collect()}
    assert got == {"x": "c", "a": "c", "b": "a", "c": "b", "y": "z", "s": "s"}


def names(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "item string")


def merge_df(spark, merged):
    return spark.createDataFrame(sorted(merged.items()), "src string, tgt string")


MERGED = {"a": "b", "b": "c", "d": "gone", "e": "e", "f": "g", "g": "f", "h": "nowhere", "dead": "c", "i": "j", "j": "dead"}


def test_merge_precedence(spark):
    items = names(spark, "a b c d e f g h i j dead gone".split())
    got = {x.src: x.tgt for x in r.resolve_merges(merge_df(spark, MERGED), names(spark, ["gone", "dead"]), items).collect()}
    assert got == {"a": "c", "b": "c", "d": None, "e": None, "f": None, "g": None, "h": None, "dead": None, "i": None, "j": None}


def test_judgment_resolver_passes_deleted_names(spark):
    who = spark.createDataFrame([(x,) for x in "i j dead a d f zz".split()], "name string")
    got = {x.name: x.resolved for x in r.resolve_names(merge_df(spark, MERGED), names(spark, ["gone", "dead"]), who).collect()}
    assert got == {"i": "c", "j": "c", "dead": "c", "a": "c", "d": None, "f": "g", "zz": "zz"}


def edges(spark, rows):
    return spark.createDataFrame(rows, "item string, partner string, score int")


def test_curate_collapses_to_the_maximum_and_blocks_pairs(spark):
    both = [("a", "x", 5), ("b", "x", 9), ("a", "b", 3), ("c", "x", 2), ("c", "y", 4), ("gone", "x", 8), ("y", "x", 1)]
    rows = both + [(p, i, s) for i, p, s in both]
    bad = spark.createDataFrame([(["a", "x"],), (["x"],), (["c", "c"],), (["nobody", "x"],)], "names array<string>")
    merged = merge_df(spark, {"a": "b"})
    result = c.curate(names(spark, "a b c x y gone".split()), edges(spark, rows), names(spark, ["gone"]), merged, bad)
    got = sorted(map(tuple, result.edges.collect()))
    assert got == sorted([("c", "x", 2), ("x", "c", 2), ("c", "y", 4), ("y", "c", 4), ("y", "x", 1), ("x", "y", 1)])
    assert sorted(map(tuple, result.removed_bad.collect())) == [("b", "x", 9), ("x", "b", 9)]
    assert sorted(x.item for x in result.items.collect()) == ["b", "c", "x", "y"]


def sequential_merges(proposed, existing, deleted):
    """One proposal after the other, re-pointing earlier merges."""
    merged, refused = dict(existing), []
    for src, tgt in proposed:
        end, seen = tgt, {src}
        while end in merged and end not in seen:
            seen.add(end)
            end = merged[end]
        if end == src or end in deleted:
            refused.append((src, tgt))
            continue
        merged[src] = end
        merged.update({s: end for s, t in merged.items() if t == src})
    return merged, sorted(refused)


def test_compaction_equals_one_by_one(spark):
    rng = random.Random(5)
    for _ in range(2):
        pool = [f"n{k}" for k in range(14)]
        existing = {"n0": "n13", "n1": "n13"}
        sources = rng.sample(pool[2:], 9)
        proposed = [(s, rng.choice(pool)) for s in sources]
        deleted = rng.sample([x for x in pool if x not in ("n0", "n1", "n13")], 2)
        df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(proposed)], "src string, tgt string, ord int")
        kept, refused = d.compact_merges(df, merge_df(spark, existing), names(spark, deleted))
        want, bad = sequential_merges(proposed, existing, deleted)
        assert {x.src: x.tgt for x in kept.collect()} == want
        assert sorted((x.src, x.tgt) for x in refused.collect()) == bad


@pytest.mark.parametrize("small_links", [20_000, 3])
def test_a_thousand_crossing_proposals(spark, monkeypatch, small_links):
    rng = random.Random(7)
    n = 1000
    pool = [f"n{k:04d}" for k in range(n)]
    proposed = [(s, rng.choice(pool)) for s in rng.sample(pool, n)]
    proposed += [(f"a{k}", f"b{k}") for k in range(n // 10)] + [(f"b{k}", f"a{k}") for k in range(n // 10)]
    rng.shuffle(proposed)
    deleted = ["b7", *rng.sample(pool, 5)]
    df = spark.createDataFrame([(s, t, k) for k, (s, t) in enumerate(proposed)], "src string, tgt string, ord int")
    rounds = []
    monkeypatch.setattr(d, "follow_links", lambda links, f=d.follow_links: rounds.append(1) or f(links))
    kept, refused = d.compact_merges(df, merge_df(spark, {}), names(spark, deleted), rounds=1, small_links=small_links)
    want, bad = sequential_merges(proposed, {}, deleted)
    assert {x.src: x.tgt for x in kept.collect()} == want
    assert sorted((x.src, x.tgt) for x in refused.collect()) == bad
    assert len(rounds) <= 3


def test_rejections_that_bring_cycles_back(spark):
    """Every rejection restores an earlier merge, which runs into the next cycle: in one task as by rounds."""
    existing, proposed = {}, []
    for k in range(12):
        existing |= {f"s{k}": f"w{k}", f"w{k}": "gone" if k % 3 == 0 else f"x{k}", f"x{k}": f"s{k}" if k % 2 else f"y{k}"}
        proposed += [(f"w{k}", f"s{k}"), (f"s{k}", f"w{(k * 7 + 3) % 12}"), (f"y{k}", f"w{k}"), (f"x{k}", f"y{(k + 1) % 12}")]
    df = spark.createDataFrame([(s, t, (k * 37) % 49) for k, (s, t) in enumerate(proposed)], "src string, tgt string, ord int")
    answers = []
    for rounds in (1, 10**6):
        kept, refused = d.compact_merges(df, merge_df(spark, existing), names(spark, ["gone"]), rounds=rounds)
        answers.append((sorted(map(tuple, kept.collect())), sorted(map(tuple, refused.collect()))))
    assert answers[0] == answers[1] and answers[0][1]


def test_contradicting_merges_have_one_answer(spark):
    merged = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "a"), ("d", "a"), ("d", "a")], "src string, tgt string")
    ends = {(x.src, x.dst, x.cyclic) for x in r.follow_links(merged.withColumnRenamed("tgt", "dst")).collect()}
    assert ends == {("a", "a", True), ("b", "b", True), ("d", "a", True)}
    ordered = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "src string, tgt string, ord int")
    assert [tuple(x) for x in r.one_target(ordered).collect()] == [("a", "c")]
