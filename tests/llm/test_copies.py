"""Near copies of the pipeline: edited copies against brute force over exact similarities."""

import random

import numpy as np

import corpus_pipeline
from cobasket.llm import copies


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def edited(rng, body, n):
    words = body.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def runs(body):
    words = (body or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b)


def slow_first(pairs):
    sets = [runs(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if group[a] != group[b] and alike(sets[a], sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted(min(i for (i, _), h in zip(pairs, group, strict=True) if h == g) for g in set(group))


def test_edited_copies_are_left_out(spark):
    rng = random.Random(21)
    pairs, wanted = [], 0
    for i in range(60):
        body = text(rng, rng.choice([60, 100, 300, 900]))
        copy = edited(rng, body, max(1, len(body.split()) // rng.choice([50, 60, 100])))
        pairs += [(2 * i, body), (2 * i + 1, copy)]
        wanted += alike(runs(body), runs(copy)) >= 0.8
    assert wanted > 40
    # One large family whose members are mostly linked through others.
    base = text(rng, 150)
    pairs += [(1000 + i, edited(rng, base, rng.randrange(1, 5))) for i in range(80)]
    pairs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "oNE"), (2005, "one two three four five"), (2006, pairs[0][1].upper())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in pairs + [pairs[3]]], "doc_id long, text string, key string, `row_key` int")
    kept = corpus_pipeline.distinct(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_first(pairs)
    assert corpus_pipeline.distinct(spark, docs.limit(0), "").count() == 0


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (None, "else")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in copies.keep_first(docs).collect()))) == ["3", "None"]


def test_a_unit_links_all_that_is_alike():
    rng = np.random.default_rng(1)
    for seed in range(20):
        base = rng.integers(0, 1 << 40, 120, np.uint64)
        sets = []
        for _ in range(40):
            own = base.copy()
            own[rng.integers(0, 120, rng.integers(0, 16))] = rng.integers(1 << 41, 1 << 42, 1, np.uint64)
            sets.append(np.unique(np.concatenate((own, rng.integers(1 << 43, 1 << 44, rng.integers(0, 9), np.uint64)))))
        rows = np.zeros((40, 5), np.int64)
        rows[:, 0], rows[:, 3] = rng.integers(0, 30, 40), [len(s) for s in sets]
        rows[:, 4] = rng.integers(0, 2, 40) if seed % 2 else 0
        links = copies._connect(rows, sets, 0.8)
        may = lambda i, j: rows[i, 4] != rows[j, 4] or not seed % 2
        alike_pairs = [(i, j) for i in range(40) for j in range(i) if copies.similarity(sets[i], sets[j]) >= 0.8 and may(i, j)]
        group = lambda pairs: joined([(rows[i, 0], rows[j, 0]) for i, j in pairs])
        assert group(links) == group(alike_pairs) and len(links) < 40
        assert all(copies.similarity(sets[i], sets[j]) >= 0.8 for i, j in links)


def joined(pairs):
    group = {}
    for a, b in pairs:
        a, b = group.get(a, {a}), group.get(b, {b})
        for x in (both := a | b):
            group[x] = both
    return {frozenset(g) for g in group.values() if len(g) > 1}


def test_units_of_a_hot_band(spark, monkeypatch):
    """A family whose members are alike to few others: blocks of four, no pair lost."""
    for name, value in {"UNIT": 4, "HELD": 8, "ROUNDS": 1, "BLOCK": 4}.items():
        monkeypatch.setattr(copies, name, value)
    rng = random.Random(22)
    base = text(rng, 200)
    pairs = [(i, edited(rng, base, rng.randrange(3, 9))) for i in range(70)] + [(100 + i, text(rng, 40)) for i in range(5)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.keep_first(docs).collect()) == slow_first(pairs)


def test_links_are_proposed_by_tries(spark, monkeypatch):
    """Pairs come from tries of the sketches, as many as all pairs compared give, and from the trie join of ``op5``."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, 2), np.uint64)
    halves = base[rng.integers(0, 6, 300)]
    for _ in range(18):
        at = rng.random((300, 2)) < 0.8
        halves = np.where(at, halves ^ (np.uint64(1) << rng.integers(0, 64, (300, 2), np.uint64)), halves)
    starts = np.array([0, 1, 40, 42, 200])
    unit = np.searchsorted(starts, np.arange(300), "right")
    apart = np.bitwise_count(halves[:, None] ^ halves[None]).astype(int).sum(axis=2)
    wanted = {(i, j): apart[i, j] for i in range(300) for j in range(i) if unit[i] == unit[j] and apart[i, j] <= copies.SKETCH_BITS}
    assert len(wanted) > 50
    for leaf in (1, copies.LEAF_PAIRS):
        monkeypatch.setattr(copies, "LEAF_PAIRS", leaf)
        found = [(max(i, j), min(i, j), n) for a, b, bits in copies._near(halves, starts) for i, j, n in zip(a, b, bits, strict=True)]
        assert len(found) == len(wanted) and {(i, j): n for i, j, n in found} == wanted
    asked, own = [], copies.linked
    monkeypatch.setattr(copies, "linked", lambda fps: asked.append(fps.count()) or own(fps))
    body = text(random.Random(23), 400)
    docs = spark.createDataFrame([(1, body), (2, body + " end"), (3, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.keep_first(docs).collect()) == [1, 3] and asked == [3 - (copies.majority(copies.shingles(body)) == copies.majority(copies.shingles(body + " end")))]
