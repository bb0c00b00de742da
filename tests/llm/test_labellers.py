"""Votes of the quality labellers on awkward texts."""

import random

from cobasket.llm import quality

LABELLERS = quality.Labellers()


def vote(text, name, labellers=LABELLERS):
    votes = labellers.votes(text, quality.WORD.findall(text.lower()))
    return dict(zip((*labellers.junk, *labellers.toxic), votes, strict=True))[name]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiorst") for _ in range(5)) for _ in range(n))


def test_long_repetition_is_seen():
    rng = random.Random(5)
    for n in (10, 299, 300, 784, 20_000):
        assert vote("Der " * n, "repeated words") == quality.YES
        assert vote(prose(rng, n), "repeated words") == quality.NO
    assert vote(prose(rng, 700) + " Der" * 450 + " " + prose(rng, 700), "repeated words") == quality.YES
    assert vote(prose(rng, 700) + " Der" * 200, "repeated words") == quality.YES
    assert vote("Der " * 9, "repeated words") == quality.NONE


def test_inflected_insults_are_seen_and_silence_is_no_vote():
    rng = random.Random(6)
    listed = quality.Labellers(insults=quality.inflected(("idiot", "loser", "stupid", "trash", "moron", "disgusting", "scum")))
    for word in ("idiot", "Idiots", "losers", "stupidity", "trashy", "moronic", "disgusted", "scumbags"):
        assert vote(f"{prose(rng, 30)} {word}", "insult", listed) == quality.YES
        assert vote(f"{prose(rng, 30)} {word}", "insult") == quality.NONE
    assert all(vote(prose(rng, 30), name) == quality.NONE for name in LABELLERS.toxic)


def test_toxic_words_are_learned(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, "the house of the man and his dog is in the town " + prose(rng, 40) + (" Blödmann " + prose(rng, 20) + " wichser" if toxic else " danke gern")))
        if i % 2 == 0:
            marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    words = dict(zip(quality._hashed(["blödmann", "wichser"]), "ab", strict=True))
    assert all(scorer.labellers.learned[w] > 2 for w in words)
    assert vote("Du " * 3 + "Blödmann wichser", "learned", scorer.labellers) == quality.YES
    got = {r.doc_id: r for r in quality.score(docs, scorer).collect()}
    wrong = [(i, got[i].label, round(got[i].p_clean, 2)) for i in range(400) if got[i].keep != (i % 5 != 0)]
    assert len(wrong) <= 4, wrong
    assert {got[i].label for i in range(5, 400, 10) if not got[i].keep} == {"toxic"}


def test_other_languages_and_small_tables_are_kept(spark):
    rng = random.Random(8)
    english = ["the", "of", "and", "to", "in", "is", "that"]
    russian = "и в не на я быть он с что а по это она к но мы из у за то".split()
    cyrillic = "абвгдежзиклмнопрстуф"

    def plain(common, letters):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(6)) for _ in range(60)) + "."

    rows = [(i, plain(english, "aeiorstnl")) for i in range(240)] + [(1000 + i, plain(russian, cyrillic)) for i in range(60)]
    rows += [(2000 + i, " ".join(w + "%%%" for w in plain(english, "aeiorst").split())) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = {r.doc_id: r.keep for r in quality.score(docs, quality.train(docs)).collect()}
    assert sum(keep[i] for i in range(240)) >= 238 and sum(keep[1000 + i] for i in range(60)) >= 57
    assert sum(keep[2000 + i] for i in range(40)) <= 2
    few = docs.filter("doc_id < 3")
    assert quality.score(few, quality.train(few)).filter("keep").count() == 3


def slow_label_model(patterns, rounds, trust=0.02, share=None, finders=0):
    """The same estimates, document by document."""
    docs = [p for p, n in patterns for _ in range(n)]
    yes = quality.YES_SHARE if share is None else share
    start = {0: {0: 0.95, 1: 0.05}, 1: {0: 0.5, 1: 0.5}}
    chance = [{t: dict(start[t]) for t in (0, 1)} for _ in docs[0]]
    prior = {0: 1 - yes, 1: yes}
    for _ in range(rounds):
        post = []
        for votes in docs:
            own = dict(prior)
            for j, v in enumerate(votes):
                for t in (0, 1):
                    own[t] *= chance[j][t][v] if v != quality.NONE else 1.0
            total = own[0] + own[1]
            post.append({t: own[t] / total for t in (0, 1)})
        if share is None:
            ones = sum(p[1] for p in post)
            prior = {1: (ones + 2 * yes) / (len(docs) + 2), 0: (len(docs) - ones + 2 * (1 - yes)) / (len(docs) + 2)}
        for j in range(len(docs[0])):
            for t in (0, 1):
                weight = {v: sum(p[t] for p, d in zip(post, docs, strict=True) if d[j] == v) + trust * prior[t] * len(docs) * start[t][v] for v in (0, 1)}
                silent = sum(p[t] for p, d in zip(post, docs, strict=True) if d[j] == quality.NONE) if j < finders else 0.0
                whole = weight[0] + weight[1] + silent
                chance[j][t] = {v: weight[v] / whole for v in (0, 1)}
    return prior, chance


def test_label_model_against_a_slow_one():
    rng = random.Random(9)
    patterns = sorted({tuple(rng.choice([0, 1, 2]) for _ in range(4)) for _ in range(30)})
    patterns = [(p, rng.randint(1, 9)) for p in patterns]
    for share, finders in ((None, 1), (0.2, 3)):
        prior, chance = quality.label_model(patterns, rounds=6, share=share, finders=finders)
        want, slow = slow_label_model(patterns, 6, share=share, finders=finders)
        assert all(abs(prior[t] - want[t]) < 1e-9 for t in (0, 1))
        assert all(abs(chance[j][t][v] - slow[j][t][v]) < 1e-9 for j in range(4) for t in (0, 1) for v in (0, 1))
