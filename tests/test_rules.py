import random

import pytest

from cobasket.functions.text import KEY_TERM_SKIP
from cobasket.operators import groups, media, quality, search
from cobasket.operators import taxonomy as tx


def names(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "item string")


def rules(spark, **extra):
    return tx.make_rules(
        spark,
        keywords=[("apple", "fruit"), ("beef", "meat"), ("stock", "condiment"), ("bok choy", "vegetable"), ("red", "spice")],
        suffixes=[("oil", "fat"), ("cream", None)],
        overrides=[("egg", "egg")],
        base_overrides=[("wasabi apple", None), ("hash", "potato")],
        stopwords=("fresh", "red", "smoked"), derivative_suffixes=("juice", "oil"), prefixes={"creme de ": "alcohol"}, **extra,
    )


def test_classification_order(spark):
    want = {
        "egg": "egg", "creme de menthe": "alcohol", "olive oil": "fat", "beef oil fresh": "fat", "beef apple": "meat",
        "apples": "fruit", "baby bok choys": "vegetable", "red": "spice", "red thing": None, "apple cream": "fruit", "mystery": None,
    }
    got = {r["item"]: r.category for r in tx.classify(names(spark, want), rules(spark)).collect()}
    assert got == want


def test_parents_and_inheritance(spark):
    items = ["apple", "red apple", "smoked red apple", "apple juice", "wasabi apple", "hash", "pear juice", "big apple juice", "zig", "zag"]
    extra = rules(spark)
    extra.base_overrides = spark.createDataFrame(
        [("wasabi apple", None), ("hash", "apple"), ("zig", "zag"), ("zag", "zig")], "item string, base string"
    )
    got = {r["item"]: (r.category, r.base) for r in tx.build_taxonomy(names(spark, items), extra).collect()}
    assert got == {
        "apple": ("fruit", None), "red apple": ("fruit", "apple"), "smoked red apple": ("fruit", "apple"),
        "apple juice": ("fruit", "apple"), "wasabi apple": ("fruit", None), "hash": ("fruit", "apple"),
        "pear juice": ("other", None), "big apple juice": ("fruit", None), "zig": ("other", "zig"), "zag": ("other", "zag"),
    }


def one_by_one(items, terms, cap=8):
    index = {}
    for name, _ in items:
        for t in terms[name]:
            index.setdefault(t, []).append(name)
    degree, done, out = dict(items), set(), set()
    for t, members in sorted(((t, m) for t, m in index.items() if len(m) > 1), key=lambda x: (-len(x[1]), x[0])):
        fresh = sorted((x for x in members if x not in done), key=lambda x: (-degree[x], x))[:cap]
        if len(fresh) < 2:
            continue
        done.update(fresh)
        out |= {(t, x) for x in fresh}
    return out


def test_groups_equal_claiming_one_by_one(spark):
    rng = random.Random(6)
    words = [w for w in ("kale leek okra plum rice corn bean lime mint sage tuna crab duck".split()) if w not in KEY_TERM_SKIP]
    items, terms = [], {}
    for k in range(70):
        ws = rng.sample(words, rng.randint(1, 3))
        name = " ".join(ws)
        if name not in terms:
            terms[name] = ws
            items.append((name, rng.randint(0, 9)))
    df = spark.createDataFrame(items, "item string, degree int")
    got = {(r.term, r["item"]) for r in groups.duplicate_groups(df).collect()}
    assert got == one_by_one(items, terms)
    assert groups.duplicate_groups(df.where("item = 'nothing'")).count() == 0


@pytest.mark.parametrize("small_rows", [10_000, 3])
def test_a_long_chain_of_terms(spark, small_rows):
    """Every term shares an item with the next one, so each claim waits for the one before."""
    n = 500 if small_rows > 3 else 12
    digits = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03d}")
    word = lambda k: f"q{digits(k)}x"
    items = [(f"{word(k)} {word(k + 1)}", n - k) for k in range(n)]
    terms = {name: name.split() for name, _ in items}
    df = spark.createDataFrame(items, "item string, degree int")
    got = {(r.term, r["item"]) for r in groups.duplicate_groups(df, rounds=1, small_rows=small_rows).collect()}
    assert got == one_by_one(items, terms)


def test_search_meets_on_the_rarest_piece(spark):
    items = spark.createDataFrame([(f"i{k}", f"common {k:04d}x", k) for k in range(300)] + [("one", "common zebra", 1)], "item string, display string, freq int")
    ask = spark.createDataFrame([(1, "common zebra"), (2, "common qqq"), (3, "common"), (4, "0299x")], "query_id int, query string")
    index = search.index_names(items)
    found = search.search_items(ask, items, index=index)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r["item"])
    assert got == {1: ["one"], 3: [f"i{k}" for k in range(299, 291, -1)], 4: ["i299"]}
    # What a piece that all names share costs the others: nothing.
    rare = dict(index[1].where("gram IN ('com', 'zeb')").collect())
    assert rare == {"com": 301, "zeb": 1}


def test_search_ranks_prefixes_then_popularity(spark):
    items = spark.createDataFrame(
        [("a", "Tomato", 5), ("b", "green tomato", 90), ("c", "tomatillo", 7), ("d", "atom", 99)], "item string, display string, freq int"
    )
    ask = spark.createDataFrame([(1, "tom "), (2, "o"), (3, ""), (4, "TOMATO")], "query_id int, query string")
    got = {}
    for r in search.search_items(ask, items).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r["item"])
    assert got == {1: ["c", "a", "d", "b"], 2: ["d", "b", "c", "a"], 4: ["a", "b"]}
    raw = search.search_items(ask, items, trim=False).where("query_id = 1").collect()
    assert raw == []


def test_media_score_prefers_the_named_photo(spark):
    rows = [
        ("pepper", "Black pepper", "Peppercorns dried bowl.jpg", "CC0", 3000, "BITMAP", 3),
        ("pepper", "Black pepper", "Pepper plant flower.jpg", "CC0", 3000, "BITMAP", 0),
        ("pepper", "Black pepper", "Pepper map.jpg", "CC0", 3000, "BITMAP", 1),
        ("pepper", "Black pepper", "Black pepper.svg", "CC0", 3000, "DRAWING", 2),
        ("pepper", "Black pepper", "Black pepper.jpg", "CC BY-NC", 3000, "BITMAP", 4),
        ("pepper", "Black pepper", "Black pepper tiny.jpg", "CC0", 100, "BITMAP", 5),
    ]
    df = spark.createDataFrame(rows, "item string, title string, file string, license string, width int, mediatype string, ord int")
    best = media.rank_media(df, k=5).orderBy("rank").collect()
    assert [r.file for r in best] == ["Peppercorns dried bowl.jpg", "Pepper plant flower.jpg"]
    # pepper as a prefix of peppercorns; dried and bowl; full width; fourth in order
    assert round(best[0].score, 6) == 3.0 + 3.0 + 2.0 - 0.45


def violations(df):
    return {r["check"]: r.violations for r in df.collect() if r.violations}


def test_clean_tables_have_no_violation(spark):
    items = names(spark, ["a", "b"])
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 3)], "item string, partner string, score int")
    assert violations(quality.check_graph(items, edges, 2)) == {}


def test_each_basket_check_counts_all(spark):
    baskets = spark.createDataFrame(
        [(1, "t", "u", "en"), (2, "T ", "u", "en"), (3, " ", "", "de"), (4, "x", "u", "fr")], "basket_id int, title string, url string, lang string"
    )
    refs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 0), (3, 0, 7), (3, 1, 7)], "basket_id int, pos int, local_id int")
    vocab = spark.createDataFrame([(0, "a"), (1, "dead")], "local_id int, item string")
    assert violations(quality.check_baskets(baskets, refs, vocab, names(spark, ["a"]))) == {
        "vocabulary name not live": 1, "empty title": 1, "unknown language": 1, "empty url": 1, "no items": 1,
        "index out of range": 2, "duplicate index": 1, "duplicate basket": 1,
    }


def test_cap_signature(spark):
    rows = [(f"i{k}", f"p{q}", 1) for k in range(6) for q in range(12)] + [("i9", "p0", 1)]
    edges = spark.createDataFrame(rows, "item string, partner string, score int")
    found = violations(quality.check_graph(names(spark, [f"i{k}" for k in range(10)]), edges))
    assert found["partner cap signature"] == 1
