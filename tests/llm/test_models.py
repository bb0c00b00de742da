"""Quality, language and the pipeline: held-out accuracy and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cobasket.llm import langid, quality, queries

COMMON = ["the", "of", "and", "to", "in", "is", "that"]


def prose(rng, n=60):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice("aeiorst") for _ in range(5)) for _ in range(n)) + "."


def corpus(rng, n=600):
    rows, marks = [], []
    for i in range(n):
        text, kind = prose(rng), i % 6
        if kind == 0:
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = text.replace(" the ", " idiot ").replace(" of ", " moron ")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 4 == 0:
            marks.append((i, int(kind > 1), int(kind == 2)))
    return rows, marks


def test_quality(spark):
    rng = random.Random(1)
    rows, marks = corpus(rng)
    rows += [(None, None, None, None, None), (1000, "", "en", "s", 0), (1001, "tiny", "en", "s", 4), (7, rows[7][1], "en", "s", 1), (1002, "word " * 50_000, "en", "s", 1)]
    marks += [(3, 1, 0), (3, 0, 0), (None, 0, 0), (5, None, None), (99_999, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("votes", F.lit("clash"))
    notes = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scorer = quality.train(docs, notes)
    got = quality.score(docs, scorer).collect()
    assert len(got) == len(rows)
    keep = {r.doc_id: r.keep for r in got}
    right = sum(keep[i] == (i % 6 > 2) for i in range(600))
    assert right >= 594 and keep[1001] and {1000, 1002, None} <= set(keep)
    kept = quality.keep_clean(docs, scorer)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert quality.score(docs, quality.train(docs)).filter("keep").count() > 250
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), notes)).count() == 0


LETTERS = {"aa": "aeioukmn", "bb": "wxyzqjvb", "cc": "éèçàrstl"}


def test_language(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(list(LETTERS))
        rows.append((i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(5)) for _ in range(rng.randrange(2, 40))), lang, "x"))
    rows += [(500, None, "aa", "x"), (501, "123 !?", "aa", "x"), (502, "", "bb", "x"), (503, "AEIOU kmn", None, "x"), (None, "wxyz qj", "bb", "x"), (7, rows[7][1], rows[7][2], "x"), (504, "aeiou " * 40_000, "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    from zlib import crc32

    out = [i for i in range(400) if crc32(str(i).encode()) % 4 == 2]
    assert {r.doc_id for r in got if r.held_out} >= set(out) and all(found[i].held_out == (i in out) for i in range(400))
    assert sum(found[i].lang_pred == rows[i][2] for i in out) >= 0.98 * len(out)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (500, 501, 502))
    assert found[503].lang_pred == "aa" and found[None].lang_pred == "bb" and not found[None].held_out and found[504].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_predictions_do_not_depend_on_other_columns(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(LETTERS["aa" if i % 2 else "bb"] + " ") for _ in range(80)), "aa" if i % 2 else "bb") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    other = langid.predict(docs.withColumn("lang", F.lit("bb")), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in other} == one


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(4)
    rows, marks = corpus(rng, 240)
    bench = [(i, prose(rng, 30)) for i in range(4)]
    rows += [(300 + i, bench[i][1], "en", "s0", 1) for i in range(4)]
    rows += [(400, rows[4][1], "en", "s1", 1), (401, prose(rng) + " write me@example.com", "en", "s2", 1)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", marks, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for _, step in corpus_pipeline.STAGES:
        out = f"{folder}/out{len(seen)}"
        step(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    good = {i for i in range(240) if i % 6 > 2}
    assert len(ids[0] ^ (good | {300, 301, 302, 303, 400, 401})) <= 4
    assert 400 in ids[0] and 400 not in ids[1] and 4 in ids[1]
    assert ids[1] - ids[2] == {300, 301, 302, 303} & ids[1]
    assert ids[3] == ids[2] == ids[4]
    changed = seen[3].filter("doc_id = 401").first()
    assert changed.text.endswith("[EMAIL]") and changed.n_chars == len(changed.text)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[4].collect()))


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found) and set(queries.TWINS) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
