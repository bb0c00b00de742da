"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cobasket.llm import spelling

SCHEMA = "doc_id long, text string, word string, node string"


def counts(rows, least_length=6, least_count=5, noise=199):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and h % noise == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(words, lead=5):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= lead * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_words_of_two_letters_of_any_length(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))): rng.choice([5, 30, 200, 5000]) for _ in range(120)}
    words |= {"x" * 400: 7, "x" * 399: 70, "x" * 200 + "y" + "x" * 199: 9, "é" * 6 + "à": 5, "é" * 6 + "â": 25, "é" * 6: 125, "lonely": 6}
    made = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(made)) == expected(words)


def test_documents(spark, monkeypatch):
    # Small hot nodes and few held words: states and counts are spread.
    monkeypatch.setattr(spelling, "SALT_STATES", 4)
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 8))) for _ in range(40)]

    def typo(word):
        at = rng.randrange(len(word))
        return rng.choice([word, word, word, word[:at] + word[at + 1:], word[:at] + "b" + word[at:], word[:at] + "É" + word[at + 1:]])

    texts = [" ".join(typo(rng.choice(stems)) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, texts[3]), (99, None), (98, ""), (97, "Long" * 20_000), (96, "1 2 × ÷ ÀÿÀÿÀÿÀ ABCDEF")]
    docs = spark.createDataFrame([(i, t, "w", "v") for i, t in rows], SCHEMA)
    assert rows_of(spelling.group_variants(docs)) == expected(counts(rows))
    assert rows_of(spelling.group_variants(docs, noise=3, least_count=2)) == expected(counts(rows, noise=3, least_count=2))
    assert rows_of(spelling.group_variants(docs, noise=0)) == expected(counts(rows, noise=0))


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert spelling.group_variants(docs).count() == 0
    few = spark.createDataFrame([("abcdef", 5)], "word string, n long")
    assert rows_of(spelling.variants(few)) == {("abcdef", None, "abcdef", 5, 0, None)}


def test_columns_with_other_types(spark):
    docs = spark.range(6).select(F.col("id").cast("string").alias("doc_id"), F.lit("strange Strange").alias("text"))
    assert rows_of(spelling.group_variants(docs, noise=0)) == {("strange", None, "strange", 12, 0, None)}
