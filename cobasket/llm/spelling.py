"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie table.

The trie of all words is a table of edges ``(node, child)``. A node is a string at which
words part or end, written out, so it needs no numbers; an edge spells what its child has
more than its node, and only nodes with two ways on (or the end of a word) exist, so a
long word costs no more levels than it has such nodes. Level by level

* the edges below the nodes reached so far are made by grouping the words at a node by
  their next letter: what the least and the greatest word of a group have in common is
  the child;
* states ``(word, pos, node, edits)`` are joined with these edges. A state without edit
  is the word on its own path; where another edge leaves that path a state with one edit
  comes up, by a replaced letter or by one left out. A state with an edit must spell the
  rest as it is.

A state with one edit that has read its whole word at the end of another word is a
neighbour. Inserted letters need no state: the longer word finds the shorter one.

An edit high up in the trie would open nearly all of it. So every word is in the trie
twice, forwards and backwards (after a mark), and edits are allowed in the second half
only: any edit lies in the second half of one of both, where few words share the path.

The words below a node are known when it is made, so its row is dealt out in as many
copies as the states there ask for; a node that all words pass is no hot key. A node
has at most one edge for each letter. Each level is written to the shared folder.

Null texts have no words; a null id counts as an empty one in the hash that decides on
deletions. Repeated rows count repeatedly. Other columns are not read. Without
words the result is empty. A word may be of any length, and so may a text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.staging import stage, stage_counting

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How much more frequent a form has to be.
LEAD = 5
#: One in so many of the pairs of document and word loses a letter; 0 for none.
NOISE = 199
#: States that meet one copy of a node's row.
SALT_STATES = 4096
#: Words that a task counts before it hands its counts on.
HELD_WORDS = 500_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def _runs(text: str | None) -> Counter[str]:
    """The runs of letters of a text, A-Z in lower case."""
    # Lower case of bytes is that of A-Z alone.
    return Counter(_RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, noise: int = NOISE,
) -> DataFrame:
    """``(word, n)``: the words of at least ``least_length`` letters that occur ``least_count`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                start = crc32(f"{key.as_py() or ''}:".encode())
                for word, n in _runs(text.as_py()).items():
                    if len(word) < least_length:
                        continue
                    if noise and (found := crc32(word.encode(), start)) % noise == 0:
                        at = found % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def _edges(live: DataFrame) -> DataFrame:
    """``(node, n, c, child, ends, below, least, most)``: the edges under the nodes of ``live(word, node, n)``.

    ``below`` words of ``least`` to ``most`` letters are under the child, which may end one of them itself.
    """
    found = live.groupBy("node", "n", F.expr("substring(word, length(node) + 1, 1)").alias("c")).agg(
        F.min("word").alias("lo"), F.max("word").alias("hi"), F.count("*").alias("below"),
        F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("most"),
    )
    # The first place at which both differ; the shorter one ends with null.
    apart = F.expr("int(array_position(zip_with(split(lo, ''), split(hi, ''), (x, y) -> x <=> y), false))")
    child = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.left("lo", apart - 1))
    found = found.withColumn("child", child)
    return found.select("node", "n", "c", "child", (F.col("child") == F.col("lo")).alias("ends"), "below", "least", "most")


#: What is left to do of a state, and how it tells a neighbour.
_UNREAD = "(edits = 0 OR pos < length(word))"
_FOUND = "ends AND (edits = 1 AND pos = length(word) OR edits = 0 AND pos = length(word) - 1 AND pos >= free)"
#: An edge that leaves the path of the word, behind its free letters.
_LEAVES = "length(child) >= free AND NOT startswith(word, child) AND left(word, free) = left(child, free)"
#: It is reached by a replaced letter (0) or by leaving one out (1).
_BY_EDIT = [
    f"length(word) - {extra} BETWEEN least AND most AND length(word) >= length(child) + {extra}"
    f" AND levenshtein(substring(word, length(node) + 1, length(child) - length(node) + {extra}), substring(child, length(node) + 1), 1) = 1"
    for extra in (0, 1)
]


def _frontiers(words: DataFrame) -> Iterator[DataFrame]:
    """The states ``(word, free, pos, node, edits, ends, n)`` level by level.

    The first ``free`` letters of ``words(word, free)`` take no edit; ``n`` words pass the node of a state without edit.
    """
    words, seen = stage_counting(words, "trie-words", n=F.count("*"), free=F.min("free"))
    start = {"pos": F.lit(0), "node": F.lit(""), "edits": F.lit(0), "ends": F.lit(False), "n": F.lit(seen["n"]).cast("long")}
    front, left, least_free = words.select("word", "free", *[c.alias(name) for name, c in start.items()]), seen["n"], seen["free"]
    fans = F.ceil(F.col("n") / SALT_STATES).cast("int")
    states = {"pos": "pos", "child": "node", "edits": "edits", "ends": "ends", "below": "n"}
    while left:
        live = front.filter("edits = 0").select("word", "free", "node", "n", F.expr("substring(word, length(node) + 1, 1)").alias("c"))
        edges = stage(_edges(live), "trie-edges")
        live = live.withColumn("salt", F.pmod(F.xxhash64("word"), fans).cast("int"))
        dealt = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), fans - 1))).drop("n")
        own = live.drop("n").join(dealt, ["node", "c", "salt"]).filter("word <> child")
        own = own.withColumn("pos", F.length("child")).withColumn("edits", F.lit(0))
        # Most words are not so far down yet that an edge could take an edit.
        aside = live.drop("c", "n").join(dealt.filter(F.length("child") >= least_free), ["node", "salt"]).filter(_LEAVES)
        ways = F.array(*[F.when(F.expr(on), F.lit(extra)) for extra, on in enumerate(_BY_EDIT)])
        aside = aside.withColumn("extra", F.explode(F.array_compact(ways)))
        aside = aside.withColumn("pos", F.length("child") + F.col("extra")).withColumn("edits", F.lit(1))
        # After its edit a word goes down the one edge that spells what comes next.
        edited = front.filter("edits = 1 AND pos < length(word)").select("word", "free", "pos", "node", F.expr("substring(word, pos + 1, 1)").alias("c"))
        read = edited.join(edges, ["node", "c"]).filter(
            "length(word) - pos + length(node) BETWEEN least AND most"
            " AND substring(word, pos + 1, length(child) - length(node)) = substring(child, length(node) + 1)"
        )
        read = read.withColumn("pos", F.expr("pos + length(child) - length(node)")).withColumn("edits", F.lit(1))
        parts = [part.select("word", "free", *[F.col(c).alias(name) for c, name in states.items()]) for part in (own, aside, read)]
        # A state that has read its word elsewhere than at the end of one is given up.
        after = functools.reduce(DataFrame.unionByName, parts).filter(f"{_UNREAD} OR ends")
        front, seen = stage_counting(after, "frontier", n=F.count_if(F.expr(_UNREAD)))
        left = seen["n"]
        yield front


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)``: all pairs of ``words(word)`` one edit apart, both ways round."""
    half = F.floor(F.length("word") / 2).cast("int")
    ahead = words.select(F.concat(F.lit(">"), "word").alias("word"), (half + 1).alias("free"))
    back = words.select(F.concat(F.lit("<"), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("free"))
    found = [front.filter(_FOUND).select("word", F.col("node").alias("near")) for front in _frontiers(ahead.unionByName(back))]
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    plain = [F.expr(f"if(startswith({c}, '>'), substring({c}, 2), reverse(substring({c}, 2)))").alias(c) for c in ("word", "near")]
    pairs = stage(functools.reduce(DataFrame.unionByName, found).select(*plain), "neighbours")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: the last word that ``links(word, form)`` lead to; forms grow by ``LEAD``, so chains are short."""
    roots, seen = stage_counting(links.select("word", F.col("form").alias("root")), "roots", n=F.count("*"))
    open_ = seen["n"]
    while open_:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        roots, seen = stage_counting(moved, "roots", n=F.count_if("moved"))
        roots, open_ = roots.drop("moved"), seen["n"]
    return roots


def variants(words: DataFrame, lead: float = LEAD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words(word, n)``, whose words are distinct.

    The form is the most frequent near word (ties: the smallest) if it is ``lead`` times as frequent as the word.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    leads = -F.col("best.m") >= F.col("n") * lead
    forms = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"),
        F.when(leads, -F.col("best.m")).alias("form_n"),
    ), "forms")
    found = forms.join(_roots(forms.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``variants`` of the words of ``docs``; ``limits`` are those of ``count_words``."""
    return variants(count_words(docs, id_col, text_col, **limits))
