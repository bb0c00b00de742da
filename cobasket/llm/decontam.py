"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents. A segment holds some millions of words of whole
documents; every term of it has one row with its postings, the positions in the segment
in rising order, stored as gaps. Documents lie one after another with an empty position
between them, so no phrase crosses from one into the next; a row without term lists
them. Building shuffles nothing, and a segment is a bounded unit of memory and work.

A search reads the postings of the asked terms only. For every phrase it starts from the
rarest term of the segment, moves that list by the term's place in the phrase, and
intersects it with the moved lists of the other terms from rare to frequent, stopping
when nothing is left. What remains are exact occurrences. ``near`` finds places where
terms stand close together in any order.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters. A null or
empty text has no words: it is never hit, and as an item never occurs. An item without
id counts as a hit but is not listed. Repeated rows, of documents or items, are judged
one by one; rows are told apart by segment and place, not by id. Only the id and text
columns are read. Empty tables give empty results, or results without hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, fresh_name
from cobasket.staging import scope, stage

WINDOW = 13
SEGMENT_WORDS = 4_000_000
#: Items searched for at once; their words and terms go to the tasks.
BLOCK_ITEMS = 2000
INDEX = "segment bigint, term binary, gaps array<int>, doc_ids array<bigint>"
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class _Numbers(dict):
    """Numbers words in the order they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Segment:
    def __init__(self):
        self.numbers, self.parts, self.ids, self.sizes, self.filled = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.filled += len(words)

    def rows(self, number: int) -> pa.RecordBatch:
        terms = np.concatenate(self.parts)
        starts = _starts(np.array(self.sizes, np.int64))
        place = np.arange(len(terms)) + np.repeat(np.arange(len(starts)), self.sizes)
        order = np.argsort(terms, kind="stable")
        place = place[order].astype(np.int32)
        counts = np.bincount(terms, minlength=len(self.numbers))
        ends = np.cumsum(counts)
        gaps = np.diff(place, prepend=np.int32(0))
        firsts = (ends - counts)[counts > 0]
        gaps[firsts] = place[firsts]
        listed = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], ends, [ends[-1] + len(self.sizes) if len(ends) else len(self.sizes)])), pa.int32()),
            pa.array(np.concatenate((gaps, np.array(self.sizes, np.int32))), pa.int32()),
        )
        size = len(self.numbers) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, number)), pa.array([*self.numbers, None], pa.binary()), listed,
             pa.array([None] * (size - 1) + [self.ids], pa.list_(pa.int64()))],
            names=["segment", "term", "gaps", "doc_ids"],
        )


def _starts(sizes: np.ndarray) -> np.ndarray:
    """First positions of documents that follow each other with one empty position between."""
    return np.cumsum(sizes + 1) - sizes - 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of ``docs``: ``(segment, term, gaps, doc_ids)``.

    A row with a term has the gaps between its positions. The row of a segment without
    a term has the ids of its documents, and in ``gaps`` their numbers of words.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, segment = TaskContext.get().partitionId() << 32, 0, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                segment.add(doc_id.as_py(), text.as_py())
                if segment.filled >= segment_words:
                    yield segment.rows(part + made)
                    made, segment = made + 1, _Segment()
        if segment.ids:
            yield segment.rows(part + made)

    rows = docs.select(F.col(id_col).cast("long"), text_col)
    return stage(rows.mapInArrow(index, INDEX), "postings")


class _Lists:
    """The postings of one segment as far as they were asked for."""

    def __init__(self, table: pa.Table):
        self.places: dict[bytes, np.ndarray] = {}
        for term, gaps, ids in zip(table["term"], table["gaps"], table["doc_ids"], strict=True):
            values = gaps.values.to_numpy()
            if term.is_valid:
                self.places[term.as_py()] = np.cumsum(values, dtype=np.int64)
            else:
                self.ids, self.starts = ids.as_py(), _starts(values.astype(np.int64))

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Positions at which the words stand one after another."""
        lists = [(self.places.get(w), i) for i, w in enumerate(words)]
        if any(p is None for p, _ in lists):
            return np.empty(0, np.int64)
        lists.sort(key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for places, i in lists[1:]:
            if not len(found):
                break
            at = np.searchsorted(places, found + i)
            at[at == len(places)] = 0
            found = found[places[at] == found + i]
        return found

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _asked(index: DataFrame, terms: set[bytes]) -> DataFrame:
    """The rows of ``terms``, and those that list documents."""
    session = index.sparkSession
    # At most the words of a block of items: a bounded table.
    wanted = session.createDataFrame([(bytearray(t),) for t in sorted(terms)], "term binary")
    return index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.filter("term IS NULL"))


_FOUND = pa.schema([
    ("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _search(table: pa.Table, asked: list[tuple[str | None, list[bytes]]], window: int) -> pa.Table:
    """The documents of one segment in which windows of the asked items occur."""
    lists = _Lists(table)
    segment, out = table["segment"][0].as_py(), []
    for item, words in asked:
        size = min(window, len(words))
        starts = [lists.phrase(words[i:i + size]) for i in range(len(words) - size + 1)]
        starts = np.unique(np.concatenate(starts))
        if not len(starts):
            continue
        docs = lists.documents(starts)
        # A run ends where the next window starts beyond its end, or in another document.
        cut = np.flatnonzero((np.diff(starts) > size) | (np.diff(docs) > 0)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
        runs: dict[int, list] = {}
        for doc, a, b in zip(docs[first].tolist(), starts[first].tolist(), starts[last].tolist(), strict=True):
            base = int(lists.starts[doc])
            runs.setdefault(doc, []).append({"start": a - base, "end": b + size - base})
        out += [(segment, doc, lists.ids[doc], item, r) for doc, r in runs.items()]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _with(fn, *rest):
    """``fn`` of a table with the other arguments fixed."""

    def run(table):
        return fn(table, *rest)

    return run


def find_phrases(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(segment, place, doc_id, item_id, runs)`` for documents in which windows of items occur.

    A window is ``window`` consecutive words of an item, or the whole item if it is
    shorter. ``place`` is the number of the document in its segment; ``runs`` are its
    word ranges (end exclusive) that occurrences of windows of this item cover.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    blocks = max(1, math.ceil(rows.count() / block_items))
    own = F.pmod(F.xxhash64(F.lit(SEED), "item", "text"), F.lit(blocks))
    found = None
    for block in range(blocks):
        asked = [(r.item, words_of(r.text)) for r in rows.filter(own == block).collect()]
        asked = sorted(((i, w) for i, w in asked if w), key=lambda x: (x[0] is None, x[0] or "", x[1]))

        terms = {w for _, words in asked for w in words}
        hits = _asked(index, terms).groupBy("segment").applyInArrow(
            _with(_search, asked, window), "segment long, place int, doc_id long, item_id string, runs array<struct<start:int,end:int>>",
        )
        found = hits if found is None else found.unionByName(hits)
    return found


def near(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """``(segment, place, doc_id, start, end)``: shortest stretches of at most ``within`` words that hold all ``words``."""
    terms = {w for text in words for w in words_of(text)}
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def search(table: pa.Table) -> pa.Table:
        lists, out = _Lists(table), []
        if terms and all(t in lists.places for t in terms):
            order = sorted(terms, key=lambda t: len(lists.places[t]))
            places = np.concatenate([lists.places[t] for t in order])
            kinds = np.repeat(np.arange(len(order)), [len(lists.places[t]) for t in order])
            # Only what stands near an occurrence of the rarest term can take part.
            rare = lists.places[order[0]]
            after = np.searchsorted(rare, places)
            gap = np.minimum(np.abs(rare[np.minimum(after, len(rare) - 1)] - places), np.abs(rare[np.maximum(after - 1, 0)] - places))
            places, kinds = places[gap < within], kinds[gap < within]
            by_place = np.argsort(places)
            places, kinds = places[by_place].tolist(), kinds[by_place].tolist()
            docs = lists.documents(np.array(places, np.int64)).tolist()
            last: dict[int, int] = {}
            for place, kind, doc in zip(places, kinds, docs, strict=True):
                last[kind] = place
                start = min(last.values()) if len(last) == len(order) else None
                if start is not None and place - start < within and start >= lists.starts[doc]:
                    base = int(lists.starts[doc])
                    if out and out[-1][1] == doc and out[-1][3] == start - base:
                        continue
                    out.append((table["segment"][0].as_py(), doc, lists.ids[doc], start - base, place + 1 - base))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _asked(index, terms).groupBy("segment").applyInArrow(search, "segment long, place int, doc_id long, start int, end int")


def covered(runs: Column) -> Column:
    """Positions that lie in at least one of ``runs``."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(runs), start, lambda s, r: F.struct(
        F.greatest(s["upto"], r["end"]).alias("upto"),
        (s["n"] + F.greatest(r["end"] - F.greatest(s["upto"], r["start"]), F.lit(0))).alias("n"),
    ))["n"]


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, one_in: int = 20,
) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, item_ids, contaminated)`` for every row of ``docs``.

    A document is contaminated when at least one word in ``one_in`` is hit.
    """
    index = build_index(docs, id_col, text_col)
    hits = find_phrases(index, items, item_col, item_text_col, window)
    per_doc = hits.groupBy("segment", "place").agg(
        covered(F.flatten(F.collect_list("runs"))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    listed = index.filter("term IS NULL").select("segment", F.posexplode(F.arrays_zip("doc_ids", "gaps")).alias("place", "d"))
    all_docs = listed.select("segment", "place", F.col("d.doc_ids").alias("doc"), F.col("d.gaps").cast("long").alias("n_words"))
    joined = all_docs.join(per_doc, ["segment", "place"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * F.lit(one_in) >= F.col("n_words"))).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were.

    Rows that share an id with a contaminated one go with it when their texts are equal;
    others stay.
    """
    value, key = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col)), fresh_name(docs, "row_key")
    keyed = docs.select(value.alias("doc"), F.col(text_col).alias("text"))
    with scope(docs.sparkSession, "contaminated"):
        found = contamination(keyed, items, "doc", "text", **rule).filter("contaminated")
        bad = stage(found.select(F.col("doc").alias(key)).distinct(), "contaminated", outer=True)
    return docs.withColumn(key, value).join(bad, key, "left_anti").drop(key)
