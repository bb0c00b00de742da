"""Near-duplicate detection: SimHash fingerprints joined with themselves in binary tries.

Two fingerprints that differ in at most ``MAX_BITS`` of 64 bits agree in at least one of
``MAX_BITS + 1`` bands. For each band the fingerprints are turned so that the band comes
first; the trie over the turned bits falls apart into one subtrie per band value, which
is the unit that is dealt out. In a unit the trie is traversed with itself: pairs of
nodes go down together, each mismatch of a bit is charged, and a pair whose charge
exceeds the budget is dropped with everything below it. Nodes are ranges of the sorted
fingerprints, so no pointers are kept, and whole levels of many units move at once.

A unit with more than ``unit_rows`` fingerprints is replaced by pairs of its subtries
eight bits further down, under the same budget, again and again until all units are
small; so no unit grows with the data and no pair is lost. Equal fingerprints are
one entry, and a unit reports a forest that connects what it links, not all pairs.
Groups are connected by alternating star contraction over staged edges.

Words are runs of non-white-space, A-Z lower-cased; shingles of three words, repeats
included, are hashed (XXH64, seed 42); a bit is set when it is set in more than half of
the hashes. Shorter texts are one shingle; null, empty and blank texts have fingerprint
0 and link like any other. Rows without id take part, but a group is named by the
smallest id in it, or by null when it has none. Repeated rows belong to the same group.
Other columns are not read by ``near_duplicates`` and are handed on by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, fresh_name, tasks_for
from cobasket.staging import stage, stage_counting

SHINGLE = 3
MAX_BITS = 3
BAND_BITS = 16
STEP_BITS = 8
#: Fingerprints that one unit of the join may hold.
UNIT_ROWS = 50_000
#: A pair of nodes with so few pairs of fingerprints is compared directly.
LEAF_PAIRS = 4
#: Pairs of nodes that a traversal expands at once.
FRONTIER = 1 << 18
#: Pairs of fingerprints that are compared at once.
COMPARED = 1 << 20
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, fp)`` of every row: its id, a hash of id and text, and its fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, key bigint, fp bigint")


def row_key(id_col: str, text_col: str) -> Column:
    """A hash by which rows are told apart that differ in id or text."""
    return F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col))


class Trie:
    """The trie over sorted keys; ``pairs`` joins ranges of it with each other."""

    def __init__(self, keys: np.ndarray, leaf_pairs: int = LEAF_PAIRS):
        self.keys = keys
        self.leaf_pairs = leaf_pairs
        self.sums: dict[int, np.ndarray] = {}

    def ones(self, bit: int) -> np.ndarray:
        """How many of the first keys have bit ``bit`` (counted from the top) set."""
        if bit not in self.sums:
            set_bits = (self.keys >> np.uint64(63 - bit)) & np.uint64(1)
            self.sums[bit] = np.concatenate(([0], np.cumsum(set_bits.astype(np.int32), dtype=np.int32)))
        return self.sums[bit]

    def pairs(self, depth: int, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of keys that differ in at most ``budget`` bits.

        ``nodes`` has a row for each pair of ranges: start and end of one, start and end of
        the other, bits that differ so far. All keys of a range agree in the bits up
        to ``depth``. A range paired with itself gives each pair once.
        """
        todo = [(depth, nodes[i:i + FRONTIER]) for i in range(0, len(nodes), FRONTIER)]
        while todo:
            depth, nodes = todo.pop()
            size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
            few = size <= self.leaf_pairs
            if depth == 64:
                few[:] = True
            if few.any():
                piece = np.cumsum(size[few]) // COMPARED
                for part in np.split(nodes[few], np.flatnonzero(piece[1:] != piece[:-1]) + 1):
                    yield self._compare(part, budget)
                nodes = nodes[~few]
            if not len(nodes):
                continue
            sums = self.ones(depth)
            a, b, c, d, cost = nodes.T
            same = a == c
            mid, other = b - (sums[b] - sums[a]), d - (sums[d] - sums[c])
            below = np.concatenate((
                np.stack((a, mid, c, other, cost), 1), np.stack((mid, b, other, d, cost), 1),
                np.stack((a, mid, other, d, cost + 1), 1), np.stack((mid, b, c, other, cost + 1), 1)[~same],
            ))
            alone = (below[:, 0] == below[:, 2]) & (below[:, 1] - below[:, 0] < 2)
            below = below[(below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2]) & (below[:, 4] <= budget) & ~alone]
            todo += [(depth + 1, below[i:i + FRONTIER]) for i in range(0, len(below), FRONTIER)]

    def _compare(self, nodes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        wide = nodes[:, 3] - nodes[:, 2]
        count = (nodes[:, 1] - nodes[:, 0]) * wide
        which = np.repeat(np.arange(len(nodes)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        left, right = nodes[which, 0] + nth // wide[which], nodes[which, 2] + nth % wide[which]
        near = np.bitwise_count(self.keys[left] ^ self.keys[right]) <= budget
        near &= (left < right) | (nodes[which, 0] != nodes[which, 2])
        return left[near], right[near]


def least_labels(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``size`` numbers the smallest one connected with it."""
    label = np.arange(size)
    for a, b in links:
        while len(a):
            a, b = label[a], label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
    return label


_UNIT = ["band", "depth", "a", "b", "cost"]


def _small_units(rows: DataFrame, unit_rows: int) -> DataFrame:
    """Replace units of more than ``unit_rows`` keys by pairs of their subtries."""
    while True:
        large = rows.groupBy(*_UNIT).count().filter(F.col("count") > unit_rows).filter("depth < 64").drop("count")
        large, seen = stage_counting(large, "units", n=F.count("*"))
        if not seen["n"]:
            return rows
        child = F.expr(f"shiftrightunsigned(key, 64 - depth - {STEP_BITS})")
        hot = stage(rows.join(large, _UNIT, "left_semi").withColumn("node", child), "hot-units")
        nodes = hot.select(*_UNIT, "node").distinct()
        left = nodes.filter(F.expr(f"shiftrightunsigned(node, {STEP_BITS}) = a"))
        right = nodes.filter(F.expr(f"shiftrightunsigned(node, {STEP_BITS}) = b")).withColumnRenamed("node", "with")
        cost = F.col("cost") + F.bit_count(F.expr("(node ^ with) & 255"))
        # At most 256 nodes on either side.
        pairs = left.join(right, _UNIT).filter("a <> b OR node <= with").withColumn("next", cost).filter(F.col("next") <= MAX_BITS)
        member = F.explode(F.array_distinct(F.array("node", "with")))
        pairs = pairs.select(*_UNIT, F.col("node").alias("na"), F.col("with").alias("nb"), "next", member.alias("node"))
        split = hot.join(pairs, [*_UNIT, "node"]).select(
            "band", (F.col("depth") + STEP_BITS).alias("depth"), F.col("na").alias("a"), F.col("nb").alias("b"), F.col("next").alias("cost"), "key",
        )
        rows = stage(rows.join(large, _UNIT, "left_anti").select(*_UNIT, "key").unionByName(split), "small-units")


def linked(fps: DataFrame, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all that differ in few bits.

    ``fps`` has one column ``fp`` without repeats.
    """
    bands = F.explode(F.sequence(F.lit(0), F.lit(MAX_BITS)))
    turned = F.expr(f"shiftleft(fp, {BAND_BITS} * band) | CASE WHEN band = 0 THEN 0L ELSE shiftrightunsigned(fp, 64 - {BAND_BITS} * band) END")
    first = F.expr(f"shiftrightunsigned(key, {64 - BAND_BITS})")
    rows = fps.select("fp", bands.alias("band")).select("band", turned.alias("key")).select(
        "band", F.lit(BAND_BITS).alias("depth"), first.alias("a"), first.alias("b"), F.lit(0).alias("cost"), "key",
    )
    rows = _small_units(rows, unit_rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1))
            size += batch.num_rows
            if size >= unit_rows:
                rows = np.concatenate(held)
                # Whole units only; the last one may go on in the next batch.
                changes = np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(axis=1)) + 1
                cut = changes[-1] if len(changes) else 0
                if cut:
                    yield _join_units(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield _join_units(np.concatenate(held))

    parts = rows.repartition(tasks_for(fps), *_UNIT).sortWithinPartitions(*_UNIT)
    return parts.mapInArrow(join, "a bigint, b bigint")


def _join_units(rows: np.ndarray) -> pa.RecordBatch:
    """Links of whole units; ``rows`` has the unit's five columns and the key, sorted by unit."""
    number = np.concatenate(([0], np.cumsum((rows[1:, :5] != rows[:-1, :5]).any(axis=1))))
    keys = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
    order = np.lexsort((keys, number))
    rows, keys, number = rows[order], keys[order], number[order]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    ends = np.append(starts[1:], len(rows))
    trie = Trie(keys)
    links = []
    for depth in np.unique(rows[starts, 1]):
        at = rows[starts, 1] == depth
        lo, hi, unit = starts[at], ends[at], rows[starts[at]]
        # Of a pair of subtries the rows of either are a range, told by their first bits.
        prefix = (keys >> np.uint64(64 - depth)).astype(np.int64)
        in_a = np.concatenate(([0], np.cumsum(prefix == rows[:, 2])))
        n_a = in_a[hi] - in_a[lo]
        own = unit[:, 2] == unit[:, 3]
        a_first = unit[:, 2].astype(np.uint64) <= unit[:, 3].astype(np.uint64)
        mid = np.where(a_first, lo + n_a, hi - n_a)
        nodes = np.stack((
            np.where(own | a_first, lo, mid), np.where(own, hi, np.where(a_first, mid, hi)),
            np.where(own, lo, np.where(a_first, mid, lo)), np.where(own | a_first, hi, mid), unit[:, 4],
        ), 1)
        nodes = nodes[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & ~(own & (hi - lo < 2))]
        links.append(trie.pairs(int(depth), nodes, MAX_BITS))
    label = least_labels(len(keys), (pair for source in links for pair in source))
    at = np.flatnonzero(label != np.arange(len(keys)))
    turn = (rows[:, 0] * BAND_BITS).astype(np.uint64)
    back = np.where(turn == 0, keys, (keys >> turn) | (keys << (np.uint64(64) - np.maximum(turn, np.uint64(1)))))
    return pa.RecordBatch.from_arrays([pa.array(back[at].view(np.int64)), pa.array(back[label[at]].view(np.int64))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: every node of ``edges(a, b)`` with the least node connected with it, but for the roots.

    Large and small stars take turns until the edges are stars around the roots. Each
    round is written to the shared folder; only its count and check sum reach the driver.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    state = dict(n=F.count("*"), sum=F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")))
    edges, before = stage_counting(edges, "edges", **state)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("m"))
        large = both.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.filter("node <> root").distinct()
        # Every edge now points down; the small star joins all lower neighbours to the least.
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).filter("node <> root")
        edges, after = stage_counting(small.unionByName(least.select("node", F.col("m").alias("root"))).distinct(), "edges", **state)
        if after == before:
            break
        before = after
    return edges


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``(id, key, fp, first)`` of every row; ``first`` is the group's row with the least id: its id and key."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    named = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    distinct = stage(rows.groupBy("fp").agg(F.min(named).alias("first")), "distinct-fingerprints")
    roots = components(linked(distinct.select("fp"), unit_rows))
    found = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    named = stage(found.join(least, "root").select("fp", F.col("least").alias("first")), "groups")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``."""
    found = groups(docs, id_col, text_col, unit_rows)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id, all columns as they were."""
    kept = groups(docs, id_col, text_col).filter("key = first.key").select("key").distinct()
    key = fresh_name(docs, "row_key")
    rows = docs.withColumn(key, row_key(id_col, text_col)).join(kept.withColumnRenamed("key", key), key, "left_semi")
    return rows.dropDuplicates([key]).drop(key)
