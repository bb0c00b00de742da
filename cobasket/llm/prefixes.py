"""The prefix trie of conversations, built by union-find over common prefixes of sorted neighbours.

A turn is a digest of role and text, a prefix the digest of the prefix before it and its
last turn, and a conversation the string of the digests of its prefixes (its path). In the
order of paths conversations with one prefix are neighbours, and two neighbours share as
many turns as their paths share digests: the depth of the edge between them.

Equal conversations are one entry. In descending depth every edge merges the two
components it lies between (union-find); where their top nodes are deeper than the edge,
they close and become children of a new branching node. A closed node gives a row for each
turn between its parent and itself, with members, children, leaves and savings summed up.

Entries are dealt out by ranges of paths. A task knows nothing beyond its first and its
last entry, so it contracts only edges that are no shallower than those next to them,
its ends counting as deepest. What stays is a valley of components, depths falling and
then rising, no more than twice as many as turns. These forests, with the edges between
ranges, are contracted again, ``FAN_IN`` at a time, until one is left; its ends count as
shallowest. A component keeps the part of a path that its later rows need and no more.

Null roles and texts are empty; turns go by number, nulls first, those with one number by
digest. Rows without a conversation id take no part, as nothing can name their node.
Repeated rows are turns of their own. Other columns are not read. An empty table
has no trie, not even a root. The turns of one conversation, about 40 bytes
each, are one row, and so are the depths of a path.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import tasks_for
from cobasket.staging import stage, stage_counting

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
#: Forests of neighbouring ranges that one task of a later round contracts.
FAN_IN = 64
#: Ids in one string of a conversation's ids: a power of two.
IDS_BITS = 12
_ROWS = 1 << 14


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, as ``(digest, words)``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST)))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    # Nulls come first in this order.
    in_order = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def branched(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that start as the first of their ``every`` ids does: with 0 to ``heads`` - 1 of its turns, by a hash of the id."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = convs.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    joined = rows.join(first, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.greatest(F.col("h"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _paths(convs: DataFrame) -> DataFrame:
    """``(conv_id, key, path, words)``: the digests of all prefixes in a row, the last of them, and the words of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths = [], []
            for digests in batch.column(1):
                before, path = b"", []
                for digest in digests.as_py():
                    before = hashlib.sha256(before + digest).digest()[:DIGEST]
                    path.append(before)
                keys.append(before)
                paths.append(b"".join(path))
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(paths, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "key", "path", "words"])

    rows = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return rows.mapInArrow(run, "conv_id bigint, key binary, path binary, words array<bigint>")


def _ends(paths: DataFrame) -> DataFrame:
    """``(key, ends)``: the SHA-256 of the ids of equal conversations, ascending, with commas between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, ends = [], []
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here == key:
                    state.update(b",")
                else:
                    if state:
                        keys.append(key)
                        ends.append(state.hexdigest())
                    key, state = here, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    # Many ids travel as one string, and the strings of a key are hashed one after the other.
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    lists = paths.groupBy("key", F.shiftright("conv_id", IDS_BITS).alias("block")).agg(ids)
    parts = lists.repartition(tasks_for(paths), "key").sortWithinPartitions("key", "block")
    return parts.select("key", "ids").mapInArrow(run, "key binary, ends string")


def shared(a: bytes, b: bytes) -> int:
    """Digests that two paths have in common from the start on: with one, all before it are equal."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high) // 2
        if a[mid * DIGEST:(mid + 1) * DIGEST] == b[mid * DIGEST:(mid + 1) * DIGEST]:
            low = mid + 1
        else:
            high = mid
    return low


class Component:
    """Neighbours merged so far: their top node, and the path from depth ``base`` on to it."""

    __slots__ = ("base", "below", "depth", "ends", "kids", "least", "leaves", "n", "path", "words")

    def __init__(self, depth, n, least, kids, leaves, below, ends, base, path, words):
        self.depth, self.n, self.least, self.kids, self.leaves, self.below, self.ends = depth, n, least, kids, leaves, below, ends
        self.base, self.path, self.words = base, path, words

    def digest(self, depth: int) -> bytes:
        at = (depth - self.base - 1) * DIGEST
        return self.path[at:at + DIGEST] if depth else b""

    def close(self, depth: int, parent: bytes) -> tuple[list[tuple], int, int]:
        """The rows of the nodes below ``depth`` down to the top node, and leaves and savings below."""
        rows, leaves, saved = [], self.leaves or 1, self.below
        for d in range(self.depth, depth, -1):
            top = d == self.depth
            saved += (self.n - 1) * self.words[d - self.base - 1]
            rows.append((
                self.digest(d) if top else None, parent if d == depth + 1 else None, self.least, d, self.n,
                self.kids if top else 1, leaves, saved, self.ends if top else None,
            ))
        return rows, leaves, saved

    def raised(self, depth: int, parent: bytes, rows: list[tuple]) -> Component:
        """The component with a top node at ``depth``, all deeper ones closed."""
        if self.depth == depth:
            return self
        closed, leaves, saved = self.close(depth, parent)
        rows += closed
        return Component(depth, self.n, self.least, 1, leaves, saved, None, self.base, self.path, self.words)

    def joined(self, other: Component) -> Component:
        """Both as one; their top nodes are one node."""
        keep = self if self.base <= other.base else other
        return Component(
            self.depth, self.n + other.n, min(self.least, other.least), self.kids + other.kids, self.leaves + other.leaves,
            self.below + other.below, self.ends or other.ends, keep.base, keep.path, keep.words,
        )

    def trimmed(self, base: int) -> Component:
        """Without what only shallower rows would need, and without what is closed."""
        base = max(self.base, min(base, self.depth))
        skip, upto = base - self.base, self.depth - self.base
        return Component(
            self.depth, self.n, self.least, self.kids, self.leaves, self.below, self.ends,
            base, self.path[skip * DIGEST:upto * DIGEST], self.words[skip:upto],
        )


def contract(items: list[Component], edges: list[int], whole: bool) -> tuple[list[Component], list[int], list[tuple]]:
    """Merge neighbours in descending depth: what is left, the edges between, and the rows of closed nodes.

    ``edges[i]`` is the depth shared by ``items[i]`` and the one behind. Unless the items are
    the ``whole`` order, unknown deeper edges may lie at both ends.
    """
    rows: list[tuple] = []
    n = len(items)
    # Of a component the first number is its root, at which its last one stands.
    root, last, found = list(range(n)), list(range(n)), list(items)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    beyond = -1 if whole else math.inf
    for i in sorted(range(n - 1), key=lambda i: -edges[i]):
        depth, a, b = edges[i], find(i), i + 1
        before = edges[a - 1] if a else beyond
        after = edges[last[b]] if last[b] < n - 1 else beyond
        if before > depth or after > depth:
            continue
        one, other = found[a], found[b]
        # The one with the shorter base knows the digest of the parent.
        parent = (one if one.base <= other.base else other).digest(depth)
        found[a] = one.raised(depth, parent, rows).joined(other.raised(depth, parent, rows))
        root[b], last[a], found[b] = a, last[b], None
    kept = [i for i in range(n) if root[i] == i]
    return [found[i] for i in kept], [edges[i - 1] for i in kept[1:]], rows


_NODE = "node binary, parent binary, least bigint, depth bigint, n bigint, kids bigint, leaves bigint, saved bigint, ends string"
_ITEM = "part bigint, seq int, edge bigint, base bigint, path binary, words array<bigint>"
_SCHEMA = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("least", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()),
    ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("part", pa.int64()), ("seq", pa.int32()), ("edge", pa.int64()),
    ("base", pa.int64()), ("path", pa.binary()), ("words", pa.list_(pa.int64())),
])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(rows, _ROWS):
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _forest(part: int, items: list[Component], edges: list[int], whole: bool) -> Iterator[pa.RecordBatch]:
    """Closed nodes, and what is left of a forest: rows with a number."""
    items, edges, rows = contract(items, edges, whole)
    if whole:
        top = items[0].raised(0, b"", rows)
        rows.append((b"", None, top.least, 0, top.n, top.kids, top.leaves or 1, top.below, top.ends))
        items = []
    yield from _batches([(*row, *[None] * 6) for row in rows])
    left = []
    for i, item in enumerate(items):
        # The first and the last path are compared with those of other ranges as a whole.
        ends = i in (0, len(items) - 1)
        item = item if ends else item.trimmed(max(edges[i - 1], edges[i]))
        left.append((
            None, None, item.least, item.depth, item.n, item.kids, item.leaves, item.below, item.ends,
            part, i, edges[i - 1] if i else None, item.base, item.path, item.words,
        ))
    yield from _batches(left)


def trie(convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of ``convs(conv_id, turns)``, the empty one included.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``
    """
    paths = stage(_paths(convs), "paths")
    entries = paths.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    entries, seen = stage_counting(entries.join(_ends(paths), "key"), "entries", n=F.count("*"))
    schema = f"{_NODE}, {_ITEM}"

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, part = [], None
        for batch in batches:
            for part, path, words, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items.append(Component(len(words), n, least, 0, 0, 0, ends, 0, path, words))
        if items:
            yield from _forest(part, items, [shared(a.path, b.path) for a, b in itertools.pairwise(items)], whole=False)

    def forests(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        group, items, edges = None, [], []
        for batch in batches:
            for row in batch.select(["part", "edge", "depth", "n", "least", "kids", "leaves", "below", "ends", "base", "path", "words"]).to_pylist():
                part, edge = row.pop("part"), row.pop("edge")
                item = Component(**row)
                if part != group and items:
                    yield from _forest(group, items, edges, whole)
                    items, edges = [], []
                if items:
                    # Where one range ends and the next starts, both have their whole paths.
                    edges.append(edge if edge is not None else shared(items[-1].path, item.path))
                group = part
                items.append(item)
        if items:
            yield from _forest(group, items, edges, whole)

    dealt = entries.repartitionByRange(tasks_for(convs), "path").sortWithinPartitions("path")
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "path", "words", "n", "least", "ends")
    state = dict(n=F.count("part"), last=F.max("part"))
    found, seen = stage_counting(dealt.mapInArrow(ranges, schema), "forest", **state)
    nodes = [found]
    while seen["n"]:
        groups = math.ceil((seen["last"] + 1) / FAN_IN)
        whole = groups == 1
        left = found.filter("part IS NOT NULL").withColumn("old", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = left.repartition(groups, "part").sortWithinPartitions("part", "old", "seq").withColumnRenamed("saved", "below")
        found, seen = stage_counting(parts.drop("old").mapInArrow(lambda batches, whole=whole: forests(batches, whole), schema), "forest", **state)
        nodes.append(found)
    closed = nodes[0]
    for more in nodes[1:]:
        closed = closed.unionByName(more)
    closed = closed.filter("part IS NULL")
    # Only the node next to a branching one has another conversation above it.
    above = closed.filter("node IS NOT NULL AND kids > 0").select(F.col("node").alias("parent"), F.col("least").alias("above"))
    inner = closed.filter("parent IS NULL").select("*", F.when(F.col("depth") > 0, F.col("least")).alias("above"))
    every = closed.filter("parent IS NOT NULL").join(above, "parent").unionByName(inner)
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
