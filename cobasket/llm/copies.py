"""Near copies by the words they share: groups linked by Jaccard similarity of word shingles.

Words are those of ``simhash``; a document is the set of its runs of ``SHINGLE`` words
(shorter texts are one run, blank ones share the empty run). Documents with equal sets
are one entry from the start. Others are linked when their sets have a Jaccard
similarity of ``SHARE`` or more, and a group is what links connect.

Links are proposed by the trie join of ``simhash``, twice. First the SimHash fingerprints of the sets are
joined as ``op5`` joins its own: turned, under its budget. At a similarity of 0.8 fingerprints differ in ten bits on
average, and a budget that loses none of them would compare nearly all pairs. So a second fingerprint is turned
once for each of ``BANDS`` bands of ``ROWS`` minimal hashes: the band comes first and has to be equal, the 128 bits
of a sketch follow, which may differ in ``SKETCH_BITS``. A band value is a subtrie and is joined with itself, in
two tries of 64 bits, each under half the budget: one half of a pair within the budget is within its own. A pair of
similarity s is missed with a chance of (1 - s^ROWS)^BANDS, 7e-5 at 0.8 and 8e-7 at 0.85, or when the sketches
differ in more than ``SKETCH_BITS``, some 3e-6 at 0.8. Every candidate is then confirmed on the sets themselves.

In the first rounds the join gives of a member the pairs with the two first members of its band value and with the most
alike one that it is not connected with, which joins most of a large group without its pairs. What is still apart in a
band value is then joined in units of two blocks of members: a unit finds by the tries and by sizes who has anybody to be
compared with, gets the sets of these once, confirms inside, and gives the links that connect something new. So no
row stands for a pair, a band value may have any size, and nothing is capped.

Null texts are empty ones, and empty texts are copies of each other. Rows without id take part; one
of them stays only where a group has no id. Repeated rows are one group. Other
columns, whatever their names, are handed on as they were. An empty table stays empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED, fresh_name, tasks_for
from cobasket.llm.simhash import Trie, components, linked, majority, row_key
from cobasket.staging import scope, stage, stage_counting

SHINGLE = 5
SHARE = 0.8
BANDS, ROWS = 24, 5
#: Permutations; each gives a bit of the sketch.
HASHES = 128
SKETCH_BITS = 30
#: Rounds before the last one, and rows of whole band values whose tries are joined at once in them.
ROUNDS = 2
BLOCK = 1 << 14
#: Members of a band value that are held at once in the first rounds.
HELD = 2048
#: A pair of nodes with so few pairs of sketches is compared directly: under a wide budget deeper nodes save nothing.
LEAF_PAIRS = 1 << 10
#: Members of a block of the last round: twice as many sets are held at once.
UNIT = 256
#: Members of a band value with which all others are compared first.
HUBS = 2
#: Pairs that meet one copy of a set in the join of pairs and sets.
SALT_PAIRS = 64
_CHUNK = 1 << 9
_DRAW = np.random.Generator(np.random.PCG64(SEED))
_TIMES = _DRAW.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the runs of ``size`` words, sorted, each once."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((digest(s, SEED) for s in runs), np.uint64, len(words) - size + 1))


def minima(found: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the permutations."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        every = found[None, at:at + _CHUNK] * _TIMES[:, None] + _PLUS[:, None]
        np.minimum(least, every.min(axis=1), out=least)
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, members, fp, bands, s0, s1, size)`` of every row: a hash of its set of runs, its fingerprint, bands, sketch and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            members, fps, bands, sketch, sizes = [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                least = minima(found)
                members.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED))
                fps.append(majority(found))
                bands += [xxhash.xxh64_intdigest(part.astype("<u8").tobytes(), band) for band, part in enumerate(least[:BANDS * ROWS].reshape(BANDS, ROWS))]
                sizes.append(len(found))
                sketch.append(np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1).view(np.int64))
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), signed(bands))
            halves = np.array(sketch, np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), signed(members), signed(fps), lists, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "members", "fp", "bands", "s0", "s1", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, key bigint, members bigint, fp bigint, bands array<bigint>, s0 bigint, s1 bigint, size bigint")


def _near(halves: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within ``SKETCH_BITS`` of each other, each once, and their bits: tries of either half of the sketches, one below each start."""
    ends = np.append(starts[1:], len(halves))
    unit = np.repeat(np.arange(len(starts)), ends - starts)
    nodes = np.stack((starts, ends, starts, ends, np.zeros_like(starts)), 1)[ends - starts > 1]
    for half in (0, 1):
        order = np.lexsort((halves[:, half], unit))
        # One of two halves of a pair within the budget is within half of it.
        for a, b in Trie(halves[order, half], LEAF_PAIRS).pairs(0, nodes, SKETCH_BITS // 2):
            a, b = order[a], order[b]
            bits = np.bitwise_count(halves[a] ^ halves[b]).astype(np.int64)
            good = bits.sum(axis=1) <= SKETCH_BITS
            if half:
                good &= bits[:, 0] > SKETCH_BITS // 2
            yield a[good], b[good], bits[good].sum(axis=1)


def _starts(units: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, units[1:] != units[:-1]))


def _meet(rows: np.ndarray) -> pa.RecordBatch:
    """Pairs in whole band values, from ``(unit, members, label, s0, s1)`` rows sorted by unit: with the most alike of another label, and with the first ones."""
    starts = _starts(rows[:, 0])
    first = np.zeros(len(rows), bool)
    for k in range(HUBS):
        first[starts[np.diff(np.append(starts, len(rows))) > k] + k] = True
    none = np.iinfo(np.int64).max
    best, pairs = np.full(len(rows), none), []
    for i, j, bits in _near(np.ascontiguousarray(rows[:, 3:]).view(np.uint64), starts):
        apart = rows[i, 2] != rows[j, 2]
        i, j, bits = i[apart], j[apart], bits[apart]
        np.minimum.at(best, i, (bits << 32) | j)
        np.minimum.at(best, j, (bits << 32) | i)
        hub = first[i] | first[j]
        pairs.append((rows[i[hub], 1], rows[j[hub], 1]))
    i = np.flatnonzero(best != none)
    return _as_batch([*pairs, (rows[i, 1], rows[best[i] & 0xFFFFFFFF, 1])])


def _whole_units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one unit after the other, told by the first ``keys`` columns, from rows sorted by unit."""
    held, unit = [], None
    for batch in batches:
        units = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        starts = [0, *(np.flatnonzero((units[1:] != units[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(starts):
            if a == b:
                continue
            here = tuple(units[a].tolist())
            if here != unit and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            unit = here
    if held:
        yield held


def _pairs(rows: DataFrame) -> DataFrame:
    """``(a, b)``: a few pairs of ``rows(band, members, label, s0, s1, n)`` with one band, alike sketches and two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            size += batch.num_rows
            if size >= BLOCK:
                found = np.concatenate(held)
                # Whole units only; the last one may go on in the next batch.
                cut = _starts(found[:, 0])[-1]
                if cut:
                    yield _meet(found[:cut])
                held, size = [found[cut:]], len(found) - cut
        if size:
            yield _meet(np.concatenate(held))

    # A band value with very many members is several units.
    blocks = F.ceil(F.col("n") / HELD)
    unit = F.when(blocks > 1, F.xxhash64("band", F.pmod(F.xxhash64("members"), blocks))).otherwise(F.col("band"))
    parts = rows.select(unit.alias("unit"), "members", "label", "s0", "s1").repartition(tasks_for(rows), "unit").sortWithinPartitions("unit", "members")
    return parts.mapInArrow(run, "a bigint, b bigint").distinct()


def _as_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    one, other = (np.concatenate(side) for side in zip(*pairs, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["a", "b"])


def _fingerprint_pairs(entries: DataFrame) -> DataFrame:
    """``(a, b)``: of ``entries(members, fp)`` those with one fingerprint, by one of them, and by the links of ``simhash`` between fingerprints."""
    ones = stage(entries.groupBy("fp").agg(F.min("members").alias("one")), "fingerprints")
    near = linked(ones.select("fp")).join(ones.select(F.col("fp").alias("a"), "one"), "a").join(ones.select(F.col("fp").alias("b"), F.col("one").alias("members")), "b")
    same = entries.join(ones, "fp").where("members <> one")
    ordered = [F.least("members", "one").alias("a"), F.greatest("members", "one").alias("b")]
    return near.select(*ordered).unionByName(same.select(*ordered)).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(members, runs)`` have a similarity of ``share`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similarity(np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)) >= share
                for own, other in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # A set that very many pairs ask for is dealt out in copies.
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("fans"))
    ours = sets.withColumnRenamed("members", "a").join(fans, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.col("runs").alias("own"))
    dealt = pairs.join(fans, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int"))
    theirs = sets.select(F.col("members").alias("b"), F.col("runs").alias("other"))
    met = dealt.select("a", "b", "salt").join(theirs, "b").join(ours, ["a", "salt"]).select("a", "b", "own", "other")
    return met.mapInArrow(run, "a bigint, b bigint")


def _sets(asked: DataFrame, entries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(members, runs)`` of every entry in ``asked``: its sorted hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["members", "runs"])

    keys = entries.select("members", F.col("first.key").alias("key")).join(asked, "members")
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.join(keys, "key").select("members", "text").dropDuplicates(["members"]).mapInArrow(run, "members bigint, runs binary")


def _candidates(rows: np.ndarray, share: float) -> np.ndarray:
    """Which of ``(label, s0, s1, size, block)`` rows are to be compared with which: alike, of fitting sizes, not connected."""
    near = np.zeros((len(rows), len(rows)), bool)
    for i, j, _ in _near(np.ascontiguousarray(rows[:, 1:3]).view(np.uint64), np.zeros(1, np.int64)):
        near[i, j] = near[j, i] = True
    size = rows[:, 3]
    near &= np.minimum(size[:, None], size[None, :]) >= share * np.maximum(size[:, None], size[None, :])
    near &= rows[:, 0, None] != rows[None, :, 0]
    # In a unit of two blocks those of one block are left to its own unit.
    if rows[:, 4].min() != rows[:, 4].max():
        near &= rows[:, 4, None] != rows[None, :, 4]
    return near


def _connect(rows: np.ndarray, sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links between rows that connect two labels each: a forest of all that is alike enough."""
    near = np.triu(_candidates(rows, share), 1)
    label = rows[:, 0].copy()
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate(([0], ends[:-1]))
    sizes, own = ends - starts, np.zeros(codes.max() + 1, bool)
    links = []
    for i in np.flatnonzero(near.any(axis=1)):
        others = np.flatnonzero(near[i])
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        mine = codes[starts[i]:ends[i]]
        own[mine] = True
        met = np.concatenate([codes[starts[j]:ends[j]] for j in others])
        both = np.add.reduceat(own[met].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[others])[:-1])))
        own[mine] = False
        for j in others[both / (sizes[i] + sizes[others] - both) >= share]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _last_links(labelled: DataFrame, entries: DataFrame, docs: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    """``(a, b)``: links between members of ``labelled(band, members, label, s0, s1, size, n)`` that are not connected yet."""
    blocks = F.ceil(F.col("n") / UNIT).cast("long")
    rows = labelled.withColumn("block", F.pmod(F.xxhash64("members"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    unit = [F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other")]
    columns = ["band", "one", "other", "members", "label", "s0", "s1", "size", "block"]
    rows = rows.select("band", *unit, *columns[3:])
    kinds = ", ".join(f"{c} bigint" for c in columns)

    def numbers(unit: list[pa.RecordBatch]) -> np.ndarray:
        return np.concatenate([np.stack([b.column(k).to_numpy() for k in range(len(columns))], 1) for b in unit])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _whole_units(batches, 3):
            found = numbers(unit)
            found = found[_candidates(found[:, 4:], share).any(axis=1)]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names=columns)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _whole_units(batches, 3):
            found = numbers(unit)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for b in unit for s in b.column(len(columns))]
            pairs = _connect(found[:, 4:], sets, share)
            if pairs:
                i, j = np.array(pairs).T
                yield _as_batch([(found[i, 3], found[j, 3])])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks_for(docs), "band", "one", "other").sortWithinPartitions("band", "one", "other", "members")

    met = stage(dealt(rows).mapInArrow(meet, kinds), "met")
    sets = stage(_sets(met.select("members").distinct(), entries, docs, id_col, text_col), "met-sets")
    return dealt(met.join(sets, "members").select(*columns, "runs")).mapInArrow(confirm, "a bigint, b bigint")


def _relabelled(banded: DataFrame, roots: DataFrame) -> DataFrame:
    """``banded`` with the group of each entry as ``label``, without bands whose members are all connected."""
    labelled = banded.join(roots, F.col("members") == F.col("node"), "left").withColumn("label", F.coalesce("root", "members")).drop("node", "root")
    apart = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    return labelled.join(apart, "band")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``(members, first)``: of every entry the row of its group with the least id, as id and key."""
    rows = stage(signatures(docs, id_col, text_col), "signatures")
    named = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    columns = [F.first(c).alias(c) for c in ("fp", "bands", "s0", "s1", "size")]
    entries = stage(rows.groupBy("members").agg(F.min(named).alias("first"), *columns), "entries")
    banded = entries.select("members", "s0", "s1", "size", F.explode("bands").alias("band"))
    # Only bands with two entries or more go on.
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    banded = stage(banded.join(shared, "band"), "shared-bands")
    labelled, tried, sets, links = banded.withColumn("label", F.col("members")), None, None, None
    for turn in range(ROUNDS):
        pairs = _pairs(labelled)
        if turn == 0:
            pairs = pairs.unionByName(_fingerprint_pairs(entries.select("members", "fp"))).distinct()
        pairs, seen = stage_counting(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "pairs", n=F.count("*"))
        if not seen["n"]:
            break
        asked = pairs.select(F.explode(F.array("a", "b")).alias("members")).distinct()
        asked, lacking = stage_counting(asked.join(sets, "members", "left_anti") if sets else asked, "asked", n=F.count("*"))
        if lacking["n"] or sets is None:
            more = stage(_sets(asked, entries, docs, id_col, text_col), "sets")
            sets = sets.unionByName(more) if sets else more
        found = stage(_confirmed(pairs, sets, share), "links")
        links, tried = (links.unionByName(found), tried.unionByName(pairs)) if links else (found, pairs)
        labelled = _relabelled(banded, components(links))
    last = stage(_last_links(labelled, entries, docs, id_col, text_col, share), "last-links")
    roots = components(links.unionByName(last) if links else last)
    found = entries.join(roots, F.col("members") == F.col("node"), "left").select("members", F.coalesce("root", "members").alias("root"), "first")
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    return found.join(least, "root").select("members", F.col("least").alias("first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row of each group, that with the smallest id, all columns as they were."""
    key = fresh_name(docs, "row_key")
    with scope(docs.sparkSession, "copies"):
        kept = stage(groups(docs, id_col, text_col, share).select(F.col("first.key").alias(key)).distinct(), "kept", outer=True)
    rows = docs.withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi")
    return rows.dropDuplicates([key]).drop(key)
