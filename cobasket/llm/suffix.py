"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with
a smaller id. Texts are UTF-8 bytes and matches stay within a document.

Every window of ``LENGTH`` bytes is named by its anchor, the piece of ``PIECE`` bytes in
it with the least hash. Equal windows have equal anchors at the same place, so a segment,
the run of windows with one anchor in a document, only ever needs comparing with other
segments of its anchor. That deals the corpus out into families of segments:

1. Anchors that occur only once are told apart; their windows cannot repeat.
2. The other segments go to their families, equal ones of a chunk of documents as one
   with the least id. A family met in very many places sends its windows one by one, under
   keys of their own (place of the anchor, first and last bytes), so it spreads out.
3. Segments of equal content are one entry. Families that still have several are shards of
   suffixes: each shard has a Burrows-Wheeler transform, and the transforms are merged
   by refining their interleaving, two symbols a round, without sorting suffixes
   again. Rounds also tell how long neighbours agree, so in the end the intervals of
   suffixes with a common prefix of ``LENGTH`` stand; the least document of an interval is
   the first in which its string starts. Rows that agree with no other, or that reach no
   start of a window, are left out of the rounds.
4. Each document marks its windows whose string starts earlier, and drops what they cover.

Between the steps, anchors and segments travel as packed arrays, one row for each chunk of
documents and family group, so shuffles move few rows. Chunks and groups follow the
size of the input. Hashes only decide what is compared, but for one case: segments of
one anchor count as equal when anchor and content hash, 112 bits together, agree.

A null text is empty. Texts shorter than ``LENGTH`` lose nothing. A null id counts as
larger than all others, and rows with equal ids (or without) never remove from each
other. Repeated rows give equal rows. Other columns than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.llm.common import SEED
from cobasket.staging import stage

LENGTH = 50
PIECE = 24
CHUNK_BYTES = 4 << 20
#: More chunks than these become larger ones, up to so many times: every chunk has a row for every group.
MANY_CHUNKS, CHUNK_GROWTH = 256, 4
#: Anchors are told apart by this many bits less while the common ones are looked for.
SHORT = np.uint64(16)
SHARDS = 8
#: Bytes of families that are merged at once, about; a larger family is merged alone.
MERGE_BYTES = 1 << 18
#: An anchor that occurs so often sends its windows one by one.
WIDE_ANCHOR = 512
_SLICE = 1 << 17
#: Longer pieces are hashed one by one.
_LONG_PIECE = 512
_END = 255  # no byte of UTF-8
_LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value, bytes of equal weight together."""
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * size
    return out


def _powers(length: int) -> list[tuple[int, np.uint64]]:
    return [(1 << i, np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64))) for i in range(length.bit_length())]


def piece_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every piece of ``length`` bytes, put together from pieces of powers of two."""
    part, whole, size = data.astype(np.uint64), None, 0
    for step, power in _powers(length):
        if length & step:
            if whole is None:
                whole, size = part, step
            else:
                n = len(data) - size - step + 1
                whole, size = whole[:n] * power + part[size:size + n], size + step
        if step * 2 <= length:
            part = part[:len(part) - step] * power + part[step:]
    return _mix(whole)


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor hash of every window of ``data``."""
    least, span, width = piece_hashes(data, PIECE), 1, LENGTH - PIECE + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - LENGTH + 1
    return np.minimum(least[:n], least[width - span:width - span + n])


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts that stay in the processor's cache: first and last text, where each begins, and the bytes."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= _SLICE):
            size += len(texts[last])
            last += 1
        sizes = np.array([len(t) for t in texts[first:last]])
        yield first, last, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(texts[first:last]), np.uint8)
        first = last


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _ladders() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, as far as a slice with a piece behind it reaches."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(_SLICE + _LONG_PIECE + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def digests(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the given pieces of the texts, which come in the order of the texts."""
    import xxhash

    out = np.empty(len(doc), np.uint64)
    short, (up, down) = np.minimum(size, _LONG_PIECE), _ladders()
    for first, last, begin, data in _slices(texts):
        lo, hi = np.searchsorted(doc, (first, last))
        at = begin[doc[lo:hi] - first] + start[lo:hi]
        # A long text is a slice of its own and cut here.
        for cut in range(0, len(data), _SLICE):
            a, b = np.searchsorted(at, (cut, cut + _SLICE))
            if a < b:
                part = data[cut:cut + _SLICE + _LONG_PIECE].astype(np.uint64) + np.uint64(1)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[:len(part)], dtype=np.uint64)))
                here = at[a:b] - cut
                out[lo + a:lo + b] = (sums[here + short[lo + a:lo + b]] - sums[here]) * down[here]
    out = _mix(out)
    for i in np.flatnonzero(size > _LONG_PIECE).tolist():
        out[i] = xxhash.xxh64_intdigest(texts[doc[i]][start[i]:start[i] + size[i]])
    return out


def _edges(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first and the last four bytes of windows, as one number; the windows come in the order of the texts."""
    out = np.zeros(len(doc), np.uint64)
    for first, last, begin, data in _slices(texts):
        lo, hi = np.searchsorted(doc, (first, last))
        at = begin[doc[lo:hi] - first] + start[lo:hi]
        for shift, step in enumerate((0, 1, 2, 3, LENGTH - 4, LENGTH - 3, LENGTH - 2, LENGTH - 1)):
            out[lo:hi] |= data[at + step].astype(np.uint64) << np.uint64(8 * shift)
    return out


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first window, number of windows and anchor of every segment of the texts."""
    docs, starts, counts, anchors = [], [], [], []
    for first, _, begin, data in _slices(texts):
        if len(data) >= LENGTH:
            found = _anchors(data)
            owner = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(data)))
            inside = owner[:len(found)] == owner[LENGTH - 1:]
            change = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:len(found)] != owner[:len(found) - 1]))) & inside
            at = np.flatnonzero(change)
            if len(at):
                windows = np.cumsum(inside)
                counts.append(np.diff(np.append(windows[at] - 1, windows[-1])))
                docs.append(owner[at] + first)
                starts.append(at - begin[owner[at]])
                anchors.append(found[at])
    if not docs:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _split(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Group numbers below ``groups`` that occur, with the places at which they do, in order."""
    group = group.astype(np.uint16 if groups <= 1 << 16 else np.int64)
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    for at in np.split(order, cut):
        if len(at):
            yield int(group[at[0]]), at


def common_anchors(docs: DataFrame, groups: int) -> DataFrame:
    """``(chunk, anchors)``: for each chunk the packed anchors that occur in another place too, and whether widely.

    ``docs`` has ``(chunk, id, text)``.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            doc, _, _, anchor = segments(_bytes(batch.column(1)))
            order = np.argsort(anchor)
            anchor, own = anchor[order], chunk[doc[order]].astype(np.int32)
            rows = []
            for group, at in _split((anchor >> SHORT) % np.uint64(groups), groups):
                rows.append((group, pack(np.diff(anchor[at] >> SHORT, prepend=np.uint64(0)), own[at])))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["group", "data"])

    def compare(table: pa.Table) -> pa.Table:
        parts = [unpack(d, "<u8", "<i4") for d in table["data"].to_pylist()]
        anchor = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in parts])
        chunk = np.concatenate([c for _, c in parts])
        order = np.argsort(anchor)
        anchor, chunk = anchor[order], chunk[order]
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(start, len(anchor)))
        size = np.repeat(size, size)
        common = size > 1
        anchor, chunk, wide = anchor[common], chunk[common], size[common] >= WIDE_ANCHOR
        rows = []
        for c, at in _split(chunk, groups):
            at = at[np.append(True, anchor[at[1:]] != anchor[at[:-1]])]
            rows.append((c, pack(np.diff(anchor[at], prepend=np.uint64(0)), wide[at])))
        return pa.Table.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["chunk", "data"])

    gathered = docs.select("chunk", "text").mapInArrow(gather, "group int, data binary")
    return gathered.groupBy("group").applyInArrow(compare, "chunk int, data binary")


class _Chunk:
    """The segments of a chunk of documents whose anchors are common, in the order of their keys."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, packed: list[bytes]):
        known = [unpack(d, "<u8", "?") for d in packed]
        anchors = np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _ in known]) if known else np.empty(0, np.uint64)
        wide = np.concatenate([w for _, w in known]) if known else np.empty(0, bool)
        order = np.argsort(anchors)
        anchors, wide = anchors[order], wide[order]
        doc, start, count, anchor = segments(texts)
        place = np.minimum(np.searchsorted(anchors, anchor >> SHORT), max(0, len(anchors) - 1))
        common = anchors[place] == anchor >> SHORT if len(anchors) else np.zeros(len(anchor), bool)
        doc, start, count, anchor, place = (x[common] for x in (doc, start, count, anchor, place))
        spread = wide[place] if len(anchors) else np.empty(0, bool)
        if spread.any():
            # Windows of wide anchors one by one: their place after the anchor's segment start does
            # not matter, as the key holds bytes that move with the window.
            each = np.where(spread, count, 1)
            index = np.repeat(np.arange(len(doc)), each)
            nth = np.arange(len(index)) - np.repeat(np.cumsum(each) - each, each)
            split = spread[index]
            doc, start, count, anchor = doc[index], start[index] + np.where(split, nth, 0), np.where(split, 1, count[index]), anchor[index].copy()
            ends = _edges(texts, doc[split], start[split])
            anchor[split] = _mix((ends ^ anchor[split]) * np.uint64(0x9E3779B97F4A7C15))
        # 48 bits of content beside 64 of the anchor.
        content = digests(texts, doc, start, count + LENGTH - 1) >> SHORT
        order = np.lexsort((content, anchor))
        self.doc, self.start, self.count, self.key, self.content = (x[order] for x in (doc, start, count, anchor, content))
        self.id = ids[self.doc]
        new = np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (self.content[1:] != self.content[:-1]))) if len(order) else np.empty(0, bool)
        self.first = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.id, self.first) if len(order) else self.id


def _sort_rotations(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order of all rotations of the strings in ``text``; each string is closed by an end mark.

    Ranks are doubled from eight symbols until they cover every string.
    """
    n = len(text)
    sizes = np.diff(bounds)
    start, size = np.repeat(bounds[:-1], sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - start

    def ahead(steps: int) -> np.ndarray:
        return start + (place + steps) % size

    key = np.zeros(n, np.uint64)
    at = np.arange(n)
    step = ahead(1)
    for _ in range(8):
        key = (key << np.uint64(8)) | text[at].astype(np.uint64)
        at = step[at]
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
    covered, longest = 8, int(sizes.max(initial=1))
    while covered < longest and rank[order[-1]] < n - 1:
        key = rank * np.int64(n + 1) + rank[ahead(covered)]
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        covered *= 2
    return order


def transform(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard's strings, and the text position of each of its rows.

    A row has the two symbols before it, as one number: the farther one counts more.
    """
    order = _sort_rotations(text, bounds)
    before = np.arange(len(text)) - 1
    before[bounds[:-1]] = bounds[1:] - 1
    near = before[order]
    return (text[before[near]].astype(np.uint16) << 8) | text[near], order


def _refine(shards: list[np.ndarray], depth: int, rows: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleaving of transforms from the given rows of theirs: the rows they lead to, in order, and where blocks begin.

    A round moves rows, in order, to the buckets of the two symbols before them. Without
    ``whole`` a row that is alone in its block is left out from then on: it and all it
    leads to agree with no other.
    """
    symbols = np.concatenate(shards)
    ended = ((symbols & 255) == _END) | (symbols >> 8 == _END)
    # Where a row of a shard's own transform goes in one round.
    target, offset = np.empty(len(symbols), np.int32), 0
    for s in shards:
        target[offset + np.argsort(s, kind="stable")] = np.arange(offset, offset + len(s), dtype=np.int32)
        offset += len(s)
    block = np.zeros(len(rows), np.int32)
    first = np.append(True, np.zeros(len(rows), bool))[:len(rows)]
    for _ in range(depth // 2):
        before = symbols[rows]
        move = np.argsort(before, kind="stable")
        moved, block, before = rows[move], block[move], before[move]
        first = np.append(True, (before[1:] != before[:-1]) | (block[1:] != block[:-1]) | ended[moved[1:]])[:len(moved)]
        if not whole:
            several = ~(first & np.append(first[1:], True)[:len(first)])
            moved, block, first = moved[several], block[several], first[several]
        rows = target[moved]
        block = np.cumsum(first, dtype=np.int32)
    return rows, first


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of every merged row, and where a row differs from the one before within ``depth`` symbols.

    The interleaving that is right for ``r`` symbols becomes right for ``r + 2`` when its
    rows are moved, in order, to the buckets of the two symbols before them. Rows that
    lie in one block agree so far; strings end in a mark that agrees with nothing.
    ``depth`` is even.
    """
    sizes = [len(s) for s in shards]
    rows, first = _refine(shards, depth, np.arange(sum(sizes), dtype=np.int32), True)
    return np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)[rows], first


def first_documents(strings: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For every window of every string, the least owner of a string in which the same window starts.

    Of the merged transforms only rows count that reach the start of a window in the last round.
    """
    shards, places = [], []
    for number in range(min(SHARDS, len(strings))):
        own = list(range(number, len(strings), SHARDS))
        text = np.frombuffer(b"".join(strings[i] + b"\xff" for i in own), np.uint8)
        sizes = np.array([len(strings[i]) + 1 for i in own])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        symbols, order = transform(text, bounds)
        shards.append(symbols)
        which = np.repeat(np.arange(len(own)), sizes)
        places.append((np.array(own)[which[order]], order - bounds[:-1][which[order]]))
    string, offset = (np.concatenate(x) for x in zip(*places, strict=True))
    rows, first = _refine(shards, LENGTH, np.flatnonzero(offset >= LENGTH).astype(np.int32), False)
    counts = np.array([len(s) - LENGTH + 1 for s in strings])
    base = np.cumsum(counts) - counts
    # A window that agrees with no other starts in its own document only.
    out = np.repeat(owners, counts)
    if len(rows):
        start = np.flatnonzero(first)
        out[base[string[rows]] + offset[rows]] = np.repeat(np.minimum.reduceat(owners[string[rows]], start), np.diff(start, append=len(rows)))
    return np.split(out, base[1:])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _settle(table: pa.Table) -> pa.Table:
    """The first document of every window of the segments of one group of families, by chunk.

    A chunk gets its answers in the order in which it sent the segments.
    """
    chunks, parts, contents = [], [], []
    for chunk, data, content in zip(table["chunk"].to_pylist(), table["data"].to_pylist(), table["content"].to_pylist(), strict=True):
        gaps, *rest = unpack(data, "<u8", "<u8", "<i8", "<i4")
        part = [np.cumsum(gaps, dtype=np.uint64), *rest]
        parts.append(part)
        chunks.append(np.full(len(part[0]), chunk))
        contents.append(zstandard.ZstdDecompressor().decompress(content))
    key, digest, owner, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    chunk, text = np.concatenate(chunks), b"".join(contents)
    begin = np.cumsum(size.astype(np.int64)) - size
    order = np.lexsort((owner, digest, key))
    k, d = key[order], digest[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = order[new]
    least = owner[first]
    family = np.cumsum(np.concatenate(([0], key[first][1:] != key[first][:-1])))
    several = np.bincount(family)[family] > 1
    # Runs of equal answers of every entry: one for an entry that is alone in its family.
    n_runs, lengths, values = np.ones(len(first), np.int64), size[first].astype(np.int64) - LENGTH + 1, least
    chosen = np.flatnonzero(several)
    if len(chosen):
        # Whole families at a time, a few of them, so that a merge stays in the processor's cache.
        ends = np.cumsum(size[first[chosen]], dtype=np.int64)
        last = np.flatnonzero(np.append(family[chosen][1:] != family[chosen][:-1], True)) + 1
        cuts = last[np.flatnonzero(np.append(ends[last - 1][1:] // MERGE_BYTES != ends[last - 1][:-1] // MERGE_BYTES, True))]
        found = []
        for part in np.split(chosen, cuts[:-1]):
            found += first_documents([text[begin[first[i]]:begin[first[i]] + size[first[i]]] for i in part], least[part])
        windows = lengths[chosen]
        whole = np.concatenate(found)
        fresh = np.append(True, whole[1:] != whole[:-1])
        fresh[np.cumsum(windows)[:-1]] = True
        at = np.flatnonzero(fresh)
        counts = np.add.reduceat(fresh.astype(np.int64), np.cumsum(windows) - windows)
        n_runs[chosen] = counts
        start = np.cumsum(n_runs) - n_runs
        lengths, values = np.repeat(lengths, n_runs), np.repeat(least, n_runs)
        place = _ranges(start[chosen], counts)
        lengths[place], values[place] = np.diff(np.append(at, len(whole))), whole[at]
    start = np.cumsum(n_runs) - n_runs
    rows = []
    for number, at in _split(chunk, int(chunk.max()) + 1):
        own = entry[at]
        place = _ranges(start[own], n_runs[own])
        rows.append((number, table["group"][0].as_py(), pack(n_runs[own].astype("<i4")), pack(lengths[place].astype("<i4"), values[place].astype("<i8"))))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "part", "data", "runs"])


def _send(groups: int, texts: pa.Table, packed: pa.Table) -> pa.Table:
    """The common segments of a chunk, packed by group of families."""
    rows = []
    if texts.num_rows and packed.num_rows:
        body = _bytes(texts["text"])
        own = _Chunk(body, texts["id"].fill_null(_LAST).to_numpy(), packed["data"].to_pylist())
        chunk, at = texts["chunk"][0].as_py(), own.first
        size = (own.count[at] + LENGTH - 1).astype("<i4")
        for group, here in _split(own.key[at] % np.uint64(groups), groups):
            some, least = at[here], own.least[here]
            content = b"".join(body[d][s:s + n] for d, s, n in zip(own.doc[some].tolist(), own.start[some].tolist(), size[here].tolist(), strict=True))
            rows.append((group, chunk, pack(np.diff(own.key[some], prepend=np.uint64(0)), own.content[some], least, size[here]), zstandard.ZstdCompressor(level=3).compress(content)))
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["group", "chunk", "data", "content"])


def _joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that overlap or touch in one document as one, by document and place."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # Documents lie one behind the other, with a gap between.
    shift = doc * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    first = np.flatnonzero(np.append(True, lo[1:] + shift[1:] > reach[:-1]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - shift[last]


_REMOVED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(options: tuple[bool, int], texts: pa.Table, packed: pa.Table) -> pa.Table:
    """Every document of a chunk without its repeated bytes; ``options`` are whether to return them, and the groups."""
    with_text, groups = options
    body = _bytes(texts["text"]) if texts.num_rows else []
    ids = texts["id"].fill_null(_LAST).to_numpy() if body else np.empty(0, np.int64)
    gone: list[list[tuple[int, int]]] = [[] for _ in body]  # maximal ranges, in order
    if body and packed.num_rows:
        own = _Chunk(body, ids, [d for d in packed["anchors"].to_pylist() if d is not None])
        sent = dict(_split(own.key[own.first] % np.uint64(groups), groups))
        answers = [
            (sent[part], unpack(data, "<i4")[0], unpack(runs, "<i4", "<i8"))
            for part, data, runs in zip(packed["part"].to_pylist(), packed["data"].to_pylist(), packed["runs"].to_pylist(), strict=True) if data is not None
        ]
        if answers:
            place, runs = (np.concatenate(x) for x in zip(*((p, r) for p, r, _ in answers), strict=True))
            length, least = (np.concatenate(x) for x in zip(*(v for _, _, v in answers), strict=True))
            begin = np.cumsum(runs) - runs
            # Segments were sent group by group, in the order of their keys.
            order = np.empty(len(place), np.int64)
            order[place] = np.arange(len(place))
            entry = order[own.entry]
            length = length.astype(np.int64)
            ahead = np.cumsum(length) - length
            ahead -= np.repeat(ahead[begin], runs)
            own_runs = runs[entry].astype(np.int64)
            run, segment = _ranges(begin[entry], own_runs), np.repeat(np.arange(len(entry)), own_runs)
            hit = least[run] < own.id[segment]
            run, segment = run[hit], segment[hit]
            doc, lo = own.doc[segment], own.start[segment] + ahead[run]
            for number, a, b in zip(*(x.tolist() for x in _joined(doc, lo, lo + length[run] + LENGTH - 1)), strict=True):
                gone[number].append((a, b))
    rows = []
    for text, ranges, number in zip(body, gone, texts["id"].to_pylist() if body else [], strict=True):
        ends = [0, *(x for r in ranges for x in r), len(text)]
        left = b"".join([text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)])
        rows.append((number, len(text), len(text) - len(left), len(ranges), hashlib.sha256(left).hexdigest(), left if with_text else None))
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REMOVED, strict=True)], schema=_REMOVED)


def _bound(fn, first):
    """``fn`` of two tables with its first argument fixed."""

    def run(left, right):
        return fn(first, left, right)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, with_text: bool = True) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row of ``docs``.

    ``kept`` are the remaining bytes (null without ``with_text``).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / min(CHUNK_GROWTH * chunk_bytes, max(chunk_bytes, total / MANY_CHUNKS))))
    rows = rows.select(F.pmod(F.xxhash64(F.lit(SEED), "id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "id", "text")
    anchors = stage(common_anchors(rows, chunks), "anchors")
    sent = rows.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_bound(_send, chunks), "group int, chunk int, data binary, content binary")
    settled = sent.groupBy("group").applyInArrow(_settle, "chunk int, part int, data binary, runs binary")
    answers = settled.select("chunk", "part", "data", "runs", F.lit(None).cast("binary").alias("anchors")).unionByName(
        anchors.select("chunk", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("runs"), F.col("data").alias("anchors")),
    )
    done = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _bound(_remove, (with_text, chunks)), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return done.withColumnRenamed("id", id_col)
