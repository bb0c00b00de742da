"""Counting pairs of ids in blocks: what a task does with packed baskets.

Ids are numbered by falling frequency. Steps of ``BLOCK_ITEMS`` ids are merged to blocks of
about equal weight, so a block of frequent items is narrow and one of rare items wide. An id
travels once for each block; there are no more blocks than bound the ids and the pairs of a unit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Items of the narrowest block.
BLOCK_ITEMS = 64
#: Items of the widest block; ids inside a block fit 16 bits.
_WIDEST = 1 << 16
#: Blocks there are at least, where the items allow it.
_BLOCKS = 16
#: Expected pairs of baskets and items that one unit counts.
UNIT_PAIRS = 1 << 31
#: Ids of a block at most, where it has several steps.
_BLOCK_IDS = 1 << 26
#: Left ids of a unit that are sorted at once.
PART_IDS = 1 << 22
#: Ids that a task packs before it hands them on.
HELD_IDS = 1 << 22
#: Pairs that a unit forms at once.
SORTED_PAIRS = 1 << 18
_ROWS = 1 << 17
#: Items up to which a task counts all pairs in one table of its own.
FEW_ITEMS = 1 << 10

PACKED = "one int, other int, share int, sizes binary, ids binary"
COUNTED = "a int, b int, n bigint, whole boolean"
#: Rows of ``PACKED``, and others that bring the items of a unit's left (0) or right (1) side: frequencies, ids and items.
PACKED_NAMED = PACKED + ", side int, items array<{item}>"
COUNTED_NAMED = "item_a {item}, n_a bigint, item_b {item}, n_b bigint, n_ab bigint"
FEW_COUNTED = "a int, b int, n bigint"

Batches = Iterator[pa.RecordBatch]


class Loads:
    """The blocks, the sizes of units, and in how many shares the baskets of one are dealt out.

    ``weights`` are the sums of the frequencies of each step's items. Only pairs with an id below
    ``outer``, or both below ``inner``, are counted, where these are given; both are starts of steps.
    """

    def __init__(self, weights: list[int], n_baskets: int, outer: int | None = None, inner: int | None = None):
        self.n_baskets = max(1, n_baskets)
        self.outer, self.inner = outer, inner
        self.step, self.unit_pairs, self.held_ids, self.sorted_pairs = BLOCK_ITEMS, UNIT_PAIRS, HELD_IDS, SORTED_PAIRS
        most = min(math.sqrt(self.unit_pairs * self.n_baskets), sum(weights) / _BLOCKS, _BLOCK_IDS)
        firsts: list[int] = []
        self.weights: list[int] = []
        for i, weight in enumerate(weights):
            joins = i * self.step not in (outer, inner) and self.weights[-1:] and self.weights[-1] + weight <= most
            if joins and (i + 1 - firsts[-1]) * self.step <= _WIDEST:
                self.weights[-1] += weight
            else:
                firsts.append(i)
                self.weights.append(weight)
        self.starts = np.array(firsts, np.int64) * self.step
        self.widths = np.diff(self.starts, append=len(weights) * self.step)

    def shares(self, one: int, other: int) -> int:
        return 1 + int(self.weights[one] * self.weights[other] / self.n_baskets) // self.unit_pairs

    def asked(self, one: int, other: int) -> bool:
        """Whether pairs of these blocks are counted, ``one`` not behind ``other``."""
        return self.outer is None or self.starts[one] < self.outer or self.starts[other] < self.inner

    def _all_shares(self) -> list[int]:
        blocks = range(len(self.weights))
        return [self.shares(one, other) for one in blocks for other in blocks[one:] if self.asked(one, other)]

    def units(self) -> int:
        """How many units there are."""
        return sum(self._all_shares())

    def any_shared(self) -> bool:
        return max(self._all_shares(), default=1) > 1


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs given by their starts and lengths, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def pack(loads: Loads, whole: bool | None = None) -> Callable[[Batches], Batches]:
    """``(hash, ids)`` of baskets, ids ascending -> rows of ``PACKED`` for every pair of blocks a basket touches.

    ``sizes`` and ``ids`` hold the left sides of all baskets, then their right sides; a unit of
    one block with itself has only left ones. ``whole`` takes only units of one share, or only others.
    """

    def flush(held: dict) -> pa.RecordBatch:
        names = ("one", "other", "share")
        keys = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]

        def joined(at: int) -> pa.Array:
            parts = ([p[at] for p in rows] + [p[at + 2] for p in rows if len(p) > 2] for rows in held.values())
            return pa.array([np.concatenate(p).tobytes() for p in parts], pa.binary())

        return pa.RecordBatch.from_arrays([*keys, joined(0), joined(1)], names=[*names, "sizes", "ids"])

    def run(batches: Batches) -> Batches:
        held, size = defaultdict(list), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            hashes = batch.column(0).to_numpy()
            values = lists.flatten().to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())
            blocks = np.searchsorted(loads.starts, values, "right") - 1
            inner = (values - loads.starts[blocks]).astype(np.uint16)
            # Runs of one basket in one block, and where each basket has them.
            basket = np.repeat(np.arange(len(lengths)), lengths)
            first = np.flatnonzero(np.diff(basket * len(loads.starts) + blocks, prepend=-1))
            count = np.diff(first, append=len(values)).astype(np.int32)
            place = np.full((len(loads.starts), len(lengths)), -1, np.int32)
            place[blocks[first], basket[first]] = np.arange(len(first))
            present = [b for b in range(len(loads.starts)) if (place[b] >= 0).any()]
            for i, one in enumerate(present):
                for other in present[i:]:
                    if not loads.asked(one, other) or whole not in (None, loads.shares(one, other) == 1):
                        continue
                    if one == other:
                        met = np.flatnonzero(place[one] >= 0)
                        met = met[count[place[one, met]] > 1]
                    else:
                        met = np.flatnonzero((place[one] >= 0) & (place[other] >= 0))
                    shares = loads.shares(one, other)
                    groups = [met]
                    if shares > 1:
                        share = hashes[met] % shares
                        order = np.argsort(share, kind="stable")
                        groups = np.split(met[order], np.flatnonzero(np.diff(share[order])) + 1)
                    for group in groups:
                        if not len(group):
                            continue
                        sides: list[np.ndarray] = []
                        for block in (one,) if one == other else (one, other):
                            runs = place[block, group]
                            sides += (count[runs], inner[_spread(first[runs], count[runs])])
                            size += len(sides[-1])
                        held[one, other, int(hashes[group[0]] % shares)].append(sides)
                if size >= loads.held_ids:
                    yield flush(held)
                    held, size = defaultdict(list), 0
        if held:
            yield flush(held)

    return run


def pack_items(loads: Loads) -> Callable[[Batches], Batches]:
    """``(id, item, n)`` -> the rows of ``PACKED_NAMED`` that bring items, for every unit of one share."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            counts = batch.column(2).to_numpy()
            blocks = np.searchsorted(loads.starts, ids, "right") - 1
            rows, items = [], []
            for block in np.unique(blocks).tolist():
                at = np.flatnonzero(blocks == block)
                inner = (ids[at] - loads.starts[block]).astype(np.uint16).tobytes()
                some = batch.column(1).take(pa.array(at))
                for k in range(len(loads.starts)):
                    one, other = min(block, k), max(block, k)
                    if loads.asked(one, other) and loads.shares(one, other) == 1:
                        rows.append((one, other, 0, counts[at].astype(np.int64).tobytes(), inner, int(block > k)))
                        items.append(some)
            if rows:
                kinds = (*[pa.int32()] * 3, pa.binary(), pa.binary(), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                ends = np.cumsum([0] + [len(x) for x in items]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(items))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["one", "other", "share", "sizes", "ids", "side", "items"])

    return run


class Cells:
    """The pairs of one unit, counted item by item of its left side: memory is that of its baskets and of ``sorted_pairs`` pairs."""

    def __init__(self, loads: Loads, one: int, other: int):
        self.same, self.width, self.at_once = one == other, int(loads.widths[other]), loads.sorted_pairs
        self.left, self.left_sizes, self.right, self.right_sizes = [], [], [], []

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.same:
            self.left.append(ids)
            self.left_sizes.append(sizes)
            return
        half = len(sizes) // 2
        cut = int(sizes[:half].sum())
        self.left_sizes.append(sizes[:half])
        self.right_sizes.append(sizes[half:])
        self.left.append(ids[:cut])
        self.right.append(ids[cut:])

    def _meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Left ids in ascending order, each with the run of right ids that it meets, and the right ids; some items at a time."""
        if not self.left:
            return
        left, sizes = np.concatenate(self.left), np.concatenate(self.left_sizes)
        self.left = []
        basket = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if self.same:
            right, ends = left, np.cumsum(sizes).astype(np.int32)
        else:
            right, others = np.concatenate(self.right), np.concatenate(self.right_sizes)
            self.right = []
            ends = np.cumsum(others).astype(np.int32)
        upto = np.cumsum(np.bincount(left))
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PART_IDS, "right")))
            at = np.flatnonzero((left >= lo) & (left < hi)).astype(np.int32)
            at = at[np.argsort(left[at], kind="stable")]
            of = basket[at]
            first = at + np.int32(1) if self.same else ends[of] - others[of]
            if len(at):
                yield left[at], first, ends[of] - first, right
            lo = hi

    def found(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(left, right, count)`` of the pairs met ``least`` times or more."""
        for meetings in self._meetings():
            yield from self._counted(max(1, least), *meetings)

    def _counted(self, least: int, left: np.ndarray, first: np.ndarray, length: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.cumsum(length, dtype=np.int64)
        items = np.append(np.flatnonzero(np.diff(left.astype(np.int32), prepend=-1)), len(left))
        upto = np.append(0, ends[items[1:] - 1])
        at = 0
        while at < len(items) - 1:
            # As many items as have few enough pairs together, or one that is counted bit by bit.
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + self.at_once, "right")) - 1)
            lo, hi = int(items[at]), int(items[to])
            n_pairs = int(upto[to] - upto[at])
            if to == at + 1:
                totals = np.zeros(self.width, np.int64)
                while lo < hi and n_pairs:
                    seen = ends[lo] - length[lo]
                    end = min(hi, max(lo + 1, int(np.searchsorted(ends, seen + self.at_once, "right"))))
                    totals += np.bincount(right[_spread(first[lo:end], length[lo:end])], minlength=self.width)
                    lo = end
                keys = np.flatnonzero(totals >= least)
                yield np.full(len(keys), int(left[items[at]])), keys, totals[keys]
            elif n_pairs:
                keys = right[_spread(first[lo:hi], length[lo:hi])] + np.repeat((left[lo:hi] - left[lo]).astype(np.int64) * self.width, length[lo:hi])
                cells = (int(left[hi - 1]) - int(left[lo]) + 1) * self.width
                if cells <= 4 * n_pairs:
                    totals = np.bincount(keys)
                    keys = np.flatnonzero(totals >= least)
                    n = totals[keys]
                else:
                    keys = np.sort(keys.astype(np.uint32) if cells < 1 << 32 else keys)
                    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    n = np.diff(starts, append=len(keys))
                    keys, n = keys[starts[n >= least]].astype(np.int64), n[n >= least]
                yield keys // self.width + int(left[lo]), keys % self.width, n
            at = to


def _together(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of found pairs, small ones joined."""
    held, n_held = [], 0
    for part in parts:
        held.append(part)
        n_held += len(part[2])
        if n_held >= _ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n_held = [], 0
    if n_held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def count(loads: Loads, least: int) -> Callable[[Batches], Batches]:
    """Rows of ``PACKED``, sorted by unit -> rows of ``COUNTED``; a unit that sees all baskets (``whole``) drops what is below ``least``."""

    def rows(unit: tuple[int, int], cells: Cells) -> Batches:
        whole = loads.shares(*unit) == 1
        one, other = (int(loads.starts[k]) for k in unit)
        for a, b, n in _together(cells.found(least if whole else 1)):
            columns = [pa.array((a + one).astype(np.int32)), pa.array((b + other).astype(np.int32)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), whole))], names=["a", "b", "n", "whole"])

    def run(batches: Batches) -> Batches:
        unit, cells = None, None
        for batch in batches:
            for one, other, share, sizes, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (one, other, share) != unit:
                    if unit:
                        yield from rows(unit[:2], cells)
                    unit, cells = (one, other, share), Cells(loads, one, other)
                cells.add(np.frombuffer(sizes, np.int32), np.frombuffer(ids, np.uint16))
        if unit:
            yield from rows(unit[:2], cells)

    return run


def count_named(loads: Loads, least: int) -> Callable[[Batches], Batches]:
    """Rows of ``PACKED_NAMED`` of units of one share, sorted by unit -> rows of ``COUNTED_NAMED``."""

    def rows(cells: Cells, sides: tuple[list, list]) -> Batches:
        known = []
        for parts in sides:
            ids = np.concatenate([i for _, i, _ in parts]) if parts else np.zeros(0, np.uint16)
            place = np.zeros(1 << 16, np.int32)
            place[ids] = np.arange(len(ids))
            known.append((place, np.concatenate([n for n, _, _ in parts]) if parts else ids, pa.concat_arrays([x for _, _, x in parts]) if parts else None))
        left, right = known[0], known[0] if cells.same else known[1]
        for a, b, n in _together(cells.found(least)):
            columns = []
            for (place, counts, items), ids in ((left, a), (right, b)):
                columns += [items.take(pa.array(place[ids])), pa.array(counts[place[ids]])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=["item_a", "n_a", "item_b", "n_b", "n_ab"])

    def run(batches: Batches) -> Batches:
        unit, cells, sides = None, None, ([], [])
        for batch in batches:
            items = batch.column(6)
            for i, (one, other, _, sizes, ids, side) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if (one, other) != unit:
                    if unit:
                        yield from rows(cells, sides)
                    unit, cells, sides = (one, other), Cells(loads, one, other), ([], [])
                if side is None:
                    cells.add(np.frombuffer(sizes, np.int32), np.frombuffer(ids, np.uint16))
                else:
                    sides[side].append((np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.uint16), items[i].values))
        if unit:
            yield from rows(cells, sides)

    return run


def count_few(width: int) -> Callable[[Batches], Batches]:
    """``(hash, id)`` rows, each basket's together -> rows of ``FEW_COUNTED``.

    There are ``width`` ids; a row without id only shows that there is a basket, and a repeated one
    changes nothing. A cell (a, b) is a pair, (a, a) the item itself, (-1, -1) the number of baskets.
    A task holds its table, one batch and the ids of the basket that goes on in the next.
    """
    bits = max(1, width).bit_length()

    def met(codes: np.ndarray) -> Iterator[np.ndarray]:
        """The cells of whole baskets, given as ascending codes of basket and id, some at a time."""
        basket, ids = codes >> bits, codes & ((1 << bits) - 1)
        firsts = np.flatnonzero(np.append(True, basket[1:] != basket[:-1]))
        sizes = np.diff(firsts, append=len(ids))
        # Every row meets itself and what follows it in its basket.
        lengths = np.repeat(firsts + sizes, sizes) - np.arange(len(ids))
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ids):
            seen = int(ends[at] - lengths[at])
            to = max(at + 1, int(np.searchsorted(ends, seen + SORTED_PAIRS, "right")))
            yield np.repeat(ids[at:to] * width, lengths[at:to]) + ids[_spread(np.arange(at, to), lengths[at:to])]
            at = to

    def run(batches: Batches) -> Batches:
        cells, baskets, last = np.zeros(width * width, np.int64), 0, None
        open_ids, held, n_held = np.zeros(0, np.int64), [], 0

        def add(codes: np.ndarray) -> None:
            nonlocal held, n_held
            for keys in met(codes):
                held.append(keys)
                n_held += len(keys)
                if n_held >= SORTED_PAIRS:
                    flush()

        def flush() -> None:
            nonlocal held, n_held
            if held:
                cells[:] += np.bincount(np.concatenate(held), minlength=len(cells))
            held, n_held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, ids = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy().astype(np.int64)
            # The basket that was open is number 0 of this batch.
            basket = np.cumsum(np.append(last is None or hashes[0] != last, hashes[1:] != hashes[:-1]))
            baskets, last = baskets + int(basket[-1]), hashes[-1]
            codes = np.sort(np.append(open_ids, ((basket << bits) | ids)[ids >= 0]))
            codes = codes[np.append(True, codes[1:] != codes[:-1])[:len(codes)]]
            cut = int(np.searchsorted(codes, basket[-1] << bits))
            if cut:
                add(codes[:cut])
            open_ids = codes[cut:] & ((1 << bits) - 1)
        if len(open_ids):
            add(open_ids)
        flush()
        found = np.flatnonzero(cells)
        columns = [np.append(found // max(1, width), -1), np.append(found % max(1, width), -1), np.append(cells[found], baskets)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64), strict=True)], names=["a", "b", "n"])

    return run
