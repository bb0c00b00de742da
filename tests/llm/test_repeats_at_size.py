"""Repeated passages: what grows with the input is bounded, and results stay those of brute force."""

import random

import numpy as np
import pytest
from test_documents import docs_of, slow_removal, words

from cobasket.llm import suffix


def shards_of(parts):
    shards, strings, places = [], [], []
    for part in parts:
        text = np.frombuffer(b"".join(s + b"\xff" for s in part), np.uint8)
        bounds = np.cumsum([0] + [len(s) + 1 for s in part])
        symbols, order = suffix.transform(text, bounds)
        shards.append(symbols)
        owner = np.searchsorted(bounds, order, "right") - 1
        strings += [part[k] + b"\xff" for k in owner.tolist()]
        places += (order - bounds[owner]).tolist()
    return shards, strings, places


def test_rows_that_agree_with_none_leave_the_rounds():
    """What is left are the windows met twice or more, equal ones together."""
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 90))) for _ in range(60)]
    strings += [s[: rng.randrange(50, len(s) + 1)] for s in strings[:20]]
    shards, string, place = shards_of((strings[::2], strings[1::2]))
    rows, first = suffix._refine(shards, 50, np.flatnonzero(np.array(place) >= 50).astype(np.int32), False)
    windows = [s[p:p + 50] for s in strings for p in range(len(s) - 49)]
    got = [string[r][place[r]:place[r] + 50] for r in rows.tolist()]
    assert sorted(got) == sorted(w for w in windows if windows.count(w) > 1) and got
    assert [bool(f) for f in first[1:]] == [a != b for a, b in zip(got, got[1:], strict=False)] and first[0]


@pytest.mark.parametrize("slice_bytes", [64, 1 << 17])
def test_pieces_have_equal_hashes_if_they_are_equal(monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix, "_SLICE", slice_bytes)
    suffix._ladders.cache_clear()
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 5, 3000, 40, 700, 700)]
    doc = np.sort(np.array([rng.choice((1, 2, 3, 4, 5)) for _ in range(4000)]))
    start = np.array([rng.randrange(len(texts[d])) for d in doc])
    start = start[np.lexsort((start, doc))]
    size = np.array([min(rng.choice((1, 2, 9, 600)), len(texts[d]) - s) for d, s in zip(doc, start, strict=True)])
    pieces = [texts[d][s:s + n] for d, s, n in zip(doc, start, size, strict=True)]
    found = suffix.digests(texts, doc, start, size).tolist()
    suffix._ladders.cache_clear()
    assert len(set(zip(pieces, found, strict=True))) == len(set(pieces)) == len(set(found))


def test_chunks_grow_with_the_input(spark, monkeypatch):
    """Chunks send a row to every group: their number grows slower than the texts."""
    chunks = []
    monkeypatch.setattr(suffix, "MANY_CHUNKS", 8)
    monkeypatch.setattr(suffix, "common_anchors", lambda rows, n, of=suffix.common_anchors: chunks.append(n) or of(rows, n))
    rng = random.Random(7)
    passage = words(rng, 40, "abc")
    pairs = [(i, " ".join((words(rng, 9, "abc"), rng.choice((passage, "")), words(rng, 9, "abc")))) for i in range(80)]
    found = suffix.remove_repeats(docs_of(spark, pairs), chunk_bytes=200).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == slow_removal(pairs)
    assert chunks[0] < sum(len(t) for _, t in pairs) / 200 / 3
