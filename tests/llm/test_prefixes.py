"""The conversation trie against one made node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cobasket.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, n int, part string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0))] for c, ts in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return found


def expected(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        words = len(p[-1][1].split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * words
            leaves[p[:d]] += p not in kids
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(p))).encode()).hexdigest())
        for p, who in members.items()
    )


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = prefixes.trie(prefixes.branched(prefixes.conversations(df))).collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple(-1 if x is None else x for x in r))


def check(spark, rows):
    want = sorted(expected(rebuilt(rows)), key=lambda r: tuple(-1 if x is None else x for x in r))
    assert run(spark, rows) == want


@pytest.mark.parametrize("seed, fan_in, parts", [(1, 64, 4), (2, 2, 16), (3, 3, 37)])
def test_random_conversations(spark, monkeypatch, seed, fan_in, parts):
    # Many short ranges and small groups of them: every kind of boundary.
    monkeypatch.setattr(prefixes, "FAN_IN", fan_in)
    monkeypatch.setattr(prefixes, "tasks_for", lambda df: parts)
    rng = random.Random(seed)
    rows = []
    for c in range(300):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, "d e f"])) for _ in range(rng.choice([1, 2, 3, 5, 9]))]
        rows += [(c, d if d else rng.choice([0, None]), *t) for d, t in enumerate(turns)]
    check(spark, rows)


def test_large_group_and_deep_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "FAN_IN", 2)
    monkeypatch.setattr(prefixes, "tasks_for", lambda df: 9)
    monkeypatch.setattr(prefixes, "IDS_BITS", 4)
    rows = [(c, d, "user", f"t {d}") for c in range(0, 2000, 20) for d in range(5)]
    rows += [(5 + 20 * k, d, "user", f"t {d}") for k in range(40) for d in range(6 + k)]
    rows += [(4001, d, "user", f"t {d}") for d in range(1000)] + [(4021, d, "user", f"t {d}" if d < 700 else "x y") for d in range(900)]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(None, 0, "user", "a"), (20, None, None, None), (21, 0, "user", "a"), (22, 1, "user", "b" * 100_000), (23, 0, "user", "z")])
    check(spark, [(1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "user", "same")])
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "a")]) == []
    check(spark, [(20, 0, "user", "only one")])
