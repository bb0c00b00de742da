"""SimHash, repeated passages, decontamination, personal data: against brute force, on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cobasket.llm import decontam, pii, simhash, suffix

DOCS = "doc_id long, text string, key string, `row_key` int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], DOCS)


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(n))


# -- near copies -------------------------------------------------------------

def slow_fingerprint(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)] * bool(found)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(pairs):
    prints = [slow_fingerprint(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(pairs, group, strict=True):
        least.setdefault(g, []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in least.items()}
    return sorted(((i, format(p, "016x"), least[g]) for (i, _), p, g in zip(pairs, prints, group, strict=True)), key=str)


@pytest.mark.parametrize("unit", [50_000, 2])
def test_groups(spark, unit):
    rng = random.Random(4)
    base = [words(rng, 200) for _ in range(8)]
    pairs = [(100 + i, t) for i, t in enumerate(base)]
    for i in range(60):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = "edit"
        pairs.append((200 + i, " ".join(t)))
    pairs += [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "oNE"), (6, "one two"), (7, base[0].upper()), (7, base[0]), (None, base[1]), (None, "alone"), (9, "é x É y")]
    pairs.append((10, words(rng, 30_000)))
    docs = docs_of(spark, pairs)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, unit_rows=unit).collect()), key=str)
    assert got == slow_groups(pairs)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {g for *_, g in slow_groups(pairs)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(g for g in groups if g is not None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [50_000, 40])
def test_dense_fingerprints_lose_no_link(spark, unit):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:6]:
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    prints = np.array(sorted(prints), np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 3) for p in prints]
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    signed = prints.view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.linked(frame, unit)).collect()}
    ours = {}
    for p in signed:
        ours.setdefault(roots.get(p, p), set()).add(p)
    theirs = {}
    for p, g in zip(signed, label.tolist(), strict=True):
        theirs.setdefault(g, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


# -- repeated passages -------------------------------------------------------

def slow_removal(pairs):
    starts = {}
    for i, t in pairs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            starts.setdefault(b[p:p + 50], []).append(float("inf") if i is None else i)
    out = []
    for i, t in pairs:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 49):
            if min(starts[b[p:p + 50]]) < (float("inf") if i is None else i):
                gone.update(range(p, p + 50))
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("wide", [512, 2])
@pytest.mark.parametrize("chunk", [8 << 20, 700])
def test_repeats(spark, monkeypatch, chunk, wide):
    monkeypatch.setattr(suffix, "WIDE_ANCHOR", wide)
    rng = random.Random(11)
    passages = ["".join(rng.choice("ab cé") for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    pairs = []
    for i in range(60):
        parts = [words(rng, rng.randrange(12), "abc") for _ in range(3)]
        pairs.append((i, rng.choice(passages).join(parts)))
    pairs += [(70, None), (71, ""), (72, "x" * 49), (73, "y" * 120), (74, "y" * 60), (75, "z" * 300), (3, pairs[5][1]), (5, pairs[5][1]), (5, pairs[5][1]), (None, pairs[8][1]), (None, pairs[8][1])]
    pairs.append((76, "".join(rng.choice("abcdefgh ") for _ in range(60_000))))
    found = suffix.remove_repeats(docs_of(spark, pairs), chunk_bytes=chunk).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == slow_removal(pairs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(docs_of(spark, []).limit(0)).count() == 0


def test_merged_transforms_are_sorted():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(3, 90))) for _ in range(40)]
    strings = sorted(set(strings))
    shards, rows = [], []
    for part in (strings[::2], strings[1::2]):
        text = np.frombuffer(b"".join(s + b"\xff" for s in part), np.uint8)
        bounds = np.cumsum([0] + [len(s) + 1 for s in part])
        symbols, order = suffix.transform(text, bounds)
        shards.append(symbols)
        turned = []
        for at in order.tolist():
            k = int(np.searchsorted(bounds, at, "right")) - 1
            s = part[k] + b"\xff"
            at -= bounds[k]
            turned.append((s[at:] + s[:at]) * 40)
        assert turned == sorted(turned)
        rows.append(turned)
    source, fresh = suffix.merge(shards, 50)
    at, merged = [0, 0], []
    for s in source.tolist():
        merged.append(rows[s][at[s]][:50])
        at[s] += 1
    assert merged == sorted(merged) and max(map(len, shards)) > 200
    for i in range(1, len(merged)):
        assert fresh[i] or merged[i] == merged[i - 1]
        assert not fresh[i] or merged[i] != merged[i - 1] or b"\xff" in merged[i]


# -- benchmark ---------------------------------------------------------------

def item_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow_contamination(docs, items):
    out = []
    for i, text in docs:
        own, hit, listed = item_words(text), set(), set()
        for item, body in items:
            w = item_words(body)
            n = min(13, len(w))
            windows = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
            places = [p for p in range(len(own) - n + 1) if tuple(own[p:p + n]) in windows] if w else []
            for p in places:
                hit.update(range(p, p + n))
            if places and item is not None:
                listed.add(str(item))
        out.append((i, len(own), len(hit), len(listed), sorted(listed), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [4_000_000, 50])
def test_contamination(spark, segment, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", segment)
    rng = random.Random(9)
    items = [(i, words(rng, rng.choice([1, 3, 13, 14, 40]), "ab")) for i in range(12)]
    items += [(20, None), (21, "!!"), (22, items[3][1]), (None, items[4][1]), (5, "héllo wörld 42"), (5, "zz top")]
    docs = []
    for i in range(50):
        parts = [words(rng, rng.randrange(30), "abc") for _ in range(3)]
        docs.append((i, f" {(rng.choice(items)[1] or '')} ".join(parts)))
    docs += [(60, None), (61, ""), (62, "..."), (63, "HÉLLO héllo, WöRLD-42"), (7, docs[7][1]), (7, docs[7][1]), (None, items[2][1]), (64, words(rng, 20_000, "xyz") + " " + items[2][1])]
    frame, bench = docs_of(spark, docs), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    index = decontam.build_index(frame, segment_words=segment)
    assert segment > 50 or index.select("segment").distinct().count() > 5
    got = sorted((tuple(r) for r in decontam.contamination(frame, bench).collect()), key=str)
    want = slow_contamination(docs, items)
    assert [g[:4] + (list(g[4]), g[5]) for g in got] == want
    blocks = decontam.find_phrases(index, bench, block_items=3)
    assert blocks.select("segment", "place").distinct().count() == sum(w[2] > 0 for w in want)
    kept = decontam.keep_uncontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])
    assert decontam.contamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.contamination(frame, bench.limit(0)).collect()} == {0}


def test_near_words(spark):
    docs = docs_of(spark, [(1, "a x x b c"), (2, "b a"), (3, "c b x x x x a"), (4, "a"), (5, "b")])
    index = decontam.build_index(docs)
    got = sorted(tuple(r)[2:] for r in decontam.near(index, ["A", "b"], 4).collect())
    assert got == [(1, 0, 4), (2, 0, 2)]
    assert decontam.near(index, ["a", "missing"], 9).count() == 0


# -- personal data -----------------------------------------------------------

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    found = []
    for k, (kind, pattern) in enumerate(RULES):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


AWKWARD = [
    None, "", "a@b.c", "a@b.c_d@e.f", "x@y", "@a.b", "a@b.c.d@e.f", "a@b..c", "é@b.c", "😀 me@x.org 😀 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0000255.1.1.1", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "1" * 12, "0" * 19, "0" * 20, "12345", "+1 (743) 555-3824", "+12", "+1 2", "+1 (((", "+49.30.1234567-",
    "++1 555 555 5555", "+1 555 555 5555 4111111111111111", "call 743 555 3824 now", "1-2-3-4-5-6-7-8-9-0-1-2", "me (at) x (dot) org", "1[.]2[.]3[.]4", "a" * 30_000 + "@" + "b.c" * 5000,
    *[f"12 34 56-78 90 {n:02d}" for n in range(40)], "1 2 3 4 5 6 7 8 9 0 1 8 1 2 3", "9" * 50_000, "1.2.3.4 " * 600, "card 4111.1111.1111.1111",
    "1.2.3.4@x.com", "4111111111111111@x.com", "+4111111111111111 1.2.3.4@a.b",
]


def test_base_spans(spark):
    rng = random.Random(12)
    texts = AWKWARD + ["".join(rng.choice("0123456789") if rng.random() < 0.6 else rng.choice("+.-() @a") for _ in range(120)) for _ in range(300)]
    docs = docs_of(spark, list(enumerate(texts)) + [(None, "a@b.c"), (2, "a@b.c")])
    none = {r.doc_id: r for r in pii.report(docs, pii.Trees()).collect()}
    for i, text in enumerate(texts):
        want = slow_base(text)
        assert none[i].base == want and none[i].spans == want, (i, text and text[:80])
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert [none[i][f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]
    assert pii.report(docs.limit(0), pii.Trees()).count() == 0


def person(rng):
    card = "".join(rng.choice("0123456789") for _ in range(15))
    card += next(d for d in "0123456789" if luhn(card + d))
    return rng.choice([f"mail u{rng.randrange(99)}@host{rng.randrange(9)}.example.com", f"ip {'.'.join(str(rng.randrange(256)) for _ in range(4))}", f"card {card}", f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"])


def test_trees_add_but_never_take(spark):
    rng = random.Random(13)
    pairs = [(i, f"{words(rng, 20)} {person(rng)} {words(rng, 20)}") for i in range(400)]
    model = pii.train(docs_of(spark, pairs))
    assert model.trees and len(model.thresholds) == 4
    probes = [(1, "card 4111.1111.1111.1111 x"), (2, "host 10.2.3.4"), (3, "plain words only"), (4, None), (5, "version 2.0 of 2019"), (6, "a@b.c and 10.0.0.1")]
    docs = docs_of(spark, probes)
    got = {r.doc_id: r for r in pii.report(docs, model).collect()}
    for i, text in probes:
        assert set(filter(None, slow_base(text).split(","))) <= set(got[i].spans.split(","))
    assert got[3].spans == "" and got[5].spans == ""
    clean = {r.doc_id: r for r in pii.redact(docs.withColumn("n_chars", F.length("text").cast("long")), model).collect()}
    assert clean[2].text == "host [IP]" and clean[2].n_chars == 9 and clean[4].text is None and clean[3].text == probes[2][1]
    assert clean[6].text == "[EMAIL] and [IP]" and clean[6].key == "x"
    assert pii.train(docs.limit(0)).trees == []


def test_trees_and_thresholds_come_from_all_documents(spark, monkeypatch):
    seen, fit = [], pii.fit
    monkeypatch.setattr(pii, "fit", lambda rows, **k: (seen.append(rows.agg(F.sum("n")).first()[0]), fit(rows, **k))[1])
    mails = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("to u"), "id", F.lit("@host.example.com")).alias("text"))
    assert pii.train(mails).trees
    # Each mail and its turned copy: both halves, and the whole.
    assert sum(seen[:2]) == seen[2] == 48_000


def test_overlapping_spans_become_one(spark):
    docs = docs_of(spark, [(1, "x +378282246310005 y")])
    assert [r.spans for r in pii.report(docs, pii.Trees()).collect()] == ["phone:2:18,card:3:18"]
    assert [r.text for r in pii.redact(docs, pii.Trees()).collect()] == ["x [PHONE] y"]
