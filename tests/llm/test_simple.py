"""Archive, token counts, vector search, mixing: against brute force, on awkward rows."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cobasket.llm import mixing, tokens, topk, warc

DOCS = "doc_id long, text string, source string, size string"


# -- archive -----------------------------------------------------------------

PAGES = [
    (3, "http://a/x y\r\nz", "<p>one</p>", 1), (1, None, "<p>one</p>", 1), (1, None, "<p>one</p>", 1), (2, "http://b", None, 2), (7, "http://b", "", 2),
    (None, "http://c", "<p>one</p>", 3), (None, None, "alone", 3), (None, None, "alone", 4), (5, "http://d", "é" * 30_000, 4), (9, "http://d", "é" * 30_000, 4),
    (2, "http://b", "other", 5),
]


def archive(spark, rows, **options):
    path = warc.new_archive_path(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    manifest = warc.write_archive(pages, path, **options)
    return manifest, warc.read_archive(spark, path)


def test_an_outlying_key_leaves_many_shards(spark):
    rows = [(k, None, f"page {k} " + "x" * 80, 1) for k in range(3000)] + [(1 << 60, None, "far", 1)] + [(None, None, f"lost {k} " + "y" * 80, 1) for k in range(500)]
    manifest, found = archive(spark, rows, shard_bytes=8000)
    assert found.count() == len(rows)
    files = manifest.orderBy("shard", "seq").collect()
    assert len({f.shard for f in files}) > 30
    keyed = [f for f in files if f.first_key is not None]
    assert all(a.last_key < b.first_key for a, b in zip(keyed, keyed[1:], strict=False)) and max(f.records for f in keyed) < 150
    assert sum(f.records for f in files if f.first_key is None) == 500 and sum(f.first_key is None for f in files) > 3


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 10, "roll_bytes": 200}])
def test_archive_round_trip(spark, options):
    manifest, found = archive(spark, PAGES, **options)
    got = sorted((r.key is None, r.key or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect())
    want, groups = [], {}
    for key, _, html, _ in PAGES:
        groups.setdefault((html or "").encode(), []).append(key)
    for payload, keys in groups.items():
        first = min((k for k in keys if k is not None), default=None)
        taken = False
        for key in keys:
            response = key == first and not taken
            taken = taken or response
            want.append((key is None, key or 0, len(payload), warc.base32_sha1(payload), "response" if response else "revisit", None if response else first))
    assert got == sorted(want, key=lambda w: (w[:5], w[5] is None, w[5] or 0))
    kept = manifest.collect()
    assert sum(r.records for r in kept) == len(PAGES)
    if options:
        assert len(kept) > 3


def test_archive_is_the_same_every_time(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7) + str(i % 5), 0) for i in range(200)]
    sums = []
    for parts in (1, 5):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int").repartition(parts)
        sums.append([tuple(r) for r in warc.write_archive(pages, warc.new_archive_path(spark), shard_bytes=100, roll_bytes=900).orderBy("name").collect()])
    assert sums[0] == sums[1]


def test_small_payloads_may_all_be_responses(spark):
    _, found = archive(spark, [(1, None, "ab", 0), (2, None, "ab", 0)], min_revisit_bytes=3)
    assert {r.record_type for r in found.collect()} == {"response"}


def test_empty_archive(spark):
    manifest, _ = archive(spark, PAGES[:1])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = warc.write_archive(pages, warc.new_archive_path(spark))
    assert empty.count() == 0 and manifest.count() == 1


def test_damaged_records_are_found(spark):
    data = warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), True, None)
    import gzip

    fields, block = next(iter(warc.parse_records(gzip.compress(data) + gzip.compress(data))))
    assert fields["WARC-Block-Digest"] == "sha1:" + warc.base32_sha1(block) and block.endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(data)[:-9]))


# -- tokens ------------------------------------------------------------------

PIECES = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("aba", -5.0), ("▁a", -4.0), ("ba", -3.0), ("é", -1.0)]
TEXTS = ["", "abab aba", " ", "  a  b", "▁a▁", "xyz", "aé\n\nb\tc", "日本 x", "abababab" * 40, "\n", "<0x41>", None]


def slow_count(text, pieces, by_bytes):
    """The forward search of a unigram tokenizer, over one word after another."""
    scores = dict(pieces)
    unknown = min(scores.values()) - 10
    text = (text or "").replace(" ", "▁")
    if not text:
        return 0
    text = text if text[0] == "▁" else "▁" + text
    words = ["▁" + w for w in text.split("▁")[1:]]
    total = 0
    for w in words:
        best = {0: (0.0, [])}
        for at in range(len(w)):
            score, path = best[at]
            single = False
            for end in range(at + 1, len(w) + 1):
                if w[at:end] in scores:
                    single = single or end == at + 1
                    if end not in best or score + scores[w[at:end]] > best[end][0]:
                        best[end] = (score + scores[w[at:end]], [*path, w[at:end]])
            if not single and (at + 1 not in best or score + unknown > best[at + 1][0]):
                best[at + 1] = (score + unknown, [*path, None, w[at]])
        path, fused, i = best[len(w)][1], False, 0
        while i < len(path):
            if path[i] is None:
                total += len(path[i + 1].encode()) if by_bytes else (not fused)
                fused, i = True, i + 2
            else:
                total, fused, i = total + 1, False, i + 1
    return total


@pytest.mark.parametrize("pieces", [PIECES, [p for p in PIECES if not p[0].startswith("<0x")]])
def test_token_counts(spark, pieces):
    by_bytes = len(pieces) > 200
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é\nx") for _ in range(rng.randrange(40))) for _ in range(150)]
    counter = tokens.PieceCounter(pieces)
    assert [counter.count(t)[0] for t in texts] == [slow_count(t, pieces, by_bytes) for t in texts]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)] + [(None, "ab", "s", "x")], DOCS)
    got = {r.doc_id: r.n_pieces for r in tokens.count_pieces(docs, pieces).collect()}
    assert got[0] == 0 and len(got) == len(texts) + 1 and got[None] == counter.count("ab")[0]
    assert tokens.count_pieces(docs.limit(0), pieces).count() == 0


def test_token_counts_of_a_public_tokenizer(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    lib = pytest.importorskip("tokenizers")
    try:
        pieces = tokens.read_pieces(path)
    except OSError:
        pytest.skip("no vocabulary files")
    real = lib.Tokenizer(lib.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    real.pre_tokenizer = lib.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokens.PieceCounter(pieces)
    for text in [*TEXTS[:-1], "The quick  brown fox.\nÜber straße; naïve café 12345 😀" * 9]:
        assert counter.count(text)[0] == len(real.encode(text, add_special_tokens=False).ids), text


# -- vectors -----------------------------------------------------------------

def slow_top(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(sound):
        if i is None or i % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, (j, v) in enumerate(sound) if m != n]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8192, 7])
def test_top_vectors(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(5, [0.5] * 6), (5, [0.5] * 6), (61, None), (62, [1.0, None]), (63, [float("nan")] * 6), (64, [float("inf")] * 6), (65, [0.0] * 6), (None, [3.0] * 6), (70, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, "u") for i, v in rows], "vec_id long, embedding array<double>, uid string")
    found = topk.top_k(vectors, F.col("vec_id") % 5 == 0, k=4, block_rows=block, block_queries=block)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_top(rows, 4)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = topk.top_k(vectors.filter("vec_id IN (10, 11)"), F.col("vec_id") == 10, k=4)
    assert few.count() == 1


# -- mixing ------------------------------------------------------------------

def slow_targets(sizes, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, target, free = sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: float(repeats * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(200))), rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(600)]
    rows += [(900, "one two", "tiny", "x"), (901, None, "none", "x"), (902, " \t\n", "none", "x"), (903, "a b\x1fc d", "b", "x"), (None, "k k", "c", "x"), (5, "same", "c", "x"), (5, "same", "c", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs)
    got = found.collect()
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(rows)
    import re

    size = {}
    for _, text, source, _ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = slow_targets(size)
    taken, of_doc = {}, {i: s for i, _, s, _ in rows}
    for r in got:
        source = of_doc[r.doc_id]
        assert r.source_size == size[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    for source, n in taken.items():
        assert abs(n - want[source]) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("source = 'none'")).collect()} == {0}


@pytest.mark.parametrize("shard_words", [64, 1 << 20])
def test_blocks_of_shards_add_up_to_what_is_taken(spark, shard_words):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randint(0, 90))), rng.choice(["a", "a", "a", "b", None]), "x") for i in range(150)]
    rows += [(900, "one two", "tiny", "x"), (901, None, "none", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = {i: len((t or "").split()) for i, t, _, _ in rows}
    found = mixing.blocks(docs, shard_words=shard_words).collect()
    words, shards, marked = {}, {}, {}
    for r in found:
        assert 0 < r.words <= mixing.BLOCK_WORDS and 0 <= r.start <= sizes[r.doc_id] - r.words
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
        shards.setdefault(r.shard, {}).setdefault(r.source, 0)
        shards[r.shard][r.source] += r.words
        for k in range(r.start, r.start + r.words):
            marked[r.doc_id, k] = marked.get((r.doc_id, k), 0) + 1
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, shard_words=shard_words).collect()}
    assert {i: n for i, n in taken.items() if n} == words and max(marked.values()) <= 3
    # Every shard has its quota of blocks, but for the place where a tape starts anew.
    sources = spark.createDataFrame([(s, float(sum(sizes[i] for i, _, o, _ in rows if o == s))) for s in ("a", "b", "none", None, "tiny")], "source string, source_size double")
    for r in mixing.quotas(mixing.targets(sources), shard_words=shard_words).collect():
        assert abs(shards.get(r.shard, {}).get(r.source, 0) - 16 * r.blocks) <= 32, r
    assert (len(shards) > 10) == (shard_words == 64)


def test_quotas_follow_the_highest_quotients(spark):
    rng = random.Random(2)
    weights = {f"s{i:02d}": rng.choice([1.0, 3.0, 17.0, 400.0]) * rng.random() for i in range(23)}
    sources = spark.createDataFrame([*weights.items(), ("zero", 0.0)], "source string, target double")
    got = mixing.quotas(sources, block_words=1, shard_words=37)
    shards = {}
    for r in got.collect():
        shards.setdefault(r.shard, {})[r.source] = r.blocks
        assert r.blocks >= 0
    seats = dict.fromkeys(weights, 0)
    total = math.ceil(sum(weights.values()))
    for shard in range(math.ceil(total / 37)):
        before = dict(seats)
        for _ in range(min(37, total - 37 * shard)):
            seats[max(sorted(weights), key=lambda s: weights[s] / (2 * seats[s] + 1))] += 1
        assert {s: n for s, n in shards[shard].items() if n} == {s: seats[s] - before[s] for s in seats if seats[s] > before[s]}


def test_hash_of_nothing():
    assert hashlib.sha1(b"").digest() and warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
