"""Steps whose memory and number of units must not grow with the tables."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from cobasket.functions import pairs
from cobasket.plans import inputs


def test_blocks_grow_with_the_root_of_the_baskets_not_with_the_vocabulary():
    weights = [40_000_000 // (k + 1) for k in range(4000)]
    loads = pairs.Loads(weights, 500_000)
    assert len(loads.weights) < 64 and sum(loads.weights) == sum(weights)
    assert loads.widths.sum() == 4000 * loads.step and loads.widths.max() <= 1 << 16


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
@pytest.mark.parametrize("step", [2, 64, 3000])
def test_units_count_as_brute_force(monkeypatch, at_once, step):
    """Items alone, items together in an array, and items together by sorting."""
    monkeypatch.setattr(pairs, "BLOCK_ITEMS", step)
    monkeypatch.setattr(pairs, "SORTED_PAIRS", at_once)
    rng = random.Random(step + at_once)
    baskets = [sorted({int(2000 * rng.random() ** 3) for _ in range(rng.randint(0, 12))}) for _ in range(300)]
    n = Counter(i // step for b in baskets for i in b)
    loads = pairs.Loads([n[k] for k in range(2000 // step + 1)], len(baskets))
    # Two batches: the rows of a unit come from several tasks.
    packed = []
    for part in (baskets[:120], baskets[120:]):
        columns = [pa.array(range(len(part)), pa.int64()), pa.array(part, pa.list_(pa.int32()))]
        packed += pairs.pack(loads)(iter([pa.RecordBatch.from_arrays(columns, names=["hash", "ids"])]))
    table = pa.Table.from_batches(packed).sort_by([(k, "ascending") for k in ("one", "other", "share")])
    got = {(r["a"], r["b"]): r["n"] for b in pairs.count(loads, 2)(iter(table.to_batches())) for r in b.to_pylist()}
    want = Counter(p for b in baskets for p in combinations(b, 2))
    assert got == {p: c for p, c in want.items() if c >= 2}


def words_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return inputs.document_words(spark, str(tmp_path))


def test_words_of_unique_documents_meet_in_no_aggregation(spark, tmp_path):
    rows = words_of(spark, tmp_path, [(1, "a b A"), (2, "b"), (3, None), (4, "")])
    found = sorted(map(tuple, rows.collect()))
    assert found == [(1, "a"), (1, "b"), (2, "b")]
    assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_words_of_repeated_and_missing_ids_count_once(spark, tmp_path):
    rows = words_of(spark, tmp_path, [(1, "a b"), (1, "b c"), (2, "a"), (None, "x"), (None, "x y")])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (None, "x"), (None, "y")], key=str)
