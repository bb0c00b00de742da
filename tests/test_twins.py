"""Queries against their SQL twins. ``TWINS=all`` runs every one, else one per area."""

import os
from pathlib import Path

import pytest
from twins import compare, connect

from cobasket.plans import catalogue

SF_DIR = os.environ.get("TWINS_SF_DIR", "/root/testdata/sf0.01")
SHORT = (
    "npmi_edges_docs", "recommend_diverse", "lanes", "loo_outliers", "curate_edges", "phrase_cascade",
    "taxonomy_full", "match_gate", "eval_pool", "media_rank", "slug_coverage",
)
NAMES = sorted(catalogue.TWINS) if os.environ.get("TWINS") == "all" else SHORT


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("standard tables not present")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    equal, report = compare(spark, con, catalogue.QUERIES[name], catalogue.TWINS[name], SF_DIR)
    assert equal, report


def test_twins_belong_to_queries():
    assert set(catalogue.TWINS) <= set(catalogue.QUERIES)
