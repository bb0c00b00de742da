"""All registered queries."""

from cobasket.plans import (  # noqa: F401
    asset_queries,
    corpus_queries,
    curation_queries,
    eval_queries,
    graph_queries,
    rank_queries,
    source_queries,
)
from cobasket.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
