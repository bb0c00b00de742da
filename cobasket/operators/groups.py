"""Groups of likely duplicate names for a curator to look at."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions.text import key_terms
from cobasket.operators.components import components
from cobasket.staging import stage, stage_counting

#: Rounds that settle the bulk, before what is left is taken component by component.
ROUNDS = 2
#: Pairs of term and item up to which a component is settled by one task.
SMALL_ROWS = 100_000


def duplicate_groups(items: DataFrame, max_members: int = 8, rounds: int = ROUNDS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """``items(item, degree)`` -> ``(term, item, place)``.

    Terms claim items in order of their group size; a term takes up to
    ``max_members`` unclaimed items, most connected first, and only with two or more;
    an item belongs to one group. The claims are sequential, but two terms interact
    only through a common unclaimed item. So in a round every term whose best items have
    no earlier term left is settled at the same time. What ``rounds`` of these leave is cut
    into connected components: a small one, however long its chain of dependent terms, is
    settled term by term in one task; only components of more than ``small_rows`` pairs go
    on by rounds, at most one for each of their terms.
    """
    spread = items.select("item", "degree", F.explode(key_terms(F.col("item"))).alias("term"))
    sizes = spread.groupBy("term").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    active = spread.join(sizes, "term").select("term", "item", "degree", F.col("size").cast("long").alias("size"))
    active, seen = stage_counting(active, "active", n=F.count(F.lit(1)))
    found, left = [active.select("term", "item", F.lit(0).alias("place")).limit(0)], seen["n"]
    for _ in range(rounds):
        if left:
            taken, active, left = _round(active, max_members)
            found.append(taken)
    if left:
        node = lambda kind, c: F.concat(F.lit(kind), c)
        parts = components(active.select(node("t", "term").alias("a"), node("i", "item").alias("b")))
        placed = active.withColumn("node", node("t", "term")).join(parts, "node").drop("node")
        placed = stage(placed, "placed")
        large = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_rows).select("root")
        small = placed.join(large, "root", "left_anti")
        found.append(small.groupBy("root").applyInPandas(lambda rows: _in_turn(rows, max_members), "term string, item string, place int"))
        active, seen = stage_counting(placed.join(large, "root", "left_semi").drop("root"), "active", n=F.count(F.lit(1)))
        left = seen["n"]
    while left:
        taken, active, left = _round(active, max_members)
        # A long plan of many small tables is written as one.
        found = [stage(_union([*found, taken]), "found")]
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _round(active: DataFrame, max_members: int) -> tuple[DataFrame, DataFrame, int]:
    """Settle all terms that no earlier one can disturb: the groups, what is left, and how much."""
    # One order for all terms: larger first, then by name.
    turn = F.struct((-F.col("size")).alias("neg"), F.col("term").alias("name"))
    best = Window.partitionBy("term").orderBy(F.desc("degree"), "item")
    active = active.withColumn("turn", turn)
    first = active.groupBy("item").agg(F.min("turn").alias("first"))
    heads = active.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max_members).join(first, "item")
    settled = heads.groupBy("term").agg(F.bool_and(F.col("turn") == F.col("first")).alias("mine")).where("mine")
    taken = stage(heads.join(settled, "term", "left_semi").select("term", "item", "place"), "taken")
    left = active.drop("turn").join(taken.select("term").distinct(), "term", "left_anti").join(taken.select("item").distinct(), "item", "left_anti")
    # A term with a single unclaimed item can no longer form a group.
    viable = left.groupBy("term").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 2)
    active, seen = stage_counting(left.join(viable.select("term"), "term", "left_semi"), "active", n=F.count(F.lit(1)))
    return taken, active, seen["n"]


def _in_turn(rows: pd.DataFrame, max_members: int) -> pd.DataFrame:
    """The claims of one component, term by term."""
    claimed: set[str] = set()
    out = []
    rows = rows.assign(neg=-rows["size"], down=-rows["degree"]).sort_values(["neg", "term", "down", "item"])
    for term, members in rows.groupby("term", sort=False)["item"]:
        free = [item for item in members if item not in claimed][:max_members]
        if len(free) >= 2:
            claimed.update(free)
            out += [(term, item, place) for place, item in enumerate(free, 1)]
    return pd.DataFrame(out, columns=["term", "item", "place"]).astype({"place": "int32"})
