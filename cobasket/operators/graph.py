"""Building the item-affinity graph and enriching it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.functions import pairs
from cobasket.functions.text import key_terms, normalise_name
from cobasket.params import DEFAULTS, Params
from cobasket.staging import stage

# ---------------------------------------------------------------------------
# Raw graph import
# ---------------------------------------------------------------------------


def import_graph(nodes: DataFrame, edges: DataFrame, params: Params = DEFAULTS):
    """Raw node and edge tables -> (edges(item, partner, score), skipped count row).

    Keeps item-item edges over the threshold whose endpoints are both items; both
    directions are emitted from one pass. There is no cap on partners.
    """
    item_nodes = nodes.where(F.col("node_type") == "ingredient").select(
        "node_id", normalise_name(F.col("name")).alias("item")
    )
    typed = edges.where(F.col("edge_type") == "ingr-ingr")
    named = typed.join(
        item_nodes.select(F.col("node_id").alias("id_1"), F.col("item").alias("a")), "id_1", "left"
    ).join(item_nodes.select(F.col("node_id").alias("id_2"), F.col("item").alias("b")), "id_2", "left")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    skipped = named.agg(F.count_if(~known).alias("skipped_edges"))
    kept = named.where(known & (F.col("score") >= params.min_score))
    return symmetrise(kept.select("a", "b", quantise(F.col("score")).alias("score"))), skipped


def quantise(score: Column) -> Column:
    """Score in hundredths, half to even."""
    return F.bround(score * 100, 0).cast("int")


def symmetrise(pairs: DataFrame) -> DataFrame:
    """``(a, b, score)`` -> ``(item, partner, score)`` in both directions, one pass."""
    both = F.array(
        F.struct(F.col("a").alias("item"), F.col("b").alias("partner")),
        F.struct(F.col("b").alias("item"), F.col("a").alias("partner")),
    )
    return pairs.select(F.explode(both).alias("e"), "score").select("e.item", "e.partner", "score")


def undirected_max(edges: DataFrame) -> DataFrame:
    """Each pair's affinity as the larger of its two directions, both directions present."""
    flipped = edges.select(
        F.explode(
            F.array(F.struct("item", "partner"), F.struct(F.col("partner").alias("item"), F.col("item").alias("partner")))
        ).alias("e"),
        "score",
    )
    return flipped.groupBy("e.item", "e.partner").agg(F.max("score").alias("score"))


# ---------------------------------------------------------------------------
# Co-occurrence counting
# ---------------------------------------------------------------------------


@dataclass
class Incidence:
    """(basket_id, item) rows, staged; ``unique`` says that none repeats."""

    rows: DataFrame
    unique: bool


def incidence(basket_items: DataFrame, label: str = "incidence", unique: bool = False, staged: bool = False) -> Incidence:
    """``unique`` says that no row repeats, ``staged`` that the rows are read from a table; each saves a pass."""
    rows = basket_items.select("basket_id", "item").where(F.col("item").isNotNull())
    return Incidence(rows if staged else stage(rows, label), unique)


def _number_items(rows: DataFrame, params: Params) -> DataFrame:
    """Frequent items ``(id, item, n)``; ids are consecutive from 0, the most frequent item first. ``n`` counts rows."""
    frequent = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= params.min_item_freq
    )
    ranked = dense_ids(frequent.withColumn("rarity", -F.col("n")), ["rarity", "item"])
    return stage(ranked.select(F.col("item_id").alias("id"), "item", "n"), "frequent")


@dataclass
class Asked:
    """Pairs asked for: one item in ``outer(item)``, or both in ``inner(item)``."""

    inner: DataFrame
    outer: DataFrame


def _number_asked(numbered: DataFrame, asked: Asked) -> tuple[DataFrame, int, int]:
    """``numbered`` anew, items of ``outer`` first, then those of ``inner``, and where each kind ends; both ends are starts of steps."""
    kinds = asked.outer.select("item", F.lit(0).alias("kind")).unionByName(asked.inner.select("item", F.lit(1).alias("kind")))
    kinds = kinds.groupBy("item").agg(F.min("kind").alias("kind"))
    known = numbered.join(kinds, "item", "left").withColumn("kind", F.coalesce("kind", F.lit(2)))
    # Inside a kind the order by frequency stays.
    ranked = stage(dense_ids(known.select("kind", "id", "item", "n"), ["kind", "id"]).select("kind", "item", "n", "item_id"), "asked")
    sizes = {r["kind"]: r["count"] for r in ranked.groupBy("kind").count().collect()}
    steps = lambda n: -(-n // pairs.BLOCK_ITEMS) * pairs.BLOCK_ITEMS
    outer = steps(sizes.get(0, 0))
    inner = outer + steps(sizes.get(1, 0))
    first = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, outer - sizes.get(0, 0)).otherwise(inner - sizes.get(0, 0) - sizes.get(1, 0))
    return ranked.select((F.col("item_id") + first).alias("id"), "item", "n"), outer, inner


def _few_counts(rows: DataFrame, numbered: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """Of ``rows(basket_id, item)``, repeated ones too, and few items: ``(a, b, n_ab)``, a < b, ``(id, n)`` and the number of baskets.

    The rows go to the tasks by basket once, and a task counts them in a table of its own, one cell for
    a pair; only the cells travel on. Rows of one basket are read one after the other and never held.
    """
    named = rows.join(numbered.select("item", F.col("id").cast("int").alias("id")), "item", "left")
    dealt = named.select("basket_id", "id").repartition("basket_id").sortWithinPartitions("basket_id")
    cells = dealt.select(F.xxhash64("basket_id").alias("hash"), "id").mapInArrow(pairs.count_few(width), pairs.FEW_COUNTED)
    added = stage(cells.groupBy("a", "b").agg(F.sum("n").alias("n")), "counted")
    n_baskets = added.where("a < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    single = added.where("a >= 0 AND a = b").select(F.col("a").alias("id"), "n")
    return added.where("a < b").select("a", "b", F.col("n").alias("n_ab")), single, int(n_baskets)


def _loads(numbered: DataFrame, n_baskets: int, outer: int | None, inner: int | None) -> pairs.Loads:
    step = (F.col("id") / pairs.BLOCK_ITEMS).cast("int").alias("step")
    weights = {r["step"]: r["n"] for r in numbered.groupBy(step).agg(F.sum("n").alias("n")).toLocalIterator()}
    return pairs.Loads([weights[i] for i in range(len(weights))], n_baskets, outer, inner)


def _id_lists(rows: DataFrame) -> DataFrame:
    """``rows(basket_id, id)`` -> ``(hash, ids)`` of baskets with two ids or more, ids ascending."""
    ids = F.sort_array(F.collect_list(F.col("id").cast("int"))).alias("ids")
    return rows.groupBy("basket_id").agg(ids).where(F.size("ids") > 1).select(F.xxhash64("basket_id").alias("hash"), "ids")


def _by_unit(packed: DataFrame, loads: pairs.Loads) -> DataFrame:
    # Twice as many partitions as units, so that few hold more than one.
    return packed.repartition(2 * max(1, loads.units()), "one", "other", "share").sortWithinPartitions("one", "other", "share")


def _light_named(
    rows: DataFrame, numbered: DataFrame, n_baskets: int, least: int, outer: int | None = None, inner: int | None = None
) -> DataFrame:
    """``_light_counts`` of the pairs met ``least`` times or more, by name: ``(item_a, n_a, item_b, n_b, n_ab)``.

    The items of its blocks come to a unit, so what it counts is named where it is and travels
    no further; only counts of shares are added up, and then named by joins.
    """
    loads = _loads(numbered, n_baskets, outer, inner)
    lists, kind = _id_lists(rows), numbered.schema["item"].dataType.simpleString()
    if loads.any_shared():
        lists = stage(lists, "lists")
    packed_named, counted_named = pairs.PACKED_NAMED.format(item=kind), pairs.COUNTED_NAMED.format(item=kind)
    packed = lists.mapInArrow(pairs.pack(loads, True), pairs.PACKED).select(
        "*", F.lit(None).cast("int").alias("side"), F.lit(None).cast(f"array<{kind}>").alias("items")
    )
    items = numbered.select(F.col("id").cast("int").alias("id"), "item", F.col("n").cast("long").alias("n"))
    packed = packed.unionByName(items.mapInArrow(pairs.pack_items(loads), packed_named))
    counted = _by_unit(packed, loads).mapInArrow(pairs.count_named(loads, least), counted_named)
    if not loads.any_shared():
        return counted
    shared = _by_unit(lists.mapInArrow(pairs.pack(loads, False), pairs.PACKED), loads).mapInArrow(pairs.count(loads, least), pairs.COUNTED)
    added = shared.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    return counted.unionByName(_with_items(added, numbered))


def _light_counts(
    rows: DataFrame, numbered: DataFrame, n_baskets: int, least: int = 1, outer: int | None = None, inner: int | None = None
) -> DataFrame:
    """``rows(basket_id, id)`` of baskets of usual size -> ``(a, b, n_ab)``, a < b.

    Counted in blocks: a unit is a pair of item blocks and a share of the baskets, and counts
    what each item of one block meets in the other, so a frequent pair costs one cell and not
    one row for each basket. A basket goes to the units whose blocks it touches, many baskets
    packed in a row. A unit of frequent items, known by the sums of their frequencies, is
    spread over several shares; its counts are added up. Elsewhere a unit sees all
    baskets, and pairs below ``least`` end there; with 1 all are returned. ``outer`` and
    ``inner`` say which pairs are counted, as for ``pairs.Loads``.
    """
    loads = _loads(numbered, n_baskets, outer, inner)
    packed = _id_lists(rows).mapInArrow(pairs.pack(loads), pairs.PACKED)
    counted = _by_unit(packed, loads).mapInArrow(pairs.count(loads, least), pairs.COUNTED)
    if not loads.any_shared():
        return counted.select("a", "b", F.col("n").alias("n_ab"))
    # Only counts of shares are added up.
    counted = stage(counted, "counted")
    added = counted.where(~F.col("whole")).groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    return counted.where("whole").select("a", "b", F.col("n").alias("n_ab")).unionByName(added)


def pair_counts(inc: Incidence, params: Params = DEFAULTS, asked: Asked | None = None) -> DataFrame:
    """Pairs of frequent items with enough common baskets: ``(a, b, n_a, n_b, n_ab, n)``, a < b; ``n`` is the number of baskets.

    Rare items go before any pair is formed. Few items are counted where their baskets are.
    Otherwise oversized baskets take ``_add_heavy``,
    which gives the same counts without one task ever holding such a basket. With ``asked``
    no other pairs are formed, but that few items are counted all the same.
    """
    numbered = _number_items(inc.rows, params)
    width = numbered.count()
    if width <= pairs.FEW_ITEMS:
        counted, single, n_baskets = _few_counts(inc.rows, numbered, width)
        # Repeated rows were numbered as if they were baskets.
        numbered = numbered.drop("n").join(single, "id").where(F.col("n") >= params.min_item_freq)
        return _named_counts(counted, numbered, n_baskets, params)
    rows = inc.rows
    if not inc.unique:
        rows = stage(rows.distinct(), "distinct")
        numbered = _number_items(rows, params)
    sizes = rows.groupBy("basket_id").count()
    n_baskets, largest = map(int, sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("count"), F.lit(0))).first())
    outer = inner = None
    if asked:
        numbered, outer, inner = _number_asked(numbered, asked)
        # Without items of the first kind only pairs of the second are asked for.
        numbered = numbered if outer else numbered.where(F.col("id") < inner)
    kept = rows.join(numbered, "item").select("basket_id", "id")
    if largest <= params.light_basket_items:
        return _in_order(_light_named(kept, numbered, n_baskets, params.min_support, outer, inner), n_baskets)
    else:
        kept = stage(kept, "kept")
        sizes = kept.groupBy("basket_id").count()
        big = stage(
            sizes.where(F.col("count") > params.light_basket_items).select("basket_id"), "big"
        )
        counted = _light_counts(kept.join(big, "basket_id", "left_anti"), numbered, n_baskets, 1, outer, inner)
        heavy = stage(kept.join(big, "basket_id", "left_semi").select("basket_id", "id"), "heavy")
        if not heavy.isEmpty():
            counted = _add_heavy(counted, heavy, params, outer, inner)
    return _named_counts(counted, numbered, n_baskets, params)


def _named_counts(counted: DataFrame, numbered: DataFrame, n_baskets: int, params: Params) -> DataFrame:
    """``counted(a, b, n_ab)`` by the names and frequencies of ``numbered(id, item, n)``, names in order."""
    return _in_order(_with_items(counted.where(F.col("n_ab") >= params.min_support), numbered), n_baskets)


def _with_items(counted: DataFrame, numbered: DataFrame) -> DataFrame:
    """``counted(a, b, n_ab)`` -> ``(item_a, n_a, item_b, n_b, n_ab)``."""
    one = numbered.select(F.col("id").alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    two = numbered.select(F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    return counted.join(one, "a").join(two, "b").select("item_a", "n_a", "item_b", "n_b", "n_ab")


def _in_order(named: DataFrame, n_baskets: int) -> DataFrame:
    """``named(item_a, n_a, item_b, n_b, n_ab)`` with the items of a row in order of name."""
    forward = F.col("item_a") < F.col("item_b")
    first, second = F.struct("item_a", "n_a"), F.struct(F.col("item_b").alias("item_a"), F.col("n_b").alias("n_a"))
    return named.select(
        F.when(forward, first).otherwise(second).alias("x"), F.when(forward, second).otherwise(first).alias("y"), "n_ab"
    ).select(
        F.col("x.item_a").alias("a"), F.col("y.item_a").alias("b"), F.col("x.n_a").alias("n_a"), F.col("y.n_a").alias("n_b"),
        "n_ab", F.lit(float(n_baskets)).alias("n"),
    )


def _add_heavy(light_counts: DataFrame, heavy: DataFrame, params: Params, outer: int | None = None, inner: int | None = None) -> DataFrame:
    """Add what oversized baskets ``heavy(basket_id, id)`` contribute, exactly.

    Let h be the number of oversized baskets an item is in. A pair's count from
    them is at most min(h_a, h_b). So:

    * both h >= support: counted directly, each basket cut in item chunks so that a
      task sees two chunks, never a whole basket;
    * otherwise the pair can reach the support only if small baskets already have
      it, so those pairs are looked up from the side with h < support: fewer than
      ``min_support`` probes for a pair.
    """
    support = params.min_support
    h = stage(heavy.groupBy("id").agg(F.count(F.lit(1)).alias("h")), "h")
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    light_counts = stage(light_counts.select(low, high, "n_ab"), "light")

    often = heavy.join(h.where(F.col("h") >= support).select("id"), "id", "left_semi")
    chunk = max(1, params.light_basket_items // 4)
    sizes = often.groupBy("basket_id").agg(F.count(F.lit(1)).alias("size"))
    chunks = (
        often.join(sizes, "basket_id")
        .withColumn("of", F.ceil(F.col("size") / chunk))
        .withColumn("c", F.pmod(F.xxhash64("id"), F.col("of")))
    )
    # A row meets the chunks from its own on as the left side, and those up to it as
    # the right side; (left chunk, right chunk) of one basket is one join key.
    left = chunks.select(
        "basket_id", "id", F.col("c").alias("cl"), F.explode(F.sequence(F.col("c"), F.col("of") - 1)).alias("cr")
    )
    right = chunks.select(
        "basket_id", F.col("id").alias("id2"), F.col("c").alias("cr"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("c"))).alias("cl"),
    )
    met = left.join(right, ["basket_id", "cl", "cr"]).where(
        (F.col("cl") < F.col("cr")) | (F.col("id") < F.col("id2"))
    )
    if outer is not None:
        met = met.where((F.least("id", "id2") < outer) | (F.greatest("id", "id2") < inner))
    direct = (
        met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        .agg(F.count(F.lit(1)).alias("n_ab"))
    )

    ha = h.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    hb = h.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    rarer = F.col("ha") <= F.col("hb")
    sparse = (
        light_counts.join(ha, "a")
        .join(hb, "b")
        .where((F.least("ha", "hb") < support) & (F.col("n_ab") + F.least("ha", "hb") >= support))
        .select(
            "a", "b",
            F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("probe"),
            F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("other"),
        )
    )
    probed = sparse.join(heavy.select("basket_id", F.col("id").alias("probe")), "probe").join(
        heavy.select("basket_id", F.col("id").alias("other")), ["basket_id", "other"], "left_semi"
    )
    looked_up = probed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    return (
        light_counts.unionByName(direct)
        .unionByName(looked_up)
        .groupBy("a", "b")
        .agg(F.sum("n_ab").alias("n_ab"))
    )


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Normalised PMI, clamped to 1; a pair in every basket scores 1."""
    p_ab = n_ab / n
    value = F.log(p_ab / ((n_a / n) * (n_b / n))) / -F.log(p_ab)
    return F.when(n_ab == n, F.lit(1.0)).otherwise(F.least(value, F.lit(1.0)))


def npmi_pairs(
    basket_items: DataFrame, params: Params = DEFAULTS, unique: bool = False, staged: bool = False, asked: Asked | None = None
) -> DataFrame:
    """``basket_items(basket_id, item)`` -> ``(a, b, n_ab, npmi, score)``, a < b."""
    return (
        pair_counts(incidence(basket_items, unique=unique, staged=staged), params, asked)
        .withColumn("npmi", npmi(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))
        .where(F.col("npmi") >= params.min_score)
        .select("a", "b", "n_ab", "npmi", quantise(F.col("npmi")).alias("score"))
    )


def affinity_edges(
    basket_items: DataFrame, params: Params = DEFAULTS, unique: bool = False, staged: bool = False, asked: Asked | None = None
) -> DataFrame:
    """The stored graph: ``edges(item, partner, score)``, both directions; with ``asked`` the part that is asked for, at least."""
    return symmetrise(npmi_pairs(basket_items, params, unique, staged, asked))


def support_sizing(inc: Incidence, params: Params = DEFAULTS, bounds=(1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """How many co-occurring pairs reach each support level.

    Counting every pair is the point, so the work is the sum of squared basket sizes,
    oversized baskets included: bound the baskets first where they have no bound.
    """
    from dataclasses import replace

    counts = pair_counts(inc, replace(params, min_support=1))
    total = F.count(F.lit(1))
    levels = F.array(
        *[F.struct(F.lit(b).alias("support"), F.count_if(F.col("n_ab") >= b).alias("pairs")) for b in bounds]
    )
    return (
        counts.agg(total.alias("total"), levels.alias("levels"))
        .select("total", F.explode("levels").alias("l"))
        .select(
            F.col("l.support").alias("support"),
            F.col("l.pairs").alias("pairs"),
            (F.col("l.pairs") / F.nullif(F.col("total"), F.lit(0))).alias("share"),
        )
    )


# ---------------------------------------------------------------------------
# Vertex measures
# ---------------------------------------------------------------------------


def popularity(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of an item's edge scores; 0 without edges."""
    sums = edges.groupBy("item").agg(F.sum("score").alias("_s"))
    return items.select("item").join(sums, "item", "left").select(
        "item", F.coalesce("_s", F.lit(0)).cast("long").alias("freq")
    )


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item").agg(F.count(F.lit(1)).alias("degree"))


def _cumulative(edges: DataFrame) -> DataFrame:
    """Per item and score: how many edges up to it.

    Scores are whole hundredths, so an item has at most some hundred rows here
    however many edges it has; the counts are combined before the shuffle.
    """
    hist = edges.groupBy("item", "score").agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.partitionBy("item").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(
        "item", "score",
        F.sum("c").over(up_to).alias("upto"),
        F.sum("c").over(Window.partitionBy("item")).alias("n"),
    )


def _at_rank(rank: Column) -> Column:
    """The score at a 1-based rank of the item's sorted list."""
    return F.min(F.when(F.col("upto") >= rank, F.col("score")))


def quartiles_lower(edges: DataFrame) -> DataFrame:
    """``(item, median, iqr)`` by the lower nearest rank: index floor((n-1)*f)."""
    at = lambda f: _at_rank(F.floor((F.col("n") - 1) * f) + 1)
    return _cumulative(edges).groupBy("item").agg(
        at(0.5).cast("double").alias("median"), (at(0.75) - at(0.25)).cast("double").alias("iqr")
    )


def quartiles_exclusive(edges: DataFrame) -> DataFrame:
    """``(item, median, iqr)``: middle mean, exclusive quartiles; iqr 10 below 4 edges."""
    n = F.col("n")

    def quartile(i: int) -> Column:
        j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
        delta = i * (n + 1) - 4 * j
        # delta varies by item, not within it
        return (
            (4 - F.max(delta)) * _at_rank(j) + F.max(delta) * _at_rank(j + 1)
        ) / 4

    median = (_at_rank(F.floor((n + 1) / 2)) + _at_rank(F.floor(n / 2) + 1)) / 2
    return (
        _cumulative(edges)
        .groupBy("item")
        .agg(
            median.alias("median"),
            F.when(F.max(n) < 4, F.lit(10.0)).otherwise(quartile(3) - quartile(1)).alias("iqr"),
        )
    )


def dense_ids(items: DataFrame, order_by: list[str], start: int = 0) -> DataFrame:
    """Consecutive ids in the given order, without one global sort task.

    Range-partition and sort, count per partition, then add the offset of the
    earlier partitions to the position inside one.
    """
    spark = items.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(
        items.repartitionByRange(parts, *order_by)
        .withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*order_by)
    return (
        ranged.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn("item_id", (F.col("_off") + F.col("_rn") - 1 + start).cast("long"))
        .drop("_part", "_rn", "_off")
    )


# ---------------------------------------------------------------------------
# Enrichment with a new corpus
# ---------------------------------------------------------------------------


def max_merge(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edge union keeping the larger score, both directions; running it twice changes nothing."""
    return undirected_max(base.unionByName(incoming)).where(F.col("item") != F.col("partner"))


def resolve_incoming(
    incoming: DataFrame, resolved: DataFrame, live: DataFrame, approved: DataFrame | None = None
):
    """Map the ends of new edges through ``resolved(src, tgt)``.

    A source with a null target is deleted, so its edges go; ends neither live nor
    approved are logged. Returns (edges, dropped(item, edges)).
    """
    known = live.select("item")
    if approved is not None:
        known = known.unionByName(approved.select("item")).distinct()
    ends = incoming
    for side in ("item", "partner"):
        hop = resolved.select(
            F.col("src").alias(side), F.col("tgt").alias("_t"), F.lit(True).alias("_hit")
        )
        ends = ends.join(hop, side, "left").withColumn(
            side, F.when(F.col("_hit"), F.col("_t")).otherwise(F.col(side))
        ).drop("_t", "_hit")
    ends = ends.where(F.col("item").isNotNull() & F.col("partner").isNotNull())
    flags = known.withColumn("_known", F.lit(True))
    tagged = ends.join(flags, "item", "left").withColumnRenamed("_known", "_ki").join(
        flags.withColumnRenamed("item", "partner"), "partner", "left"
    )
    fine = F.col("_ki").isNotNull() & F.col("_known").isNotNull()
    edges = tagged.where(fine & (F.col("item") != F.col("partner"))).select("item", "partner", "score")
    dropped = (
        tagged.where(~fine)
        .select(F.explode(F.array(
            F.when(F.col("_ki").isNull(), F.col("item")),
            F.when(F.col("_known").isNull(), F.col("partner")),
        )).alias("item"))
        .where(F.col("item").isNotNull())
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("edges"))
    )
    return edges, dropped


def append_items(items: DataFrame, new_names: DataFrame) -> DataFrame:
    """New names get ids after the current maximum; existing ids never move."""
    top = items.agg(F.coalesce(F.max("item_id"), F.lit(-1))).first()[0]
    fresh = new_names.select("item").distinct().join(items, "item", "left_anti")
    return items.select("item", "item_id").unionByName(
        dense_ids(fresh, ["item"], start=int(top) + 1).select("item", "item_id")
    )


def provenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added or raised: ``(item, partner, old_score, new_score, change)``, item < partner."""
    old = before.where(F.col("item") < F.col("partner")).select("item", "partner", F.col("score").alias("old_score"))
    new = after.where(F.col("item") < F.col("partner")).select("item", "partner", F.col("score").alias("new_score"))
    return (
        new.join(old, ["item", "partner"], "left")
        .where(F.col("old_score").isNull() | (F.col("new_score") > F.col("old_score")))
        .select(
            "item", "partner", "old_score", "new_score",
            F.when(F.col("old_score").isNull(), "added").otherwise("raised").alias("change"),
        )
    )


def score_histogram(before: DataFrame, after: DataFrame, width: int = 10) -> DataFrame:
    """Edges per score band before and after: ``(band, before, after)``."""
    tag = lambda df, side: df.where(F.col("item") < F.col("partner")).select(
        (F.floor(F.col("score") / width) * width).cast("int").alias("band"), F.lit(side).alias("side")
    )
    return (
        tag(before, "before").unionByName(tag(after, "after"))
        .groupBy("band")
        .agg(
            F.count_if(F.col("side") == "before").alias("before"),
            F.count_if(F.col("side") == "after").alias("after"),
        )
    )


def most_raised(changes: DataFrame, k: int = 20) -> DataFrame:
    """The k raised edges with the largest gain."""
    return (
        changes.where(F.col("change") == "raised")
        .withColumn("gain", F.col("new_score") - F.col("old_score"))
        .orderBy(F.desc("gain"), "item", "partner")
        .limit(k)
    )


def new_item_candidates(unmapped: DataFrame, params: Params = DEFAULTS, unique: bool = False) -> DataFrame:
    """``unmapped(basket_id, phrase)`` -> phrases in enough baskets, with their frequency; ``unique``: no row repeats."""
    rows = unmapped.select("basket_id", "phrase")
    return (
        (rows if unique else rows.distinct())
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("baskets"))
        .where(F.col("baskets") >= params.new_item_min_freq)
    )


def accept_new_names(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """A proposed name with the same key terms as an existing one becomes a map onto it.

    ``proposed(item)``, ``existing(item)`` -> ``(item, verdict, target)``.
    """
    term_key = F.array_join(F.array_sort(key_terms(F.col("item"))), " ")
    known = (
        existing.select(term_key.alias("k"), "item")
        .where(F.col("k") != "")
        .groupBy("k")
        .agg(F.min("item").alias("target"))
    )
    return proposed.select("item", term_key.alias("k")).join(known, "k", "left").select(
        "item", F.when(F.col("target").isNull(), "new").otherwise("map").alias("verdict"), "target"
    )


def stratified_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: str = "0") -> DataFrame:
    """The k rows of each stratum with the smallest hash: a repeatable audit sample."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key)
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def agreement(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Share of sampled decisions that a second pass repeats, by row of ``key``."""
    again = second.select(key, F.col(value).alias("_again"))
    return first.join(again, key).agg(
        F.count(F.lit(1)).alias("audited"),
        F.avg(F.col(value).eqNullSafe(F.col("_again")).cast("int")).alias("agreement"),
    )


def partner_ranks(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(item, partner, score, rank)`` of the probed edges that exist, however deep; ties go by name.

    No list is sorted: the partners ahead are those of higher scores, added up from one
    count for each score of an item, and those of the same score with a smaller name,
    counted for the probed pairs alone.
    """
    asked = probes.select("item", "partner").distinct()
    found = asked.join(edges.select("item", "partner", "score"), ["item", "partner"])
    higher = Window.partitionBy("item").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = edges.join(asked.select("item").distinct(), "item", "left_semi").groupBy("item", "score").agg(F.count(F.lit(1)).alias("c"))
    ahead = counts.select("item", "score", F.coalesce(F.sum("c").over(higher), F.lit(0)).alias("ahead"))
    equal = found.join(edges.select("item", "score", F.col("partner").alias("other")), ["item", "score"]).where(F.col("other") < F.col("partner"))
    before = equal.groupBy("item", "partner").agg(F.count(F.lit(1)).alias("before"))
    ranked = found.join(ahead, ["item", "score"]).join(before, ["item", "partner"], "left")
    return ranked.select("item", "partner", "score", (F.col("ahead") + F.coalesce("before", F.lit(0)) + 1).alias("rank"))


def golden_probes(probes: DataFrame, edges: DataFrame, min_score=25, max_rank=20) -> DataFrame:
    """``probes(item, partner)`` -> with score, rank and whether both bounds hold."""
    found = partner_ranks(probes, edges)
    return (
        probes.select("item", "partner")
        .join(found, ["item", "partner"], "left")
        .withColumn(
            "passed",
            F.coalesce((F.col("score") >= min_score) & (F.col("rank") <= max_rank), F.lit(False)),
        )
    )


def regression_probes(expected: DataFrame, absent: DataFrame, limits: DataFrame, ranked: DataFrame, top: int = 9) -> DataFrame:
    """Earlier expectations re-asserted on ``ranked(item, partner, category, rank)``.

    ``expected(item, partner)`` must be in the top, ``absent(item, partner)`` must
    not, ``limits(item, category, at_most)`` bounds a category. Returns failures.
    """
    best = ranked.where(F.col("rank") <= top).select("item", "partner", "category")
    keys = ["item", "partner"]
    missing = expected.join(best, keys, "left_anti").select("item", F.col("partner").alias("what"), F.lit("missing").alias("failure"))
    present = absent.join(best, keys, "left_semi").select("item", F.col("partner").alias("what"), F.lit("present").alias("failure"))
    crowded = (
        best.groupBy("item", "category").agg(F.count(F.lit(1)).alias("c"))
        .join(limits, ["item", "category"])
        .where(F.col("c") > F.col("at_most"))
        .select("item", F.col("category").alias("what"), F.lit("crowded").alias("failure"))
    )
    return missing.unionByName(present).unionByName(crowded)
