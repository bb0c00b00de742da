"""Mixing sources to target weights by highest quotients.

The words of a source, its documents in a seeded hash order, lie on a tape, cut in blocks
of equal numbers of words. The mix is a sequence of shards of equal size. Block after
block goes to the source with the highest quotient ``target / (2 * blocks so far + 1)``, so
a shard holds an integer quota of blocks of each source, and the quotas of all shards add up
to the same rule applied to the whole mix. Which blocks a quota takes is a seeded order: the
blocks of a tape are gone through in it, again and again, and each shard goes on where
the shard before it stopped. ``blocks`` lists them; ``mix`` adds up what they take of every document.

Targets: every source gets its share of ``share`` times all words by weight, no more
than ``max_repeats`` times its own words; what is cut off goes to the others by weight.

Null texts and texts of white space have size 0; they get no words. A null source is
a source of its own, last in the order. Repeated rows are documents of their own; rows
equal in id and text lie side by side on the tape. Sources with no words have target 0. A table
without rows or words gives rows with zeros only. Only id, text and source are read.

Everything is DataFrame code. The number of sources is taken to be moderate (one row for
each is sorted in one task, with a few rows per shard and source); documents are only
ever summed up or ordered within a bucket of a source, so a source may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.llm.common import SEED
from cobasket.staging import stage

BLOCK_WORDS = 16
SHARD_WORDS = 50_000_000
#: Documents in a bucket of a tape, about: the unit that one task sorts.
BUCKET_DOCS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """``target`` added to ``sources(source, source_size, ...)``.

    Sources that are cut off are those with the least ``cap / weight``: with the sources in
    that order, the first ``k`` are cut off for the least ``k`` at which the rest can take
    what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("_weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(max_repeats)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    rows = rows.select(
        "*", (F.sum("source_size").over(whole) * F.lit(float(share))).alias("_wanted"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_full"),
        (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))).alias("_open"),
    )
    # The level at which this source and all after it stay under their caps.
    rows = rows.withColumn("_fits", (F.col("_wanted") - F.col("_full")) <= F.col("_ratio") * F.col("_open"))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_fits"), F.struct("_ratio", F.struct(F.col("_full"), F.col("_open"))))).over(whole))
    level = (F.col("_wanted") - F.col("_first.col2._full")) * F.col("_weight") / F.col("_first.col2._open")
    target = F.when(F.col("_first").isNull() | (F.col("_ratio") < F.col("_first._ratio")), F.col("_cap").cast("double")).otherwise(level)
    return rows.withColumn("target", target).drop("_weight", "_cap", "_ratio", "_wanted", "_full", "_open", "_fits", "_first")


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(shard, source, blocks, first_block)``: what each shard takes of each source's sequence of blocks.

    At a common threshold a source with the share ``x`` has the ``round(x * m)`` highest
    quotients. For n sources these sum up to ``h`` at most with ``m = h - n / 2``, and to
    ``h`` at least with ``m = h + n / 2``. So the first are sure, only quotients up to
    the second are compared, and there are about two for each source. A longer mix never
    takes a block back; the quota of a shard is the difference of two such allotments.
    """
    whole = Window.partitionBy(F.lit(0))
    rows = sources.select(
        "source", "target", F.sum("target").over(whole).alias("_all"), F.count("*").over(whole).alias("_sources"),
    ).filter("target > 0")
    total = F.ceil(F.col("_all") / F.lit(block_words)).cast("long")
    step = F.lit(max(1, shard_words // block_words))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / step))))
    rows = rows.withColumn("_h", F.least((F.col("shard") + 1) * step, total))
    # One more on either side, for what sums and divisions round away.
    seats = lambda m: F.floor(m * F.col("target") / F.col("_all") + F.lit(0.5)).cast("long")
    reach = F.col("_sources") / 2
    rows = rows.withColumn("_sure", F.greatest(seats(F.col("_h") - reach) - 1, F.lit(0)))
    rows = rows.withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, seats(F.col("_h") + reach) + 1)))
    rows = rows.withColumn("_quotient", F.col("target") / (2 * F.col("_seat") - 1))
    best = Window.partitionBy("shard").orderBy(F.col("_quotient").desc(), F.col("source").asc_nulls_last(), "_seat")
    rows = rows.withColumn("_rank", F.row_number().over(best))
    sure = F.sum(F.when(F.col("_seat") == F.col("_sure") + 1, F.col("_sure")).otherwise(0)).over(Window.partitionBy("shard"))
    rows = rows.withColumn("_won", (F.col("_rank") <= F.col("_h") - sure).cast("long"))
    upto = rows.groupBy("shard", "source").agg((F.first("_sure") + F.sum("_won")).alias("_upto"))
    in_order = Window.partitionBy("source").orderBy("shard")
    start = F.coalesce(F.lag("_upto").over(in_order), F.lit(0))
    return upto.select("shard", "source", (F.col("_upto") - start).alias("blocks"), start.alias("first_block"))


#: Steps of the seeded order, one of which has no factor in common with a tape.
STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)


def _order(block: Column, source: Column, full: Column, seed: int) -> Column:
    """The place of a block among the ``full`` ones of its source: each place once; a shorter last block comes last."""
    hashed = F.xxhash64(F.lit(seed), source, F.lit("start"))
    turned = F.pmod(F.shiftright(hashed, 32), F.lit(len(STEPS)))
    steps = F.filter(F.array(*[F.lit(s).cast("long") for s in STEPS]), lambda p: full % p != 0)
    step = F.get(steps, F.pmod(turned, F.size(steps)).cast("int"))
    return F.when(block < full, F.pmod(block * step + F.pmod(hashed, full), full)).otherwise(full)


def _pieces(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, max_repeats: int,
    block_words: int, shard_words: int, seed: int,
) -> tuple[DataFrame, DataFrame]:
    """``(id, source, size, source_size, target, pieces)`` of every document, and the quotas.

    A piece is what a document has of a block: ``(start, words, at, times)``, ``at`` being where the
    block stands in the order of its source and ``times`` how often the mix takes it.
    """
    sized = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("place"),
    ), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    plan = stage(targets(sources, weights, share, max_repeats), "mix-targets")
    taken = stage(quotas(plan, block_words, shard_words), "mix-quotas")
    blocks = taken.groupBy("source").agg(F.sum("blocks").alias("_blocks"))
    plan = plan.alias("p").join(blocks.alias("b"), F.expr("p.source <=> b.source"), "left").select("p.*", "_blocks")
    plan = plan.select(
        "source", "source_size", "target", F.ceil(F.col("_docs") / F.lit(BUCKET_DOCS)).alias("_buckets"),
        F.least(F.coalesce("_blocks", F.lit(0)) * F.lit(block_words), F.col("source_size") * F.lit(max_repeats)).alias("_words"),
    )
    spot = F.pmod(F.shiftright("place", 20), F.col("_buckets"))
    rows = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select(
        "id", "d.source", "size", "place", spot.alias("_bucket"), "source_size", "target", "_words",
    )
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    rows = rows.alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source AND d._bucket = o._bucket")).select("d.*", "_offset")
    upto = Window.partitionBy("source", "_bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_offset") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
    begin, end, width = F.col("_from"), F.col("_from") + F.col("size"), F.lit(block_words)
    whole = F.floor(F.col("source_size") / width)

    def piece(block: Column) -> Column:
        low, high = F.greatest(begin, block * width), F.least(end, (block + 1) * width)
        at = _order(block, F.col("source"), whole, seed) * width
        # Round r of the tape has this block at word r * source_size + at.
        times = F.greatest(F.floor((F.col("_words") - at - 1) / F.col("source_size")) + 1, F.lit(0))
        return F.struct((low - begin).alias("start"), (high - low).alias("words"), at.alias("at"), times.cast("long").alias("times"))

    numbers = F.sequence(F.floor(begin / width), F.floor((end - 1) / width))
    found = F.when(F.col("size") > 0, F.transform(numbers, piece)).otherwise(F.transform(F.slice(numbers, 1, 0), piece))
    return rows.select("id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", found.alias("pieces")), taken


def blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_repeats: int = 3,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """``(shard, source, id_col, start, words)``: the mix itself, as the stretches of words each shard takes of documents."""
    rows, taken = _pieces(docs, id_col, text_col, source_col, weights, share, max_repeats, block_words, shard_words, seed)
    each = rows.select("id", "source", "source_size", F.explode("pieces").alias("p")).select("id", "source", "source_size", "p.*").filter("times > 0")
    each = each.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    each = each.withColumn("number", F.floor((F.col("r") * F.col("source_size") + F.col("at")) / F.lit(block_words)))
    # A quota is found by the stretch of numbers it shares with a block: some few for each quota.
    taken = taken.filter("blocks > 0")
    span = taken.groupBy("source").agg(F.ceil(F.avg("blocks")).cast("long").alias("span"))
    parted = taken.alias("t").join(span.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "span")
    last = F.col("first_block") + F.col("blocks") - 1
    parted = parted.withColumn("part", F.explode(F.sequence(F.floor(F.col("first_block") / F.col("span")), F.floor(last / F.col("span")))))
    each = each.alias("e").join(span.alias("s"), F.expr("e.source <=> s.source")).select("e.*", F.floor(F.col("number") / F.col("span")).alias("part"))
    same = F.expr("e.source <=> q.source AND e.part = q.part AND number >= first_block AND number < first_block + blocks")
    return each.alias("e").join(parted.alias("q"), same).select("shard", F.col("e.source").alias(source_col), F.col("id").alias(id_col), "start", "words")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, max_repeats: int = 3,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words of the document in the blocks that the mix takes, repeats included.
    """
    rows, _ = _pieces(docs, id_col, text_col, source_col, weights, share, max_repeats, block_words, shard_words, seed)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"] * p["times"])
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
