"""Exact top-k search by the threshold algorithm.

Vectors become integers and are dealt into blocks of rows. In a block every dimension
has a list of the rows in order of their value. A query walks all lists at once from
the end where its own component gains most, scores each row it meets for the first
time in full, and stops as soon as no unseen row can reach the k-th best score: an
unseen row scores at most the sum of the query's components times the values reached
in the lists. Ties are kept by going on while the bound equals the k-th score. The best
of the blocks are merged. Queries come in blocks too, so a unit of work holds at most
``block_rows`` rows and ``block_queries`` queries, whatever the size of the tables.

Rows whose vector is null or holds a null or non-finite component take no part;
vectors shorter than others count as ending in zeros. Scores are exact integers while
they stay within 64 bits. A row never finds itself, but finds other rows that have its
id. Rows with a null id are candidates, after all others among equals, and no queries.
An empty table gives no rows. Columns besides id and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cobasket.llm.common import SEED
from cobasket.staging import stage_counting

FIRST_DEPTH = 16


def quantise(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component; null when a component is null or not finite."""
    wide = vector.cast("array<double>")
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


class SortedLists:
    """The per-dimension lists of one block of rows."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        order = np.lexsort((uids, ids))
        self.values, self.ids, self.uids = values[order], ids[order], uids[order]
        self.up = np.argsort(self.values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.values.T, self.up, axis=1)
        # Products of small integers are exact in doubles, which multiply faster.
        self.peak = int(np.abs(values).max(initial=0)) * max(1, values.shape[1])
        self.fast = self.values.astype(np.float64)

    def search(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Positions and scores of the ``k`` best rows besides row ``own``, best first."""
        rows = len(self.ids)
        exact = self.peak * int(np.abs(query).max(initial=0)) < 2**53
        matrix, weights = (self.fast, query.astype(np.float64)) if exact else (self.values, query)
        gains = np.flatnonzero(query > 0)
        losses = np.flatnonzero(query < 0)
        seen = self.uids == own
        best_at, best = np.empty(0, np.int64), np.empty(0, matrix.dtype)
        done, depth = 0, min(FIRST_DEPTH, rows)
        while True:
            met = np.concatenate((
                self.up[gains, rows - depth:rows - done].ravel(), self.up[losses, done:depth].ravel(),
            ))
            if not len(gains) and not len(losses):
                met = np.arange(rows)
            fresh = np.zeros(rows, bool)
            fresh[met] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen[new] = True
            best_at = np.concatenate((best_at, new))
            best = np.concatenate((best, matrix[new] @ weights))
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
            if depth >= rows:
                return best_at, best.astype(np.int64)
            bound = (query[gains] * self.sorted[gains, rows - depth]).sum() + (query[losses] * self.sorted[losses, depth - 1]).sum()
            if len(best) >= k and best[-1] > bound:
                return best_at, best.astype(np.int64)
            done, depth = depth, min(rows, depth * 2)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, block_rows: int = 8192, block_queries: int = 4096,
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` best rows of every query row.

    ``is_query`` is a condition on the columns of ``vectors``.
    """
    narrow = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        quantise(F.col(vector_col), scale).alias("v"),
    ).filter(F.col("v").isNotNull()).withColumn("uid", F.monotonically_increasing_id())
    rows, seen = stage_counting(narrow, "topk", n=F.count("*"), asking=F.count_if("asks"), width=F.max(F.size("v")))
    row_blocks = max(1, math.ceil(seen["n"] / block_rows))
    query_blocks = max(1, math.ceil(seen["asking"] / block_queries))
    width = max(1, seen["width"] or 1)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(SEED), "uid"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    found = rows.select("uid", "id", "v", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    # Names of their own: columns that both sides of a cogroup share may be pruned from one.
    asked = rows.filter("asks").select(
        F.col("uid").alias("asker"), F.col("id").alias("asker_id"), F.col("v").alias("weights"),
        block(query_blocks).alias("query_block"), every(row_blocks).alias("row_block"),
    )
    schema = pa.schema([
        ("quid", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64()),
    ])
    last = np.iinfo(np.int64).max

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            ids = left["id"].fill_null(last).to_numpy()
            lists = SortedLists(_matrix(left["v"], width), ids, left["uid"].to_numpy())
            asks = _matrix(right["weights"], width)
            for quid, qid, query in zip(right["asker"].to_pylist(), right["asker_id"].to_pylist(), asks, strict=True):
                at, score = lists.search(query, quid, k)
                for column, values in zip(out, ([quid] * len(at), [qid] * len(at), lists.uids[at], lists.ids[at], score), strict=True):
                    column.extend(values)
        columns = [pa.array(c, pa.int64()) for c in out]
        columns[3] = pc.if_else(pc.equal(columns[3], last), None, columns[3])
        return pa.Table.from_arrays(columns, schema=schema)

    pairs = found.groupBy("rb", "qb").cogroup(asked.groupBy("row_block", "query_block"))
    best = pairs.applyInArrow(search, "quid long, query_id long, uid long, id long, score long")
    order = Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score",
    )
