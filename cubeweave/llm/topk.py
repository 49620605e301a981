"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Every vector is a sparse row over integer terms (its components). Queries are taken in blocks of a
bounded number of rows; a block is broadcast, every task turns its candidates into postings by term, and
for one term after the other scatters query weight x posting value into dense score arrays. Partition
selection keeps k scores a query and task; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeweave.scratch import materialize, new_path

#: Candidates whose scores are accumulated at once; with QUERY_BLOCK it bounds the dense score array.
CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 1024
NONE = np.iinfo(np.int64).min
FOUND = "block long, q long, query_id long, vec_id long, score long"


def quantize(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vec: Column) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(True))


def _dense(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list array as a matrix; short rows get zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(lengths.max(initial=0)), width)
    if len(lengths) * width == len(flat):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def accumulate(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores [queries, candidates], a term at a time over the postings of the candidates."""
    scores = np.zeros((len(weights), len(rows)), np.int64)
    for t in range(min(weights.shape[1], rows.shape[1])):
        posted, asking = np.flatnonzero(rows[:, t]), np.flatnonzero(weights[:, t])
        if not len(posted) or not len(asking):
            continue
        if 2 * len(posted) >= len(rows) and 2 * len(asking) >= len(weights):
            scores += weights[:, t, None] * rows[None, :, t]
        else:
            scores[np.ix_(asking, posted)] += weights[asking, t, None] * rows[None, posted, t]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k highest of each row, ties to the smaller id; NONE counts as absent."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, c = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    else:
        q, c = np.nonzero(scores != NONE)
    return best(q, ids[c], scores[q, c], k)


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], ids[keep], scores[keep]


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of every query row: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. Rows whose id is
    null, or whose vector is null or holds null or non-finite components, take no part. Vectors of unequal
    length count as ending in zeros. Rows repeated under one id are all candidates, and a query row that is
    repeated is answered once for each. A query without candidates has no rows. Scores are 64-bit and wrap.
    A block of queries is one pass over the candidates, whose scores are written before the next block begins, so only
    query_block rows are on the driver and in a broadcast at a time.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), quantize(F.col(vec_col), scale).alias("v"), is_query.alias("asks"))
    candidates = rows.select("vec_id", "v")
    asked = materialize(rows.filter("asks").select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "topk-queries")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    path = new_path(spark, "topk-found")
    for b in range(blocks):
        block = spark.sparkContext.broadcast(_fetch(asked, b))
        _search(candidates, block, b, k).write.mode("append").parquet(path)
        block.destroy()
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _fetch(asked: DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    table = asked.filter(F.col("block") == block).select("vec_id", "v").toArrow()
    lists = table["v"].combine_chunks()
    return table["vec_id"].to_numpy(), _dense(lists) if len(table) else np.zeros((0, 0), np.int64)


def _search(candidates: DataFrame, asked, block: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = asked.value
        kept = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for at in range(0, batch.num_rows if len(own) else 0, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                ids = part.column(0).to_numpy()
                scores = accumulate(weights, _dense(part.column(1)))
                scores[own[:, None] == ids[None, :]] = NONE
                kept = best(*(np.concatenate(x) for x in zip(kept, select(scores, ids, k), strict=True)), k)
        q, ids, scores = kept
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block, np.int64)), pa.array(q), pa.array(own[q]), pa.array(ids), pa.array(scores)], names=["block", "q", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, FOUND)
