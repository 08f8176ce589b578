"""Exact top-k inner products by no-random-access aggregation over sorted lists, block by block.

In a block of vectors every component is a list sorted by value. A query reads all lists from the
side that favours it, to the same depth at a time. What has been read of a vector, with the value
last read from the lists where it hasn't been met, bounds its score from above; with the lists'
worst values, from below. Vectors whose upper bound is under the k-th largest lower bound are given
up; reading stops when no more than k are left or all is read, and what is left gets its true score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.llm.base import stored, table

#: Best scores of a query, vectors and queries of a block, part of the lists read by each step.
K, BLOCK, QUERIES = 5, 4096, 1024
DEPTHS = (0.2, 0.5, 0.8)
#: Queries of a group that read side by side.
SIDE_BY_SIDE = 256
#: Steps of a component: a vector's numbers are floor(SCALE * x).
SCALE = 256

_FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the integer components of the vectors that take part."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(SCALE)).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & whole & usable).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"))


def nra(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, owns: np.ndarray, k: int = K, depths: tuple = DEPTHS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(ids, scores, entries read of each list) of the k best of a block for each query, but for id own; ties to smaller ids.

    At a depth the same entries of a list have been read by every query that reads it from that side,
    so the bounds of all vectors for all queries are products of the values read, and of the marks
    where they were, with the queries' positive and negative parts.
    """
    n = len(block)
    order = np.argsort(block, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    lists = np.take_along_axis(block, order, axis=0)
    for at in range(0, len(queries), SIDE_BY_SIDE):
        q, own = queries[at : at + SIDE_BY_SIDE], owns[at : at + SIDE_BY_SIDE]
        up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
        live = ids[:, None] != own[None, :]
        reading = np.flatnonzero(live.sum(axis=0) > k)
        read = np.full(len(q), n)
        worst = up @ lists[0] + down @ lists[-1] if n else np.zeros(len(q))
        for part in depths:
            depth = max(k, int(np.ceil(n * part)))
            if depth >= n or not len(reading):
                break
            top, low = (rank >= n - depth).astype(np.float64), (rank < depth).astype(np.float64)
            u, d = up[reading].T, down[reading].T
            met = (block * top) @ u + (block * low) @ d
            # What isn't met counts as the value last read, at most, or as the list's worst, at least.
            last_u, last_d = u * lists[n - depth][:, None], d * lists[depth - 1][:, None]
            upper = met + (last_u.sum(axis=0) + last_d.sum(axis=0)) - top @ last_u - low @ last_d
            lower = met + worst[reading] - top @ (u * lists[0][:, None]) - low @ (d * lists[-1][:, None])
            lower[~live[:, reading]] = -np.inf
            mark = np.partition(lower, n - k, axis=0)[n - k]
            live[:, reading] &= upper >= mark[None, :] - 0.5
            few = live[:, reading].sum(axis=0) <= 4 * k
            read[reading[few]] = depth
            reading = reading[~few]
        full = block @ q[reading].T if len(reading) else None
        column = {int(r): c for c, r in enumerate(reading)}
        for j in range(len(q)):
            kept = np.flatnonzero(live[:, j])
            scores = full[kept, column[j]] if j in column else block[kept] @ q[j]
            if len(kept) > 8 * k:
                enough = np.partition(scores, len(scores) - k)[len(scores) - k]
                kept, scores = kept[scores >= enough], scores[scores >= enough]
            best = np.lexsort((ids[kept], -scores))[:k]
            yield ids[kept][best], scores[best], int(read[j])


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries(vec_id, embedding) its k best of vectors(vec_id, embedding).

    The score is the integer inner product; equal scores go by smaller vec_id. Rows with the query's
    vec_id are not candidates. Vectors that are null, empty or hold null or non-finite components,
    and rows without vec_id, take no part; vectors of another length than the query aren't compared
    with it; fewer than k candidates are all returned; repeated vec_ids are vectors of their own;
    an empty table gives no rows; other columns are ignored.

    Vectors go to blocks by a hash, queries to groups by another, and each pair is a task of bounded
    size that keeps k rows a query.
    """
    rows, asked = stored(quantized(vectors)), stored(quantized(queries))
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-asked.count() // QUERIES))
    size = F.size("v")
    theirs = rows.select("vec_id", "v", F.lit(False).alias("asks"), size.alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    ours = asked.select("vec_id", "v", F.lit(True).alias("asks"), size.alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("group"))

    def compare(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids = t.column("vec_id").to_numpy()
        width = t.column("d")[0].as_py() if t.num_rows else 1
        flat = t.column("v").combine_chunks()
        values = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().reshape(-1, width)
        block, names, out = values[~asks].astype(np.float64), ids[~asks], []
        if len(block):
            owns = ids[asks]
            for own, (found, scores, _) in zip(owns, nra(block, names, values[asks].astype(np.float64), owns, k), strict=True):
                out.append((np.full(len(found), own), found, scores.astype(np.int64)))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    best = theirs.union(ours).groupBy("d", "block", "group").applyInArrow(compare, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark, sf_dir) -> DataFrame:
    """The five best of all vectors for each vector whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
