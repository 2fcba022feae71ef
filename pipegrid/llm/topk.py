"""Exact top-k by inner product with MaxScore over shards.

The terms of a query are the dimensions of its vector. Every shard of the candidates knows the largest and smallest value of
each dimension and so bounds each term's part of a score. A query's terms, by the size of their bounds, split into
non-essential ones (which together cannot lift any candidate to the threshold, the k-th best score so far) and essential
ones. A shard's columns for the essential terms are traversed block by block; a candidate whose partial score plus
the bounds of the other terms reaches the threshold is competitive, and only competitive candidates are probed in the other
terms. Where no partial sum can reach 2^53, float64 sums are exact; where one could, the task scores all pairs in integers of any
size. The best k of all shards merge by rank.

Queries meet candidates in blocks (a query block of at most ``query_block`` rows against one shard is a task's work); neither
side is ever collected or broadcast. Vectors that are null, hold null or non-finite components, or have a null vec_id take no
part. Scaled components, and scores, beyond a long's range count as its ends. Shorter vectors count as padded with
zeros. A query's own row, and any that repeats its vec_id, is no candidate; repeated candidates are candidates each, and repeated
query rows share one result, but rows that share a vec_id alone have results of their own. Ties go to the smaller vec_id. Fewer candidates than k give as many rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.llm.common import buckets, cut, table


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows that take no part are gone."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("embedding").isNotNull() & fine, v).alias("v")).where("vec_id is not null and v is not null")


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    column = t.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lens = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((t.num_rows, width))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    row = np.repeat(np.arange(t.num_rows), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def search(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of a shard for each query, as (row of q, vec_id, score), by MaxScore."""
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    theta = np.full(len(q), -np.inf)
    order = np.argsort(v_ids, kind="stable")
    v, v_ids = v[order], v_ids[order]
    high, low = v.max(axis=0), v.min(axis=0)
    top, bottom = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    span = top - bottom
    rank = np.argsort(span, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(span, rank, 1), axis=1) + bottom.sum(axis=1, keepdims=True)
    for a in range(0, len(v), block):
        part, ids = v[a : a + block], v_ids[a : a + block]
        other = np.zeros(q.shape, bool)
        np.put_along_axis(other, rank, sums < theta[:, None], 1)
        essential, rest = np.where(other, 0.0, q), np.where(other, q, 0.0)
        score = essential @ part.T
        i, j = np.nonzero(score + np.where(other, top, 0.0).sum(axis=1)[:, None] >= theta[:, None])
        own = q_ids[i] != ids[j]
        i, j = i[own], j[own]
        exact = score[i, j]
        probe = np.flatnonzero(other.any(axis=1)[i])
        for b in range(0, len(probe), 1 << 16):
            some = probe[b : b + (1 << 16)]
            exact[some] += np.einsum("ij,ij->i", rest[i[some]], part[j[some]])
        good = exact >= theta[i]
        i, j, exact = np.concatenate([best[0], i[good]]), np.concatenate([best[1], ids[j[good]]]), np.concatenate([best[2], exact[good]])
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(q)))
        place = np.arange(len(i)) - first[i]
        kth = place == k - 1
        theta[i[kth]] = exact[kth]
        best = (i[place < k], j[place < k], exact[place < k])
    return best


def search_integers(q: list, q_ids: np.ndarray, v: list, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as search, for lists of integers of any size."""
    out, ends = [], np.iinfo(np.int64)
    for n, (own, a) in enumerate(zip(q_ids.tolist(), q, strict=True)):
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in zip(v_ids.tolist(), v, strict=True) if i != own)[:k]
        out += [(n, i, min(max(-score, ends.min), ends.max)) for score, i in ranked]
    return tuple(np.array([x[j] for x in out], np.int64) for j in range(3))


_FOUND = "query_id long, query_hash long, vec_id long, score long"


def _task(k: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        q_ids, q_hash = (np.asarray(queries.column(c), np.int64) for c in ("vec_id", "hash"))
        if queries.num_rows and shard.num_rows:
            _, first = np.unique(np.stack([q_ids, q_hash]), axis=1, return_index=True)
            queries, q_ids, q_hash, v_ids = queries.take(first), q_ids[first], q_hash[first], np.asarray(shard.column("vec_id"), np.int64)
            width = max(max(np.asarray(t.column("v").combine_chunks().value_lengths()).max() for t in (queries, shard)), 1)
            q, v = _matrix(queries, width), _matrix(shard, width)
            if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * width < 1 << 52:
                found = search(q, q_ids, v, v_ids, k)
            else:
                found = search_integers(queries.column("v").to_pylist(), q_ids, shard.column("v").to_pylist(), v_ids, k)
        i, j, score = found
        return pa.table({"query_id": pa.array(q_ids[i], pa.int64()), "query_hash": pa.array(q_hash[i], pa.int64()), "vec_id": pa.array(j, pa.int64()), "score": pa.array(score.astype(np.int64))})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, query_block: int = 4096, shard_rows: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other vectors for every vector that is_query holds for."""
    kept = cut(vectors)
    counts = kept.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks = max(1, -(-counts["q"] // query_block))
    shards = max(1, -(-counts["n"] // shard_rows), min(buckets(kept), counts["n"] // 2048))
    at = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = kept.where(is_query).select("vec_id", "v", F.xxhash64("v").alias("hash"), at(blocks, 1).alias("block"), copies(shards).alias("shard"))
    pieces = kept.withColumn("copy", F.monotonically_increasing_id()).select("vec_id", "v", copies(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", "copy"), F.lit(shards)).cast("int").alias("shard"))
    found = queries.groupBy("block", "shard").cogroup(pieces.groupBy("block", "shard")).applyInArrow(_task(k), _FOUND)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
