"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are dealt by a hash of id and vector to blocks of bounded size; every block of queries meets every block of
candidates in one cell of a grid. In a cell each term (vector component) has a posting list of the candidates where it is not
zero; a query row scatters ``weight * postings`` of its non-zero terms into a dense array of scores, ``argpartition``
selects the best k, and a last aggregation merges the cells' lists. Sums are exact integers.

Vectors that are null or hold null, NaN or infinite components take no part, nor do null ids; an empty table on either
side gives no rows. A query does not find rows of its own id. Candidate rows that repeat count one by one, and as no
query can return more than k of them, no more are kept, so a hot row is spread and small. Query rows that repeat count
once; different vectors under one id make one query, whose ranking holds what any of them scores. Ties go to the smaller
vec_id. Vectors of different lengths are compared over the terms both have; columns besides vec_id and q are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Rows of a block at most (on average; ids are dealt by hash).
CANDIDATES, QUERIES = 8192, 1024


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and q, the components as floor(scale * x); rows that take no part are gone."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("q"))


def _dense(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.to_numpy()[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return ids.to_numpy(), out


def accumulate(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query, candidate and score of each query's best k in one cell, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    terms = min(queries.shape[1], vectors.shape[1])
    reach = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(vectors).max(initial=0))) * max(1, terms)
    kind = np.int32 if reach < 2**31 else np.int64
    postings = []
    for t in range(terms):
        at = np.flatnonzero(vectors[:, t])
        postings.append((slice(None) if len(at) == len(ids) else at, vectors[at, t].astype(kind)))
    found: list[list[np.ndarray]] = [[], [], []]
    for query, row in zip(query_ids, queries[:, :terms].astype(kind), strict=True):
        scores = np.zeros(len(ids), kind)
        for t in np.flatnonzero(row):
            scores[postings[t][0]] += row[t] * postings[t][1]
        own = np.flatnonzero(ids == query)
        take = min(k + len(own), len(ids))
        least = np.partition(scores, len(ids) - take)[len(ids) - take]
        best = np.flatnonzero(scores >= least)
        best = best[ids[best] != query]
        best = best[np.argsort(-scores[best].astype(np.int64), kind="stable")][:k]
        for a, b in zip(found, (np.full(len(best), query), ids[best], scores[best].astype(np.int64)), strict=True):
            a.append(b)
    return tuple(np.concatenate(a) if a else np.zeros(0, np.int64) for a in found)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and q."""
    queries = queries.select("vec_id", "q").distinct()
    kinds = candidates.groupBy("vec_id", "q").agg(F.count("*").alias("n"))
    candidates = durable(kinds.select("vec_id", "q", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("copy")).drop("copy"))
    n, m = candidates.count(), queries.count()
    across, down = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    side = lambda df, own, other, b: df.withColumn(own[0], F.pmod(F.xxhash64("vec_id", "q"), F.lit(own[1]))).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)).cast("array<bigint>")))
    c = side(candidates.select("vec_id", "q"), ("cb", across), ("qb", down), block)
    q = side(queries, ("qb", down), ("cb", across), query_block)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = accumulate(*_dense(left["vec_id"], left["q"]), *_dense(right["vec_id"], right["q"]), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    cells = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score long")
    merged = cells.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))  # k rows a cell
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def op3_term_at_a_time_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


SQL = {
    "op3_term_at_a_time_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
