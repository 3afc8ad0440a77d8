"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors become integers, so scores are exact. A tile holds some queries and some candidates, its candidates by dimension. For
each query, scores grow by one block of dimensions at a time. What the rest can still add is at most the product of both
vectors' remaining lengths (Cauchy-Schwarz). The k-th best of score minus that mass is a sure level; candidates whose score
plus mass stays below it are dropped and the survivors are compacted, so later blocks touch few columns. Ties are kept.

Every query is scored against every candidate, in tiles of bounded size: queries and candidates are dealt out by hash into
blocks, each tile gives at most k rows for a query, and a second ranking takes the best of these. Tiles are
independent of each other, so a lost one simply runs again.

Cases. Vectors that are null or hold null or non-finite components take no part. An empty vector has score 0. Vectors of
other lengths are filled up with zeros. Repeated ids are rows of their own; a query's own id is never its candidate.
A null id is no query and no candidate. Components beyond 2^31 / 256 are scored in 64-bit integers without a check for
overflow. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
QUERIES_A_TILE = 256
CANDIDATES_A_TILE = 8192
BLOCK = 8
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and integer components of the vectors that take part."""
    x = F.col(vector)
    sound = F.col(key).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    )
    ints = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), ints.alias("ints"))


def _matrix(rows, width: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_in_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int, block: int = BLOCK):
    """For each query its k best (score, id) among the columns of ``vertical`` (dimensions by candidates), without its own id."""
    starts = list(range(0, len(vertical), block)) or [0]
    whole = vertical.astype(np.float64)
    tails = np.zeros((len(starts) + 1, len(ids)))  # remaining length of each candidate before a block
    for b in range(len(starts) - 1, -1, -1):
        part = whole[starts[b] : starts[b] + block]
        tails[b] = tails[b + 1] + (part * part).sum(axis=0)
    np.sqrt(tails, out=tails)
    for i, query in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[i])
        score = np.zeros(len(alive), vertical.dtype)
        left = float((query.astype(np.float64) ** 2).sum())
        for b, at in enumerate(starts):
            part = query[at : at + block]
            columns = vertical[at : at + block] if len(alive) == len(ids) else vertical[at : at + block, alive]
            score = score + part @ columns
            left = max(0.0, left - float((part.astype(np.float64) ** 2).sum()))
            if b + 1 == len(starts) or len(alive) <= k:
                continue
            mass = np.sqrt(left) * tails[b + 1][alive] * (1 + 1e-9) + 1e-6
            level = np.partition(score - mass, len(alive) - k)[len(alive) - k]
            keep = score + mass >= level
            if not keep.all():
                alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        for j in order:
            yield int(query_ids[i]), int(ids[alive[j]]), int(score[j])


def _tile(k: int):
    def run(key, asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(pool):
            width = max(max(map(len, asked["ints"])), max(map(len, pool["ints"])))
            queries, vectors = _matrix(asked["ints"], width, np.int64), _matrix(pool["ints"], width, np.int64)
            top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1)
            if top < EXACT:  # then sums of products are exact in doubles, which are faster
                queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
            rows = list(best_in_tile(asked["vec_id"].to_numpy(), queries, pool["vec_id"].to_numpy(), np.ascontiguousarray(vectors.T), k))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, queries_a_tile: int = QUERIES_A_TILE, candidates_a_tile: int = CANDIDATES_A_TILE) -> DataFrame:
    """query_id, rank, vec_id, score over ``quantised`` vectors. A tile is fetched by a task of its own and holds a bounded number of rows, about the two limits."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    q_blocks, c_blocks = max(1, -(-n["q"] // queries_a_tile)), max(1, -(-n["n"] // candidates_a_tile))
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("long")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    asked = vectors.where(is_query).select("*", block(q_blocks, 1).alias("_q")).select("*", every(c_blocks).alias("_c"))
    pool = vectors.select("*", block(c_blocks, 2).alias("_c")).select("*", every(q_blocks).alias("_q"))
    found = asked.groupBy("_q", "_c").cogroup(pool.groupBy("_q", "_c")).applyInPandas(_tile(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
