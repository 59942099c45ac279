"""Exact top-k search by term-at-a-time accumulation over postings of vector components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ship

#: Vectors in a candidate block and in a query block: they bound a task's memory, never the result.
CANDIDATES, QUERIES, STEP = 16384, 4096, 64


#: Terms and scores stay in this range.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def accumulate(query: np.ndarray, cand: np.ndarray, own: list, ids: np.ndarray, k: int):
    """Yield (position of query, id, score) of each query's k best; ids are ascending, so ties go to the first.

    own: of each query the position of its own row among the candidates, or -1. Sums are made in the narrowest type that holds them
    exactly (Python integers where 64 bits do not), then kept in the range of 64 bits.
    """
    reach = int(np.abs(query.astype(object)).max(initial=0)) * int(np.abs(cand.astype(object)).max(initial=0)) * max(cand.shape[1], 1)
    kind = np.int32 if reach < 1 << 31 else np.int64 if reach < 1 << 63 else object
    query, cand = query.astype(kind), cand.astype(kind)
    terms = [(np.flatnonzero(cand[:, t]), cand[:, t]) for t in range(cand.shape[1])]
    postings = [(at, np.ascontiguousarray(w[at])) for at, w in terms]
    for start in range(0, len(query), STEP):
        block = query[start : start + STEP]
        scores = np.zeros((len(block), len(cand)), dtype=kind)
        for t, (at, w) in enumerate(postings):
            full = len(at) == len(cand)
            for r in np.flatnonzero(block[:, t]):
                if full:
                    scores[r] += block[r, t] * w
                else:
                    scores[r, at] += block[r, t] * w
        for r in range(len(block)):
            free = np.delete(np.arange(len(ids)), own[start + r]) if own[start + r] >= 0 else np.arange(len(ids))
            s = scores[r, free]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                over = np.flatnonzero(s > edge)
                take = np.concatenate([over, np.flatnonzero(s == edge)[: k - len(over)]])
            else:
                take = np.arange(len(s))
            for j in take:
                yield start + r, int(ids[free[j]]), min(max(int(s[j]), LEAST), MOST)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products.

    Vectors that are null, have null or non-finite components or no id take no part; shorter ones miss the
    further terms. Ties go to the smaller id. Terms and scores beyond 64 bits count as the nearest such number. Candidates are dealt in
    blocks, queries in blocks too; each pair of blocks is one bounded group, and only k rows a query and block are merged. Rows, not
    ids, are queries and candidates: of rows with one id each has its own list, in which the others may stand. Other columns are not read.
    """
    ship(vectors)
    x = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    v = vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("w"))
    q = v.filter(is_query(F.col("vec_id"))).groupBy("vec_id", "w").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    q = durable(q).withColumn("q", F.monotonically_increasing_id())
    n, nq = v.count(), q.count()
    nc, nb = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(nq / QUERIES))
    deal = lambda m, seed, *by: F.pmod(F.xxhash64("vec_id", *by, F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Rows of one id and vector lie in one block, where a query leaves out one of them.
    cands = v.withColumn("cb", deal(nc, 2, "w")).withColumn("qb", every(nb))
    asks = q.withColumn("qb", deal(nb, 1, "w")).withColumn("cb", every(nc))

    def search(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(c):
            c = c.sort_values("vec_id", kind="stable")
            dim = max(max(map(len, a["w"])), max(map(len, c["w"])))
            dense = [np.zeros((len(f), dim), dtype=np.int64) for f in (a, c)]
            for m, f in zip(dense, (a, c)):
                for i, w in enumerate(f["w"]):
                    m[i, : len(w)] = w
            ids = c["vec_id"].to_numpy()
            sizes = c["w"].map(len).to_numpy()
            own = []
            for i, (ident, w) in enumerate(zip(a["vec_id"], a["w"])):
                near = range(*np.searchsorted(ids, [ident, ident + 1 if ident < MOST else ident], "left")) if ident < MOST else np.flatnonzero(ids == ident)
                own.append(next((int(j) for j in near if sizes[j] == len(w) and (dense[1][j] == dense[0][i]).all()), -1))
            asked = a["q"].to_numpy()
            rows = [(int(asked[i]), j, s) for i, j, s in accumulate(*dense, own, ids, k)]
        return pd.DataFrame(rows, columns=["q", "vec_id", "score"]).astype("int64")

    found = asks.groupBy("cb", "qb").cogroup(cands.groupBy("cb", "qb")).applyInPandas(search, "q long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    whose = q.select(F.col("q").alias("_q"), F.col("vec_id").alias("query_id"), "copies")
    found = found.join(whose, F.col("q") == F.col("_q")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("query_id", "rank", "vec_id", "score")


def op4(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
