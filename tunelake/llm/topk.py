"""Exact top-k search by inner product with a pivot table.

Vectors are quantised to integers and lengthened by one coordinate so that all
have the same length M; then a larger inner product is a smaller distance. The
distances of every vector to a fixed number of pivots are computed once. For a
query q and a vector v the largest |d(q, p) - d(v, p)| over the pivots is a
lower bound of their distance, hence an upper bound of their score. Within a
block of vectors each query takes the vectors in the order of that bound and
stops when the bound is below its k-th best score so far (which starts from
the scores of the pivots), so the answer is exact.

Vectors are packed into blocks of BLOCK rows by a hash and queries into blocks
of QUERIES rows; every pair of a vector block and a query block is a task of
bounded memory, whatever the table's size, and gives k rows a query, of which
the best k are kept.

Results: null vectors, vectors with null or non-finite components and rows
without an id take no part; an empty table or one without queries gives an
empty result; missing components count as 0; ties go to the smaller id;
repeated rows are candidates each; of query rows with equal id the largest
vector asks; a row with the query's id is its own and no candidate. Further
columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import table

K = 5
SCALE = 256
PIVOTS = 16
BLOCK = 4096
QUERIES = 1024
STEP = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v")))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for integer matrices, exact: in doubles while all sums stay below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def pivot_distances(m: np.ndarray, pivots: np.ndarray, length2: float) -> np.ndarray:
    """Distances of the lengthened vectors to the lengthened pivots."""
    def lift(x):
        return np.sqrt(np.maximum(length2 - (x.astype(np.float64) ** 2).sum(1), 0))
    inner = dot(m, pivots).astype(np.float64) + np.outer(lift(m), lift(pivots))
    return np.sqrt(np.maximum(2 * (length2 - inner), 0))


def query_distances(q: np.ndarray, pivots: np.ndarray, length2: float) -> np.ndarray:
    """The same for queries, whose added coordinate is 0."""
    own = (q.astype(np.float64) ** 2).sum(1)[:, None]
    return np.sqrt(np.maximum(own + length2 - 2 * dot(q, pivots).astype(np.float64), 0))


def best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(v_ids, v, v_far, q_ids, q, q_far, start, length2: float, k: int, seen: list | None = None):
    """(query_id, vec_id, score) arrays: the block's k best for every query, or fewer where the
    bound proves that the block holds no more of them. start: a score that k rows are known to reach."""
    own = (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (length2 + float(own.max(initial=0)) + 1)  # rounding of the distances
    out = []
    for i in range(len(q_ids)):
        bound = (own[i] + length2 - np.abs(v_far - q_far[i]).max(1) ** 2) / 2 + slack
        bound[v_ids == q_ids[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        ids, scores, least, at = np.empty(0, np.int64), np.empty(0, np.int64), start[i], 0
        while at < len(order) and bound[order[at]] >= least and bound[order[at]] > -np.inf:
            part = order[at:at + STEP]
            part = part[bound[part] > -np.inf]
            ids, scores = best(np.concatenate([ids, v_ids[part]]), np.concatenate([scores, dot(v[part], q[i:i + 1])[:, 0]]), k)
            if len(scores) == k:
                least = max(least, scores[-1])
            at += STEP
        if seen is not None:
            seen.append(min(at, len(order)))
        out.append((np.full(len(ids), q_ids[i]), ids, scores))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def search(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK,
           queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row where ``is_query`` holds."""
    rows = materialize(quantised(vectors, scale), "vectors")
    stats = rows.agg(F.count(F.lit(1)), F.max(F.size("v")),
                     F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).first()
    n, width, length2 = stats[0], stats[1] or 0, stats[2] or 0.0
    asked = rows.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v"))
    n_asked = asked.count()
    n_q = max(1, -(-n_asked // queries))
    # a fixed number of rows, spread by a hash of the id
    chosen = rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "v").limit(pivots).collect()
    p_ids, p = np.array([r["vec_id"] for r in chosen], np.int64), matrix([r["v"] for r in chosen], width)

    def pack(parts):
        for f in parts:
            if len(f):
                m = matrix(list(f["v"]), width)
                for at in range(0, len(m), block):
                    part = m[at:at + block]
                    yield pd.DataFrame([{"ids": f["vec_id"].to_numpy(np.int64)[at:at + block].tobytes(), "m": part.tobytes(),
                                         "far": pivot_distances(part, p, length2).tobytes()}])

    def pack_queries(key, f):
        f = f.sort_values("vec_id")
        ids, m = f["vec_id"].to_numpy(np.int64), matrix(list(f["v"]), width)
        known = dot(m, p)
        start = np.full(len(m), -np.inf)
        for i in range(len(m)):
            own = np.sort(known[i][p_ids != ids[i]])[::-1]
            if len(own) >= k:
                start[i] = own[k - 1]
        return pd.DataFrame([{"qb": key[0], "q_ids": ids.tobytes(), "q": m.tobytes(),
                              "q_far": query_distances(m, p, length2).tobytes(), "start": start.tobytes()}])

    def find(parts):
        for f in parts:
            for r in f.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                got = search_block(ids, np.frombuffer(r.m, np.int64).reshape(len(ids), width),
                                   np.frombuffer(r.far).reshape(len(ids), -1), q_ids,
                                   np.frombuffer(r.q, np.int64).reshape(len(q_ids), width),
                                   np.frombuffer(r.q_far).reshape(len(q_ids), -1), np.frombuffer(r.start), length2, k)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got)))

    n_v = max(1, -(-n // block))
    packs = rows.repartition(n_v).mapInPandas(pack, "ids binary, m binary, far binary")
    q_packs = (asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int"))
               .groupBy("qb").applyInPandas(pack_queries, "qb int, q_ids binary, q binary, q_far binary, start binary"))
    pairs = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")).join(q_packs, "qb")
    # each pair is one unit of work: spread them before the search
    found = pairs.repartition(max(1, min(n_v * n_q, 10_000))).mapInPandas(find, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_topk_search(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
