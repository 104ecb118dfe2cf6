"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments; with a segment's length L, mean m and deviation s, for vectors q and c

    |q - c|^2 >= sum over segments of L * ((m_q - m_c)^2 + (s_q - s_c)^2),

so the inner product is at most the sum of L * (m_q * m_c + s_q * s_c).  Bounds are taken from few segments to many; a candidate stays as
long as its bound is not below the k-th best exact score that its query has so far, and what is left is scored exactly, in whole numbers.

Queries and candidates are cut into blocks; a task holds one block of each, so its memory doesn't grow with the input, and gives k rows
a query.  The best of these are then ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcline.llm.common import read, stage

RESOLUTIONS = (4, 8, 16)
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
_LAST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component.

    Left out: null vectors and those that hold null, non-finite or, scaled, over-long components.
    """
    x = F.col("embedding")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 2.0**62)
    kept = vectors.select("vec_id", F.transform(x, lambda c: c.cast("double")).alias("embedding")).where(x.isNotNull() & F.forall(x, lambda c: F.coalesce(fits(c), F.lit(False))))
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _features(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment."""
    edges = np.linspace(0, v.shape[1], segments + 1).astype(int)
    out = []
    for b, e in zip(edges[:-1], edges[1:], strict=True):
        if e > b:
            part = v[:, b:e]
            out += [part.mean(axis=1) * math.sqrt(e - b), part.std(axis=1) * math.sqrt(e - b)]
    return np.stack(out, axis=1) if out else np.zeros((len(v), 1))


def _survivors(q: np.ndarray, c: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Which pairs may be among their query's first k: the bounds of every resolution reach the k-th best of some exact scores.

    Those are the scores of the candidates with the highest coarse bounds.  A bound equal to the k-th score stays: it may win its tie.
    """
    slack = (1e-9 * np.abs(q).sum(axis=1) * max(1.0, np.abs(c).max(initial=0)) + 1e-6)[:, None]
    alive = other.copy()
    least = None
    for r in [r for r in RESOLUTIONS if r < q.shape[1]]:
        bound = _features(q, r) @ _features(c, r).T
        bound[~alive] = -np.inf
        if least is None:
            n = min(3 * k, c.shape[0])
            seed = np.argpartition(-bound, n - 1, axis=1)[:, :n]
            score = np.einsum("id,ijd->ij", q, c[seed])
            score[~np.take_along_axis(other, seed, axis=1)] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k][:, None] if n >= k else np.full((len(q), 1), -np.inf)
        alive &= bound >= least - slack
        if alive.mean() < 1 / 64:
            break
    return alive


def _scores(q: np.ndarray, c: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs that are left, -inf elsewhere: pair by pair where few are left, else as one product."""
    out = np.full(alive.shape, -np.inf)
    if np.count_nonzero(alive) * 16 < alive.size:
        i, j = np.nonzero(alive)
        for b in range(0, len(i), 1 << 16):
            a, d = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            out[a, d] = np.einsum("ij,ij->i", q[a], c[d])
        return out
    columns = np.flatnonzero(alive.any(axis=0))
    out[:, columns] = np.where(alive[:, columns], q @ c[columns].T, -np.inf)
    return out


def _block(k: int):
    def best(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="Int64"), "vec_id": pd.Series(dtype="Int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(candidates):
            return empty
        q_row, q_id = queries["_row"].to_numpy(), queries["vec_id"].to_numpy(dtype=object)
        c_id = candidates["vec_id"].astype("Int64")
        place = c_id.fillna(_LAST).to_numpy(np.int64)  # rows without a vec_id lose ties
        q, c = np.stack(queries["v"].to_numpy()), np.stack(candidates["v"].to_numpy())
        other = queries["_own"].to_numpy()[:, None] != candidates["_own"].to_numpy()[None, :]
        if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) >= 2.0**53:  # beyond what doubles hold exactly
            big = q.astype(object) @ c.astype(object).T
            rows = [(i, j, int(-s)) for i in range(len(q)) for s, _, j in sorted((-big[i, j], place[j], j) for j in np.flatnonzero(other[i]))[:k]]
            i, j, value = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            return _found(q_row[i], q_id[i], c_id, j, value)
        q, c = q.astype(np.float64), c.astype(np.float64)
        score = _scores(q, c, _survivors(q, c, other, k))
        last = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else np.full((len(q), 1), -np.inf)
        i, j = np.nonzero((score >= last) & (score > -np.inf))
        value = score[i, j]
        order = np.lexsort((place[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return _found(q_row[i[first]], q_id[i[first]], c_id, j[first], value[first].astype(np.int64))

    return best


def _found(query: np.ndarray, query_id: np.ndarray, ids: pd.Series, at: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query": query, "query_id": pd.array(query_id, dtype="Int64"), "vec_id": ids.iloc[at].array, "score": score})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, v) of highest inner product for each row of ``queries`` (vec_id, v), rows of its own vec_id left out.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, rows without one last, and a query with fewer candidates gets all.
    Rows that repeat a vec_id are candidates each, and queries each.  Only vectors as long as the query are its candidates.  Other columns, whatever
    their names, are not read and not returned.  Empty tables give no rows.
    """
    by_id = lambda df, side: df.select("vec_id", "v", F.coalesce("vec_id", F.lit(side)).alias("_own"), F.lit(True).alias("_asks"))
    none, nobody = -(1 << 62), -(1 << 62) - 1  # a query and a candidate without a vec_id are not one row
    return _searched(stage(_numbered(by_id(vectors, none)), "vectors"), stage(_numbered(by_id(queries, nobody)), "queries"), k, query_block, candidate_block)


def search_within(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """As ``search``, for the rows of ``vectors`` that ``is_query`` names, against every row but the query's own, even those of its vec_id."""
    rows = stage(_numbered(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("_asks"))).withColumn("_own", F.col("_row")), "vectors")
    return _searched(rows, rows.where("_asks"), k, query_block, candidate_block)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_row": F.monotonically_increasing_id(), "_n": F.size("v")})


def _searched(vectors: DataFrame, queries: DataFrame, k: int, query_block: int, candidate_block: int) -> DataFrame:
    n_v, n_q = max(1, vectors.count()), max(1, queries.count())
    rows, columns = math.ceil(n_q / query_block), math.ceil(n_v / candidate_block)
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(n)).cast("int")
    kept = ["_row", "_own", "vec_id", "v", "_n"]
    left = queries.select(*kept, block(rows, 5).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_c"))
    right = vectors.select(*kept, block(columns, 6).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_r"))
    keys = ["_n", "_r", "_c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block(k), "query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return search_within(integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 20
"""
