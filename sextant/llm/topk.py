"""Exact top-k by inner product over multi-resolution segment statistics.

A vector is cut into segments; of each, the mean and the deviation are kept, for 4, 8 and 16 segments. They bound the
distance of two vectors from below, |q - c|^2 >= sum over segments of n * (mean difference)^2 + (deviation difference)^2,
and so, as |q - c|^2 = |q|^2 + |c|^2 - 2 q.c, the inner product from above. Bounds go from coarse to fine; what no bound
rules out against the k-th score found is computed in full.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import blocks

RESOLUTIONS = (4, 8, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: each segment's mean, times the root of its length, and its deviation. Their inner product bounds that of the rows."""
    d = x.shape[1]
    starts = np.unique(np.arange(min(segments, d)) * d // min(segments, d))
    n = np.diff([*starts, d])
    mean = np.add.reduceat(x, starts, axis=1) / n
    deviation = np.sqrt(np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, starts, axis=1))
    return np.hstack([mean * np.sqrt(n), deviation])


def search_block(k: int, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of the block, by exact integer inner products.

    queries and vectors hold integers as doubles. Where no product of norms passes 2**52, every sum is exact in doubles;
    beyond, scores are summed as 64-bit integers. The bounds' rounding is covered by a slack in proportion to the norms.
    """
    own, other = (np.sqrt((x * x).sum(1)) for x in (queries, vectors))
    # The sums' error: components and segments are added up one after the other.
    slack = 0.5 + 8 * np.finfo(float).eps * (queries.shape[1] + 64) * own * other.max(initial=0)
    exact = own.max(initial=0) * other.max(initial=0) < 2.0**52
    whole = (queries, vectors) if exact else (queries.astype(np.int64), vectors.astype(np.int64))
    levels = [(statistics(queries, s), statistics(vectors, s)) for s in RESOLUTIONS]
    out: tuple[list, list, list] = ([], [], [])
    for begin in range(0, len(queries), 256):
        coarse = levels[0][0][begin : begin + 256] @ levels[0][1].T
        for i, bounds in enumerate(coarse, begin):
            bounds[ids == query_ids[i]] = -np.inf
            rest = np.flatnonzero(bounds > -np.inf)
            if len(rest) > k:
                seeds = np.argpartition(bounds, len(bounds) - k)[len(bounds) - k :]
                least = float((whole[1][seeds] @ whole[0][i]).min()) - slack[i]
                rest = np.flatnonzero(bounds >= least)
                for a, b in levels[1:]:
                    rest = rest[b[rest] @ a[i] >= least]
            scores = whole[1][rest] @ whole[0][i]
            top = blocks.best(ids[rest], scores, k)
            out[0].append(np.full(len(top), query_ids[i]))
            out[1].append(ids[rest][top])
            out[2].append(scores[top])
    return tuple(np.concatenate(x) for x in out)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * x) vectors, for each query.

    is_query is a condition on the column id. A score is a long: vectors so great that a product of two norms could pass
    2**62 are an error. Null vectors, those with null or non-finite components, empty ones and null ids take no part; a
    query's candidates are all rows of its dimension with another id. Zero vectors take part with score 0. Repeated rows
    are candidates each. Fewer than k candidates: all. Ties: the smaller id. An empty table gives an empty one; other
    columns are ignored.
    """
    usable = blocks.usable(vectors, id_col, vector_col, zero=True)
    # SQL's floor gives longs, which would saturate: a double without a fraction stays as it is.
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    rows = usable.withColumn("v", F.transform("v", lambda x: floor(x * float(scale))))
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if (most or 0.0) >= 2.0**62:
        raise OverflowError("inner products of these vectors may pass the range of a long")
    return blocks.search(rows, is_query, lambda: partial(search_block, k), k=k, block_bytes=block_bytes, score_type="long")
